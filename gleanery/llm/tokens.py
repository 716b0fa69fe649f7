"""Token counts by prefix dynamic programming.

A byte-pair encoding is decided by its neighbours: a sequence of tokens is the
encoding of its text exactly if each two adjacent tokens are the encoding of
theirs. So the last token of each prefix follows from those of shorter ones,
and one pass over a word gives the exact number of tokens of every prefix of
it. Texts are cut at ASCII white space, which no token crosses; prefix counts
of a piece are computed once and kept (up to ``CACHE`` pieces).

A text's prefix index is the change of the count at each character, one signed
byte each (more where a change is larger), deflated. From it follow the count
of any prefix and the longest prefix within a budget, without encoding anything
again.

Pieces that normalization changes in length (marks to be composed and the like)
are normalized by parts: a part begins with a character that never joins what
stands before it, so only a prefix that ends within a part can end unlike the
whole, and the dynamic program then goes on from the part's beginning with that
end. Special tokens' strings divide a piece; a prefix that ends within one holds
it as plain text. All other texts go word by word through one table, which is
filled for all new words of a batch together.

Edge cases: null or empty text has no bytes and no tokens; a null id is kept;
repeated rows get equal results; an empty table gives an empty result; extra
columns are left out.
"""

from __future__ import annotations

import bisect
import functools
import json
import re
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanery.llm import _bytes as B

CACHE = 400_000
#: A piece with the one white space character after it, or white space alone.
_PIECES = re.compile("[^\x09-\x0d ]+[\x09-\x0d ]?|[\x09-\x0d ]+")
#: Texts of other characters than these (up to U+024F, which normalization keeps,
#: less three whose lower case is longer) are counted piece by piece.
_OTHER = re.compile("[^\x00-\u012f\u0131-\u0239\u023b-\u023d\u023f-\u024f]")
_WHITE = "\t\n\x0b\x0c\r \x85\xa0"
_LETTER, _NUMBER = "a-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u024f", "0-9\xb2\xb3\xb9\xbc-\xbe"
_TOKENS = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTER}]+|[{_NUMBER}]|[{_WHITE}]+|[^{_WHITE}{_LETTER}{_NUMBER}]+")
_WORDS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\\sa-z0-9]+", re.ASCII)


def byte_letters() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in shown else chr(next(rest)) for b in range(256)]


class WordTable:
    """Token counts of every prefix of a word, by dynamic programming over prefixes."""

    def __init__(self, vocab: dict[str, int], merges: list, end: str):
        self.vocab, self.end = vocab, end
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in merges]
        self.rank = {p: i for i, p in enumerate(pairs)}
        self.longest = max((len(t.removesuffix(end)) for t in vocab), default=1)
        self.apart: dict[tuple[str, str], bool] = {}

    def symbols(self, token: str) -> list[str]:
        if self.end and token.endswith(self.end) and token != self.end:
            body = token[: -len(self.end)]
            return [*body[:-1], body[-1] + self.end]
        return list(token)

    def merge(self, parts: list[str]) -> list[str]:
        """Plain byte-pair merging: the pair of least rank, leftmost first."""
        while len(parts) > 1:
            best, at = min((self.rank.get(p, 1 << 60), i) for i, p in enumerate(zip(parts, parts[1:], strict=False)))
            if best == 1 << 60:
                break
            parts = [*parts[:at], parts[at] + parts[at + 1], *parts[at + 2 :]]
        return parts

    def adjacent(self, left: str, right: str) -> bool:
        key = (left, right)
        if (known := self.apart.get(key)) is None:
            if len(self.apart) > CACHE:
                self.apart.clear()
            known = self.apart[key] = self.merge([*self.symbols(left), *self.symbols(right)]) == [left, right]
        return known

    def counts(self, word: str) -> list[int]:
        """Tokens of word[:1], word[:2], ..., each as a word that ends there."""
        return self.grow(word, [""], [0])

    def grow(self, word: str, last: list[str], number: list[int]) -> list[int]:
        """Counts at the letters of ``word`` that ``last`` and ``number`` do not cover yet; both are extended.

        They hold the last token and the number of tokens of each prefix, as
        one that goes on. A word may be given from its middle on.
        """
        out = []
        vocab, end = self.vocab, self.end
        for i in range(len(last), len(word) + 1):
            ended, plain, n = 0, "", 0
            for j in range(max(0, i - self.longest), i):
                token = word[j:i]
                begins = not j and not last[0]
                if not plain and token in vocab and (begins or (last[j] and self.adjacent(last[j], token))):
                    plain, n = token, number[j] + 1
                token += end
                if not ended and token in vocab and (begins or (last[j] and self.adjacent(last[j], token))):
                    ended = number[j] + 1
            last.append(plain)
            number.append(n)
            out.append(ended)
        return out

    def count_on(self, word: str, last: list[str], number: list[int], more: str) -> int:
        """Tokens of ``word`` with ``more`` letters, from the states of the word's prefixes."""
        lo, known = max(0, len(word) - self.longest), len(word) + bool(more)
        return self.grow(word[lo:] + more, last[lo:known], number[lo:known])[-1]


@functools.cache
def joining() -> frozenset[str]:
    """Characters that normalization may join with, or move before, what stands before them."""
    marks = {chr(c) for c in range(0x300, 0x20000) if unicodedata.combining(chr(c))}
    pairs = (unicodedata.decomposition(chr(c)).split() for c in range(0xC0, 0x30000))
    seconds = {chr(int(p[1], 16)) for p in pairs if len(p) == 2 and p[0][0] != "<"}
    return frozenset(marks | seconds | {chr(c) for c in (*range(0x1161, 0x1176), *range(0x11A8, 0x11C3))})


class WordBatch:
    """``WordTable.counts`` for many words at once, with numpy.

    Tokens get numbers in the order in which merging makes them: bytes, bytes
    that end a word, then merges by rank. Whether two tokens stay apart is
    found by undoing merges at their border, latest first: a pair of pieces
    that meet there would have been merged if the vocabulary merges them
    earlier than the merge that was undone last (or as early, if that lies to
    the right, since equal merges go from left to right).
    """

    MAX = 64
    P = np.uint64(0x9E3779B97F4A7C15)

    def __init__(self, table: WordTable, letters: list[str]):
        end = table.end
        number = {c: k for k, c in enumerate(letters)} | {c + end: 256 + k for k, c in enumerate(letters)}
        left, right = list(range(512)), list(range(512))
        pairs = []
        for (a, b), rank in table.rank.items():
            if a in number and b in number and a + b not in number:
                number[a + b] = 512 + len(pairs)
                left.append(number[a])
                right.append(number[b])
                pairs.append(rank)
        self.sound = pairs == sorted(pairs) and len(pairs) == len(table.rank)
        self.left, self.right = np.array(left, np.int64), np.array(right, np.int64)
        made = np.arange(512, len(left))
        self.merged = _Lookup(((self.left[512:] << 20) | self.right[512:]).astype(np.uint64), made)
        byte_of = {c: k for k, c in enumerate(letters)}
        alone = np.ones(len(left), bool)
        alone[512:] = self.apart(self.left[512:], self.right[512:], made)
        tokens: tuple[list, list] = ([], [])
        self.longest = 1
        for text, k in number.items():
            if alone[k]:
                body = text.removesuffix(end) if end and text.endswith(end) and text != end else text
                raw = [byte_of[c] for c in body]
                self.longest = max(self.longest, len(raw))
                h = 0
                for b in raw:
                    h = (h * int(self.P) + b + 1) & (2**64 - 1)
                tokens[body is not text and body != text].append((h, k))
        self.tokens = [_Lookup(np.array([h for h, _ in t], np.uint64), np.array([k for _, k in t], np.int64)) for t in tokens]
        self.longest = min(self.longest, self.MAX)

    def apart(self, a: np.ndarray, b: np.ndarray, limit: np.ndarray | None = None) -> np.ndarray:
        """Whether tokens a and b stay two; ``limit`` at first: merges from this number on do not count."""
        out = np.ones(len(a), bool)
        rows = np.arange(len(a))
        limit = np.full(len(a), 1 << 40) if limit is None else limit
        while len(rows):
            m = self.merged.get(((a << 20) | b).astype(np.uint64))
            joined = (m >= 0) & (m < limit)
            out[rows[joined]] = False
            go = ~joined & ((a >= 512) | (b >= 512))
            rows, a, b, limit = rows[go], a[go], b[go], limit[go]
            undo = a > b
            limit = np.where(undo, a, b + 1)
            a, b = np.where(undo, self.right[a], a), np.where(undo, b, self.left[b])
        return out

    def steps(self, words: list[bytes]) -> np.ndarray:
        """A row for each word (1 to MAX bytes): the change at each byte of the count of tokens up to there, as a word that ends there."""
        order = sorted(range(len(words)), key=lambda k: -len(words[k]))
        sizes = np.array([len(words[k]) for k in order])
        longest = int(sizes[0])
        flat = np.frombuffer(b"".join(words[k].ljust(longest, b"\0") for k in order), np.uint8).reshape(len(words), longest)
        n = len(words)
        h = np.zeros((longest + 1, n), np.uint64)
        power = [np.uint64(1)]
        last = np.full((longest + 1, n), -1, np.int64)
        number = np.zeros((longest + 1, n), np.int16)
        ended = np.zeros((longest + 1, n), np.int16)
        with np.errstate(over="ignore"):
            for i in range(1, longest + 1):
                h[i] = h[i - 1] * self.P + flat[:, i - 1] + np.uint64(1)
                power.append(power[-1] * self.P)
            for i in range(1, longest + 1):
                m = int(np.searchsorted(-sizes, -i, "right"))
                for tokens, store in ((self.tokens[0], last), (self.tokens[1], None)):
                    todo = np.arange(m)
                    for k in range(1, min(i, self.longest) + 1):
                        j = i - k
                        token = tokens.get(h[i, todo] - h[j, todo] * power[k])
                        some = token >= 0 if j == 0 else (token >= 0) & (last[j, todo] >= 0)
                        at, token = todo[some], token[some]
                        if j:
                            ok = self.apart(last[j, at], token)
                            at, token = at[ok], token[ok]
                        if store is not None:
                            last[i, at], number[i, at] = token, number[j, at] + 1
                        else:
                            ended[i, at] = number[j, at] + 1
                        if len(at):
                            taken = np.zeros(m, bool)
                            taken[at] = True
                            todo = todo[~taken[todo]]
                        if not len(todo):
                            break
        steps = np.empty((n, longest), np.int8)
        steps[order] = np.diff(ended, axis=0).T
        return steps


class _Lookup:
    """Values by 64-bit key in an open hash table, for arrays of keys; -1 where there is none."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        bits = max(4, int(len(keys) * 4).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.values = np.zeros(1 << bits, np.uint64), np.full(1 << bits, -1, np.int64)
        self.steps = 1
        left = np.arange(len(keys))
        at = self._first(keys)
        step = 1
        while len(left):
            free = self.values[at[left]] < 0
            put = left[free]
            _, one = np.unique(at[put], return_index=True)
            put = put[one]
            self.keys[at[put]], self.values[at[put]] = keys[put], values[put]
            left = np.setdiff1d(left, put)
            at[left] = (at[left] + 1) & self.mask
            self.steps = max(self.steps, step)
            step += 1

    def _first(self, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((keys * np.uint64(0xBF58476D1CE4E5B9) ^ (keys >> np.uint64(29))) * np.uint64(0x94D049BB133111EB) >> self.shift).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        at = self._first(keys)
        value = self.values[at]
        out = np.where(self.keys[at] == keys, value, -1)
        open_ = np.flatnonzero((out < 0) & (value >= 0))
        while len(open_):
            at[open_] = (at[open_] + 1) & self.mask
            spot = at[open_]
            value = self.values[spot]
            hit = (value >= 0) & (self.keys[spot] == keys[open_])
            out[open_[hit]] = value[hit]
            open_ = open_[~hit & (value >= 0)]
        return out


class PrefixCounter:
    """Prefix counts of texts under a byte-level word-end BPE in a tokenizers file."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        self.table = WordTable(model["vocab"], model["merges"], model.get("end_of_word_suffix") or "")
        self.letters = byte_letters()
        self.byte_of = {c: b for b, c in enumerate(self.letters)}
        self.batch = WordBatch(self.table, self.letters)
        self.words: dict[str, list[int]] = {}
        self.pieces: dict[str, np.ndarray] = {}
        self.steps: dict[str, bytes] = {}
        self.normal: dict[str, str] = {}
        self.wide: set[str] = set()

    def learn(self, words: set[str]) -> None:
        """Fills ``steps``: the change of the count at each character of a word."""
        if len(self.steps) > CACHE:
            self.steps.clear()
        new = [w for w in words if w not in self.steps]
        short, rest = [], []
        for w in new:
            if w[0] in _WHITE:
                self.steps[w] = bytes(len(w))
            elif len(w) <= WordBatch.MAX // 4 and self.batch.sound and (w[0] != "'" or len(w) == 1 or not w[1].isalpha()):
                short.append(w)
            else:
                rest.append(w)
        for lo in range(0, len(short), 1 << 16):
            part = short[lo : lo + (1 << 16)]
            raw = [w.encode() for w in part]
            found = self.batch.steps(raw)
            flat, width = found.tobytes(), found.shape[1]
            for k, (w, r) in enumerate(zip(part, raw, strict=True)):
                own = flat[k * width : k * width + len(r)]
                self.steps[w] = own if len(r) == len(w) else _by_character(own, r)
        for w in rest:
            raw = w.encode()
            counts = self.table.counts("".join(self.letters[b] for b in raw))
            counts = [c for k, c in enumerate(counts) if k + 1 == len(raw) or raw[k + 1] & 0xC0 != 0x80]
            if w[0] == "'" and len(w) > 1 and w[1].isalpha():
                counts = self._contraction(w, counts)
            change = np.diff(counts, prepend=0)
            if np.abs(change).max() > 127:
                self.wide.add(w)
            self.steps[w] = change.astype(np.int8).tobytes()

    def _contraction(self, word: str, own: list[int]) -> list[int]:
        """'re and the like: a prefix of one is a mark, and a letter."""
        first = self.word("'")[0]
        return [first, own[1]] if len(word) == 2 else [first, first + self.word(word[1])[0], own[2]]

    def indexes(self, texts: list[str]) -> list[tuple[bytes, int]]:
        """The prefix index and the number of tokens of each text; words new to all of them are counted together."""
        found = [None if _OTHER.search(t) or any(x in t for x in self.special) else _TOKENS.findall(t.lower()) for t in texts]
        self.learn(set().union(*[f for f in found if f]))
        if self.wide:  # changes over a byte: such texts go piece by piece
            found = [None if f is None or not self.wide.isdisjoint(f) else f for f in found]
        out = []
        for text, words in zip(texts, found, strict=True):
            if words is not None:
                steps = b"".join(map(self.steps.__getitem__, words))
                out.append((_packed(steps), int(np.frombuffer(steps, np.int8).sum(dtype=np.int64))))
            else:
                wide = np.concatenate([np.zeros(0, np.int32), *map(self.changes, _PIECES.findall(text))])
                out.append((_packed(wide), int(wide.sum(dtype=np.int64))))
        return out

    def word(self, letters: str) -> list[int]:
        """Counts of one word in byte letters, for texts that go piece by piece."""
        if (known := self.words.get(letters)) is None:
            known = self.table.counts(letters)
            if len(letters) <= 64:
                if len(self.words) > CACHE:
                    self.words.clear()
                self.words[letters] = known
        return known

    def changes(self, piece: str) -> np.ndarray:
        """The change of the count at each character of a piece, white space included."""
        if (known := self.pieces.get(piece)) is None:
            body = piece.rstrip("\t\n\x0b\f\r ")
            counts = None
            if not any(t in body for t in self.special):
                counts = self._ascii(body) if body.isascii() else self._other(body)
            if counts is None:
                counts = self._any(body)
            known = np.zeros(len(piece), np.int32)
            known[: len(body)] = np.diff(np.array([0, *counts], np.int64))
            if len(piece) <= 64:
                if len(self.pieces) > CACHE:
                    self.pieces.clear()
                self.pieces[piece] = known
        return known

    def _ascii(self, body: str) -> list[int] | None:
        out: list[int] = []
        before = 0
        for m in _WORDS.finditer(body.lower()):
            word = m[0]
            own = self.word(word)
            if word[0] == "'" and len(word) > 1 and word[1].isalpha():
                own = self._contraction(word, own)
            out += [before + c for c in own]
            before += own[-1]
        return out if len(out) == len(body) else None

    def _other(self, body: str) -> list[int] | None:
        if unicodedata.normalize("NFC", body) != body:
            return None
        plain = self.library.normalizer.normalize_str(body)
        if len(plain) != len(body) or "'" in plain or any(c.isspace() for c in plain):
            return None
        out: list[int] = []
        before = 0
        for letters, _ in self.library.pre_tokenizer.pre_tokenize_str(plain):
            own = self.word(letters)
            raw = bytes(map(self.byte_of.__getitem__, letters))
            ends = [k for k in range(1, len(raw) + 1) if k == len(raw) or raw[k] & 0xC0 != 0x80]
            out += [before + own[k - 1] for k in ends]
            before += own[-1]
        return out if len(out) == len(body) else None

    def _any(self, body: str) -> list[int]:
        """Counts of every prefix of a piece, whatever it holds."""
        out: list[int] = []
        start = before = 0
        while True:
            at, less = min(((body.index(t, start), -len(t)) for t in self.special if t in body[start:]), default=(len(body) + 1, 0))
            own = self._plain(body[start : at - less - 1])  # up to the last character of the special string, plain text
            out += [before + c for c in own]
            if at > len(body):
                return out
            before += 1 + (own[at - start - 1] if at > start else 0)
            out.append(before)
            start = at - less

    def _normal(self, part: str) -> str:
        if (known := self.normal.get(part)) is None:
            known = self.library.normalizer.normalize_str(part)
            if len(part) <= 8:
                if len(self.normal) > CACHE:
                    self.normal.clear()
                self.normal[part] = known
        return known

    def _plain(self, text: str) -> list[int]:
        """Counts of every prefix of a text without special strings, part by part."""
        if not text:
            return []
        starts = [k for k, c in enumerate(text) if not k or (c not in joining() and unicodedata.category(c) != "Cn")]
        parts = [self._normal(text[a:b]) for a, b in zip(starts, [*starts[1:], len(text)], strict=True)]
        whole = _Counted(self, "".join(parts))
        out: list[int] = []
        done = 0
        for a, b, part in zip(starts, [*starts[1:], len(text)], parts, strict=True):
            for k in range(a + 1, b + 1):
                out.append(whole.up_to(done, part if k == b else self._normal(text[a:k])))
            done += len(part)
        return out

    def index(self, text: str) -> tuple[bytes, int]:
        return self.indexes([text])[0]


class _Counted:
    """A normalized text, its tokens' counts at every character, and the states to go on from."""

    def __init__(self, of: PrefixCounter, text: str):
        self.of, self.text = of, text
        self.counts, self.starts, self.states = [0], [], []
        for letters, (s, e) in of.library.pre_tokenizer.pre_tokenize_str(text):
            before = self.counts[-1]
            self.counts += [before] * (s + 1 - len(self.counts))
            last, number = [""], [0]
            own = of.table.grow(letters, last, number)
            ends = np.cumsum([len(c.encode()) for c in text[s:e]]).tolist()
            own = [own[k - 1] for k in ends]
            if text[s] == "'" and e - s > 1 and text[s + 1].isalpha():
                own = of._contraction(text[s:e], own)
            self.counts += [before + c for c in own]
            self.starts.append(s)
            self.states.append((letters, last, number))
        self.counts += [self.counts[-1]] * (len(text) + 1 - len(self.counts))

    def up_to(self, n: int, end: str) -> int:
        """Tokens of text[:n] with ``end`` after it."""
        if self.text.startswith(end, n):
            return self.counts[n + len(end)]
        k = bisect.bisect_right(self.starts, n - 1) - 1
        split = self.of.library.pre_tokenizer.pre_tokenize_str
        if k >= 0 and n - self.starts[k] > 8 and split(self.text[n - 2 : n])[0][1] == (0, 2):
            # a long run of letters or of signs: what goes on with it, then the rest
            run = "a" if split("a" + self.text[n - 1])[0][1] == (0, 2) else "!"
            (head, _), *rest = split(run + end)
            letters, last, number = self.states[k]
            done = len(self.text[self.starts[k] : n].encode())
            total = self.counts[self.starts[k]] + self.of.table.count_on(letters[:done], last, number, head[1:])
        else:
            if k > 0 and self.text[self.starts[k - 1] : self.starts[k]] == "'":
                k -= 1  # with a letter it may become one token
            at = self.starts[k] if k >= 0 else 0
            total, rest = self.counts[at], split(self.text[at:n] + end)
        return total + sum(self.of.table.counts(letters)[-1] for letters, _ in rest)


def _by_character(steps: bytes, raw: bytes) -> bytes:
    """Changes at the bytes of a word, summed up by character."""
    out, total = bytearray(), 0
    for k, d in enumerate(steps):
        total += d
        if k + 1 == len(raw) or raw[k + 1] & 0xC0 != 0x80:
            out.append(total & 255)
            total = 0
    return bytes(out)


def _packed(steps: bytes | np.ndarray) -> bytes:
    """Changes in as few bytes each as they need, of which the first byte tells the number."""
    if not isinstance(steps, bytes):
        kind = next(t for t in (np.int8, np.int16, np.int32) if not len(steps) or np.iinfo(t).min <= steps.min() <= steps.max() <= np.iinfo(t).max)
        return zlib.compress(bytes([np.dtype(kind).itemsize]) + steps.astype(kind).tobytes(), 1)
    return zlib.compress(b"\x01" + steps, 1)


def prefix_counts(index: bytes) -> np.ndarray:
    """Tokens of the first 1, 2, ... characters."""
    raw = zlib.decompress(index)
    return np.cumsum(np.frombuffer(raw, f"i{raw[0]}", offset=1), dtype=np.int64)


def tokens_at(index: bytes, chars: int) -> int:
    counts = prefix_counts(index)
    return int(counts[min(chars, len(counts)) - 1]) if chars > 0 and len(counts) else 0


def longest_prefix(index: bytes, budget: int) -> int:
    """Characters of the longest prefix of at most ``budget`` tokens."""
    fits = np.flatnonzero(prefix_counts(index) <= budget)
    return int(fits[-1]) + 1 if len(fits) else 0


def tokens_in_prefix(index: Column, chars: Column) -> Column:
    return F.pandas_udf(lambda x, k: pd.Series([tokens_at(a, b) for a, b in zip(x, k, strict=True)]), "long")(index, chars)


def chars_within(index: Column, budget: int) -> Column:
    return F.pandas_udf(lambda x: pd.Series([longest_prefix(a, budget) for a in x], dtype="int64"), "long")(index)


_counters: dict[str, PrefixCounter] = {}


def counter(path: str) -> PrefixCounter:
    if path not in _counters:
        _counters[path] = PrefixCounter(path)
    return _counters[path]


def prefix_index(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", budget: int = 2048) -> DataFrame:
    """doc_id, n_bytes, n_tokens, budget_chars (longest prefix within the budget), prefix_index of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(tokenizer_path)
        for whole in batches:
            for batch in B.pieces(whole, "text", B.CHUNK):
                texts = [t or "" for t in batch.column("text").to_pylist()]
                indexes, numbers = zip(*own.indexes(texts), strict=True)
                within = [len(t) if n <= budget else longest_prefix(x, budget) for t, x, n in zip(texts, indexes, numbers, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), pa.array(numbers, pa.int64()), pa.array(within, pa.int64()), pa.array(indexes, pa.binary())], ["doc_id", "n_bytes", "n_tokens", "budget_chars", "prefix_index"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, budget_chars long, prefix_index binary")
