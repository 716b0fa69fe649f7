"""Benchmark decontamination with a distributed positional inverted index.

The training texts are cut into segments of about ``SEGMENT_WORDS`` words. A
segment's index holds, for each term, the positions in the segment where it
stands; documents lie one position apart so that no phrase crosses two.
Segments are rows of a table in the shared folder, built once and searched by
any number of benchmarks.

A search takes the windows of the test items (``WINDOW`` consecutive words; a
shorter item is one window) to every segment. A window whose terms are not all
there ends at once. For the rest the postings of the rarest term in the
segment, moved by the term's offset in the window, are intersected with those
of the next rarest, until none or all terms are used up; all windows of a block
take each step together. With ``slop`` it also returns proximity matches: all terms
of a window, in any order, within ``slop`` words more than it has.

Terms are known by 128 bits of two unrelated hashes. Nothing is shuffled by
term, so a frequent word or a passage that a third of all documents hold is no
hot key. Items are cut into parts that share ``WINDOW - 1`` words, and searched
in blocks of ``BLOCK_WORDS`` words on average, 16 bytes a word, one scan of the
index for each block; a search of several blocks is joined by document.

Edge cases: null text has no words; null items and items without words have
no windows; an item with a null id counts, as the empty string; items may
repeat; repeated rows each get a result; empty tables give empty or clean
results; extra columns are left out. A segment holds at least one document, so
memory is some 40 bytes for each word of the longest one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanery.llm import _bytes as B
from gleanery.llm._shared import KEYS, NULL_ID, cut, row_keys, scratch, without

WINDOW, SEGMENT_WORDS, BLOCK_WORDS = 10, 1 << 18, 1 << 21
#: Words of a part of an item, and pairs of a window and a place looked at together.
PART_WORDS, PAIRS = 1 << 16, 1 << 20
INDEX = "ids binary, row_keys binary, firsts binary, terms binary, checks binary, begins binary, positions binary"
FOUND = "id long, row long, n_words long, hits array<int>, items array<string>, near array<string>"


def _cells(values: list[np.ndarray]) -> list[pa.Array]:
    """Columns of one row, each with the bytes of an array."""
    at = lambda v: pa.py_buffer(np.array([0, v.nbytes], np.int32))
    return [pa.Array.from_buffers(pa.binary(), 1, [None, at(v), pa.py_buffer(np.ascontiguousarray(v))]) for v in values]


def checks_of(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A second hash of each of some words."""
    raw = B.LOWER[data].tobytes() if len(starts) else b""
    return np.array([xxhash.xxh3_64_intdigest(raw[a:b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)], np.uint64)


def _flush(held: list[tuple]) -> pa.RecordBatch:
    join = lambda k: np.concatenate([h[k] for h in held])
    ids, rows, counts, hashes, own, checks = (join(k) for k in range(6))
    held.clear()
    firsts = np.concatenate([[0], np.cumsum(counts + 1)]).astype(np.int32)  # one position free after each document
    order = np.argsort(hashes, kind="stable").astype(np.int32)
    hashes = hashes[order]
    begins = np.flatnonzero(np.concatenate([[True], hashes[1:] != hashes[:-1]])) if len(hashes) else np.zeros(0, np.int64)
    terms = hashes[begins]
    known, first = np.unique(own, return_index=True)
    begins = np.append(begins, len(hashes)).astype(np.int32)
    places = order + (np.searchsorted(firsts[:-1] - np.arange(len(counts)), order, "right") - 1).astype(np.int32)
    return pa.RecordBatch.from_arrays(_cells([ids, rows, firsts, terms, checks[first][np.searchsorted(known, terms)], begins, places]), ["ids", "row_keys", "firsts", "terms", "checks", "begins", "positions"])


def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    size = 0
    for whole in batches:
        for batch in B.pieces(whole, "text"):
            data, at = B.buffer(batch.column("text"))
            starts, ends, h, first = B.tokens(data, at, B.BY_ALNUM)
            own, place = np.unique(h, return_index=True)
            held.append((B.ids(batch, "id"), B.ids(batch, "row"), np.diff(first), h, own, checks_of(data, starts[place], ends[place])))
            size += len(h) + batch.num_rows
            if size >= SEGMENT_WORDS:
                yield _flush(held)
                size = 0
    if held:
        yield _flush(held)


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The index of all of ``docs``, stored; one row a segment."""
    rows = docs.select(*[c.alias(k.removeprefix("__gl_")) for k, c in row_keys(id_col, text_col).items()], F.col(text_col).alias("text"))
    return cut(rows.mapInArrow(_index, INDEX), "index", **{"parquet.block.size": str(16 << 20), "compression": "zstd"})


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The words of each item, in parts: two hashes each."""
    for whole in batches:
        for batch in B.pieces(whole, "text"):
            data, at = B.buffer(batch.column("text"))
            starts, ends, h, first = B.tokens(data, at, B.BY_ALNUM)
            own, place, back = np.unique(h, return_index=True, return_inverse=True)
            checks = checks_of(data, starts[place], ends[place])[back]
            cuts = [(k, s, min(b, s + PART_WORDS + WINDOW - 1)) for k, (a, b) in enumerate(zip(first[:-1].tolist(), first[1:].tolist(), strict=True)) for s in range(a, max(b - WINDOW + 1, a + 1), PART_WORDS) if b > a]
            cell = lambda v: pa.array([v[a:b].tobytes() for _, a, b in cuts], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("item").take(pa.array([k for k, _, _ in cuts], pa.int64())), pa.array([b - a for _, a, b in cuts], pa.int64()), cell(h), cell(checks)], ["item", "n", "h", "checks"])


class Windows:
    """The windows of a block of items."""

    def __init__(self, parts: list):
        self.names = sorted({p["item"] for p in parts})
        number = {n: k for k, n in enumerate(self.names)}
        self.h = np.concatenate([np.zeros(0, np.uint64), *[np.frombuffer(p["h"], np.uint64) for p in parts]])
        self.checks = np.concatenate([np.zeros(0, np.uint64), *[np.frombuffer(p["checks"], np.uint64) for p in parts]])
        by: dict[int, list[np.ndarray]] = {}
        at = 0
        for p in parts:
            n = min(p["n"], WINDOW)
            by.setdefault(n, []).append(np.stack([np.arange(at, at + p["n"] - n + 1), np.full(p["n"] - n + 1, number[p["item"]])]).astype(np.int32))
            at += p["n"]
        #: By length: where windows begin in h, and the item of each.
        self.by = {n: np.concatenate(v, axis=1) for n, v in sorted(by.items())}


class Segment:
    """One row of the index."""

    def __init__(self, batch: pa.RecordBatch, row: int):
        get = lambda name, kind: np.frombuffer(batch.column(name)[row].as_buffer(), kind)
        self.ids, self.keys, self.firsts = get("ids", np.int64), get("row_keys", np.int64), get("firsts", np.int32)
        self.terms, self.checks, self.begins, self.positions = get("terms", np.uint64), get("checks", np.uint64), get("begins", np.int32), get("positions", np.int32)
        self.sizes = np.diff(self.begins)
        self.size = int(self.firsts[-1]) + WINDOW
        #: The term at each position; none between documents and after the last.
        self.at = np.full(self.size, -1, np.int32)
        self.at[self.positions] = np.repeat(np.arange(len(self.terms), dtype=np.int32), self.sizes)

    def known(self, h: np.ndarray, checks: np.ndarray) -> np.ndarray:
        """The term of each word, or -1."""
        if not len(self.terms):
            return np.full(len(h), -1, np.int32)
        at = np.minimum(np.searchsorted(self.terms, h), len(self.terms) - 1).astype(np.int32)
        at[(self.terms[at] != h) | (self.checks[at] != checks)] = -1
        return at

    def candidates(self, windows: np.ndarray, most: int = PAIRS) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """For some of the windows (rows of terms) at a time: window, place of its rarest term, and its terms from rare to frequent."""
        order = np.argsort(self.sizes[windows], axis=1, kind="stable")
        rarest = windows[np.arange(len(windows)), order[:, 0]]
        count = self.sizes[rarest].astype(np.int64)
        ends = np.cumsum(count)
        a = 0
        while a < len(windows):
            b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + most, "right")))
            q = np.repeat(np.arange(a, b), count[a:b])
            inside = np.arange(len(q)) - np.repeat(np.cumsum(count[a:b]) - count[a:b], count[a:b])
            yield q, self.positions[self.begins[rarest[q]] + inside], order
            a = b

    def phrases(self, windows: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Windows and where they begin, by intersecting moved postings from the rarest term on."""
        n = windows.shape[1]
        for q, place, order in self.candidates(windows):
            start = place - order[q, 0]
            q, start = q[ok := start >= 0], start[ok]
            for k in range(1, n):
                off = order[q, k]
                ok = self.at[start + off] == windows[q, off]
                q, start = q[ok], start[ok]
            yield q, start

    def near(self, windows: np.ndarray, span: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Windows and places of their rarest terms that lie with all other terms within ``span`` words of one document."""
        n = windows.shape[1]
        padded = np.concatenate([np.full(span, -1, np.int32), self.at, np.full(span, -1, np.int32)])
        around = np.arange(1 - span, span)
        for q, place, order in self.candidates(windows, PAIRS // (2 * span)):
            cells = padded[(place + span)[:, None] + around]
            for k in range(1, n):
                ok = (cells == windows[q, order[q, k]][:, None]).any(axis=1)
                q, place, cells = q[ok], place[ok], cells[ok]
            doc = np.searchsorted(self.firsts, place, "right") - 1
            at = place[:, None] + around
            cells[(at < self.firsts[doc][:, None]) | (at >= self.firsts[doc + 1][:, None])] = -1
            whole = np.ones((len(q), span), bool)  # by where the span begins: all terms are in it
            for k in range(n):
                seen = np.concatenate([np.zeros((len(q), 1), np.int64), np.cumsum(cells == windows[q, k][:, None], axis=1)], axis=1)
                whole &= seen[:, span:] > seen[:, :span]
            ok = whole.any(axis=1)
            yield q[ok], place[ok]

    def documents(self, pairs: list[np.ndarray], names: list[str]) -> pa.Array:
        """The items of each document, from pairs (place, item)."""
        both = np.concatenate([np.zeros((2, 0), np.int64), *pairs], axis=1)
        doc = np.searchsorted(self.firsts, both[0], "right") - 1
        doc, item = np.divmod(np.unique(doc * max(1, len(names)) + both[1]), max(1, len(names)))
        at = np.searchsorted(doc, np.arange(len(self.ids) + 1)).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(at), pa.array([names[i] for i in item.tolist()], pa.string()))  # names are in order

    def result(self, block: Windows, slop: int) -> pa.RecordBatch:
        word = self.known(block.h, block.checks)
        missing = np.concatenate([[0], np.cumsum(word < 0)])
        hit = np.zeros(self.size + WINDOW, np.int32)
        exact, near = [], []
        for n, (starts, items) in block.by.items():
            ok = missing[starts + n] == missing[starts]
            windows, owner = word[starts[ok][:, None] + np.arange(n)], items[ok]
            for q, start in self.phrases(windows):
                np.add.at(hit, start, 1)
                np.add.at(hit, start + n, -1)
                exact.append(np.stack([start, owner[q]]).astype(np.int64))
            if slop:
                near += [np.stack([place, owner[q]]).astype(np.int64) for q, place in self.near(windows, n + slop)]
        flags = np.flatnonzero(np.cumsum(hit) > 0)
        doc = np.searchsorted(self.firsts, flags, "right") - 1
        hits = pa.ListArray.from_arrays(pa.array(np.searchsorted(doc, np.arange(len(self.ids) + 1)).astype(np.int32)), pa.array((flags - self.firsts[doc]).astype(np.int32)))
        return pa.RecordBatch.from_arrays([pa.array(self.ids), pa.array(self.keys), pa.array(np.diff(self.firsts).astype(np.int64) - 1), hits, self.documents(exact, block.names), self.documents(near, block.names)], ["id", "row", "n_words", "hits", "items", "near"])


def search(index: DataFrame, benchmark: DataFrame, item_col: str = "item_id", text_col: str = "text", slop: int = 0, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Per document: id, row, n_words, hits (word numbers), items (exact), near (proximity).

    Parts of items are dealt to blocks by a hash.
    """
    spark = index.sparkSession
    asked = benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("item"), F.col(text_col).cast("string").alias("text"))
    asked = cut(asked.mapInArrow(_parts, "item string, n long, h binary, checks binary"), "items")
    blocks = max(1, -(-(asked.agg(F.sum("n")).first()[0] or 0) // block_words))
    out = None
    for k in range(blocks):
        data = spark.sparkContext.broadcast(asked.where(F.pmod(F.xxhash64("item", "h"), F.lit(blocks)) == k).collect())  # 16 bytes a word of a block

        def run(batches: Iterator[pa.RecordBatch], data=data) -> Iterator[pa.RecordBatch]:
            windows = Windows(data.value)
            for batch in batches:
                for row in range(batch.num_rows):
                    yield Segment(batch, row).result(windows, slop)

        part = index.mapInArrow(run, FOUND).withColumn("block", F.lit(k))
        out = part if out is None else out.unionByName(part)
    return out.drop("block") if blocks == 1 else _merge(out)


def _merge(parts: DataFrame) -> DataFrame:
    """One row a document again, of as many as there are blocks; rows that repeat a text and an id repeat here too."""
    each = parts.groupBy("id", "row", "block").agg(*[F.first(c).alias(c) for c in ("n_words", "hits", "items", "near")], F.count(F.lit(1)).cast("int").alias("copies"))
    both = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c)
    one = each.groupBy("id", "row").agg(F.max("n_words").alias("n_words"), both("hits"), both("items"), both("near"), F.max("copies").alias("copies"))
    return one.withColumn("copies", F.explode(F.sequence(F.lit(1), "copies"))).drop("copies")


def match(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", slop: int = 0) -> DataFrame:
    """doc_id, row keys, n_words, n_hit, hits, items, near of every document of ``docs``."""
    found = search(build_index(docs, id_col, text_col), benchmark, slop=slop)
    return found.select(
        F.when(F.col("id") != NULL_ID, F.col("id")).alias("doc_id"), F.col("id").alias("__gl_id"), F.col("row").alias("__gl_row"), "n_words",
        F.size("hits").cast("long").alias("n_hit"), "hits", "items", "near",
    )


def keep_clean(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` without a hit."""
    with scratch() as keep:  # the index goes once the leaks stand
        leaks = keep(cut(match(docs, benchmark, id_col, text_col).where("n_hit > 0").select(*KEYS), "leaks"))
    return without(docs, leaks, id_col, text_col)
