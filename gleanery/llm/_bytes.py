"""Words of many texts at once, on their UTF-8 bytes with numpy.

The contracts' word classes only tell ASCII characters apart, and all other
characters are word characters, so bytes decide: no text is decoded. Words are
known by a 64-bit hash (polynomial over the bytes, then mixed).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
#: Bytes looked at together, which bounds temporary arrays (some 60 bytes each).
CHUNK = 1 << 19
P = U(0x9E3779B97F4A7C15)
P_INV = U(pow(0x9E3779B97F4A7C15, -1, 2**64))


def _table(separators: bytes) -> np.ndarray:
    out = np.ones(256, bool)
    out[list(separators)] = False
    return out


SPACE = bytes([0x20, *range(0x09, 0x0E)])
NOT_ALNUM = bytes([*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)])
#: True for bytes of words: of any but white space; of letters, digits and non-ASCII (after lowering).
BY_SPACE, BY_ALNUM = _table(SPACE), _table(NOT_ALNUM)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_powers: list[np.ndarray] = []


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0 to n of P and of its inverse; only tables for a chunk are kept."""
    if n <= CHUNK and _powers:
        return _powers[0], _powers[1]
    with np.errstate(over="ignore"):
        made = [np.concatenate([np.ones(1, U), np.cumprod(np.full(max(n, CHUNK), x, U))]) for x in (P, P_INV)]
    if n <= CHUNK:
        _powers[:] = made
    return made[0], made[1]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def buffer(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes and where each text begins (one more entry than texts); null is empty."""
    texts = texts.fill_null("").cast(pa.large_string())
    _, at, data = texts.buffers()
    at = np.frombuffer(at, np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and len(at) > 1 else np.zeros(0, np.uint8)
    return data, at - at[0]


def pieces(batch: pa.RecordBatch, column: str, limit: int = CHUNK) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about ``limit`` bytes of text each, one row at least."""
    lengths = np.diff(buffer(batch.column(column))[1])
    start, held = 0, 0
    for i, n in enumerate(lengths):
        if held and held + n > limit:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += int(n)
    if start < batch.num_rows:
        yield batch.slice(start)


def tokens(data: np.ndarray, at: np.ndarray, table: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """starts, ends and hashes of all words; first: where each text's words begin, one more entry than texts.

    A chunk is looked at at a time; words that chunk edges cut are put together after.
    """
    starts, ends, sums = [], [], []
    for lo in range(0, len(data), CHUNK):
        hi = min(len(data), lo + CHUNK)
        part = LOWER[data[lo:hi]] if lower else data[lo:hi]
        s, e = _runs(part, table, at, lo, hi)
        power, inverse = _power(hi - lo)
        with np.errstate(over="ignore"):
            total = np.empty(hi - lo + 1, U)
            total[0] = 0
            np.cumsum((part.astype(U) + U(1)) * power[: hi - lo], out=total[1:])
            sums.append((total[e] - total[s]) * inverse[s])
        starts.append(s + lo)
        ends.append(e + lo)
    if not starts:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(0, U), np.zeros(len(at), np.int64)
    s, e, h = np.concatenate(starts), np.concatenate(ends), np.concatenate(sums)
    edges = np.arange(CHUNK, len(data), CHUNK)
    word = table[LOWER] if lower else table
    cut = np.searchsorted(s, edges[word[data[edges]] & word[data[edges - 1]] & ~np.isin(edges, at)])
    for k in cut[::-1].tolist():
        h[k - 1] = (int(h[k - 1]) + int(h[k]) * pow(int(P), int(e[k - 1] - s[k - 1]), 1 << 64)) % (1 << 64)
        e[k - 1] = e[k]
    if len(cut):
        s, e, h = (np.delete(x, cut) for x in (s, e, h))
    with np.errstate(over="ignore"):
        h = mix(h + (e - s).astype(U))
    return s, e, h, np.searchsorted(s, at)


def _runs(part: np.ndarray, table: np.ndarray, at: np.ndarray, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
    word = table[part]
    before = np.empty(len(word), bool)
    before[0] = False
    before[1:] = word[:-1]
    after = np.empty(len(word), bool)
    after[-1] = False
    after[:-1] = word[1:]
    edges = at[np.searchsorted(at, lo) : np.searchsorted(at, hi)] - lo
    before[edges] = False
    after[edges[edges > 0] - 1] = False
    return np.flatnonzero(word & ~before), np.flatnonzero(word & ~after) + 1


def grams(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of n neighbouring word hashes (len(h) - n + 1 of them)."""
    if len(h) < n:
        return np.zeros(0, U)
    with np.errstate(over="ignore"):
        out = np.full(len(h) - n + 1, n, U)
        for i in range(n):
            out = out * P + h[i : len(h) - n + 1 + i]
    return mix(out)


def strings(values: list[str]) -> pa.Array:
    return pa.array(values, pa.string())


def binaries(data: np.ndarray, at: np.ndarray) -> pa.Array:
    """A binary array: row i holds data[at[i]:at[i + 1]] as little-endian bytes."""
    raw = np.ascontiguousarray(data)
    return pa.Array.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer((at * raw.itemsize).astype(np.int64).tobytes()), pa.py_buffer(raw.tobytes())]).cast(pa.binary())


def ids(batch: pa.RecordBatch, column: str) -> np.ndarray:
    return np.asarray(batch.column(column).cast(pa.int64()))
