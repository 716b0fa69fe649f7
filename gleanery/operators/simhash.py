"""Near duplicates by SimHash: fingerprints, bands, pairs, clusters."""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator
from hashlib import md5

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleanery.operators.components import connected_components, ensure_checkpoint_dir

MIN_CHARS, SHINGLE = 50, 3
WORD = "[\\p{L}\\p{N}_]+"
#: A block's rows; the tiles that two blocks are compared in; pairs in a batch that is returned; blocks, if there are so many rows for each, at least.
BLOCK_ROWS, TILE, BATCH, LEAST_BLOCKS, LEAST_ROWS = 131_072, (64, 4096), 1 << 17, 8, 1000


def shingles(corpus: DataFrame, distinct: bool = False) -> DataFrame:
    """id, shingle: runs of three words of lowered texts of 50 characters or more; fewer words stand alone.

    The generator's input has no lambda and is not filtered afterwards by
    anything that would be pushed below it (inline_outer), so that words are
    extracted once.
    """
    w = F.col("w")
    rows = corpus.where(F.length("text") >= MIN_CHARS).select("id", F.regexp_extract_all(F.lower("text"), F.lit(WORD), F.lit(0)).alias("w"))
    # two columns that need the words keep the optimizer from inlining them
    rows = rows.select("id", F.size(w).alias("n"), F.arrays_zip(w.alias("a"), F.slice(w, F.lit(2), F.greatest(F.size(w), F.lit(1))).alias("b"), F.slice(w, F.lit(3), F.greatest(F.size(w), F.lit(1))).alias("c")).alias("z"))
    rows = rows.select("id", "n", F.inline_outer("z").alias("a", "b", "c"))
    rows = rows.where(F.col("a").isNotNull() & (F.col("c").isNotNull() | (F.col("n") < SHINGLE)))
    out = rows.select("id", F.when(F.col("n") < SHINGLE, F.col("a")).otherwise(F.concat_ws(" ", "a", "b", "c")).alias("shingle"))
    return out.distinct() if distinct else out


def words(corpus: DataFrame) -> DataFrame:
    """id, words: those of lowered texts of 50 characters or more, with a space between them."""
    return corpus.where(F.length("text") >= MIN_CHARS).select("id", F.array_join(F.regexp_extract_all(F.lower("text"), F.lit(WORD), F.lit(0)), " ").alias("words"))


def _runs(text: pa.Scalar) -> list[bytes]:
    """The shingles of words, as ``shingles`` has them."""
    raw = text.as_buffer().to_pybytes()
    gaps = np.flatnonzero(np.frombuffer(raw, np.uint8) == 32)
    whole = len(gaps) + 1 < SHINGLE  # fewer words stand alone
    starts = [0, *((gaps if whole else gaps[: len(gaps) - SHINGLE + 1]) + 1).tolist()]
    ends = [*(gaps if whole else gaps[SHINGLE - 1 :]).tolist(), len(raw)]
    return [raw[s:e] for s, e in zip(starts, ends, strict=True)] if raw else []


def digests(text: pa.Scalar, width: int = 16) -> np.ndarray:
    """The first ``width`` bytes of the md5 of each shingle of words, a row each; none for texts without words.

    One text at a time, on the executor: a batch holds texts and no digests.
    """
    each = [md5(run).digest() for run in _runs(text)]
    return np.ascontiguousarray(np.frombuffer(b"".join(each), np.uint8).reshape(-1, 16)[:, :width])


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (id, words) with words: how many shingles, how many different ones, and the first by code point."""
    for batch in batches:
        batch = batch.filter(pc.greater(pc.binary_length(batch.column("words")), 0))
        found = []
        for text in batch.column("words"):
            each = _runs(text)
            found.append((len(each), len(set(each)), min(each).decode()))
        n, distinct, first = zip(*found, strict=True) if found else ((), (), ())
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(n, pa.int64()), pa.array(distinct, pa.int64()), pa.array(first, pa.string())], ["id", "n", "n_distinct", "first"])


def shingle_counts(corpus: DataFrame) -> DataFrame:
    """id, n, n_distinct, first of the shingles of each id that has any.

    They are counted where the text is; only the shingles of texts that share
    an id are shuffled.
    """
    long_ = corpus.where(F.length("text") >= MIN_CHARS)
    shared = long_.groupBy("id").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select(F.col("id").alias("shared"))
    rows = words(corpus)
    out = rows.mapInArrow(_counted, f"id {rows.schema['id'].dataType.simpleString()}, n long, n_distinct long, first string")
    if shared.isEmpty():
        return out
    on = F.col("id").eqNullSafe(F.col("shared"))
    several = shingles(long_.join(shared, on, "left_semi")).groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("shingle").alias("n_distinct"), F.min("shingle").alias("first"))
    return out.join(shared, on, "left_anti").unionByName(several)


def _prints(bits: int):
    """Fingerprints of rows (id, words): bit k is set where more shingles have it than not."""
    weights = np.uint64(1) << np.arange(63, -1, -1, dtype=np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.zeros((batch.num_rows, 2), np.uint64)
            for k, value in enumerate(batch.column("words")):
                raw = digests(value, bits // 8)
                for part in range(bits // 64):
                    ones = sum(np.unpackbits(raw[at : at + 65536, 8 * part : 8 * part + 8], axis=1).sum(axis=0, dtype=np.int64) for at in range(0, max(1, len(raw)), 65536))
                    out[k, part] = weights[2 * ones > len(raw)].sum(dtype=np.uint64)
                if not len(raw):
                    out[k, bits // 64 - 1] = 1
            columns = [batch.column("id"), *[pa.array(np.ascontiguousarray(out[:, part]).view(np.int64)) for part in range(bits // 64)]]
            yield pa.RecordBatch.from_arrays(columns, ["id", "fp", "fp_lo"][: len(columns)])

    return run


def fingerprints(corpus: DataFrame, bits: int = 64) -> DataFrame:
    """id, fp (64 bits; with bits=128 also fp_lo) of texts long enough; 1 for texts without words."""
    rows = words(corpus)
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(_prints(bits), f"id {kind}, fp long" + (", fp_lo long" if bits == 128 else ""))


def hex16(value: Column) -> Column:
    return F.lower(F.lpad(F.hex(value), 16, "0"))


def similarity(distance: Column, bits: int = 64) -> Column:
    return 1 - distance / bits


def scaled_threshold(threshold: int, bits: int) -> int:
    return 10 if bits == 128 and threshold == 5 else threshold


def bands(fp: Column, n: int, bits: int = 64) -> list[Column]:
    """``bits`` in n pieces, the last taking the rest; numbers that differ in fewer than n bits agree in one piece."""
    width = bits // n
    out = []
    for k in range(n):
        size = width if k < n - 1 else bits - width * (n - 1)
        mask = (1 << size) - 1
        out.append(F.shiftrightunsigned(fp, width * k).bitwiseAND(F.lit(mask if mask < 2**63 else -1)))
    return out


def hamming(x: str, y: str, parts: list[str]) -> Column:
    """Bits in which two rows' fingerprints differ, over their 64-bit parts."""
    out = F.lit(0)
    for p in parts:
        out = out + F.bit_count(F.col(f"{x}.{p}").bitwiseXOR(F.col(f"{y}.{p}")))
    return out


def key_shape(n: int, threshold: int, bits: int = 64) -> tuple[int, int]:
    """pieces, and how many of them a key has, that cost least for ``n`` fingerprints.

    Of k pieces at most ``threshold`` differ, so k - threshold agree: each
    choice of so many is a key. More pieces make more and longer keys.
    """
    def cost(k: int) -> float:
        keys, width = math.comb(k, k - threshold), bits / k * (k - threshold)
        return keys * n * (1 + n / 2 ** (width + 1))

    pieces = min((k for k in range(threshold + 1, threshold + 6) if k <= bits // 4), key=cost)
    return pieces, pieces - threshold


def pairs(prints: DataFrame, threshold: int = 5) -> DataFrame:
    """a, b, distance of distinct fingerprints at most ``threshold`` bits apart (a < b, first ids that have them), and equal ones.

    Equal fingerprints are one class first, so a page that thousands copy is
    one row in the join; members of a class are linked to its first id only.
    Rows by key are never broadcast: they are many times what is known of the
    table that they are made from, which may be in memory and small.
    Prints have a column fp, or with 128 bits fp and fp_lo. Keys are as long as
    the number of classes asks for (``key_shape``); where they would be narrower
    than four bits, rows are compared block by block.
    """
    parts = [c for c in ("fp", "fp_lo") if c in prints.columns]
    bits = 64 * len(parts)
    ensure_checkpoint_dir(prints.sparkSession)
    prints = prints if prints.is_cached else prints.select("id", *parts).checkpoint()  # used twice, and dear to make
    classes = prints.groupBy(*parts).agg(F.min("id").alias("rep")).checkpoint()
    if threshold + 1 <= bits // 4:
        pieces, same = key_shape(classes.count(), threshold, bits)
        values = [b for k, p in enumerate(parts) for b in bands(F.col(p), pieces // len(parts) + (k < pieces % len(parts)))]
        keys = [F.xxhash64(F.lit(k), *some) for k, some in enumerate(itertools.combinations(values, same))]
        banded = classes.select("rep", *parts, F.explode(F.array(*keys)).alias("key"))
        x, y = banded.alias("x"), banded.alias("y")
        met = x.hint("merge").join(y.hint("merge"), (F.col("x.key") == F.col("y.key")) & (F.col("x.rep") < F.col("y.rep")))
        near = met.select(F.col("x.rep").alias("a"), F.col("y.rep").alias("b"), hamming("x", "y", parts).cast("int").alias("distance")).where(F.col("distance") <= threshold).distinct()
    else:
        near = blocked_pairs(classes, parts, threshold)
    same_prints = prints.join(classes, parts).where("id != rep").select(F.col("rep").alias("a"), F.col("id").alias("b"), F.lit(0).alias("distance"))
    return near.unionByName(same_prints)


def piece_bounds(threshold: int, n_parts: int = 1) -> tuple[list[tuple[int, int, int]], int]:
    """(part, first bit, bits) of pieces, and the bits r in which at least one differs at most if all differ in ``threshold`` or fewer.

    The pieces that leave the least share of pairs to compare, added up; none
    if that is most of them.
    """
    best, least = ([], 0), 0.6
    for each in range(2, 17):
        r, edges = threshold // (each * n_parts), [round(64 * k / each) for k in range(each + 1)]
        pieces = [(part, lo, hi - lo) for part in range(n_parts) for lo, hi in itertools.pairwise(edges)]
        share = sum(sum(math.comb(w, k) for k in range(min(r, w) + 1)) / 2**w for _, _, w in pieces)
        if max(w for *_, w in pieces) <= 12 and share < least:
            best, least = (pieces, r), share
    return best


def _tiles(left: list[np.ndarray], right: list[np.ndarray], threshold: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Rows of left and of right at most ``threshold`` bits apart, and how many, tile by tile."""
    for at in range(0, len(left[0]), TILE[0]):
        for to in range(0, len(right[0]), TILE[1]):
            d = np.bitwise_count(left[0][at : at + TILE[0], None] ^ right[0][None, to : to + TILE[1]])
            for x, y in zip(left[1:], right[1:], strict=True):
                d += np.bitwise_count(x[at : at + TILE[0], None] ^ y[None, to : to + TILE[1]])
            hit = np.flatnonzero(d.ravel() <= threshold)
            if len(hit):
                i, j = np.divmod(hit, d.shape[1])
                yield i + at, j + to, d.ravel()[hit]


def _near(left: list[np.ndarray], right: list[np.ndarray], threshold: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """As ``_tiles``, but only rows that differ in r bits at most in a piece are compared; a pair is told by its first such piece."""
    pieces, r = piece_bounds(threshold, len(left))
    if not pieces:
        yield from _tiles(left, right, threshold)
    value = lambda x, lo, w: (x >> np.uint64(lo)) & np.uint64((1 << w) - 1)
    for at, (part, lo, w) in enumerate(pieces):
        x, y = value(left[part], lo, w), value(right[part], lo, w)
        by_x, by_y = np.argsort(x, kind="stable"), np.argsort(y, kind="stable")
        every = np.arange(1 << w, dtype=np.uint64)
        from_x, from_y = np.searchsorted(x[by_x], np.arange((1 << w) + 1)), np.searchsorted(y[by_y], np.arange((1 << w) + 1))
        close = every[np.bitwise_count(every) <= r]
        sorted_y = [z[by_y] for z in right]
        for v in np.flatnonzero(np.diff(from_x)):
            rows = by_x[from_x[v] : from_x[v + 1]]
            begin = from_y[(close ^ np.uint64(v)).astype(np.int64)]
            n = from_y[(close ^ np.uint64(v)).astype(np.int64) + 1] - begin
            some = np.repeat(begin - np.cumsum(n) + n, n) + np.arange(n.sum())
            for i, j, d in _tiles([z[rows] for z in left], [z[some] for z in sorted_y], threshold):
                i, j = rows[i], by_y[some[j]]
                told = np.zeros(len(i), bool)
                for p, o, k in pieces[:at]:
                    told |= np.bitwise_count(value(left[p][i] ^ right[p][j], o, k)) <= r
                yield i[~told], j[~told], d[~told]


def _compared(parts: list[str], threshold: int):
    """Rows (rep, parts, block, x, y) of two blocks: pairs of reps, the smaller first, and their distance, as they are found."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = pa.Table.from_batches(list(batches))
        x, y, block = whole.column("x")[0].as_py(), whole.column("y")[0].as_py(), whole.column("block").to_numpy()
        sides = [[whole.column(c).to_numpy()[block == k] for c in ("rep", *parts)] for k in (x, y)]
        (reps, *left), (others, *right) = ([ids, *(f.view(np.uint64) for f in prints)] for ids, *prints in sides)
        held, n = [], 0
        for i, j, d in _near(left, right, threshold):
            a, b = reps[i], others[j]
            keep = a < b if x == y else a != b
            a, b = a[keep], b[keep]
            held.append((np.minimum(a, b), np.maximum(a, b), d[keep].astype(np.int32)))
            n += len(a)
            if n >= BATCH:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*held, strict=True)], ["a", "b", "distance"])
                held, n = [], 0
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*held, strict=True)], ["a", "b", "distance"])

    return run


def blocked_pairs(classes: DataFrame, parts: list[str], threshold: int, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """All pairs within ``threshold`` bits for thresholds too wide for bands: pairs of blocks of bounded size."""
    count = classes.count()
    n = max(1, -(-count // block_rows), min(LEAST_BLOCKS, count // LEAST_ROWS))
    placed = classes.select("rep", *parts, F.pmod(F.xxhash64("rep"), F.lit(n)).cast("int").alias("block"))
    other = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: F.struct(F.least(k, F.col("block")).alias("x"), F.greatest(k, F.col("block")).alias("y")))
    met = placed.select("*", F.explode(other).alias("g")).select("rep", *parts, "block", "g.x", "g.y")
    return met.groupBy("x", "y").applyInArrow(_compared(parts, threshold), "a long, b long, distance int")


def clusters(links: DataFrame) -> DataFrame:
    """id, cluster_id (its least id) of every row linked to another."""
    return connected_components(links)


def cluster_similarity(members: DataFrame, prints: DataFrame, bits: int = 64) -> DataFrame:
    """cluster_id, n_members, similarity: 1 - mean distance / bits over all pairs of members.

    A pair of members differs in a bit if one has it and the other has not, so
    counts of set bits give the mean over all pairs without making them.
    """
    bit = lambda k: F.getbit("fp", F.lit(k)) if k < 64 else F.getbit("fp_lo", F.lit(k - 64))
    rows = members.join(prints, "id").select("cluster_id", *[bit(k).cast("long").alias(f"b{k}") for k in range(bits)])
    per = rows.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("n_members"), *[F.sum(f"b{k}").alias(f"s{k}") for k in range(bits)])
    total = F.lit(0)
    for k in range(bits):
        total = total + F.col(f"s{k}") * (F.col("n_members") - F.col(f"s{k}"))
    mean = total / (F.col("n_members") * (F.col("n_members") - 1) / 2)
    return per.select("cluster_id", "n_members", F.round(1 - mean / bits, 4).alias("similarity"))


def first_members(members: DataFrame, top: DataFrame, k: int = 50) -> DataFrame:
    """cluster_id, members: up to ``k`` ids, the least first, of each cluster in ``top`` (few rows)."""
    rank = F.row_number().over(Window.partitionBy("cluster_id").orderBy("id"))  # ranks over k are dropped before the shuffle
    some = members.join(F.broadcast(top.select("cluster_id")), "cluster_id").withColumn("rank", rank).where(F.col("rank") <= k)
    return some.groupBy("cluster_id").agg(F.sort_array(F.collect_list("id")).alias("members"))
