"""MinHash near-dedup: one-permutation hashing with optimal densification.

Each text's distinct shingles are hashed once; the first ``log2(BINS)`` bits
name a bin and the least hash in a bin is its value. An empty bin copies the
first filled bin in an order of its own (optimal densification), so that equal
bins in two texts have the probability of their Jaccard similarity. ``BANDS``
bands of ``BINS / BANDS`` bins are the buckets; at similarity 0.75 two texts
miss all buckets with a probability of about 5 in a million.

Texts with equal shingle sets are one class first. The centre of a bucket is
the member that meets most others in all its buckets (an original rather than
one of its copies), and each text is compared with the centre it meets most
often: a star, not all pairs. Buckets whose members are in more than one
component are opened again: of up to ``SMALL`` members all pairs of different
components are compared once, each pair for all its buckets; in larger buckets
members outside the largest component are compared with the centre of that,
``ROUNDS`` times. Then an exact way for the rest: in each larger bucket that
still holds several components all pairs of different components that sizes
allow are compared, in blocks of bounded weight; buckets in which one component
has half of the members are taken together with others of that component, so
that its sets are sent once. So every pair of texts that share a bucket is
linked, joined by other links, or compared; rounds and ``SMALL`` only save work. Pairs within a crowd that never comes
together cost the square of its texts, in blocks dealt over all tasks.

Links are confirmed on the full sets. A centre's set is sent once for some
``FAN`` partners, and pairs of one centre are dealt over many tasks.

Edge cases: null texts and those without words have an empty set, a component
of their own and stay; texts under ``SHINGLE`` words have one shingle, the
whole sequence; rows with one id are one document as to components, and each
of their texts is compared; a null id is the id that comes last; an empty table
gives an empty result; extra columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanery.llm import _bytes as B
from gleanery.llm._shared import KEYS, NULL_ID, cut, cut_with, drop, join_few, join_hot, key_of, maybe_in, row_keys, scratch, set_apart, without

SHINGLE, BINS, BANDS, PERCENT = 5, 128, 32, 75
#: How often buckets are opened by centres before the rest is compared in whole, how
#: many members a bucket has whose pairs are listed, and how many partners of a centre
#: are compared together.
ROUNDS, SMALL, FAN = 1, 8, 256
#: Links that components are found of with plain joins: at most so many narrow rows meet in a task.
FEW = 1 << 20
#: Weight of a block of a bucket: its shingles, and LEAST more for each member. In
#: groups of CROWD members pairs are left to the first bucket that they share.
BLOCK, LEAST, CROWD = 1 << 17, 256, 64
#: Words of the bitmap of bucket keys that occur more than once: 2 MB.
FILTER_WORDS = 2**18
U = np.uint64
#: A member of a bucket as a possible centre: the one that meets most others is the greatest.
OWN = ("w", "id", "row", "n")


def shingle_sets(texts: pa.Array, n: int = SHINGLE) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    _, _, h, first = B.tokens(*B.buffer(texts), B.BY_SPACE)
    g = B.grams(h, n)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= n:
            x = np.sort(g[a : b - n + 1])
            out.append(x[np.concatenate([[True], x[1:] != x[:-1]])])
        else:
            out.append(B.grams(h[a:b], b - a) if b > a else np.zeros(0, U))
    return out


def _orders(bins: int) -> np.ndarray:
    """For each bin the order in which it asks the others."""
    return np.argsort(B.mix(np.arange(bins * bins, dtype=U) + U(bins)).reshape(bins, bins), axis=1)


def signatures(sets: list[np.ndarray], bins: int = BINS) -> np.ndarray:
    """bins values of 32 bits for each set; zeros for an empty one."""
    shift = U(64 - bins.bit_length() + 1)
    edges = np.arange(bins, dtype=U) << shift
    sig, filled = np.zeros((len(sets), bins), np.uint32), np.zeros((len(sets), bins), bool)
    for k, s in enumerate(sets):
        if len(s):
            at = np.searchsorted(s, edges)
            low = s[np.minimum(at, len(s) - 1)]
            filled[k] = (at < len(s)) & ((low >> shift) == np.arange(bins, dtype=U))
            sig[k] = np.where(filled[k], (low >> U(20)) & U(0xFFFFFFFF), U(0)).astype(np.uint32)
    order, own = _orders(bins), sig.copy()
    rows, cols = np.nonzero(~filled & filled.any(axis=1)[:, None])
    for turn in range(bins):
        if not len(rows):
            break
        donor = order[cols, turn]
        ok = filled[rows, donor]
        sig[rows[ok], cols[ok]] = own[rows[ok], donor[ok]]
        rows, cols = rows[~ok], cols[~ok]
    return sig


def band_keys(sig: np.ndarray, bands: int = BANDS) -> np.ndarray:
    rows = sig.astype(U).reshape(len(sig), bands, -1)
    out = np.broadcast_to(np.arange(1, bands + 1, dtype=U), (len(sig), bands))
    with np.errstate(over="ignore"):
        for i in range(rows.shape[2]):
            out = B.mix(out * B.P + rows[:, :, i])
    return out


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in B.pieces(whole, "text"):
            sets = shingle_sets(batch.column("text"))
            keys = band_keys(signatures(sets))
            with np.errstate(over="ignore"):
                f1 = np.array([s.sum(dtype=U) for s in sets], U).view(np.int64)
                f2 = np.array([B.mix(s ^ U(0x5851F42D4C957F2D)).sum(dtype=U) for s in sets], U).view(np.int64)
            bands = pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1, dtype=np.int32) * BANDS), pa.array(keys.view(np.int64).ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("row"), pa.array([len(s) for s in sets], pa.int64()), pa.array(f1), pa.array(f2), bands], ["id", "row", "n", "f1", "f2", "bands"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Replaces text with set, the sorted distinct shingle hashes as bytes."""
    for whole in batches:
        for batch in B.pieces(whole, "text"):
            sets = shingle_sets(batch.column("text"))
            at = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int64)
            names = [n for n in batch.schema.names if n != "text"]
            yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in names], B.binaries(np.concatenate(sets) if sets else np.zeros(0, U), at)], [*names, "set"])


def _set(value: pa.Scalar) -> np.ndarray:
    return np.frombuffer(value.as_buffer(), U)


def alike(a: np.ndarray, b: np.ndarray) -> bool:
    small, large = (a, b) if len(a) < len(b) else (b, a)
    at = np.searchsorted(large, small)
    both = int((large[np.minimum(at, len(large) - 1)] == small).sum())
    return 100 * both >= PERCENT * (len(a) + len(b) - both)


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links from rows that come in order: a centre's set (no partner), then those of its partners."""
    centre = np.zeros(0, U)
    for batch in batches:
        keep = np.zeros(batch.num_rows, bool)
        for k, (partner, value) in enumerate(zip(batch.column("b").is_valid().to_pylist(), batch.column("set"), strict=True)):
            if partner:
                keep[k] = alike(centre, _set(value))
            else:
                centre = _set(value).copy()
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(keep))


def _bits(sets: list[np.ndarray]) -> np.ndarray:
    """A row of bits for each set, over the shingles that are in several."""
    at = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, place, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    col = (np.cumsum(times > 1) - 1)[place]
    keep = times[place] > 1
    at, col = at[keep], col[keep]
    out = np.zeros((len(sets), int(col.max()) // 64 + 1 if len(col) else 1), U)
    np.bitwise_or.at(out, (at, col >> 6), U(1) << (col & 63).astype(U))
    return out


def _block_links(key: int, ids: np.ndarray, roots: np.ndarray, side: np.ndarray, sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Links that join the components of two blocks, or of one with itself; all their pairs are compared."""
    n = np.array([len(s) for s in sets], np.int64)
    _, label, times = np.unique(roots, return_inverse=True, return_counts=True)
    if len(times) < 2:
        return []
    bits = _bits(sets)
    bands = band_keys(signatures(sets)) if len(sets) >= CROWD else np.zeros((len(sets), 0), U)
    earlier = int(np.argmax(bands[0] == U(key))) if bands.shape[1] else 0  # 0 where the key is no bucket's
    one = (side == side[0]).all()
    links = []
    for x in np.flatnonzero(label != np.argmax(times)):
        fit = (label != label[x]) & (100 * np.minimum(n, n[x]) >= PERCENT * np.maximum(n, n[x]))
        if not one:
            fit &= side != side[x]
        to = np.flatnonzero(fit)
        if earlier:
            to = to[~(bands[to, :earlier] == bands[x, :earlier]).any(axis=1)]
        if not len(to):
            continue
        both = np.concatenate([np.bitwise_count(bits[t] & bits[x]).sum(axis=1, dtype=np.int64) for t in np.array_split(to, len(to) * bits.shape[1] // B.CHUNK + 1)])
        for y in to[100 * both >= PERCENT * (n[to] + n[x] - both)]:
            if label[y] != label[x]:
                links.append((min(int(ids[x]), int(ids[y])), max(int(ids[x]), int(ids[y]))))
                label[label == label[y]] = label[x]
    return links


def _compare_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of each group (key, x, y) of rows that come in order; a group is two blocks at most."""
    held: list[pa.RecordBatch] = []

    def close() -> pa.RecordBatch:
        get = lambda c: np.concatenate([np.asarray(h.column(c)) for h in held])
        links = _block_links(int(np.asarray(held[0].column("key"))[:1].view(U)[0]), get("id"), get("root"), get("side"), [_set(v) for h in held for v in h.column("set")])
        held.clear()
        return pa.RecordBatch.from_arrays([pa.array([a for a, _ in links], pa.int64()), pa.array([b for _, b in links], pa.int64())], ["a", "b"])

    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        names = np.stack([np.asarray(batch.column(c)) for c in ("key", "x", "y")], axis=1)
        starts = [0, *(np.flatnonzero((names[1:] != names[:-1]).any(axis=1)) + 1).tolist(), batch.num_rows]
        for a, b in zip(starts[:-1], starts[1:], strict=True):
            if held and last != names[a].tolist():
                yield close()
            held.append(batch.slice(a, b - a))
            last = names[a].tolist()
    if held:
        yield close()


def _crowd_links(rows: DataFrame, sets: DataFrame, total: int) -> DataFrame:
    """Links between the components of each group of rows (key, id, row, n, root), by comparing all pairs that sizes allow.

    Groups are buckets, or buckets taken together. One over ``BLOCK`` is split by size into tiers, of which only
    neighbours can have links, and these by hash into blocks.
    """
    rows = rows.withColumn("weight", F.col("n") + LEAST)
    whole = rows.groupBy("key").agg(F.sum("weight").alias("all"), F.count(F.lit(1)).alias("m"))
    rows = join_hot(rows, whole, ["key"], total).drop("m").withColumn("tier", F.when(F.col("all") > BLOCK, F.floor(F.log("n") / np.log(100 / PERCENT))).otherwise(0))
    rows = cut(rows.drop("all"), "tiers")
    parts = rows.groupBy("key", "tier").agg(F.ceil(F.sum("weight") / BLOCK).alias("parts"), F.count(F.lit(1)).alias("m"))
    block = F.shiftleft("tier", 32) + F.pmod(F.xxhash64("id", "row"), "parts")
    blocks = cut(join_hot(rows, parts, ["key", "tier"], total).select("key", "id", "row", "n", "root", block.alias("block")), "blocks")
    drop(rows)
    facts = blocks.groupBy("key", "block").agg(F.min("n").alias("low"), F.max("n").alias("high"), F.min("root").alias("r0"), F.max("root").alias("r1"))
    x, y = (facts.select("key", *[F.col(c).alias(f"{c}_{s}") for c in ("block", "low", "high", "r0", "r1")]) for s in "xy")
    fits = (100 * F.least("high_x", "high_y") >= PERCENT * F.greatest("low_x", "low_y")) & (F.least("r0_x", "r0_y") < F.greatest("r1_x", "r1_y"))
    two = x.join(y, "key").where((F.col("block_x") <= F.col("block_y")) & fits).select("key", F.col("block_x").alias("x"), F.col("block_y").alias("y"))
    sides = two.select("key", "x", "y", F.explode(F.array_distinct(F.array("x", "y"))).alias("block"))
    members = blocks.join(sides, ["key", "block"]).select("key", "x", "y", F.col("block").alias("side"), "id", "row", "root")
    members = members.join(_needed(sets, blocks.join(two, "key", "left_semi")), ["id", "row"]).select("key", "x", "y", "side", "id", "root", "set")
    return members.repartition("key", "x", "y").sortWithinPartitions("key", "x", "y", "side", "id").mapInArrow(_compare_blocks, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """id, root: the least id reachable over links (a, b), for each id in one.

    Alternating large-star and small-star rounds: the number of rows never
    grows. Beyond ``FEW`` links, ids with very many are joined where their links
    are, which takes more tables a round.
    """
    figures = {"n": F.count(F.lit(1)), "hash": F.bit_xor(F.xxhash64("u", "v"))}
    now, state = cut_with(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct(), "links", **figures)
    while state["n"]:
        few = state["n"] <= FEW
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        smallest = lambda rows: rows.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("c"))
        least = smallest(both).withColumn("m", F.least("u", "m"))
        least = least if few else cut(least, "least")
        large = both.join(least, "u") if few else join_hot(both, least, ["u"], 2 * state["n"], "c")
        large = large.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large, seen = (large, None) if few else cut_with(large, "large", n=F.count(F.lit(1)))
        last = smallest(large) if few else cut(smallest(large), "least")
        hung = large.join(last, "u") if few else join_hot(large, last, ["u"], seen["n"], "c")
        small = hung.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(hung.select("u", F.col("m").alias("v"))).where("u != v").distinct()
        before, old = state, now
        now, state = cut_with(small, "stars", **figures)
        drop(old, least, large, last)
        if state == before:
            break
    return now.select(F.col("u").alias("id"), F.col("v").alias("root"))


def _deal(pairs: DataFrame, total: int) -> DataFrame:
    """The ``total`` pairs (a, row_a, b, row_b) with fan: a centre's partners, dealt into groups of some ``FAN``."""
    fans = pairs.groupBy("a", "row_a").agg(F.count(F.lit(1)).alias("m"))
    dealt = join_hot(pairs, fans, ["a", "row_a"], total).withColumn("fan", F.pmod(F.xxhash64("b", "row_b"), F.ceil(F.col("m") / FAN)))
    return cut(dealt.select("a", "row_a", "fan", "b", "row_b"), "dealt")


def _needed(sets: DataFrame, nodes: DataFrame) -> DataFrame:
    """id, row, set of ``nodes`` (id, row), and some others; most sets that are not needed stay where they are."""
    return maybe_in(sets.select("id", "row", "set"), nodes, ["id", "row"])


def _alike_to_centre(dealt: DataFrame, tails: DataFrame, sets: DataFrame) -> DataFrame:
    """Links (a, b) of tails (a, row_a, fan, b, set) whose sets are like that of their centre."""
    centres = dealt.select("a", "row_a", "fan").distinct()
    own = _needed(sets, centres.select(F.col("a").alias("id"), F.col("row_a").alias("row"))).withColumnsRenamed({"id": "a", "row": "row_a"})
    heads = centres.join(own, ["a", "row_a"]).withColumn("b", F.lit(None).cast("long"))
    both = heads.unionByName(tails).repartition("a", "row_a", "fan").sortWithinPartitions("a", "row_a", "fan", F.col("b").asc_nulls_first())
    return both.select("a", "b", "set").mapInArrow(_compare, "a long, b long")


def _confirm(pairs: DataFrame, sets: DataFrame, total: int) -> DataFrame:
    """The ``total`` pairs (a, row_a, b, row_b) whose sets are alike, as links (a, b)."""
    dealt = _deal(pairs, total)
    own = _needed(sets, dealt.select(F.col("b").alias("id"), F.col("row_b").alias("row"))).withColumnsRenamed({"id": "b", "row": "row_b"})
    return _alike_to_centre(dealt, dealt.join(own, ["b", "row_b"]).drop("row_b"), sets)


def _fits(n: str, m: str) -> Column:
    """Sets of these sizes can be as similar as ``PERCENT``."""
    return 100 * F.least(n, m) >= PERCENT * F.greatest(n, m)


def _joined(roots: DataFrame, links: DataFrame) -> DataFrame:
    """roots (id, root) with the components merged that ``links`` join; only the roots are walked."""
    at = lambda c: roots.select(F.col("id").alias(c), F.col("root").alias(f"r{c}"))
    named = links.select("a", "b").join(at("a"), "a", "left").join(at("b"), "b", "left").select("a", "b", F.coalesce("ra", "a").alias("ra"), F.coalesce("rb", "b").alias("rb"))
    over = components(named.select(F.col("ra").alias("a"), F.col("rb").alias("b"))).select(F.col("id").alias("root"), F.col("root").alias("to"))
    all_ = roots.unionByName(named.select(F.explode(F.array(F.struct(F.col("a").alias("id"), F.col("ra").alias("root")), F.struct(F.col("b").alias("id"), F.col("rb").alias("root")))).alias("e")).select("e.*")).distinct()
    return cut(all_.join(over, "root", "left").select("id", F.coalesce("to", "root").alias("root")), "roots")


def _nearest(met: DataFrame) -> DataFrame:
    """One pair for each text of met (id, row, centre): the centre that it meets most often."""
    each = met.groupBy("id", "row", F.col("centre.id").alias("a"), F.col("centre.row").alias("row_a")).agg(F.count(F.lit(1)).alias("k"), F.max("centre.w").alias("w"))
    best = each.groupBy("id", "row").agg(F.max(F.struct("k", "w", "a", "row_a")).alias("best"))
    return best.select("best.a", "best.row_a", F.col("id").alias("b"), F.col("row").alias("row_b"))


def _star(buckets: DataFrame, total: int) -> DataFrame:
    """One pair for each text that meets a centre in buckets (key, id, row, n, w) of ``total`` rows."""
    centres = buckets.groupBy("key").agg(F.max(F.struct(*OWN)).alias("centre"), F.count(F.lit(1)).alias("m"))
    met = join_hot(buckets, centres, ["key"], total).where((F.struct("id", "row") != F.struct("centre.id", "centre.row")) & _fits("n", "centre.n"))
    return _nearest(met)


def _roots(buckets: DataFrame, sets: DataFrame, links: DataFrame, tried: DataFrame, total: int) -> DataFrame:
    """id, root over all links found in buckets (key, id, row, n, w) of ``total`` rows, from those known and the pairs ``tried``."""
    roots = cut(components(links), "roots")
    for turn in range(ROUNDS + 1):
        rows = cut(buckets.join(roots, "id", "left").withColumn("root", F.coalesce("root", "id")), "rooted")
        parts = rows.groupBy("key", "root").agg(F.count(F.lit(1)).alias("m"), F.max(F.struct(*OWN)).alias("c"))
        whole = parts.groupBy("key").agg(F.sum("m").alias("m"), F.count(F.lit(1)).alias("roots"), F.max(F.struct("m", "root", "c")).alias("big")).where("roots > 1")
        together = F.when(2 * F.col("big.m") >= F.col("m"), F.col("big.root")).otherwise(F.col("key"))
        whole = cut(whole.select("key", "m", F.col("big.root").alias("big"), F.col("big.c").alias("centre"), together.alias("group")), "open")
        large = whole.where(F.col("m") > SMALL)
        if turn == ROUNDS:
            break
        met = join_hot(rows, large, ["key"], total).where((F.col("root") != F.col("big")) & _fits("n", "centre.n"))
        pairs = _nearest(_untried(met, tried))
        if not turn:
            pairs = pairs.unionByName(_small_pairs(rows.join(whole.where(F.col("m") <= SMALL).select("key"), "key"), tried)).distinct()
        pairs, seen = cut_with(pairs, "pairs", n=F.count(F.lit(1)))
        if seen["n"]:
            links, seen = cut_with(_confirm(pairs, sets, seen["n"]), "links", n=F.count(F.lit(1)))
            tried = tried.unionByName(pairs)
        if seen["n"]:
            roots = _joined(roots, links)
            drop(rows, whole)
    crowds = join_hot(rows, large.select("key", "m", "group"), ["key"], total).select(F.col("group").alias("key"), "id", "row", "n", "root").distinct()
    crowds, seen = cut_with(crowds, "crowds", n=F.count(F.lit(1)))
    links, seen = cut_with(_crowd_links(crowds, sets, seen["n"]).distinct(), "links", n=F.count(F.lit(1)))
    return _joined(roots, links) if seen["n"] else roots


def _small_pairs(rows: DataFrame, tried: DataFrame) -> DataFrame:
    """All pairs of different components in buckets of ``SMALL`` members at most, less those ``tried``."""
    rows = cut(rows.select("key", F.struct("w", "id", "row").alias("node"), "n", "root"), "small")
    other = rows.select("key", F.col("node").alias("centre"), F.col("n").alias("m"), F.col("root").alias("to"))
    pairs = rows.join(other, "key").where((F.col("centre") > F.col("node")) & (F.col("root") != F.col("to")) & _fits("n", "m"))
    pairs = pairs.select(F.col("centre.id").alias("a"), F.col("centre.row").alias("row_a"), F.col("node.id").alias("b"), F.col("node.row").alias("row_b")).distinct()
    back = tried.select(F.col("b").alias("a"), F.col("row_b").alias("row_a"), F.col("a").alias("b"), F.col("row_a").alias("row_b"))
    return pairs.join(tried.unionByName(back), ["a", "row_a", "b", "row_b"], "left_anti")


def _untried(met: DataFrame, tried: DataFrame) -> DataFrame:
    known = tried.select(F.col("a").alias("c_id"), F.col("row_a").alias("c_row"), F.col("b").alias("id"), F.col("row_b").alias("row"))
    return met.withColumns({"c_id": F.col("centre.id"), "c_row": F.col("centre.row")}).join(known, ["id", "row", "c_id", "c_row"], "left_anti")


def cluster(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, row keys, n_shingles, root, component_id, kept of every row."""
    count = {"n": F.count(F.lit(1))}
    keys = [c.alias(k.removeprefix("__gl_")) for k, c in row_keys(id_col, text_col).items()]
    texts = docs.select(*keys, F.col(text_col).alias("text"))
    sketch, seen = cut_with(texts.mapInArrow(_sketch, "id long, row long, n long, f1 long, f2 long, bands array<long>"), "sketch", **count)
    full, total = sketch.where("n > 0"), seen["n"]
    node = F.struct("id", "row")
    classes = full.groupBy("n", "f1", "f2").agg(F.min(node).alias("node"), F.min_by("bands", node).alias("bands"), F.count(F.lit(1)).alias("m"))
    classes, seen = cut_with(classes.select("n", "f1", "f2", F.col("node.id").alias("rep"), F.col("node.row").alias("rep_row"), "bands", "m"), "classes", **count)
    named = cut(join_hot(full.select("id", "row", "n", "f1", "f2"), classes.select("n", "f1", "f2", "rep", "m"), ["n", "f1", "f2"], total).select("id", "row", "n", "rep"), "named")
    # buckets of several classes, and how many members each class meets in all
    rows = classes.select(F.col("rep").alias("id"), F.col("rep_row").alias("row"), "n", F.explode("bands").alias("key"))
    many = cut(rows.groupBy("key").agg(F.count(F.lit(1)).alias("m")).where("m > 1"), "many")
    shared = join_hot(maybe_in(rows, many, ["key"], FILTER_WORDS), many, ["key"], BANDS * seen["n"])
    met = shared.groupBy("id", "row").agg(F.first("n").alias("n"), F.sum("m").alias("w"), F.collect_list("key").alias("keys"))  # BANDS keys at most
    buckets, seen = cut_with(met.select("id", "row", "n", "w", F.explode("keys").alias("key")), "buckets", **count)
    # the star's pairs come first, so that a set goes to its centre from where it is made
    tried, star = cut_with(_star(buckets, seen["n"]), "star", **count)
    dealt = _deal(tried, star["n"])
    nodes = buckets.select("id", "row").distinct().join(dealt.withColumnsRenamed({"b": "id", "row_b": "row"}), ["id", "row"], "left")
    wanted = cut(nodes.select(F.col("id").alias("__gl_id"), F.col("row").alias("__gl_row"), "a", "row_a", "fan", F.lit(True).alias("seen")), "wanted")
    sets = join_few(texts.withColumnsRenamed({"id": "__gl_id", "row": "__gl_row"}), wanted).where("seen").drop("seen")
    twice, again = cut_with(full.groupBy(F.col("id").alias("__gl_id"), F.col("row").alias("__gl_row")).agg(F.count(F.lit(1)).alias("copies")).where("copies > 1"), "twice", **count)
    if again["n"]:  # rows that repeat a row: one set is enough
        marked = join_few(sets, twice)
        sets = marked.where(F.col("copies").isNull()).unionByName(marked.where("copies > 1").dropDuplicates(KEYS)).drop("copies")
    sets = sets.select(F.col("__gl_id").alias("id"), F.col("__gl_row").alias("row"), "a", "row_a", "fan", "text").mapInArrow(_sets, "id long, row long, a long, row_a long, fan long, set binary")
    sets = cut(sets, "sets")
    links = _alike_to_centre(dealt, sets.where("a is not null").select("a", "row_a", "fan", F.col("id").alias("b"), "set"), sets)
    # an id with several texts joins their components
    split = named.groupBy("id").agg(F.min("rep").alias("a"), F.max("rep").alias("last"), F.count(F.lit(1)).alias("m")).where("a != last")
    given = join_hot(named.select("id", "rep"), split, ["id"], total).where("rep != a").select("a", F.col("rep").alias("b"))
    roots = _roots(buckets, sets, links.unionByName(given), tried, seen["n"])
    reps = classes.groupBy("rep").agg(F.sum("m").alias("m")).join(roots.withColumnRenamed("id", "rep"), "rep", "left")
    reps = cut(reps.select("rep", "m", F.coalesce("root", "rep").alias("root")), "reps")
    out = join_hot(named, reps, ["rep"], total).select("id", "row", "n", "root")
    out = out.unionByName(sketch.where("n = 0").select("id", "row", "n", F.col("id").alias("root")))
    shown = lambda c: F.when(F.col(c) != NULL_ID, F.col(c))
    return out.select(
        shown("id").alias("doc_id"), F.col("id").alias("__gl_id"), F.col("row").alias("__gl_row"), F.col("n").alias("n_shingles"), F.col("root").alias("__root"),
        shown("root").alias("component_id"), (F.col("id") == F.col("root")).alias("kept"),
    )


def keep_firsts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that ``cluster`` keeps; of rows that repeat a kept id, one."""
    with scratch() as keep:
        found = keep(cut(cluster(docs, id_col, text_col).select(*KEYS, "kept"), "clusters"))
    rest = without(docs, found.where("not kept"), id_col, text_col)
    twice = cut(found.where("kept").groupBy("__gl_id").agg(F.count(F.lit(1)).alias("__gl_copies")).where("__gl_copies > 1"), "twice")
    if twice.isEmpty():
        return rest
    own, back = set_apart(rest)
    marked = join_few(own.withColumn("__gl_id", key_of(F.col(id_col))), twice, ["__gl_id"])
    once = marked.where(F.col("__gl_copies").isNull()).unionByName(marked.where("__gl_copies > 1").dropDuplicates(["__gl_id"]))
    return once.select(*own.columns).withColumnsRenamed(back)
