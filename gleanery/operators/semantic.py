"""Near duplicates by cosine similarity of embeddings."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanery.operators.components import connected_components, ensure_checkpoint_dir

#: A block's rows; the tiles of a product, rows of one block by rows of the other; pairs in a batch that is returned; rows that are decided at once on the driver.
THRESHOLD, BLOCK_ROWS, TILE, BATCH, PREFIX = 0.85, 20_000, (512, 2048), 1 << 17, 4096
#: Blocks that many rows are cut into at least, if there are as many as LEAST_ROWS for each, so that all cores have some.
LEAST_BLOCKS, LEAST_ROWS = 8, 1000


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def unit(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """id, u: vectors of length one; zero and null vectors are left out."""
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<double>").alias("v"))
    return rows.withColumn("n", norm(F.col("v"))).where(F.col("n") > 0).select("id", F.transform("v", lambda x: x / F.col("n")).alias("u"))


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of numbers, one length each, as a matrix."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def _near(p: np.ndarray, q: np.ndarray, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Rows of p and of q and their cosine, at or over the threshold, tile by tile: memory is that of a tile."""
    for at in range(0, len(p), TILE[0]):
        for to in range(0, len(q), TILE[1]):
            cos = p[at : at + TILE[0]] @ q[to : to + TILE[1]].T
            hit = np.flatnonzero(cos.ravel() >= threshold)
            if len(hit):
                i, j = np.divmod(hit, cos.shape[1])
                yield i + at, j + to, cos.ravel()[hit]


def _joined(root: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Pairs of rows, few of them, that link the same rows as (i, j) do beyond what ``root`` knows; root is brought up to date."""
    kept = []
    while True:
        x, y = root[i], root[j]
        open_ = x != y
        if not open_.any():
            return np.concatenate(kept) if kept else np.zeros(0, np.int64)
        i, j, x, y = i[open_], j[open_], np.maximum(x, y)[open_], np.minimum(x, y)[open_]
        # each root that can hangs itself under one smaller root; which pair did so is kept
        _, first = np.unique(x, return_index=True)
        root[x[first]] = y[first]
        kept.append(np.stack([i[first], j[first]], axis=1).ravel())
        while (up := root[root] != root).any():
            root[up] = root[root[up]]


def _compared(threshold: float, links_only: bool):
    """Rows (id, u, block, x, y) of two blocks, as they come: pairs of ids and cosines; with ``links_only`` a forest of the links."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: tuple[list, list] = ([], [])
        same = True
        for batch in batches:
            if batch.num_rows:
                x, y = batch.column("x")[0].as_py(), batch.column("y")[0].as_py()
                same = x == y
                block = batch.column("block").to_numpy(zero_copy_only=False)
                ids, u = batch.column("id").to_numpy(zero_copy_only=False), _matrix(batch.column("u"))
                for part, k in zip(parts, (x, y), strict=True):
                    part.append((ids[block == k], u[block == k]))
        if same:
            parts = (parts[0], parts[0])
        if not all(parts) or not all(sum(len(ids) for ids, _ in part) for part in parts):
            return
        (left, p), (right, q) = ((np.concatenate([ids for ids, _ in part]), np.concatenate([u for _, u in part if len(u)])) for part in parts)
        every = np.concatenate([left, right]) if not same else left
        root, held, n = np.arange(len(every)), [], 0
        for i, j, cos in _near(p, q, threshold):
            a, b = left[i], right[j]
            keep = a < b if same else a != b
            if links_only:
                got = _joined(root, i[keep], j[keep] + (0 if same else len(left)))
                a, b, cos = every[got[::2]], every[got[1::2]], np.ones(len(got) // 2)
            else:
                a, b, cos = a[keep], b[keep], cos[keep]
            held.append((np.minimum(a, b), np.maximum(a, b), cos))
            n += len(a)
            if n >= BATCH:
                yield from _batches(held)
                held, n = [], 0
        yield from _batches(held)

    return run


def _batches(held: list[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
    if held:
        columns = [np.concatenate(x) for x in zip(*held, strict=True)]
        for at in range(0, len(columns[0]), BATCH):
            yield pa.RecordBatch.from_arrays([pa.array(c[at : at + BATCH]) for c in columns], ["a", "b", "cosine"])


def similar_pairs(vectors: DataFrame, threshold: float = THRESHOLD, id_col: str = "vec_id", vec_col: str = "embedding", block_rows: int = BLOCK_ROWS, links_only: bool = False) -> DataFrame:
    """a, b (a < b), cosine of all pairs at or over the threshold, exactly.

    Rows are cut into blocks by a hash; each pair of blocks meets in one group
    of two blocks' rows, which is compared tile by tile with matrix products,
    and pairs are returned as they are found. The number of groups grows with
    the square of the blocks; their size, and so memory, is bounded.

    With ``links_only`` a group returns no more pairs than it has rows, which
    link the same rows together as all pairs do (cosine is 1 then).
    """
    rows = unit(vectors, id_col, vec_col).where("id IS NOT NULL")
    n = vectors.count()
    n_blocks = max(1, -(-n // block_rows), min(LEAST_BLOCKS, n // LEAST_ROWS))
    placed = rows.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(n_blocks)).cast("int"))
    other = F.transform(F.sequence(F.lit(0), F.lit(n_blocks - 1)), lambda k: F.struct(F.least(k, F.col("block")).alias("x"), F.greatest(k, F.col("block")).alias("y")))
    met = placed.select("id", "u", "block", F.explode(other).alias("g")).select("id", "u", "block", "g.x", "g.y")
    return met.groupBy("x", "y").applyInArrow(_compared(threshold, links_only), "a long, b long, cosine double")


def components(vectors: DataFrame, threshold: float = THRESHOLD, id_col: str = "vec_id", vec_col: str = "embedding", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """id, cluster_id (its least id) of every row in a pair, over all links at or over the threshold; pairs are not listed."""
    return connected_components(similar_pairs(vectors, threshold, id_col, vec_col, block_rows, links_only=True))


def _owners(ids: np.ndarray, u: np.ndarray, threshold: float):
    """For rows (id, u): the least of ``ids`` (in order) that is near and less, as owner, or null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, none = batch.column("id").to_numpy(zero_copy_only=False), len(ids)
            first = np.full(len(own), none)
            for i, j, _ in _near(_matrix(batch.column("u")), u, threshold) if len(own) else ():
                less = ids[j] < own[i]
                np.minimum.at(first, i[less], j[less])
            owner = pa.array(np.append(ids, 0)[first], mask=first == none)
            yield pa.RecordBatch.from_arrays([*batch.columns, owner], [*batch.schema.names, "owner"])

    return run


def _decided(ids: np.ndarray, u: np.ndarray, threshold: float) -> np.ndarray:
    """Which of rows in order of id are kept: those near no earlier one that is kept."""
    near: list[list[np.ndarray]] = [[] for _ in ids]
    for i, j, _ in _near(u, u, threshold):
        i, j = i[i < j], j[i < j]
        cuts = np.flatnonzero(np.diff(i)) + 1
        for k, later in zip(i[np.concatenate([[0], cuts])] if len(i) else [], np.split(j, cuts), strict=len(i) > 0):
            near[k].append(later)
    kept = np.ones(len(ids), bool)
    for k in range(len(ids)):
        if kept[k]:
            for later in near[k]:
                kept[later] = False
    return kept


def clusters(vectors: DataFrame, threshold: float = THRESHOLD, id_col: str = "vec_id", vec_col: str = "embedding", block_rows: int = BLOCK_ROWS, prefix: int = PREFIX) -> DataFrame:
    """cluster_id, id as ``greedy_clusters`` gives them for all pairs, which are not listed where they are many.

    The first ``prefix`` rows in order of id that are undecided are decided by
    themselves, as nothing earlier is near them; all others that are near one
    of those that are kept are its duplicates, and go. Where many pairs are
    near, few rows are left after each such round. Once a round leaves more
    than half of the rows, pairs among those left are few, and are listed.
    """
    ensure_checkpoint_dir(vectors.sparkSession)
    rows = unit(vectors, id_col, vec_col).where("id IS NOT NULL").checkpoint()
    n, n_ids = rows.select(F.count("id"), F.count_distinct("id")).first()
    if n != n_ids:  # rows of one id are one node of the links
        return greedy_clusters(similar_pairs(vectors, threshold, id_col, vec_col, block_rows))
    done = None
    while n:
        last = rows.select("id").orderBy("id").limit(prefix).agg(F.max("id")).first()[0]
        firsts = rows.where(F.col("id") <= last).orderBy("id").toArrow()
        ids, u = firsts.column("id").to_numpy(), _matrix(firsts.column("u").combine_chunks())
        kept = _decided(ids, u, threshold)
        owned = rows.mapInArrow(_owners(ids[kept], u[kept], threshold), "id long, u array<double>, owner long").checkpoint()
        some = owned.where("owner IS NOT NULL").select(F.col("owner").alias("cluster_id"), "id")
        done = some if done is None else done.unionByName(some)
        rows = owned.where(F.col("owner").isNull() & (F.col("id") > last)).select("id", "u")
        before, n = n, rows.count()
        if 2 * n > before:
            rest = greedy_clusters(similar_pairs(rows, threshold, "id", "u", block_rows))
            return _with_firsts(done).unionByName(rest)
    return _with_firsts(done) if done is not None else greedy_clusters(similar_pairs(vectors, threshold, id_col, vec_col, block_rows))


def _with_firsts(owner: DataFrame) -> DataFrame:
    """cluster_id, id with a row for each cluster's first."""
    return owner.unionByName(owner.select("cluster_id", F.col("cluster_id").alias("id")).distinct())


def greedy_clusters(pairs: DataFrame) -> DataFrame:
    """cluster_id, id: in order of id, a row that is near no earlier kept row is kept, and its near rows are its duplicates.

    Rounds decide all rows whose earlier neighbours are decided; each ends in
    a checkpoint.
    """
    ensure_checkpoint_dir(pairs.sparkSession)
    links = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct().checkpoint()
    nodes = links.select(F.col("a").alias("id")).unionByName(links.select(F.col("b").alias("id"))).distinct()
    state = nodes.withColumn("kept", F.lit(None).cast("boolean")).checkpoint()
    while True:
        earlier = links.join(state.select(F.col("id").alias("a"), F.col("kept").alias("k")), "a").groupBy(F.col("b").alias("id")).agg(F.max(F.coalesce("k", F.lit(False))).alias("some"), F.count_if(F.col("k").isNull()).alias("open"))
        now = state.join(earlier, "id", "left")
        kept = F.when(F.col("kept").isNotNull(), F.col("kept")).when(F.coalesce("some", F.lit(False)), F.lit(False)).when(F.coalesce("open", F.lit(0)) == 0, F.lit(True))
        state = now.select("id", kept.alias("kept")).checkpoint()
        if state.where("kept is null").isEmpty():
            break
    owner = links.join(state.where("kept").select(F.col("id").alias("a")), "a").groupBy(F.col("b").alias("id")).agg(F.min("a").alias("cluster_id"))
    return _with_firsts(owner)
