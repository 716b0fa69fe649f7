"""Sharding by fixed virtual slots.

A record's key (its id and its text's checksum) is hashed into one of thousands
of slots, for good. What can
change is the small map from slot to shard: it is made from the bytes in each
slot, stored under a version, and edited (few slots moved) when the load or
the number of shards changes. Data never has to be hashed anew.

Law: ``bytes`` - shards hold near equal bytes. A record larger than a fair
share cannot be split, so then its shard is the largest.

Edge cases: rows with a null id or one id are told apart by their texts; a null
text has no bytes (size 1, crc 0); rows that repeat a row share its slot, as one
key cannot be split, and get places of their own;
an empty table gives an empty result and an even map; extra columns are kept
by ``place`` unless they have the name of one it adds, then they are replaced.
"""

from __future__ import annotations

import heapq
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gleanery.llm._shared import cut, new_path

#: Virtual slots, and cells within a slot in which places are counted.
N_SLOTS, N_CELLS = 4096, 16


def size_of(text: Column) -> Column:
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long")


def crc_of(text: Column) -> Column:
    return F.crc32(F.coalesce(text, F.lit("")).cast("binary"))


def slot_of(*key: Column, n_slots: int = N_SLOTS) -> Column:
    return F.pmod(F.xxhash64(*key), F.lit(n_slots)).cast("int")


def cell_of(*key: Column) -> Column:
    return F.pmod(F.shiftrightunsigned(F.xxhash64(*key), 32), F.lit(N_CELLS)).cast("int")


def slot_bytes(docs: DataFrame, slot: Column, size: Column) -> dict[int, int]:
    """Bytes by slot; at most one row for each slot reaches the driver."""
    return {r[0]: r[1] for r in docs.groupBy(slot.alias("s")).agg(F.sum(size).alias("b")).collect()}


def make_map(load: Mapping[int, int], n_shards: int, n_slots: int = N_SLOTS) -> list[int]:
    """Slot to shard: the heaviest slot left goes to the lightest shard."""
    out, heap = [0] * n_slots, [(0, 0, k) for k in range(n_shards)]
    for slot in sorted(range(n_slots), key=lambda s: (-load.get(s, 0), s)):
        total, held, k = heapq.heappop(heap)
        out[slot] = k
        heapq.heappush(heap, (total + load.get(slot, 0), held + 1, k))
    return out


def rebalance(old: Sequence[int], load: Mapping[int, int], n_shards: int, tolerance: float = 0.02) -> list[int]:
    """An edited map: slots move only from shards over the mean to those under it."""
    out = list(old)
    fair = sum(load.values()) / n_shards
    total = [0] * n_shards
    loose = []
    held: dict[int, list[int]] = {k: [] for k in range(n_shards)}
    for slot, k in enumerate(out):
        if k >= n_shards:
            loose.append(slot)
        else:
            total[k] += load.get(slot, 0)
            held[k].append(slot)
    for k in range(n_shards):
        for slot in sorted(held[k], key=lambda s: (-load.get(s, 0), s)):  # few and heavy ones first
            if total[k] <= fair * (1 + tolerance):
                break
            if load.get(slot, 0) <= total[k] - fair:
                total[k] -= load.get(slot, 0)
                loose.append(slot)
    heap = [(b, k) for k, b in enumerate(total)]
    heapq.heapify(heap)
    for slot in sorted(loose, key=lambda s: (-load.get(s, 0), s)):
        b, k = heapq.heappop(heap)
        out[slot] = k
        heapq.heappush(heap, (b + load.get(slot, 0), k))
    return out


def save_map(spark: SparkSession, path: str, version: int, shard_of: Sequence[int]) -> None:
    """Add one version of the map; a version that exists is never changed."""
    rows = [(s, k) for s, k in enumerate(shard_of)]
    spark.createDataFrame(rows, "vslot int, shard int").coalesce(1).write.parquet(f"{path.rstrip('/')}/version={version}")


def load_map(spark: SparkSession, path: str, version: int) -> DataFrame:
    return spark.read.schema("vslot int, shard int").parquet(f"{path.rstrip('/')}/version={version}")


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: bool = True, n_slots: int = N_SLOTS) -> DataFrame:
    """Adds size, text_crc32, vslot; with ``keep`` beside the table's own columns, else beside the id."""
    new = {"size", "text_crc32", "vslot", "shard", "slot", "law", "grown_shard", "__cell", "__first", "__n"}
    own = [c for c in docs.columns if c not in new] if keep else [id_col]
    return docs.select(*own, size_of(F.col(text_col)).alias("size"), crc_of(F.col(text_col)).alias("text_crc32"), slot_of(F.col(id_col), crc_of(F.col(text_col)), n_slots=n_slots).alias("vslot"))


def place(rows: DataFrame, shard_map: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Adds shard, slot (a row's place in its shard), law and grown_shard to ``measured`` rows.

    Places are counted by cell: the counts of all cells (``N_CELLS`` rows a
    slot) give each cell its first place, so that no task holds a shard.
    """
    rows = rows.withColumn("__cell", cell_of(F.col(id_col), F.col("text_crc32")))
    counts = rows.groupBy("vslot", "__cell").agg(F.count(F.lit(1)).alias("n")).join(F.broadcast(shard_map), "vslot")  # one row a slot
    before = Window.partitionBy("shard").orderBy("vslot", "__cell").rowsBetween(Window.unboundedPreceding, -1)
    firsts = counts.select("vslot", "__cell", "shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__first"))
    within = Window.partitionBy("vslot", "__cell").orderBy(id_col, "text_crc32", "size")
    return (
        rows.withColumn("__n", F.row_number().over(within) - 1)
        .join(F.broadcast(firsts), ["vslot", "__cell"])  # N_CELLS rows a slot
        .withColumn("slot", (F.col("__first") + F.col("__n")).cast("long"))
        .withColumn("law", F.lit("bytes"))
        .withColumn("grown_shard", F.lit(None).cast("int"))
        .drop("__cell", "__n", "__first")
    )


def shard(docs: DataFrame, n_shards: int = 8, id_col: str = "doc_id", text_col: str = "text", keep: bool = True, n_slots: int = N_SLOTS, map_path: str | None = None) -> DataFrame:
    """``docs`` placed by version 1 of a slot map made for them and stored at ``map_path``.

    Without ``keep`` only the id and the figures remain; they are then written
    to the shared folder first, and the texts are read once.
    """
    spark = docs.sparkSession
    rows = measured(docs, id_col, text_col, keep, n_slots)
    if not keep:
        rows = cut(rows, "records")
    load = slot_bytes(rows, F.col("vslot"), F.col("size"))
    path = map_path or new_path(spark, "slotmap")
    save_map(spark, path, 1, make_map(load, n_shards, n_slots))
    return place(rows, load_map(spark, path, 1), id_col)
