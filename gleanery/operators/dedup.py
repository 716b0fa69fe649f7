"""Exact duplicates by content hash."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def hashed(corpus: DataFrame, content: Column | None = None) -> DataFrame:
    """id, size, hash of each row with content. Hashing happens where the content is, before any shuffle."""
    content = F.col("text") if content is None else content
    return corpus.where(content.isNotNull()).select("id", "size", F.sha2(content, 256).alias("hash"))


def group_sizes(hashes: DataFrame) -> DataFrame:
    """hash, size, n, first_id of every distinct content; constant space a group however many copies."""
    return hashes.groupBy("hash", "size").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first_id"))


def duplicate_groups(hashes: DataFrame) -> DataFrame:
    """hash, size, n, first_id, wasted_bytes of contents that two rows or more have."""
    return group_sizes(hashes).where("n > 1").withColumn("wasted_bytes", F.col("size") * (F.col("n") - 1))


def members(hashes: DataFrame) -> DataFrame:
    """id, hash, first_id of rows in a duplicate group."""
    return hashes.join(duplicate_groups(hashes).select("hash", "first_id"), "hash").select("id", "hash", "first_id")


def dedup_summary(hashes: DataFrame) -> DataFrame:
    """One row of figures; every member of a group counts as a duplicate."""
    dup = F.col("n") > 1
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    out = group_sizes(hashes).agg(
        zero(F.sum("n")).alias("total_hashed"), zero(F.count_if(~dup)).alias("unique_files"), zero(F.count_if(dup)).alias("duplicate_groups"),
        zero(F.sum(F.when(dup, F.col("n")))).alias("duplicate_files"), zero(F.sum(F.when(dup, F.col("size") * (F.col("n") - 1)))).alias("duplicate_bytes"),
    )
    pct = F.when(F.col("total_hashed") > 0, 100.0 * F.col("duplicate_files") / F.col("total_hashed")).otherwise(0.0)
    return out.withColumn("duplicate_pct", F.round(pct, 4))


def top_groups(hashes: DataFrame, k: int = 10) -> DataFrame:
    """The k groups that waste most."""
    return duplicate_groups(hashes).orderBy(F.desc("wasted_bytes"), "first_id").limit(k)
