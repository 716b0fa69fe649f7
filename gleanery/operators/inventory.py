"""Inventory: types, extensions, sizes, ages and directories of a corpus."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanery.functions.paths import depth, extension, parent

KB, MB, DAY = 1024, 1024 * 1024, 86400

# Bucket labels with lower bounds, each up to the next.
SIZE_BUCKETS = [("<1 KB", 0), ("1-10 KB", KB), ("10-100 KB", 10 * KB), ("100 KB-1 MB", 100 * KB), ("1-10 MB", MB), ("10-100 MB", 10 * MB), (">100 MB", 100 * MB)]
AGE_BUCKETS = [("<1 day", 0), ("1-7 days", DAY), ("7-30 days", 7 * DAY), ("1-6 months", 30 * DAY), ("6-12 months", 180 * DAY), (">1 year", 365 * DAY)]
PAGE_BUCKETS = [("1 page", 1), ("2-5 pages", 2), ("6-10 pages", 6), ("11-50 pages", 11), ("51-100 pages", 51), ("101-500 pages", 101), (">500 pages", 501)]


def bucket(value: Column, buckets: list[tuple[str, int]]) -> Column:
    """The number of the bucket of a value; null below the first."""
    out = None
    for k, (_, low) in reversed(list(enumerate(buckets))):
        out = F.when(value >= low, F.lit(k)) if out is None else out.when(value >= low, F.lit(k))
    return out


def histogram(rows: DataFrame, value: Column, buckets: list[tuple[str, int]]) -> DataFrame:
    """bucket_ord, label, n, total of every bucket, empty ones included."""
    spark = rows.sparkSession
    known = spark.createDataFrame([(k, label) for k, (label, _) in enumerate(buckets)], "bucket_ord int, label string")
    counted = rows.select(bucket(value, buckets).alias("bucket_ord"), value.alias("v")).groupBy("bucket_ord").agg(F.count(F.lit(1)).alias("n"), F.sum("v").alias("total"))
    return known.join(counted, "bucket_ord", "left").select("bucket_ord", "label", F.coalesce("n", F.lit(0)).cast("long").alias("n"), F.coalesce("total", F.lit(0)).cast("long").alias("total"))


def type_distribution(corpus: DataFrame) -> DataFrame:
    """mime, n_files, total_bytes, avg_bytes (floored), pct of files."""
    per = corpus.groupBy("mime").agg(F.count(F.lit(1)).alias("n_files"), F.sum("size").cast("long").alias("total_bytes"))
    whole = per.agg(F.sum("n_files").alias("whole"))
    return per.crossJoin(F.broadcast(whole)).select("mime", "n_files", "total_bytes", F.floor(F.col("total_bytes") / F.col("n_files")).cast("long").alias("avg_bytes"), F.round(100.0 * F.col("n_files") / F.col("whole"), 4).alias("pct"))  # one row


def extension_counts(files: DataFrame, path: str = "path") -> DataFrame:
    return files.groupBy(extension(F.col(path)).alias("extension")).agg(F.count(F.lit(1)).alias("n_files"))


def size_histogram(corpus: DataFrame) -> DataFrame:
    return histogram(corpus, F.col("size"), SIZE_BUCKETS)


def size_stats(corpus: DataFrame) -> DataFrame:
    """One row: n_files, min, max, median (truncated), mean (2 places), total."""
    return corpus.agg(
        F.count("size").alias("n_files"), F.min("size").alias("min_bytes"), F.max("size").alias("max_bytes"), F.percentile("size", F.lit(0.5)).cast("long").alias("median_bytes"),
        F.round(F.avg("size"), 2).alias("mean_bytes"), F.sum("size").cast("long").alias("total_bytes"),
    )


def age_histogram(rows: DataFrame, mtime: str, now: Column) -> DataFrame:
    """Counts by age at ``now``; times after it are in no bucket."""
    age = F.unix_timestamp(now) - F.unix_timestamp(F.col(mtime).cast("timestamp"))
    return histogram(rows, age, AGE_BUCKETS).select("bucket_ord", "label", "n")


def age_range(rows: DataFrame, mtime: str) -> DataFrame:
    return rows.agg(F.min(mtime).alias("oldest"), F.max(mtime).alias("newest"))


def directory_structure(files: DataFrame, path: str = "path") -> DataFrame:
    """One row: directories with files, files, depth of files (max, mean), files a directory (max, mean)."""
    per = files.groupBy(parent(F.col(path)).alias("dir")).agg(F.count(F.lit(1)).alias("n"), F.max(depth(F.col(path))).alias("deep"), F.sum(depth(F.col(path))).alias("sum_deep"))
    return per.agg(
        F.count(F.lit(1)).alias("n_dirs"), F.sum("n").cast("long").alias("n_files"), F.max("deep").alias("max_depth"), F.round(F.sum("sum_deep") / F.sum("n"), 4).alias("avg_depth"),
        F.max("n").alias("max_breadth"), F.round(F.avg("n"), 4).alias("avg_breadth"),
    )
