"""Incremental scans: new documents as a stream (an addition of this library)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanery.operators import health


def first_seen(stream: DataFrame, time_col: str, watermark: str = "1 day") -> DataFrame:
    """Documents whose content has not come before within the watermark."""
    return stream.withColumn("hash", F.sha2(F.coalesce("text", F.lit("")), 256)).withWatermark(time_col, watermark).dropDuplicatesWithinWatermark(["hash"])


def health_by_window(stream: DataFrame, time_col: str, watermark: str = "1 hour", window: str = "10 minutes") -> DataFrame:
    """Counts of each health status in tumbling windows; late rows up to the watermark count."""
    size = F.coalesce(F.octet_length("text"), F.lit(0))
    status = F.when(F.col("text").isNull(), "unreadable").when(size == 0, "empty").when(size <= health.NEAR_EMPTY, "near_empty").otherwise("ok")
    rows = stream.withWatermark(time_col, watermark).withColumn("status", status)
    return rows.groupBy(F.window(time_col, window).alias("w"), "status").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("window_start"), "status", "n")
