"""Connected components of links between rows."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """The session's shared folder; where none is set, one of this machine in local mode (tests), an error on a cluster."""
    if not (spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()):
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="gleanery-"))


def connected_components(links: DataFrame) -> DataFrame:
    """id, cluster_id (the least id that can be reached) of every id in links (a, b).

    Alternating large-star and small-star steps: the number of rows never
    grows, hubs are reduced by partial aggregation, and the number of rounds
    is logarithmic. Each round ends in a reliable checkpoint.
    """
    ensure_checkpoint_dir(links.sparkSession)
    now = links.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct().checkpoint()
    before = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        hung = large.join(least, "u")
        small = hung.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(hung.select("u", F.col("m").alias("v"))).where("u != v").distinct().checkpoint()
        state = small.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        if state == before:
            roots = small.select(F.col("v").alias("id"), F.col("v").alias("cluster_id")).distinct()
            return small.select(F.col("u").alias("id"), F.col("v").alias("cluster_id")).unionByName(roots)
        now, before = small, state
