"""Exact-size stratified samples and the design effect of clustering.

Order within a stratum is by md5 of seed and id: every engine and every run
takes the same rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleanery.functions.wilson import auto_rate


def draw(seed: int, id_: Column) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}|"), id_.cast("string")))


def targets(corpus: DataFrame, rate: float | None = None, min_per_type: int = 30) -> DataFrame:
    """mime, population, target of each stratum; without a rate, the automatic one."""
    per = corpus.groupBy("mime").agg(F.count(F.lit(1)).alias("population"))
    if rate is None:
        per = per.crossJoin(F.broadcast(per.agg(auto_rate(F.sum("population")).alias("rate"))))  # one row
    else:
        per = per.withColumn("rate", F.lit(float(rate)))
    floor = F.least(F.lit(min_per_type), F.col("population"))
    wanted = F.greatest(F.ceil(F.round(F.col("population") * F.col("rate"), 9)), floor)
    return per.select("mime", "population", F.least("population", F.when(F.col("rate") >= 1, F.col("population")).otherwise(wanted)).cast("long").alias("target"))


def stratified_sample(corpus: DataFrame, rate: float | None = None, min_per_type: int = 30, seed: int = 42, cells: int = 256) -> DataFrame:
    """The rows of ``corpus`` in the sample.

    A stratum is cut into cells by the first byte of the draw; counts by cell
    say which are in, which are out, and how many rows the one between gives,
    so no task sorts a stratum.
    """
    t = targets(corpus, rate, min_per_type).select("mime", "target")
    drawn = corpus.withColumn("__d", draw(seed, F.col("id"))).withColumn("__cell", F.substring("__d", 1, 2 if cells <= 256 else 4))
    before = Window.partitionBy("mime").orderBy("__cell").rowsBetween(Window.unboundedPreceding, -1)
    per = drawn.groupBy("mime", "__cell").agg(F.count(F.lit(1)).alias("n")).withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
    quota = per.join(t, per["mime"].eqNullSafe(t["mime"])).select(per["mime"].alias("__m"), "__cell", (F.col("target") - F.col("before")).alias("__quota")).where("__quota > 0").withColumnRenamed("__cell", "__c")
    rank = F.row_number().over(Window.partitionBy("mime", "__cell").orderBy("__d", "id"))
    taken = drawn.join(quota, F.col("mime").eqNullSafe(F.col("__m")) & (F.col("__cell") == F.col("__c"))).withColumn("__rank", rank)
    return taken.where(F.col("__rank") <= F.col("__quota")).select(*corpus.columns)


def directory_allocation(corpus: DataFrame, rate: float | None = None, min_per_type: int = 30) -> DataFrame:
    """mime, cluster, n, alloc: each stratum's target dealt to directories in proportion.

    Shares are rounded half to even, at least 1, in order of directory while
    the target lasts; what is left goes to the directories with most files.
    """
    per = corpus.groupBy("mime", "cluster").agg(F.count(F.lit(1)).alias("n")).join(targets(corpus, rate, min_per_type), "mime")
    share = F.least(F.greatest(F.lit(1), F.expr("bround(n * 1.0D / population * target)")).cast("long"), F.col("n"))
    by_dir = Window.partitionBy("mime").orderBy("cluster").rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumn("want", share)
    per = per.withColumn("first", F.greatest(F.lit(0), F.least("want", F.col("target") - F.coalesce(F.sum("want").over(by_dir), F.lit(0)))))
    left = F.col("target") - F.sum("first").over(Window.partitionBy("mime"))
    by_size = Window.partitionBy("mime").orderBy(F.desc("n"), "cluster").rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumn("left", left).withColumn("room", F.col("n") - F.col("first"))
    extra = F.greatest(F.lit(0), F.least("room", F.col("left") - F.coalesce(F.sum("room").over(by_size), F.lit(0))))
    return per.select("mime", "cluster", "n", (F.col("first") + extra).cast("long").alias("alloc"))


def directory_sample(corpus: DataFrame, rate: float | None = None, min_per_type: int = 30, seed: int = 42) -> DataFrame:
    """The rows of the sample with the allocation by directory."""
    alloc = directory_allocation(corpus, rate, min_per_type).select("mime", "cluster", "alloc")
    rank = F.row_number().over(Window.partitionBy("mime", "cluster").orderBy(draw(seed, F.col("id")), "id"))
    return corpus.withColumn("__rank", rank).join(alloc, ["mime", "cluster"]).where(F.col("__rank") <= F.col("alloc")).select(*corpus.columns)


def design_effect(corpus: DataFrame) -> DataFrame:
    """One row: n, k clusters, rho, deff; one-way analysis of variance of log1p(size) by cluster.

    Clusters are reduced to count, mean and variance first, which are merged
    in one more step.
    """
    y = F.log1p(F.col("size").cast("double"))
    per = corpus.groupBy("cluster").agg(F.count("size").alias("m"), F.avg(y).alias("mean"), (F.var_pop(y) * F.count("size")).alias("within"))
    whole = per.agg(F.sum("m").alias("n"), F.count(F.lit(1)).alias("k"), (F.sum(F.col("m") * F.col("mean")) / F.sum("m")).alias("grand"), F.sum("within").alias("ssw"))
    between = per.crossJoin(F.broadcast(whole.select("grand"))).agg(F.sum(F.col("m") * F.pow(F.col("mean") - F.col("grand"), F.lit(2))).alias("ssb"))  # one row
    out = whole.crossJoin(F.broadcast(between))
    m = F.col("n") / F.col("k")
    degenerate = (F.col("n") < 2) | (F.col("k") <= 1) | (F.col("k") == F.col("n"))
    msb, msw = F.col("ssb") / F.nullif(F.col("k") - 1, F.lit(0)), F.col("ssw") / F.nullif(F.col("n") - F.col("k"), F.lit(0))
    below = msb + (m - 1) * msw
    rho = F.when(degenerate | (below == 0), 0.0).otherwise(F.greatest(F.lit(0.0), (msb - msw) / F.nullif(below, F.lit(0.0))))
    return out.select(F.col("n").cast("long").alias("n"), "k", rho.alias("rho"), F.greatest(F.lit(1.0), 1 + rho * (m - 1)).alias("deff"))
