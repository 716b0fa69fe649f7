"""Mixing sources to target weights along a curriculum.

Every source has a weight that changes linearly over training time t in
[0, 1]. Its integral is the source's share of all words; where the share is
over ``max_repeats`` times what the source has, the excess goes to the others
by weight until none is above. The cumulative demand of a source up to time t,
inverted at the words that come before a document in the source's own order,
gives the document's training position - one for each time it is taken.

Documents are taken whole, in the source's order while they fit; one more then
is the document nearest in size to the words that are missing.

Order within a source is by a hash of the id, so reruns agree. It is cut into
``2**CELL_BITS`` cells by the hash's first bits; cell totals are summed first,
so that no task holds a whole source, however large.

DataFrame operations only.

Edge cases: null text has size 0 and is taken 0 words; a null source is a
source of its own, the last; a null id orders like the text 'null'; repeated
rows are documents of their own (they tie, in any order, with equal sizes);
an empty table gives an empty result; extra columns are left out.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleanery.llm._shared import KEYS, cut, row_keys, set_apart, words

CELL_BITS = 12
#: Weights of the sources in order, repeating, and how far each class's weight
#: runs over training: -0.5 falls from 1.5 to 0.5 of its mean, 0.5 rises.
WEIGHTS, SLOPES, MAX_REPEATS = (1.0, 2.0, 3.0), (-0.5, 0.0, 0.5), 3


def _pick(values: Sequence[float], at: Column) -> Column:
    return F.element_at(F.array(*[F.lit(float(v)) for v in values]), (at % len(values) + 1).cast("int"))


def source_targets(sized: DataFrame, weights: Sequence[float] = WEIGHTS, slopes: Sequence[float] = SLOPES, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """One row a source: sk, source_size, weight, slope, target.

    With sources sorted by cap / weight, the level L at which all targets are
    min(cap, L * weight) is found at the first source that its own level does
    not cap; windows over the table of sources do it without a loop.
    """
    one = Window.partitionBy(F.lit(1))
    per = sized.groupBy("sk").agg(F.sum("size").alias("source_size"), F.first("source", ignorenulls=True).alias("source"))
    per = per.withColumn("rank", F.row_number().over(one.orderBy(F.col("source").asc_nulls_last())) - 1)
    per = per.withColumns({"weight": _pick(weights, F.col("rank")), "slope": _pick(slopes, F.col("rank")), "cap": F.col("source_size") * float(max_repeats)})
    per = per.withColumn("ratio", F.col("cap") / F.col("weight"))
    before = one.orderBy("ratio", "rank").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0.0)
    per = per.withColumns(
        {
            "level": (F.sum("source_size").over(one) - F.coalesce(F.sum("cap").over(before), zero)) / (F.sum("weight").over(one) - F.coalesce(F.sum("weight").over(before), zero)),
            "at": F.row_number().over(one.orderBy("ratio", "rank")),
        }
    )
    first = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("at", "level"))).over(one)["level"]
    return per.withColumn("target", F.least("cap", F.coalesce(first, zero) * F.col("weight"))).select("sk", "source_size", "weight", "slope", "target")


def position_at(share: Column, slope: Column) -> Column:
    """The time at which a linear weight 1 + slope * (2t - 1) has used ``share`` of its integral."""
    a, b = slope, 1 - slope
    return F.when(F.abs(a) < 1e-9, share).otherwise((F.sqrt(F.greatest(b * b + 4 * a * share, F.lit(0.0))) - b) / (2 * a))


def assign(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: Sequence[float] = WEIGHTS, slopes: Sequence[float] = SLOPES, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """One row a document: doc_id, row keys, source, sk (source, never null), size, source_size, target, n_takes, taken, positions (one a take)."""
    keys = [c.alias(k) for k, c in row_keys(id_col, text_col).items()]
    sized = docs.select(F.col(id_col).alias("doc_id"), *keys, F.col(source_col).cast("string").alias("source"), F.size(words(F.col(text_col))).cast("long").alias("size"))
    bits = F.conv(F.substring(F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit("|mix"))), 1, 15), 16, 10).cast("long")
    sized = cut(sized.withColumns({"sk": F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n")), "h": bits, "cell": F.shiftright(bits, 60 - CELL_BITS).cast("int")}), "sizes")
    cells = sized.groupBy("sk", "cell").agg(F.sum("size").alias("cell_size"))
    before = Window.partitionBy("sk").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.withColumn("start", F.coalesce(F.sum("cell_size").over(before), F.lit(0))).drop("cell_size")
    cells = cells.join(source_targets(sized, weights, slopes, max_repeats), "sk")
    within = Window.partitionBy("sk", "cell").orderBy("h", "doc_id", "size", "__gl_row")
    out = sized.join(cells, ["sk", "cell"]).withColumns({"at": F.row_number().over(within), "before": F.col("start") + F.coalesce(F.sum("size").over(within.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))})
    whole = F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(max_repeats))).otherwise(F.lit(0)).cast("long")
    out = out.withColumn("whole", whole).withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))
    out = cut(out.withColumn("fits", (F.col("size") > 0) & (F.col("before") + F.col("size") <= F.col("rest"))), "ordered")
    # the words still missing, and the one document more that comes nearest to them
    gaps = out.groupBy("sk").agg((F.max("rest") - F.coalesce(F.max(F.when(F.col("fits"), F.col("before") + F.col("size"))), F.lit(0))).alias("gap"))
    gaps = out.select("sk", "cell").distinct().join(gaps, "sk")  # by cell, so that no source is one group
    spare = out.where(~F.col("fits") & (F.col("size") > 0) & (F.col("whole") < max_repeats)).join(gaps, ["sk", "cell"])
    miss = F.abs(F.col("size") - F.col("gap"))
    more = spare.where(miss < F.col("gap")).groupBy("sk").agg(F.min(F.struct(miss.alias("miss"), "h", "doc_id", "cell", "at")).alias("m")).select("sk", "m.cell", "m.at", F.lit(1).alias("more"))
    out = out.join(more, ["sk", "cell", "at"], "left")
    out = out.withColumn("n_takes", F.when(F.col("size") > 0, F.col("whole") + F.when(F.col("fits"), 1).otherwise(F.coalesce("more", F.lit(0)))).otherwise(F.lit(0)).cast("int"))
    takes = F.sequence(F.lit(0), F.col("n_takes") - 1)
    shares = F.transform(takes, lambda k: position_at(F.least((k * F.col("source_size") + F.col("before") + F.col("size") / 2) / F.col("target"), F.lit(1.0)), F.col("slope")))
    return out.select(
        "doc_id", *KEYS, "source", "sk", "size", "source_size", F.col("target").cast("double").alias("target"), "n_takes", (F.col("size") * F.col("n_takes")).alias("taken"),
        F.when(F.col("n_takes") > 0, shares).otherwise(F.array().cast("array<double>")).alias("positions"),
    )


def in_training_order(docs: DataFrame, assigned: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The columns of ``docs``, a row for each take, range-sorted by position.

    Rows that agree in id, text and source are copies: the takes of all of
    them go to one of the rows.
    """
    keys = [*KEYS, "__gl_source"]
    own, back = set_apart(docs)
    named = own.withColumns({**row_keys(id_col, text_col), "__gl_source": F.coalesce(F.concat(F.lit("s"), F.col(source_col).cast("string")), F.lit("n"))})
    if not assigned.groupBy(*KEYS, "sk").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty():
        named = named.dropDuplicates(keys)
    takes = assigned.where("n_takes > 0").select(*KEYS, F.col("sk").alias("__gl_source"), F.explode("positions").alias("__gl_at"))
    return named.join(takes, keys).repartitionByRange("__gl_at", *KEYS).sortWithinPartitions("__gl_at", *KEYS).select(*own.columns).withColumnsRenamed(back)
