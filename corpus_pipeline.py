"""From raw documents to mixed, sharded training data, in stages.

Each stage works on what the one before kept and returns the columns of
``documents``; the last adds where a row goes.

Edge cases, for all stages: null or empty texts fail the base rules of the
first stage; rows with a null id are one document to near-duplicates, so of
those that are linked through the shared id one stays; rows that repeat a row
become one; texts and words may be of any length; null languages and sources
are values of their own; extra columns go along (the last stage replaces those
that have the names of its own); an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gleanery.llm import decontaminate, mixing, near_dup, quality, sharding
from gleanery.llm._shared import cut
from gleanery.session import table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts that fail the base rules or are far outliers among their like go."""
    return quality.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One text of each group of near copies stays."""
    return near_dup.keep_firsts(docs)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with a passage of a benchmark item go."""
    return decontaminate.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts are left out or repeated to meet the sources' targets, in training order."""
    assigned = cut(mixing.assign(docs), "assigned")
    return mixing.in_training_order(docs, assigned)


def into_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows get a shard of 8 and a place in it."""
    return sharding.shard(docs, n_shards=8)


STAGES = [
    ("quality rules", quality_rules),
    ("near-duplicates", near_duplicates),
    ("benchmark leaks", benchmark_leaks),
    ("mixing sources", mix_sources),
    ("sharding", into_shards),
]

#: SQL cannot express the robust estimate of the first stage or the links of the second.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
