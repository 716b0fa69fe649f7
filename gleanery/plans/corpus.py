"""The corpus relation that all operators work on.

Columns: id (string), size (long, bytes), mime (string, the stratum),
cluster (string, the parent directory), text (string) - and mtime where known.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def from_table(frame: DataFrame, id_col: str, text_col: str, stratum: str | Column | None = None, cluster: str | Column | None = None, mtime: str | None = None) -> DataFrame:
    """A corpus from any table with an id and a text column."""
    pick = lambda c, other: F.lit(other) if c is None else F.col(c) if isinstance(c, str) else c
    columns = [
        F.col(id_col).cast("string").alias("id"), F.octet_length(text_col).cast("long").alias("size"), pick(stratum, "text/plain").alias("mime"),
        pick(cluster, "").alias("cluster"), F.col(text_col).alias("text"),
    ]
    if mtime:
        columns.append(F.col(mtime).alias("mtime"))
    return frame.select(*columns)


def documents(frame: DataFrame) -> DataFrame:
    """The documents table as a corpus: language is the stratum, source the directory. The id stays a long."""
    return frame.select(F.col("doc_id").alias("id"), F.octet_length("text").cast("long").alias("size"), F.col("lang").alias("mime"), F.col("source").alias("cluster"), "text")
