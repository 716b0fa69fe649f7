"""Line dedup: a line that several documents hold stays in the first only.

Lines become 128-bit hashes of their keys (both ends stripped, A-Z lowered;
keys under ``min_chars`` are left alone). First occurrences by hash, salt of
the document and map task are found before anything is sorted, so a line that
a third of all documents hold gives ``N_SALTS`` rows at most. These are
range-partitioned by hash with a secondary sort by document and position, and
one pass over each range streams out the hashes that several documents hold
with the first of these. Every occurrence elsewhere is dropped; a line with very
many of them meets its owner where its occurrences are.

The result is not text but each document's keep bitmap, compressed to its runs
of kept lines; ``apply_runs`` turns text and bitmap into the kept text.

DataFrame operations only.

Edge cases: null or empty text is one empty line; a null id counts as one
document that comes last; rows with one id are one document, but each row
keeps its own lines; an empty table gives an empty result; extra columns are
left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleanery.llm._shared import KEYS, SPACE_CHARS, ascii_lower, cut, cut_with, join_few, join_hot, row_keys

N_SALTS, MIN_CHARS = 64, 10


def line_key(line: Column) -> Column:
    return ascii_lower(F.trim(line, F.lit(SPACE_CHARS)))


def hashed_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS) -> DataFrame:
    """The row keys, pos from 0, h1 and h2 of each line whose key counts."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(*[c.alias(k) for k, c in row_keys(id_col, text_col).items()], F.posexplode(F.split(text, "\n")).alias("pos", "line"))
    rows = rows.withColumn("line", line_key(F.col("line"))).where(F.length("line") >= min_chars)
    return rows.select(*KEYS, "pos", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit("second"), "line").alias("h2"))


def shared_keys(lines: DataFrame) -> DataFrame:
    """h1, h2, owner, m: the hashes that two ids or more hold, the smallest of them, and how many lines have each."""
    salt = F.pmod(F.xxhash64("__gl_id"), F.lit(N_SALTS))
    firsts = lines.groupBy("h1", "h2", salt.alias("salt")).agg(F.min(F.struct("__gl_id", "pos")).alias("first"), F.max("__gl_id").alias("last"), F.count(F.lit(1)).alias("m"))
    firsts = firsts.select("h1", "h2", F.col("first.__gl_id").alias("id"), F.col("first.pos").alias("pos"), "last", "m")
    ranged = firsts.repartitionByRange("h1", "h2").sortWithinPartitions("h1", "h2", "id", "pos")
    stream = Window.partitionBy("h1", "h2").orderBy("id", "pos")
    whole = stream.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)  # N_SALTS rows at most
    ranged = ranged.withColumns({"n": F.row_number().over(stream), "next": F.lead("id").over(stream), "m": F.sum("m").over(whole)})
    return ranged.where((F.col("n") == 1) & ((F.col("last") > F.col("id")) | F.col("next").isNotNull())).select("h1", "h2", F.col("id").alias("owner"), "m")


def keep_runs(dropped: Column, n: Column) -> Column:
    """Runs of kept positions (start, n) between sorted dropped ones, of ``n`` positions."""
    ends = F.concat(dropped, F.array(n))
    starts = F.concat(F.array(F.lit(-1)), dropped)
    runs = F.zip_with(starts, ends, lambda a, b: F.struct((a + 1).alias("start"), (b - a - 1).alias("n")))
    return F.filter(runs, lambda r: r["n"] > 0)


def keep_bitmaps(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS) -> DataFrame:
    """The row keys and dropped (sorted positions) of the texts that lose a line."""
    lines, seen = cut_with(hashed_lines(docs, id_col, text_col, min_chars), "lines", n=F.count(F.lit(1)))
    hits = join_hot(lines, cut(shared_keys(lines), "shared"), ["h1", "h2"], seen["n"]).where(F.col("__gl_id") != F.col("owner"))
    return hits.groupBy(*KEYS).agg(F.sort_array(F.collect_set("pos")).alias("dropped"))


def runs_text(runs: Column) -> Column:
    """A bitmap to read: first place and length of each run, as in ``0+3,5+2``."""
    return F.array_join(F.transform(runs, lambda r: F.concat(r["start"].cast("string"), F.lit("+"), r["n"].cast("string"))), ",")


def apply_runs(lines: Column, runs: Column) -> Column:
    return F.array_join(F.flatten(F.transform(runs, lambda r: F.slice(lines, r["start"] + 1, r["n"]))), "\n")


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS) -> DataFrame:
    """doc_id, n_lines, n_dropped, keep (compressed bitmap), kept_text of every row."""
    bitmaps = cut(keep_bitmaps(docs, id_col, text_col, min_chars), "bitmaps")
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = join_few(docs.select(F.col(id_col).alias("doc_id"), text.alias("text"), *[c.alias(k) for k, c in row_keys(id_col, text_col).items()]), bitmaps)
    rows = rows.withColumn("lines", F.split("text", "\n")).withColumn("n_lines", F.size("lines"))
    drops = F.col("dropped").isNotNull()
    rows = rows.withColumn("keep", F.when(drops, keep_runs(F.col("dropped"), F.col("n_lines"))).otherwise(F.array(F.struct(F.lit(0).alias("start"), F.col("n_lines").alias("n")))))
    return rows.select(
        "doc_id", F.col("n_lines").cast("long").alias("n_lines"), F.coalesce(F.size("dropped"), F.lit(0)).cast("long").alias("n_dropped"), "keep",
        F.when(drops, apply_runs(F.col("lines"), F.col("keep"))).otherwise(F.col("text")).alias("kept_text"),
    )
