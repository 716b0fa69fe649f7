"""Mojibake flags and readability scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MOJIBAKE_MIN, READ_MIN, LOW_SCORE = 20, 200, 30.0

# What UTF-8 read as a one-byte encoding looks like, lost characters, and C1 controls.
DAMAGE = {
    "double_encoded": "[\\x{C2}\\x{C3}][\\x{80}-\\x{BF}]",
    "punctuation": "\\x{E2}\\x{20AC}[\\x{80}-\\x{BF}\\x{2122}\\x{153}\\x{2DC}\\x{A2}\\x{201C}\\x{201D}]",
    "replacement": "\\x{FFFD}",
    "c1_control": "[\\x{80}-\\x{9F}]",
}


def head(text: Column, max_chars: int | None) -> Column:
    """The first characters of a text; without a limit the whole text."""
    return F.substring(text, 1, max_chars) if max_chars else text


def damage(text: Column) -> dict[str, Column]:
    return {name: text.rlike(regex) for name, regex in DAMAGE.items()}


def is_damaged(text: Column) -> Column:
    """Any kind of damage, in texts long enough to tell."""
    any_of = F.lit(False)
    for c in damage(text).values():
        any_of = any_of | c
    return F.coalesce((F.length(text) >= MOJIBAKE_MIN) & any_of, F.lit(False))


def mojibake(corpus: DataFrame, max_chars: int | None = None) -> DataFrame:
    """id, a flag for each kind of damage, is_damaged, of texts long enough to tell; of their first ``max_chars`` characters, or in whole."""
    rows = corpus.where(F.length("text") >= MOJIBAKE_MIN).select("id", head(F.col("text"), max_chars).alias("t"))
    rows = rows.select("id", *[c.alias(n) for n, c in damage(F.col("t")).items()])
    any_of = F.lit(False)
    for n in DAMAGE:
        any_of = any_of | F.col(n)
    return rows.withColumn("is_damaged", any_of)


def round_trip_repairs(text: Column) -> Column:
    """Text read again as UTF-8 from its one-byte form, where that is possible and changes it; else null."""
    raw = F.encode(text, "ISO-8859-1")
    fits = ~text.rlike("[^\\x{00}-\\x{FF}]")
    back = F.try_validate_utf8(F.decode(raw, "UTF-8")) if hasattr(F, "try_validate_utf8") else F.decode(raw, "UTF-8")
    return F.when(fits & F.is_valid_utf8(raw.cast("string")) & (back != text), back)


def flesch(text: Column) -> Column:
    """206.835 - 1.015 words a sentence - 84.6 syllables a word; vowel groups count as syllables."""
    words = F.greatest(F.regexp_count(text, F.lit("[\\p{L}\\p{N}]+")), F.lit(1))
    sentences = F.greatest(F.regexp_count(text, F.lit("[.!?]+")), F.lit(1))
    syllables = F.greatest(F.regexp_count(F.lower(text), F.lit("[aeiouy\\x{E0}-\\x{FF}]+")), F.lit(1))
    return 206.835 - 1.015 * (words / sentences) - 84.6 * (syllables / words)


def readability(corpus: DataFrame, max_chars: int | None = None) -> DataFrame:
    """id, flesch (unrounded), is_low_quality of texts long enough to score; by their first ``max_chars`` characters, or in whole."""
    rows = corpus.where(F.length(F.trim("text")) >= READ_MIN).select("id", flesch(head(F.col("text"), max_chars)).alias("flesch"))
    return rows.withColumn("is_low_quality", F.col("flesch") < LOW_SCORE)


def readability_summary(scores: DataFrame) -> DataFrame:
    return scores.agg(F.count(F.lit(1)).alias("n_scored"), F.round(F.avg("flesch"), 1).alias("avg_flesch"), F.count_if("is_low_quality").alias("n_low_quality"))
