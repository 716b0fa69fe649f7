"""Encodings of raw bytes: UTF-8 in the engine, the rest with a detector."""

from __future__ import annotations

import codecs
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# How codec names are shown.
SHOWN = {"ascii": "utf-8", "utf-8-sig": "utf-8", "cp1252": "windows-1252", "iso8859-1": "iso-8859-1", "iso8859-15": "iso-8859-15"}


def canonical(name: str | None) -> str:
    if not name:
        return "unknown"
    try:
        known = codecs.lookup(name).name
    except LookupError:
        known = name.lower()
    return SHOWN.get(known, known)


def canonical_column(name: Column) -> Column:
    return F.pandas_udf(lambda s: s.map(canonical), "string")(name)


def head_bytes(raw: bytes, max_bytes: int | None) -> bytes:
    """The first bytes of a file, never the beginning of a UTF-8 character only; without a limit all."""
    if not max_bytes or len(raw) <= max_bytes:
        return raw
    end = max_bytes
    while end > max(0, max_bytes - 4) and raw[end] & 0xC0 == 0x80:
        end -= 1
    return raw[:end]


def detect_bytes(raw: bytes) -> tuple[str, str, float]:
    """Text, encoding and confidence."""
    try:
        return raw.decode("utf-8"), "utf-8", 1.0
    except UnicodeDecodeError:
        pass
    try:
        from charset_normalizer import from_bytes

        best = from_bytes(raw).best()
        if best is not None:
            return str(best), canonical(best.encoding), round(1.0 - best.chaos, 4)
    except ImportError:
        pass
    return raw.decode("utf-8", "replace"), "utf-8", 0.0


def _head(raw: Column, max_bytes: int | None) -> Column:
    """``head_bytes`` as a column: the part's bytes before the last character's begin are in UTF-8's first or only bytes."""
    if not max_bytes:
        return raw
    goes_on = lambda k: F.hex(F.substring(raw, max_bytes + 1 - k, 1)).rlike("^[89AB]")
    back = F.when(~goes_on(0), 0).when(~goes_on(1), 1).when(~goes_on(2), 2).when(~goes_on(3), 3).otherwise(4)
    return F.when(F.length(raw) <= max_bytes, raw).otherwise(F.substr(raw, F.lit(1), F.lit(max_bytes) - back))


def decode(files: DataFrame, content: str = "content", max_bytes: int | None = None) -> DataFrame:
    """Replaces bytes with text, encoding, enc_confidence; only what is not UTF-8 goes to Python. Reads the first ``max_bytes``, or all."""
    cut = _head(F.col(content), max_bytes)
    valid = F.is_valid_utf8(cut.cast("string"))

    @F.pandas_udf("text string, encoding string, enc_confidence double")
    def by_detector(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in batches:
            yield pd.DataFrame([detect_bytes(bytes(b)) if b is not None else (None, None, None) for b in s], columns=["text", "encoding", "enc_confidence"])

    rest = [c for c in files.columns if c != content]
    plain = files.where(valid).select(*rest, cut.cast("string").alias("text"), F.lit("utf-8").alias("encoding"), F.lit(1.0).alias("enc_confidence"))
    other = files.where(~valid).select(*rest, by_detector(cut).alias("d")).select(*rest, "d.*")
    return plain.unionByName(other)


def distribution(decoded: DataFrame) -> DataFrame:
    return decoded.groupBy("encoding").agg(F.count(F.lit(1)).alias("n_files"))
