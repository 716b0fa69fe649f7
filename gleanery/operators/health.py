"""Health rules: empty, near-empty, unreadable, corrupt, encrypted, truncated, ok.

Rules for content are one CASE over binary columns; what needs a container
parsed (zip flags, OOXML integrity, encrypted Office) comes from
``gleanery.sources.health`` as extra columns where files are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NEAR_EMPTY = 50

# First bytes by type.
SIGNATURES = {
    "application/pdf": [b"%PDF"], "application/zip": [b"PK\x03\x04", b"PK\x05\x06"], "image/png": [b"\x89PNG"], "image/jpeg": [b"\xff\xd8\xff"],
    "image/gif": [b"GIF87a", b"GIF89a"], "application/gzip": [b"\x1f\x8b"],
}
STATUSES = ["ok", "empty", "near_empty", "corrupt", "encrypted_pdf", "encrypted_zip", "encrypted_office", "truncated", "unreadable"]


def bytes_lit(value: bytes) -> Column:
    return F.unhex(F.lit(value.hex()))


def head(content: Column, n: int) -> Column:
    return F.substring(content, 1, n)


def tail(content: Column, n: int) -> Column:
    return F.when(F.octet_length(content) <= n, content).otherwise(F.substring(content, -n, n))


def has(content: Column, value: bytes) -> Column:
    """Whether bytes hold other bytes; on hex digits, at an even place."""
    return F.coalesce(F.contains(content, bytes_lit(value)), F.lit(False))


def begins(content: Column, *values: bytes) -> Column:
    out = F.lit(False)
    for v in values:
        out = out | F.startswith(content, bytes_lit(v))
    return F.coalesce(out, F.lit(False))


def text_status() -> Column:
    """The status of a text by the size rules, from columns text and size."""
    return F.when(F.col("text").isNull(), "unreadable").when(F.col("size") == 0, "empty").when(F.col("size") <= NEAR_EMPTY, "near_empty").otherwise("ok")


def text_health(corpus: DataFrame) -> DataFrame:
    """id, status, is_degraded of texts: the size rules, and over a tenth of replacement characters."""
    lost = F.length("text") - F.length(F.replace("text", F.lit("\ufffd"), F.lit("")))
    return corpus.select("id", text_status().alias("status"), F.coalesce(lost > 0.1 * F.length("text"), F.lit(False)).alias("is_degraded"))


def file_health(files: DataFrame) -> DataFrame:
    """path, size, mime, status, detail of files (path, size, mime, content; zip_encrypted, office_encrypted, ooxml_error if known)."""
    content, size, mime = F.col("content"), F.col("size"), F.col("mime")
    known = lambda name, other: F.col(name) if name in files.columns else F.lit(other)
    mismatch = F.lit(False)
    for kind, firsts in SIGNATURES.items():
        mismatch = mismatch | ((mime == kind) & ~begins(content, *firsts))
    pdf, zipped = begins(content, b"%PDF"), begins(content, b"PK\x03\x04")
    ooxml = mime.startswith("application/vnd.openxmlformats-officedocument")
    ooxml_error = known("ooxml_error", None).cast("string")
    rules = [
        (size == 0, "empty", F.lit("File is empty (0 bytes)")),
        (size <= NEAR_EMPTY, "near_empty", F.format_string("File is very small (%d bytes)", size)),
        (content.isNull(), "unreadable", F.lit("Content cannot be read")),
        (mismatch, "corrupt", F.concat(F.lit("Header mismatch for "), mime)),
        (pdf & (has(head(content, 4096), b"/Encrypt") | has(tail(content, 4096), b"/Encrypt")), "encrypted_pdf", F.lit("PDF is encrypted")),
        (zipped & known("zip_encrypted", False), "encrypted_zip", F.lit("Archive has encrypted members")),
        (known("office_encrypted", False), "encrypted_office", F.lit("Office file is encrypted")),
        (pdf & ~has(tail(content, 1024), b"%%EOF"), "truncated", F.lit("PDF has no end marker")),
        (zipped & ooxml & ooxml_error.isNotNull(), "corrupt", F.concat(F.lit("OOXML integrity: "), ooxml_error)),
        ((mime == "image/jpeg") & (size >= 16) & ~has(tail(content, 64), b"\xff\xd9"), "truncated", F.lit("JPEG has no end marker")),
        ((mime == "image/png") & (size >= 16) & ~has(tail(content, 64), b"IEND"), "truncated", F.lit("PNG has no end marker")),
    ]
    status, detail = None, None
    for test, name, why in rules:
        status = F.when(test, F.lit(name)) if status is None else status.when(test, F.lit(name))
        detail = F.when(test, why) if detail is None else detail.when(test, why)
    out = files.withColumns({"status": status.otherwise("ok"), "detail": detail.otherwise("")})
    return out.select("path", "size", F.when(F.col("status") == "empty", "").otherwise(mime).alias("mime"), "status", "detail")


def health_tally(health: DataFrame) -> DataFrame:
    """One row of counters; the three kinds of encryption are one."""
    n = lambda *names: F.count_if(F.col("status").isin(*names))
    return health.agg(
        F.count(F.lit(1)).alias("total_checked"), n("ok").alias("n_ok"), n("empty").alias("n_empty"), n("near_empty").alias("n_near_empty"), n("corrupt").alias("n_corrupt"),
        n("encrypted_pdf", "encrypted_zip", "encrypted_office").alias("n_encrypted"), n("truncated").alias("n_truncated"), n("unreadable").alias("n_unreadable"),
    )
