"""Report tables as DataFrames: files, findings, gate, summary, top-k rollups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanery.functions.wilson import wilson_ci
from gleanery.operators import health, language, pii, text_quality
from gleanery.operators.pii import Pattern

# Rules by id (name, text, level), and the rule of each health status.
RULES = {
    "FC001": ("CorruptFile", "File is corrupt or has structural issues", "error"), "FC002": ("TruncatedFile", "File appears truncated (missing end marker)", "error"),
    "FC003": ("EncryptedFile", "File is encrypted and cannot be processed", "warning"), "FC004": ("EmptyFile", "File is empty (0 bytes)", "warning"),
    "FC005": ("PIIRiskIndicator", "File contains PII risk indicators", "warning"), "FC006": ("DuplicateFile", "File is an exact duplicate of another file", "note"),
    "FC007": ("EncodingDamage", "File contains encoding damage (mojibake)", "note"),
}
RULE_OF = {"corrupt": "FC001", "truncated": "FC002", "encrypted_pdf": "FC003", "encrypted_zip": "FC003", "encrypted_office": "FC003", "empty": "FC004", "near_empty": "FC004", "unreadable": "FC001"}


def file_report(corpus: DataFrame, duplicates: DataFrame, checked: DataFrame, pii_files: DataFrame, languages: DataFrame, encodings: DataFrame | None = None) -> DataFrame:
    """One row a file; the hash is shown for duplicates only.

    Left joins on the id; each side has an id once.
    """
    out = corpus.select(F.col("id"), "size", F.col("mime").alias("mime_type"))
    out = out.join(duplicates.select("id", F.col("hash").alias("content_hash")), "id", "left")
    out = out.join(checked.select("id", "status"), "id", "left").join(pii_files.select("id", "pii_types"), "id", "left").join(languages.select("id", "language"), "id", "left")
    out = out.join(encodings.select("id", "encoding"), "id", "left") if encodings is not None else out.withColumn("encoding", F.lit("utf-8"))
    text = lambda c, other="": F.coalesce(c, F.lit(other))
    return out.select(
        "id", "size", "mime_type", text(F.col("content_hash")).alias("content_hash"), F.col("content_hash").isNotNull().alias("is_duplicate"), text(F.col("status"), "ok").alias("health_status"),
        F.col("pii_types").isNotNull().alias("has_pii"), text(F.col("pii_types")).alias("pii_types"), text(F.col("language")).alias("language"), text(F.col("encoding")).alias("encoding"),
    )


def row_facts(corpus: DataFrame, patterns: list[Pattern] | None = None, with_language: bool = True) -> DataFrame:
    """id, size, mime, status, n_matches and pii_types (null without a match), is_damaged and language of texts, all made where the row is."""
    facts = {"status": health.text_status(), "found": pii.found_in(F.col("text"), patterns), "is_damaged": text_quality.is_damaged(F.col("text"))}
    rows = corpus.select("id", "size", "mime", "text", *[c.alias(k) for k, c in facts.items()])
    rows = language.detect(rows, keep=("size", "mime", *facts)) if with_language else rows
    some = F.size("found") > 0
    total = F.aggregate("found", F.lit(0).cast("long"), lambda n, e: n + e["n"])
    types = F.array_join(F.array_sort(F.transform("found", lambda e: e["pattern"])), ",")
    own = ["language"] if with_language else []
    return rows.select("id", "size", "mime", "status", F.when(some, total).alias("n_matches"), F.when(some, types).alias("pii_types"), "is_damaged", *own)


def file_rows(facts: DataFrame, duplicates: DataFrame) -> DataFrame:
    """``file_report`` from ``row_facts``: duplicates are all that has to be brought to a row."""
    out = facts.join(duplicates.select("id", F.col("hash").alias("content_hash")), "id", "left")
    empty = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    return out.select(
        "id", "size", F.col("mime").alias("mime_type"), empty("content_hash"), F.col("content_hash").isNotNull().alias("is_duplicate"), F.col("status").alias("health_status"),
        F.col("pii_types").isNotNull().alias("has_pii"), empty("pii_types"), "language", F.lit("utf-8").alias("encoding"),
    )


def _rule_of(status: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in RULE_OF.items() for x in kv]), status)


def row_findings(facts: DataFrame, duplicates: DataFrame) -> DataFrame:
    """``findings`` from ``row_facts``."""
    one = lambda when, rule, message: F.when(when, F.struct(rule.alias("rule_id"), message.alias("message")))
    risk = F.format_string("%d PII risk indicators: %s", F.col("n_matches"), F.col("pii_types"))
    every = F.array(
        one(F.col("status") != "ok", _rule_of(F.col("status")), F.concat(F.lit("Health status: "), "status")), one(F.col("pii_types").isNotNull(), F.lit("FC005"), risk),
        one(F.col("is_damaged"), F.lit("FC007"), F.lit(RULES["FC007"][1])),
    )
    own = facts.select("id", F.inline(F.filter(every, lambda e: e.isNotNull())).alias("rule_id", "message"))
    copies = duplicates.where("id != first_id").select("id", F.lit("FC006").alias("rule_id"), F.concat(F.lit("Exact duplicate of "), F.col("first_id").cast("string")).alias("message"))
    level = F.create_map(*[F.lit(x) for k, v in RULES.items() for x in (k, v[2])])
    return own.unionByName(copies).select("id", "rule_id", F.try_element_at(level, F.col("rule_id")).alias("level"), "message")


def row_cases(facts: DataFrame, duplicates: DataFrame) -> DataFrame:
    """``junit_cases`` from ``row_facts``."""
    rule = _rule_of(F.col("status"))
    error = F.coalesce(rule.isin("FC001", "FC002"), F.lit(False))
    out = facts.join(duplicates.where("id != first_id").select("id", "first_id"), "id", "left")
    failures = (rule.isNotNull() & ~error).cast("long") + F.col("pii_types").isNotNull().cast("long") + F.col("first_id").isNotNull().cast("long")
    return out.select("id", error.cast("long").alias("n_errors"), failures.alias("n_failures"))


def guarded(value: Column) -> Column:
    """Text that no spreadsheet takes for a formula."""
    return F.when(F.substring(value, 1, 1).isin("=", "+", "-", "@", "\t", "\r", "|"), F.concat(F.lit("'"), value)).otherwise(value)


def csv_rows(files: DataFrame) -> DataFrame:
    """The file report as it stands in a CSV: types joined by semicolons, cells guarded."""
    out = files.withColumn("pii_types", F.replace("pii_types", F.lit(","), F.lit(";")))
    return out.select(*[guarded(F.col(f.name)).alias(f.name) if f.dataType.simpleString() == "string" else F.col(f.name) for f in out.schema.fields])


def findings(checked: DataFrame, pii_files: DataFrame, duplicates: DataFrame, mojibake: DataFrame) -> DataFrame:
    """id, rule_id, level, message. Of duplicates the first of each group is none; matched text never appears."""
    bad = checked.where("status != 'ok'").select("id", _rule_of(F.col("status")).alias("rule_id"), F.concat(F.lit("Health status: "), "status").alias("message"))
    risk = pii_files.select("id", F.lit("FC005").alias("rule_id"), F.format_string("%d PII risk indicators: %s", F.col("n_matches"), F.col("pii_types")).alias("message"))
    copies = duplicates.where("id != first_id").select("id", F.lit("FC006").alias("rule_id"), F.concat(F.lit("Exact duplicate of "), F.col("first_id").cast("string")).alias("message"))
    damaged = mojibake.where("is_damaged").select("id", F.lit("FC007").alias("rule_id"), F.lit(RULES["FC007"][1]).alias("message"))
    level = F.create_map(*[F.lit(x) for k, v in RULES.items() for x in (k, v[2])])
    return bad.unionByName(risk).unionByName(copies).unionByName(damaged).select("id", "rule_id", F.try_element_at(level, F.col("rule_id")).alias("level"), "message")


def junit_cases(corpus: DataFrame, found: DataFrame) -> DataFrame:
    """id, n_errors, n_failures of every file: corrupt and truncated are errors, other findings but mojibake failures."""
    per = found.where("rule_id != 'FC007'").groupBy("id").agg(F.count_if(F.col("rule_id").isin("FC001", "FC002")).alias("n_errors"), F.count_if(~F.col("rule_id").isin("FC001", "FC002")).alias("n_failures"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return corpus.select("id").join(per, "id", "left").select("id", zero("n_errors"), zero("n_failures"))


def gate(dedup: DataFrame, checked: DataFrame, pii_files: DataFrame, n_scanned: DataFrame, duplicate_critical: float = 0.10, corrupt_critical: float = 0.01, pii_critical: float = 0.05) -> DataFrame:
    """ord, metric, rate, threshold, breached of the three limits; only the status corrupt counts as corrupt.

    ``n_scanned`` has one row with n; the others are the operators' results.
    """
    dup = dedup.select(F.lit(1).alias("ord"), F.lit("duplicate").alias("metric"), (F.col("duplicate_pct") / 100).alias("rate"), F.lit(duplicate_critical).alias("threshold"))
    bad = checked.agg(F.count_if(F.col("status") == "corrupt").alias("k"), F.count(F.lit(1)).alias("n"))
    bad = bad.select(F.lit(2).alias("ord"), F.lit("corrupt").alias("metric"), F.when(F.col("n") > 0, F.col("k") / F.col("n")).otherwise(0.0).alias("rate"), F.lit(corrupt_critical).alias("threshold"))
    risk = pii_files.agg(F.count(F.lit(1)).alias("k")).crossJoin(F.broadcast(n_scanned))  # one row each
    risk = risk.select(F.lit(3).alias("ord"), F.lit("pii").alias("metric"), F.when(F.col("n") > 0, F.col("k") / F.col("n")).otherwise(0.0).alias("rate"), F.lit(pii_critical).alias("threshold"))
    return dup.unionByName(bad).unionByName(risk).withColumn("breached", F.col("rate") >= F.col("threshold"))


def top_with_other(counts: DataFrame, name: str, n: str, k: int = 10) -> DataFrame:
    """rank, label, n: the k largest and one row for all others."""
    top = counts.orderBy(F.desc(n), name).limit(k)
    ranked = top.agg(F.sort_array(F.collect_list(F.struct(-F.col(n), F.col(name)))).alias("a"))  # k rows
    shown = ranked.select(F.posexplode("a").alias("p", "e")).select((F.col("p") + 1).cast("int").alias("rank"), F.col(f"e.{name}").cast("string").alias("label"), F.col("e.col1").alias("n"))
    shown = shown.withColumn("n", -F.col("n"))
    whole = counts.agg(F.sum(n).alias("s"), F.count(F.lit(1)).alias("c")).crossJoin(F.broadcast(shown.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("t"), F.count(F.lit(1)).alias("m"))))  # one row each
    other = whole.where("c > m").select(F.lit(k + 1).alias("rank"), F.format_string("Other (%d types)", F.col("c") - F.col("m")).alias("label"), (F.col("s") - F.col("t")).alias("n"))
    return shown.unionByName(other)


def rates_with_ci(counts: DataFrame, name: str, k: str, n: Column, population: Column, level: float = 0.95) -> DataFrame:
    ci = wilson_ci(F.col(k), n, population, level)
    return counts.select(name, k, F.round(ci["p"] * 100, 4).alias("pct"), F.round(ci["lo"] * 100, 4).alias("lo_pct"), F.round(ci["hi"] * 100, 4).alias("hi_pct"))
