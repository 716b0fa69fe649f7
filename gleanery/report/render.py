"""Rendered reports of a ``CorpusReport``.

Text and HTML show top-k tables and one-row summaries. JSON, CSV, SARIF and
JUnit hold every file, finding and case, read part by part, so such a document
grows with the corpus; the file table can be written by Spark instead
(``write_files``). Of near-duplicate clusters JSON has the ``MAX_CLUSTERS``
largest, with up to ``MAX_MEMBERS`` members each. Shares of languages, scripts,
encodings and personal data come with 95 % Wilson intervals for all files,
where only a sample was read.
"""

from __future__ import annotations

import html
import json
import os
import tempfile
import time
from collections.abc import Iterator
from datetime import UTC, datetime
from typing import Any
from xml.sax.saxutils import quoteattr

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanery import __version__
from gleanery.operators.simhash import first_members
from gleanery.plans.scan import CorpusReport, near_duplicate_members, near_duplicates
from gleanery.report.formatting import bar, format_size
from gleanery.report.tables import RULES, csv_rows, rates_with_ci, top_with_other

FORMATS = ("terminal", "json", "csv", "sarif", "junit", "html")
DEFAULT_NAMES = {"json": "corpus-report.json", "csv": "corpus-report.csv", "html": "corpus-report.html", "sarif": "corpus-report.sarif.json", "junit": "corpus-report.xml"}
MAX_CLUSTERS, MAX_MEMBERS = 100, 50


def write_text(path: str, text: str) -> None:
    """Written beside the target, then moved over it."""
    folder = os.path.dirname(os.path.abspath(path))
    handle, temporary = tempfile.mkstemp(dir=folder)
    try:
        with os.fdopen(handle, "w", encoding="utf-8", newline="") as f:
            f.write(text)
        os.replace(temporary, path)
    except BaseException:
        os.unlink(temporary)
        raise


def _rows(df: DataFrame) -> Iterator[dict]:
    return (r.asDict(recursive=True) for r in df.toLocalIterator())


def _one(df: DataFrame) -> dict:
    return next(_rows(df.limit(1)), {})


def summary(report: CorpusReport) -> dict[str, Any]:
    """All sections but the files; absent ones are null."""
    names = ("types", "sizes", "size_stats", "extensions", "directories", "ages", "dedup", "health_tally", "extraction", "pii_types", "languages", "scripts", "encodings", "readability_summary", "deff", "walk_stats", "population")
    single = {"population", "size_stats", "directories", "dedup", "health_tally", "extraction", "readability_summary", "deff", "walk_stats"}
    out: dict[str, Any] = {}
    for name in names:
        df = report.sections.get(name)
        out[name] = None if df is None else _one(df) if name in single else list(_rows(df))
    for name, key, count in (("languages", "language", "n_files"), ("scripts", "script", "n_files"), ("encodings", "encoding", "n_files"), ("pii_types", "pattern", "n_files")):
        if out.get(name) is not None:
            rates = {r[key]: r for r in _rows(_rates(report, name, key, count))}
            out[name] = [r | {k: rates[r[key]][k] for k in ("pct", "lo_pct", "hi_pct")} for r in out[name]]
    out["mojibake"] = {"n_damaged": report["mojibake"].where("is_damaged").count()} if "mojibake" in report.sections else None
    out["near_duplicates"] = _clusters(report) if "fingerprints" in report.sections else None
    return out


def _rates(report: CorpusReport, section: str, key: str, count: str) -> DataFrame:
    """Shares of the texts that were read, with intervals for all files."""
    rows = report[section].crossJoin(F.broadcast(report["population"]))  # one row
    return rates_with_ci(rows, key, count, F.col("n_analyzed"), F.col("population"))


def _clusters(report: CorpusReport) -> dict[str, Any]:
    members = near_duplicate_members(report)
    top = list(_rows(near_duplicates(report).orderBy(F.desc("n_members"), "cluster_id").limit(MAX_CLUSTERS)))
    named: dict[Any, list] = {}
    if top:
        known = members.sparkSession.createDataFrame([(r["cluster_id"],) for r in top], members.select("cluster_id").schema)
        named = {r["cluster_id"]: r["members"] for r in _rows(first_members(members, known, MAX_MEMBERS))}
    total = _one(members.agg(F.countDistinct("cluster_id").alias("n_clusters"), F.count(F.lit(1)).alias("n_files")))
    return total | {"method": report.config.near_method, "threshold": report.config.simhash_threshold, "bits": report.config.simhash_bits, "clusters": [r | {"members": named.get(r["cluster_id"], [])} for r in top]}


def to_json(report: CorpusReport) -> str:
    body = {
        "version": __version__, "scan_path": report.scan_path, "scan_date": datetime.now(UTC).isoformat(), "duration_seconds": round(time.time() - report.started, 3),
        "summary": summary(report), "files": list(_rows(report["files"].orderBy("id"))) if "files" in report.sections else [],
    }
    return json.dumps(body, indent=2, default=str, allow_nan=False, ensure_ascii=False)


def to_csv(report: CorpusReport) -> str:
    import csv
    import io

    out = io.StringIO()
    frame = csv_rows(report["files"]).orderBy("id")
    writer = csv.writer(out)
    writer.writerow(frame.columns)
    for r in frame.toLocalIterator():
        writer.writerow([str(v).lower() if isinstance(v, bool) else "" if v is None else v for v in r])
    return "﻿" + out.getvalue()


def to_sarif(report: CorpusReport) -> str:
    rules = [{"id": k, "name": v[0], "shortDescription": {"text": v[1]}, "defaultConfiguration": {"level": v[2]}} for k, v in RULES.items()]
    results = [
        {"ruleId": r["rule_id"], "level": r["level"], "message": {"text": r["message"]}, "locations": [{"physicalLocation": {"artifactLocation": {"uri": str(r["id"])}}}]}
        for r in _rows(report["findings"].orderBy("rule_id", "id"))
    ]
    return json.dumps({"version": "2.1.0", "$schema": "https://docs.oasis-open.org/sarif/sarif/v2.1.0/errata01/os/schemas/sarif-schema-2.1.0.json", "runs": [{"tool": {"driver": {"name": "gleanery", "version": __version__, "rules": rules}}, "results": results}]}, indent=2)


def to_junit(report: CorpusReport) -> str:
    found: dict[str, list[dict]] = {}
    for r in _rows(report["findings"].where("rule_id != 'FC007'").orderBy("id", "rule_id")):
        found.setdefault(r["id"], []).append(r)
    cases, errors, failures = [], 0, 0
    for r in _rows(report["cases"].orderBy("id")):
        inner = []
        for f in found.get(r["id"], []):
            kind = "error" if f["rule_id"] in ("FC001", "FC002") else "failure"
            errors, failures = errors + (kind == "error"), failures + (kind == "failure")
            inner.append(f"<{kind} type={quoteattr(f['rule_id'])} message={quoteattr(f['message'])}/>")
        cases.append(f"  <testcase classname=\"corpus\" name={quoteattr(str(r['id']))}>{''.join(inner)}</testcase>")
    return f'<?xml version="1.0" encoding="utf-8"?>\n<testsuite name="corpus" tests="{len(cases)}" time="{time.time() - report.started:.3f}" failures="{failures}" errors="{errors}">\n' + "\n".join(cases) + "\n</testsuite>\n"


def ci_text() -> Column:
    """A share with its interval; without one where all files were read."""
    whole = F.format_string("%.1f%%", F.col("pct"))
    return F.when(F.col("lo_pct") == F.col("hi_pct"), whole).otherwise(F.format_string("%.1f%% (CI: %.1f%% -- %.1f%%)", F.col("pct"), F.col("lo_pct"), F.col("hi_pct")))


def sections_for_people(report: CorpusReport) -> list[tuple[str, list[str], list[list]]]:
    """Title, header and rows of each section, bounded in size, for text and HTML."""
    out: list[tuple[str, list[str], list[list]]] = []

    def add(title: str, df: DataFrame, limit: int = 20) -> None:
        out.append((title, df.columns, [list(r) for r in df.limit(limit).collect()]))

    s = report.sections
    add("File types", top_with_other(s["types"], "mime", "n_files", 15))
    add("Sizes", s["sizes"].orderBy("bucket_ord").select("label", "n", "total"))
    if "ages" in s:
        add("Ages", s["ages"].orderBy("bucket_ord").select("label", "n"))
        add("Directories", s["directories"])
    add("Exact duplicates", s["dedup"])
    add("Largest duplicate groups", s["duplicate_groups"].select("first_id", "n", "size", "wasted_bytes"), 10)
    add("Health", s["health_tally"])
    add("Flagged files", s["health"].where("status != 'ok'").orderBy("status", "id").select("id", "status"), 20)
    if "extraction" in s:
        add("Extraction", s["extraction"])
    shown = lambda name, key, count="n_files": s[name].join(_rates(report, name, key, count).drop(count), key).withColumn("share", ci_text())
    add("PII risk indicators", shown("pii_types", "pattern").orderBy(F.desc("n_matches"), "pattern").drop("pct", "lo_pct", "hi_pct"))
    if "pii_samples" in s:
        add("PII samples", s["pii_samples"], 20)
    add("Languages", top_with_other(s["languages"], "language", "n_files", 10))
    add("Languages, of all files", shown("languages", "language").orderBy(F.desc("n_files"), "language").select("language", "n_files", "share"), 10)
    if "encodings" in s:
        add("Encodings", shown("encodings", "encoding").orderBy(F.desc("n_files"), "encoding").select("encoding", "n_files", "share"))
    add("Encoding damage", s["mojibake"].where("is_damaged").orderBy("id"), 20)
    add("Least readable", s["readability"].orderBy("flesch", "id").withColumn("flesch", F.round("flesch", 1)), 10)
    add("Near-duplicate clusters", near_duplicates(report).orderBy(F.desc("n_members"), F.desc("similarity"), "cluster_id"), 5)
    add("Limits", s["gate"].orderBy("ord").select("metric", "rate", "threshold", "breached"))
    return out


def to_text(report: CorpusReport) -> str:
    if report.empty:
        return "No files.\n"
    lines = [f"Corpus report {report.scan_path}".rstrip()]
    for title, header, rows in sections_for_people(report):
        lines += ["", title, "-" * len(title)]
        if not rows:
            lines.append("none")
            continue
        counts = [r[header.index("n")] for r in rows] if "n" in header else []
        table = [[format_size(v) if h in ("size", "wasted_bytes", "total") and isinstance(v, (int, float)) else f"{v:.4g}" if isinstance(v, float) else str(v) for h, v in zip(header, r, strict=True)] for r in rows]
        widths = [max(len(x) for x in col) for col in zip(header, *table, strict=True)]
        lines.append("  ".join(h.ljust(w) for h, w in zip(header, widths, strict=True)))
        for k, r in enumerate(table):
            mark = "  " + bar(counts[k] / max(1, sum(counts))) if counts else ""
            lines.append(("  ".join(x.ljust(w) for x, w in zip(r, widths, strict=True)) + mark).rstrip())
    return "\n".join(lines) + "\n"


def chart(header: list[str], rows: list[list]) -> str:
    """A bar chart as SVG of sections that have names and counts; nothing for others."""
    count = next((header.index(c) for c in ("n", "n_files", "n_matches") if c in header), None)
    if count is None or len(rows) < 2 or not count:
        return ""
    top = max(1, *(r[count] or 0 for r in rows))
    bars = "".join(
        f'<text x="215" y="{20 * k + 14}" text-anchor="end">{html.escape(str(r[0])[:32])}</text><rect x="220" y="{20 * k + 3}" width="{360 * (r[count] or 0) / top:.1f}" height="14"/><text x="{225 + 360 * (r[count] or 0) / top:.1f}" y="{20 * k + 14}">{r[count]}</text>'
        for k, r in enumerate(rows)
    )
    return f'<svg role="img" width="680" height="{20 * len(rows) + 6}" font-size="12" fill="#456">{bars}</svg>'


def to_html(report: CorpusReport) -> str:
    parts = ["<!doctype html><html lang=\"en\"><head><meta charset=\"utf-8\"><title>Corpus report</title><style>body{font-family:sans-serif;margin:2rem}table{border-collapse:collapse}td,th{border:1px solid #ccc;padding:.2rem .6rem;text-align:left}</style></head><body><h1>Corpus report</h1>"]
    for title, header, rows in [] if report.empty else sections_for_people(report):
        cells = "".join("<tr>" + "".join(f"<td>{html.escape(str(v))}</td>" for v in r) + "</tr>" for r in rows)
        parts.append(f"<h2>{html.escape(title)}</h2>{chart(header, rows)}<table><tr>{''.join(f'<th>{html.escape(h)}</th>' for h in header)}</tr>{cells}</table>")
    return "".join([*parts, "</body></html>\n"])


RENDER = {"json": to_json, "csv": to_csv, "sarif": to_sarif, "junit": to_junit, "html": to_html, "terminal": to_text}


def generate(report: CorpusReport, fmt: str, output: str | None = None) -> str | None:
    """Writes a report in one of ``FORMATS``; text is returned where it is not written."""
    if fmt not in RENDER:
        raise ValueError(f"unknown format {fmt!r}; known are {', '.join(FORMATS)}")
    text = RENDER[fmt](report)
    if fmt == "terminal" and not output:
        return text
    write_text(output or DEFAULT_NAMES[fmt], text)
    return None


def write_files(report: CorpusReport, path: str, fmt: str = "parquet") -> None:
    """The file table by Spark's own writers, for reports with a row a file at any size."""
    report["files"].write.mode("overwrite").format(fmt).save(path)


def exit_code(report: CorpusReport) -> tuple[int, list[str]]:
    """1 and a message for each limit that is reached, else 0."""
    if report.empty:
        return 0, []
    breached = [f"{r['metric']} rate {r['rate']:.2%} is at or over {r['threshold']:.2%}" for r in report["gate"].where("breached").orderBy("ord").collect()]
    return int(bool(breached)), breached
