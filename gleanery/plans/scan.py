"""A whole scan: one lazy DataFrame for each section of the report."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanery.config import ScanConfig
from gleanery.operators import dedup, encoding, health, inventory, language, minhash, pii, sampling, simhash, text_quality
from gleanery.report import tables
from gleanery.sources import files as file_source
from gleanery.sources import walker

PHASES = ["walk", "inventory", "hashing", "health", "sampling", "extraction", "pii", "language", "encoding", "mojibake", "readability", "near-duplicates"]
Progress = Callable[[str, int, int], None]


class Cancelled(Exception):
    """Raised from a progress callback to end a scan."""


@dataclass
class CorpusReport:
    """Sections by name. Nothing runs until a section is read; texts are kept between sections."""

    config: ScanConfig
    sections: dict[str, DataFrame] = field(default_factory=dict)
    persisted: list[DataFrame] = field(default_factory=list)
    empty: bool = False
    started: float = field(default_factory=time.time)
    scan_path: str = ""

    def __getitem__(self, name: str) -> DataFrame:
        return self.sections[name]

    def close(self) -> None:
        for df in self.persisted:
            df.unpersist()


def _kept(report: CorpusReport, df: DataFrame, now: bool) -> DataFrame:
    """``df``, persisted until the report is closed; made at once where phases are told."""
    df = df.persist()
    report.persisted.append(df)
    if now:
        df.count()
    return df


def _sections(report: CorpusReport, corpus: DataFrame, texts: DataFrame, hashes: DataFrame, status: DataFrame, encodings: DataFrame | None, phase: Callable[[], None] | None = None) -> None:
    """All sections; with ``phase`` each part is made when its phase is told, else when it is read."""
    c, s, now = report.config, report.sections, phase is not None
    tell = phase or (lambda: None)
    s["population"] = corpus.agg(F.count(F.lit(1)).alias("population")).crossJoin(texts.agg(F.count(F.lit(1)).alias("n_analyzed")))  # one row each
    s["types"] = inventory.type_distribution(corpus)
    s["sizes"] = inventory.size_histogram(corpus)
    s["size_stats"] = inventory.size_stats(corpus)
    s["duplicate_members"] = dedup.members(hashes)
    s["dedup"] = dedup.dedup_summary(hashes)
    s["duplicate_groups"] = dedup.top_groups(hashes)
    s["health"] = status
    s["health_tally"] = health.health_tally(status)
    tell()
    patterns = pii.patterns_with(c.pii_custom_patterns)
    if c.pii_min_confidence > 0 or c.show_pii_samples:
        scored = pii.scored_matches(texts, c.pii_min_confidence, patterns)
        counts = scored.groupBy("id", "pattern").agg(F.count(F.lit(1)).alias("n"))
        if c.show_pii_samples:
            s["pii_samples"] = pii.samples(scored)
    else:
        counts = pii.count_matches(texts, patterns)
    counts = _kept(report, counts, now)
    s["pii_types"], s["pii_files"] = pii.type_rollup(counts), pii.file_rollup(counts)
    tell()
    # narrow, and used twice: by the prior and by what the prior corrects
    detected = language.correct_by_prior(_kept(report, language.detect(texts), now))
    s["languages"], s["scripts"], s["language_files"] = language.distribution(detected), language.distribution(detected, "script"), detected
    tell()
    if encodings is not None:
        s["encodings"] = encoding.distribution(_kept(report, encodings, now))
    tell()
    s["mojibake"] = _kept(report, text_quality.mojibake(texts), True) if now else text_quality.mojibake(texts)
    tell()
    s["readability"] = _kept(report, text_quality.readability(texts), True) if now else text_quality.readability(texts)
    s["readability_summary"] = text_quality.readability_summary(s["readability"])
    tell()
    s["fingerprints"] = _kept(report, simhash.fingerprints(texts, c.simhash_bits), now)
    if c.near_method == "minhash":
        s["signatures"] = _kept(report, minhash.signatures(texts), now)
    s["files"] = tables.file_report(corpus, s["duplicate_members"], status, s["pii_files"], detected, encodings)
    s["findings"] = tables.findings(status, s["pii_files"], s["duplicate_members"], s["mojibake"])
    s["cases"] = tables.junit_cases(corpus, s["findings"])
    s["gate"] = tables.gate(s["dedup"], status, s["pii_files"], texts.agg(F.count(F.lit(1)).alias("n")), c.duplicate_critical, c.corrupt_critical, c.pii_critical)


def near_duplicate_members(report: CorpusReport) -> DataFrame:
    """id, cluster_id of near duplicates; runs the links and components once."""
    if "near_duplicate_members" not in report.sections and report.config.near_method == "minhash":
        report.sections["near_duplicate_members"] = _kept(report, minhash.clusters(minhash.candidate_pairs(report["signatures"])), False)
    if "near_duplicate_members" not in report.sections:
        links = simhash.pairs(report["fingerprints"], simhash.scaled_threshold(report.config.simhash_threshold, report.config.simhash_bits))
        report.sections["near_duplicate_members"] = _kept(report, simhash.clusters(links), False)
    return report["near_duplicate_members"]


def near_duplicates(report: CorpusReport) -> DataFrame:
    """cluster_id, n_members, similarity."""
    if report.config.near_method == "minhash":
        return minhash.cluster_similarity(near_duplicate_members(report), report["signatures"])
    return simhash.cluster_similarity(near_duplicate_members(report), report["fingerprints"], report.config.simhash_bits)


def scan_table(corpus: DataFrame, config: ScanConfig | None = None) -> CorpusReport:
    """A report on a table (id, size, mime, cluster, text)."""
    report = CorpusReport(config or ScanConfig())
    _sections(report, corpus, corpus, dedup.hashed(corpus), health.text_health(corpus), None)
    report.sections["deff"] = sampling.design_effect(corpus)
    return report


def scan_directory(spark: SparkSession, path: str, config: ScanConfig | None = None, on_phase: Progress | None = None) -> CorpusReport:
    """A report on the files below ``path``; ``on_phase(name, index, of)`` may raise ``Cancelled``."""
    tell = on_phase or (lambda *_: None)
    report = CorpusReport(config or ScanConfig(), scan_path=path)
    at = iter(range(len(PHASES)))

    def phase() -> None:
        k = next(at)
        spark.sparkContext.setJobDescription(PHASES[k])
        tell(PHASES[k], k, len(PHASES))

    c = report.config
    phase()
    listed, issues, stats = walker.walk_parts(_kept(report, walker.walk_all(spark, path, c.exclude), True))
    report.sections |= {"walk_issues": issues, "walk_stats": stats}
    if stats.first()["n_files"] == 0:
        report.empty = True
        return report
    phase()
    # content is read once; what later sections need of it is kept without it where it can be
    content = file_source.read_content(listed.repartition(spark.sparkContext.defaultParallelism)).persist()
    report.persisted.append(content)
    corpus = content.select(F.col("relative_path").alias("id"), "size", "mime", F.regexp_extract("relative_path", "^(.*)/[^/]*$", 1).alias("cluster"), "mtime")
    report.sections["extensions"] = inventory.extension_counts(listed, "relative_path")
    report.sections["directories"] = inventory.directory_structure(listed, "relative_path")
    report.sections["ages"] = inventory.age_histogram(listed, "mtime", F.current_timestamp())
    phase()
    hashes = _kept(report, dedup.hashed(content.withColumn("id", F.col("relative_path")), F.col("content")), True)
    phase()
    checked = health.file_health(file_source.with_container_facts(content.select(F.col("relative_path").alias("path"), "size", "mime", "content")))
    status = _kept(report, checked.withColumnRenamed("path", "id"), True)
    phase()
    drawn = sampling.stratified_sample(corpus, None if c.sampling_rate_auto else c.sampling_rate, c.sampling_min_per_type, c.seed)
    report.sections["deff"] = sampling.design_effect(corpus)
    drawn = _kept(report, drawn, True)
    report.sections["sample"] = drawn
    phase()
    chosen = content.withColumn("id", F.col("relative_path")).join(drawn.select("id"), "id", "left_semi")
    facts = _kept(report, file_source.extract(chosen.select(F.col("id").alias("path"), "mime", "content")), True)
    classified = file_source.classify(facts, corpus.withColumnRenamed("id", "path"))
    report.sections["extraction"] = file_source.extraction_summary(classified)
    report.sections["text_facts"] = classified.drop("text")
    texts = facts.where("error is null").select(F.col("path").alias("id"), F.octet_length("text").cast("long").alias("size"), "mime", "text")
    encodings = facts.where("encoding is not null").select(F.col("path").alias("id"), "encoding")
    _sections(report, corpus, texts, hashes, status, encodings, phase)
    return report
