"""The pipeline, stage by stage, on the smallest table and on awkward rows."""

from __future__ import annotations

import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))
import brute  # noqa: E402

import corpus_pipeline  # noqa: E402
from gleanery.llm import mixing, near_dup, quality  # noqa: E402
from gleanery.llm._shared import cut  # noqa: E402


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    bench = [(str(r["item_id"]), r["text"]) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    ids = lambda df: sorted(r[0] for r in df.select("doc_id").collect())
    for name, stage in corpus_pipeline.STAGES:
        before = ids(docs)
        out = cut(stage(spark, docs, sf_dir), "test")
        after = ids(out)
        if name == "quality rules":
            judged = {r["doc_id"]: r["kept"] for r in quality.judge(docs).select("doc_id", "kept").collect()}
            assert after == [i for i in before if judged[i]]
            assert not any(brute.text_counts(text[i])[-1] for i in after)
        elif name == "near-duplicates":
            assert after == sorted(d for d, *_, kept in brute.near_dup([(i, text[i]) for i in before]) if kept)
        elif name == "benchmark leaks":
            assert after == sorted(r[0] for r in brute.decontaminate([(i, text[i]) for i in before], bench) if not r[-1])
        elif name == "mixing sources":
            takes = {r["doc_id"]: r["n_takes"] for r in mixing.assign(docs).select("doc_id", "n_takes").collect()}
            assert after == sorted(i for i in before for _ in range(takes[i]))
        else:
            assert after == before and {"shard", "slot", "law"} <= set(out.columns)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == columns
        docs = out


def test_rows_agree_with_stages(spark, sf_dir):
    out = corpus_pipeline.run(spark, sf_dir)
    places = sorted((r["shard"], r["slot"]) for r in out.select("shard", "slot").collect())
    assert len(set(places)) == len(places) > 50


def test_empty(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    bench = spark.createDataFrame([], "item_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    bench.write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_repeated_rows_collapse(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(40)
    twice = docs.unionByName(docs)
    assert near_dup.keep_firsts(twice).count() == near_dup.keep_firsts(docs).count()


def test_odd_documents(spark, sf_dir, tmp_path):
    """Null ids, languages and sources, very long texts and words, and columns with internal names go through all stages."""
    from pyspark.sql import functions as F

    frame = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(60)
    long = " ".join(f"word{k % 4999}" for k in range(60_000))
    more = [(None, f"A text without an id, the {k}th of some, about {'rain' if k else 'wind'} and {k * 7} other things that happen in a long year by the sea and the hills.", None, None, 10) for k in range(4)]
    more += [(9001, long, "en", "s", 10), (9002, "x" * 700_000 + " and then " + " ".join(f"own{k}" for k in range(200)), "en", None, 10), (9003, None, "en", "s", 0), (9004, "", None, "s", 0)]
    docs = frame.unionByName(spark.createDataFrame(more, frame.schema)).withColumn("__gl_id", F.lit("mine")).withColumn("__gl_row", F.lit(5))
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf_dir)
        assert set(docs.columns) <= set(out.columns), name
        out.write.parquet(str(tmp_path / name))
        before, docs = docs, spark.read.parquet(str(tmp_path / name))
        assert docs.where("__gl_id != 'mine' or __gl_row != 5").count() == 0, name
    kept = docs.select("doc_id", F.length("text").alias("n")).collect()
    assert {9001, 9003, 9004} & {r["doc_id"] for r in kept} <= {9001}
    assert len([1 for r in kept if r["doc_id"] is None]) <= 3  # one document, repeated up to the cap by mixing
