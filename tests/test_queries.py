"""Every registered query of the corpus operators against its SQL in DuckDB, and plan shapes."""

from __future__ import annotations

import os

import duckdb
import pytest

from gleanery.plans import registry
from gleanery.streaming import incremental

QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def con(sf_dir):
    c = duckdb.connect()
    for name in os.listdir(sf_dir):
        c.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{sf_dir}/{name}'")
    return c


def rounded(row):
    return str(tuple(round(v, 6) if isinstance(v, float) else v for v in row))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf_dir, con, name):
    frame = QUERIES[name](spark, sf_dir)
    columns = sorted(frame.columns)
    got = sorted(map(rounded, frame.select(*columns).collect()))
    if name in SQL:
        found = con.execute(SQL[name])
        assert sorted(d[0] for d in found.description) == columns
        want = sorted(map(rounded, con.execute(f"SELECT {', '.join(columns)} FROM ({SQL[name]})").fetchall()))
        assert got == want


def test_projection_reaches_the_scan(spark, sf_dir):
    plan = QUERIES["top_types_with_other"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<source:string>" in plan and "text" not in plan.split("ReadSchema")[1].split(">")[0]


def test_words_are_extracted_once(spark, sf_dir):
    plan = QUERIES["shingles"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") == 1


def test_stream(spark, sf_dir, tmp_path):
    source = spark.read.parquet(f"{sf_dir}/documents.parquet").selectExpr("text", "timestamp_seconds(1700000000 + doc_id) AS at")
    source.unionByName(source).repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("text string, at timestamp").parquet(str(tmp_path / "in"))
    for k, frame in enumerate((incremental.first_seen(stream, "at"), incremental.health_by_window(stream, "at"))):
        q = frame.writeStream.format("memory").queryName(f"seen{k}").outputMode("append" if k == 0 else "update").option("checkpointLocation", str(tmp_path / f"c{k}")).start()
        q.processAllAvailable()
        q.stop()
    assert spark.table("seen0").count() == source.select("text").distinct().count()
    assert spark.sql("SELECT sum(n) FROM (SELECT max(n) AS n FROM seen1 GROUP BY window_start, status)").first()[0] == 2 * source.count()
