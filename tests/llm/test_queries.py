"""The registered queries on the test tables, and the pipeline."""

from __future__ import annotations

import os
import zlib

import duckdb
import pytest

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in ("documents", "pages", "labels", "benchmark", "conversations"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", ["op2_license_scan", "op7_line_dedup", "op9_warc", "op12_prefix_trie", "op13_collocations"])
def test_sql(spark, con, name):
    from cladeloom.llm.queries import QUERIES, SQL

    df = QUERIES[name](spark, DATA)
    cols = sorted(df.columns)
    got = sorted(repr(tuple(r)) for r in df.select(cols).collect())
    rel = con.execute(SQL[name])
    at = {d[0]: k for k, d in enumerate(rel.description)}
    assert sorted(at) == cols
    assert got == sorted(repr(tuple(r[at[c]] for c in cols)) for r in rel.fetchall())


@pytest.mark.parametrize("name,folds,rest", [("op1_toxicity", 4, 2), ("op4_quality", 5, 0)])
def test_classifier_columns(spark, name, folds, rest):
    from cladeloom.llm.queries import QUERIES

    rows = QUERIES[name](spark, DATA).collect()
    assert len(rows) == 200
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % folds == rest)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3)


def test_pipeline(spark):
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "line_dedup", "simhash", "decontaminate", "packing"]
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    before = {r["doc_id"]: r["text"] for r in docs.collect()}
    columns, left = docs.columns, set(before)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, DATA)
        docs = spark.createDataFrame(docs.toPandas(), docs.schema) if name == "quality" else docs
        assert docs.columns == columns
        now = {r["doc_id"]: r for r in docs.collect()}
        assert set(now) <= left
        left = set(now)
    assert all(r["n_chars"] == len(r["text"]) for r in now.values())
    packed = corpus_pipeline.run(spark, DATA).collect()
    assert {r["doc_id"] for r in packed} == left


def test_pipeline_on_an_empty_table(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{DATA}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, DATA).count() == 0
