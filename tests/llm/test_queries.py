"""The numbered queries on the smallest tables: SQL where there is some, held-out accuracy of the classifiers, and the
pipeline stage by stage."""

import os

import duckdb
import pytest

import corpus_pipeline
from kerf.llm import decontamination, jaccard_join, pii, quality_classifier
from kerf.llm.common import table
from kerf.llm.queries import ORACLE, QUERIES

SF = "/root/testdata/sf0.01"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


def test_names():
    assert [n.split("_")[0] for n in sorted(QUERIES, key=lambda n: int(n[2:].split("_")[0]))] == [f"op{i}" for i in range(1, 14)]


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_sql(spark, name):
    c = duckdb.connect()
    for t in ("documents", "benchmark", "embeddings"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = c.sql(ORACLE[name])
    columns = sorted(want.columns)
    got = QUERIES[name](spark, SF).select(columns).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(want.select(*columns).fetchall(), key=repr)


def test_language_accuracy(spark):
    got = QUERIES["op1_language_id"](spark, SF).join(table(spark, SF, "documents").select("doc_id", "lang"), "doc_id").where("held_out").selectExpr("avg(cast(lang_pred = lang as int)) AS a").first()["a"]
    assert got > 0.97


@pytest.mark.parametrize("name, label, least", [("op5_quality_classifier", "quality", 0.85), ("op9_toxicity", "toxic", 0.9)])
def test_classifier_accuracy(spark, name, label, least):
    got = QUERIES[name](spark, SF).join(table(spark, SF, "labels"), "doc_id").where("held_out").selectExpr(f"avg(cast(predicted = {label} as int)) AS a").first()["a"]
    assert got > least


def test_pipeline_stages(spark):
    docs = table(spark, SF, "documents")
    for name, stage in corpus_pipeline.STAGES:
        before, out = docs, stage(spark, docs, SF)
        if name != "tokens":
            assert out.columns == table(spark, SF, "documents").columns
        docs = spark.createDataFrame(out.collect(), out.schema)
        ids = {r["doc_id"] for r in docs.select("doc_id").collect()}
        had = {r["doc_id"] for r in before.select("doc_id").collect()}
        if name == "quality":
            assert ids == {r["doc_id"] for r in quality_classifier.score_quality(before, table(spark, SF, "labels")).where("predicted = 1").collect()}
        elif name == "near_copies":
            assert ids == {r["doc_id"] for r in jaccard_join.near_duplicates(before).where("doc_id = component_id").collect()}
        elif name == "benchmark_leaks":
            assert ids == had - {r["doc_id"] for r in decontamination.find_leaks(before, table(spark, SF, "benchmark")).collect()}
        elif name == "personal_data":
            assert ids == had
            assert not any(any(pii.base_spans(r["text"]).values()) for r in docs.collect())
        else:
            assert ids == had
