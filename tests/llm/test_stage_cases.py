"""Stages on null ids, repeated ids and clashing columns."""

import random

import duckdb
import pytest

import corpus_pipeline
from kerf.llm import decontamination, jaccard_join
from kerf.llm.decontamination import remove_leaks
from kerf.llm.quality_classifier import keep_good


def test_remove_leaks_by_row(spark):
    item = " ".join(f"w{i}" for i in range(20))
    docs = spark.createDataFrame([(None, f"a b {item} c", "x"), (None, "clean text of its own", "x"), (1, item.upper(), "y"), (1, "clean as well", "y"), (2, None, "z"), (2, "", "z")], "doc_id long, text string, seed string")
    bench = spark.createDataFrame([(7, item)], "item_id long, text string")
    kept = sorted(((r["doc_id"], r["text"]) for r in remove_leaks(docs, bench).collect()), key=repr)
    assert kept == sorted([(None, "clean text of its own"), (1, "clean as well"), (2, None), (2, "")], key=repr)
    assert remove_leaks(docs.where("false"), bench).count() == 0 and remove_leaks(docs, bench.where("false")).count() == 6


def test_keep_good_with_a_score_column(spark):
    good, bad = "calm clear words about rivers and hills", "buy buy click now free free"
    rows = [(i, (good if i % 2 else bad) + f" {i % 5}", float(i)) for i in range(80)]
    docs = spark.createDataFrame([*rows, (None, good, -1.0), (None, good, -1.0)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(i, i % 2) for i in range(80)], "doc_id long, quality int")
    kept = keep_good(docs, labels, threshold=0.5)
    assert kept.columns == ["doc_id", "text", "score"]
    got = sorted((r["doc_id"], r["score"]) for r in kept.collect() if r["doc_id"] is not None)
    assert got == [(i, float(i)) for i in range(1, 80, 2)] and kept.where("doc_id IS NULL AND score = -1").count() == 2
    assert keep_good(docs.where("false"), labels).count() == 0


@pytest.mark.parametrize("most", [0, 1_000_000])
def test_short_items_and_rows_without_own_id(spark, monkeypatch, most):
    """Items of 5 to 11 words are found word for word, with and without broadcast; rows that share an id, or have none,
    are compared by their own words."""
    monkeypatch.setattr(decontamination, "BROADCAST_SEEDS", most)
    names = lambda tag, n: " ".join(f"{tag}{i}" for i in range(n))
    items = [(1, names("a", 5)), (2, names("b", 11)), (3, names("c", 4)), (4, names("d", 14)), (5, "")]
    rows = [(10, "x y " + names("a", 5) + " z"), (11, names("a", 4) + " a5"), (12, names("b", 11)), (13, names("c", 4) * 3), (None, "n " + names("d", 14)), (None, names("e", 30)), (14, names("e", 20)), (14, names("d", 14) + " w"), (15, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = sorted(((r["doc_id"], r["n_items"], r["first_item"], r["equal_words"], r["compared_words"]) for r in decontamination.find_leaks(docs, bench).collect()), key=repr)
    assert got == sorted([(10, 1, 1, 5, 5), (12, 1, 2, 11, 11), (None, 1, 4, 14, 14), (14, 1, 4, 14, 14)], key=repr)
    con = duckdb.connect()
    con.register("documents", docs.toPandas().astype({"doc_id": "Int64"}))
    con.register("benchmark", bench.toPandas())
    assert sorted(con.execute(decontamination.ORACLE).fetchall(), key=repr) == got


def test_items_of_any_length_on_request(spark):
    docs = spark.createDataFrame([(1, "a b c d e"), (2, "b  C"), (3, "c b"), (4, None), (5, "zz")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "b c"), (2, "zz"), (3, ""), (4, None)], "item_id long, text string")
    assert decontamination.find_leaks(docs, bench).count() == 0
    got = sorted(tuple(r)[:3] for r in decontamination.find_leaks(docs, bench, shortest=1).collect())
    assert got == [(1, 1, 1), (2, 1, 1), (5, 1, 2)]
    assert {r["doc_id"] for r in remove_leaks(docs, bench, shortest=2).collect()} == {3, 4, 5}


def test_keep_one_tells_rows_by_id_and_text(spark):
    """A row whose id a removed copy shares stays; of equal rows one stays; null ids come last."""
    r = random.Random(1)
    text = lambda: " ".join(f"w{r.randrange(10**6)}" for _ in range(40))
    a, b, c = text(), text(), text()
    rows = [(3, a, "p"), (5, a, "q"), (5, b, "r"), (None, a, "s"), (7, c, "t"), (7, c, "u"), (None, None, "v"), (8, "", "w"), (8, "", "x"), (None, text(), "y"), (9, a + " more", "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, node string").repartition(3)
    got = sorted(x["node"] for x in jaccard_join.keep_one(docs).collect())
    assert [x for x in got if x not in "tu"] == ["p", "r", "v", "w", "x", "y"] and len([x for x in got if x in "tu"]) == 1
    assert jaccard_join.keep_one(docs).columns == docs.columns
    assert jaccard_join.keep_one(docs.where("false")).count() == 0
    only_null = spark.createDataFrame([(None, a), (None, a), (None, a + " x")], "doc_id long, text string")
    assert jaccard_join.keep_one(only_null).count() == 1


def test_stages_on_odd_rows(spark):
    """The pipeline's last stages take null ids, repeated ids, null and empty texts, columns of any name, no rows."""
    long = " ".join(f"q{i}" for i in range(30))
    rows = [(1, f"mail me at a.b@c.org {long}", "en", "s", 9), (1, None, None, None, None), (None, "call +44 20 7946 0958 now", "en", "s", 1), (None, "", "en", "s", 0), (2, long.upper().replace("Q", "z"), "en", "s", 3)]
    docs = spark.createDataFrame([(*r, 1.0, "x") for r in rows], "doc_id long, text string, lang string, source string, n_chars long, score double, spans string")
    for name, stage in corpus_pipeline.STAGES[1:]:
        if name == "benchmark_leaks":
            continue
        out = stage(spark, docs, "")
        got = out.collect()
        assert len(got) == 5 and sorted((r["doc_id"] for r in got), key=repr) == sorted((r[0] for r in rows), key=repr)
        if name == "personal_data":
            assert not any("a.b@c.org" in (r["text"] or "") or "7946" in (r["text"] or "") for r in got)
        if name != "tokens":
            assert out.columns == corpus_pipeline.COLUMNS
        assert stage(spark, docs.where("false"), "").count() == 0
