"""Small cases of single operators, and invariants."""

import pytest
from pyspark.sql import functions as F

from kerf.functions import geometry, text
from kerf.operators import boq, building, cost, spatial
from kerf.plans.components import connected


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_merge_keeps_units_apart_and_is_idempotent(spark):
    cols = "project_id int, kind string, grp string, unit string, quantity double, cnt double, note string, tier string"
    df = spark.createDataFrame([(1, "siva", "*", "m2", 5.0, 1.0, "a", "olculdu"), (1, "siva", "*", "m2", 7.0, 2.0, "b", "tahmin"), (1, "siva", "*", "saat", 2.0, 0.0, None, "tahmin")], cols)
    once = boq.accumulate(df)
    assert rows(once, "unit", "quantity", "cnt") == [("m2", 12.0, 3.0), ("saat", 2.0, 0.0)]
    assert rows(boq.grade(once), "unit", "grade") == [("m2", "tahmin"), ("saat", "tahmin")]
    again = boq.accumulate(once.withColumns({"note": F.lit(None).cast("string"), "tier": F.lit("olculdu")}))
    assert rows(again, "unit", "quantity") == rows(once, "unit", "quantity")


def test_grandchildren_use_the_childs_total_once(spark):
    items = spark.createDataFrame([(1, "poz", f"poz:{i}", 10.0) for i in range(17)], "project_id int, kind string, key string, quantity double")
    recipes = spark.createDataFrame([("poz", "lento", 1.0), ("lento", "beton", 0.03), ("beton", "lento", 5.0)], "parent_kind string, child_kind string, factor double")
    got = {r["kind"]: r["quantity"] for r in boq.expand_recipes(items, recipes).collect()}
    assert got == {"lento": pytest.approx(170.0), "beton": pytest.approx(5.1)}


def test_best_quote(spark):
    q = spark.createDataFrame([(1, "m", "a", 5.0, False), (2, "m", "a", 0.0, False), (3, "m", "a", 9.0, True), (4, "m", "b", 0.0, False), (5, "m", "b", 3.0, False)], "quote_id int, scope string, key string, unit_price double, preferred boolean")
    assert rows(cost.best_quote(q), "key", "quote_id") == [("a", 3), ("b", 5)]


def test_subcontract_covers_all(spark):
    items = spark.createDataFrame([(1, "boya", "*", "m2", "architectural", 10.0)], "project_id int, kind string, grp string, unit string, discipline string, quantity double")
    prices = spark.createDataFrame([(1, "boya", 3.0, 4.0, 12.5, 0.0)], "project_id int, kind string, unit_price double, labor_price double, subcontract_price double, hours_per_unit double")
    r = cost.price_lines(items, prices).first()
    assert (float(r["material_total"]), float(r["labor_total"]), float(r["total"])) == (0.0, 0.0, 125.0)


def test_opening_on_wall_in_gap_and_nowhere(spark):
    walls = spark.createDataFrame([(1, 1, 0.0, 10.0, 0.0, 0.2), (1, 2, 12.0, 20.0, 0.0, 0.2)], "drawing_id int, wall_id int, x0 double, x1 double, y double, b double")
    openings = spark.createDataFrame([(1, 1, 5.0, 0.0, 0.9, 2.1, 1), (1, 2, 11.0, 0.0, 1.6, 1.4, 2), (1, 3, 5.0, 50.0, 1.0, 1.0, 1), (1, 4, 5.0, 0.0, 0.0, 1.0, 1)], "drawing_id int, opening_id int, ox double, oy double, width double, height double, count int")
    got = spatial.allocate_openings(walls, openings)
    assert rows(got, "opening_id", "method") == [(1, "geometry"), (2, "gap"), (3, "unmatched"), (4, "missing_dimensions")]
    d = {r["wall_id"]: r for r in spatial.deducted(got).collect()}
    assert d[1]["deducted"] == pytest.approx(1.89 + (1.6 * 1.4 * 2 if d[1]["gap_length"] else 0))


def test_two_copies_of_a_sheet_count_once(spark):
    base = [(1, 0, "column", i, float(3 * i), 1.0, 0.5, 2.0) for i in range(12)]
    both = [(*r[:3], d, d * 100 + r[3], *r[4:], False) for d in (1, 2) for r in base]
    e = spark.createDataFrame(both, "project_id int, floor int, etype string, drawing_id int, element_id int, x double, y double, diag double, q double, manual boolean")
    pairs = spatial.duplicates_across(e, F.lit(0))
    match = spatial.mutual_nearest(pairs, "a_element_id", "b_element_id", 3)
    assert rows(match, "a_element_id", "b_element_id") == [(100 + i, 200 + i) for i in range(12)]


def test_revisions_by_upload(spark):
    """An older dated upload loses; an undated one and a newer one win."""
    rows = [(1, "2024-03-01", 1), (2, None, 2), (3, "2024-02-01", 3), (4, "2024-01-01", 4), (5, "2024-02-01", 5)]
    d = spark.createDataFrame([(1, i, "A", "kalip", 3.0, None, r, u) for i, r, u in rows], "project_id int, drawing_id int, block string, plan_type string, level double, rank int, revision string, uploaded int").withColumn("revision", F.to_date("revision"))
    assert {r["drawing_id"]: r["superseded_by"] for r in building.superseded_by(d).collect()} == {1: 2, 2: 3, 3: 5, 4: 3, 5: None}


def test_floor_ranks(spark):
    titles = {"1.-2. NORMAL KAT PLANI": 1, "TEM PLANI": -100, "STA-03": 3, "2. BODRUM KAT": -2, "BODRUM": -1, "CATI KATI": 98, "Çatı planı": 99, "asma kat": 0.5, "ZEMİN KAT": 0, "ÜÇÜNCÜ KAT": 3, "7. KAT": 7, "TIP KAT": 1, "DETAY": None}
    got = spark.createDataFrame([(t,) for t in titles], "t string").select("t", text.floor_rank(F.col("t")).alias("r")).collect()
    assert {r["t"]: r["r"] for r in got} == titles


def test_revisions(spark):
    d = spark.createDataFrame([(1, 10, "A", "kalip", 3.0, None, "2024-01-01", 1), (1, 11, "A", "kalip", 3.0, None, "2024-02-01", 2), (1, 12, "A", "kalip", None, None, None, 3)], "project_id int, drawing_id int, block string, plan_type string, level double, rank int, revision string, uploaded int").withColumn("revision", F.to_date("revision"))
    assert rows(building.superseded_by(d).na.fill(0), "drawing_id", "superseded_by") == [(10, 11), (11, 0)]


def test_ratio_proves_nothing(spark):
    g = spark.createDataFrame([("column", 100.0, 14000.0, True), ("column", 100.0, 14000.0, False), ("slab", 100.0, 50000.0, False)], "etype string, concrete double, rebar double, by_ratio boolean")
    assert [r["verdict"] for r in building.rebar_check(g).collect()] == ["inconclusive", "supports", "conflicts"]


def test_components(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (7, 7)], "a long, b long")
    got = dict(rows(connected(links), "node", "component"))
    assert {got[i] for i in range(41)} == {0} and got[101] == 100


def test_polygon_overlap_and_area(spark):
    pt = lambda *p: [{"x": float(x), "y": float(y)} for x, y in p]
    df = spark.createDataFrame([(pt((0, 0), (4, 0), (4, 4), (0, 4)), pt((2, 2), (6, 2), (6, 6), (2, 6))), (pt((0, 0), (1, 0), (0, 1)), pt((5, 5), (6, 5), (6, 6)))], "a array<struct<x:double,y:double>>, b array<struct<x:double,y:double>>")
    got = df.select(geometry.overlap_area("a", "b").alias("o"), geometry.area(F.col("a")).alias("s")).collect()
    assert [(r["o"], r["s"]) for r in got] == [(pytest.approx(4.0), 16.0), (0.0, 0.5)]


@pytest.mark.parametrize("s, v", [("3.250,00", 3250.0), ("485,50", 485.5), ("3250.00", 3250.0), ("3.250", 3250.0), ("1.234.567", 1234567.0), ("x", None), ("", None)])
def test_numbers(spark, s, v):
    assert spark.createDataFrame([(s,)], "s string").select(text.parse_number(F.col("s")).alias("v")).first()["v"] == v


def test_titles_and_ranks(spark):
    df = spark.createDataFrame([("ÇATI_PLANI",), ("2. BODRUM",), ("ZEMİN KAT",), ("?",)], "t string")
    got = df.select(text.normalize_title(F.col("t")).alias("n"), text.floor_rank(F.col("t")).alias("r")).collect()
    assert [(r["n"], r["r"]) for r in got] == [("CATI PLANI", 99.0), ("2 BODRUM", -2.0), ("ZEMIN KAT", 0.0), ("?", None)]


def test_floor_titles_of_joined_numbers_and_codes(spark):
    """Numbers joined before a floor word, codes beside numbered floors, words with endings, and titles that name none."""
    titles = {
        "4/5. kat tavanı": 4, "6 ve 7. normal kat": 6, "B Blok 12 3. kat": 3, "MIM-00": 0, "ST_07 kesit": 7, "AK-2 9. KAT": 9, "3. bodrumun planı": -3, "Bodrumlar": -1, "teras katı": 98,
        "Çatı arası": 98, "teras bahçe": 99, "giriş holü": 0, "tip plan": 1, "normal kat": 1, "onuncu kat": 10, "temeller": -100, "": None, None: None, "A1 detay": None, "12": None, "asma tavanlı zemin": 0.5,
    }
    got = spark.createDataFrame([(t,) for t in titles], "t string").select("t", text.floor_rank(F.col("t")).alias("r")).collect()
    assert {r["t"]: r["r"] for r in got} == titles
