"""Bar tables from loose texts: two side by side, one below another, missing rows, units, positions."""

import os

import pytest

from kerf.operators import bar_tables
from kerf.registry import QUERIES

SF = "/root/testdata/sf0.001"

SCHEMA = "drawing_id long, x double, y double, text string, height double"


def sheet(n, *cells, height=5.0):
    return [(n, float(x), float(y), t, height) for x, y, t in cells]


#: Two tables side by side: the left one with all rows, the right one without weights; and a note at the height of a row.
SIDE = sheet(
    1,
    (0, 900, "POZ"), (90, 900, "ÇAP"), (400, 870, "ƒ8"), (500, 870, "Ø10"), (600, 871, "%%c20"), (1400, 870, "Ø14"),
    (0, 820, "01"), (90, 820, "10"), (180, 820, "44"), (498, 820, "640,50"), (0, 780, "02"), (90, 780, "8"), (180, 780, "70"), (402, 780, "1.150,00"),
    (1300, 780, "07"), (1330, 780, "14"), (1360, 780, "12"), (1398, 780, "50.00"),
    (-30, 700, "TOPLAM BOY (m)"), (401, 700, "1150"), (500, 699, "640.50"), (600, 700, "---"), (1280, 690, "TOTAL LENGTH (cm)"), (1400, 690, "5000"),
    (-30, 660, "BIRIM AGIRLIK (kg/m)"), (400, 660, "0.395"), (500, 660, "0.617"), (600, 660, "2.466"),
    (-30, 620, "AĞIRLIK (kg)"), (400, 620, "454.3"), (500, 620, "395.2"), (600, 620, "0.00"),
    (-30, 580, "TOPLAM AĞIRLIK (ton)"), (510, 580, "0.8495"), (5000, 580, "999999"), (700, 300, "S-101 25/50"),
)
#: A table below another of the same columns, which ends it; its declared sum is wrong.
BELOW = sheet(
    2, (100, 500, "Ø12"), (200, 500, "Ø16"), (0, 450, "TOPLAM BOY"), (100, 450, "10"), (200, 450, "20"), (100, 300, "Ø12"), (200, 300, "Ø16"), (0, 250, "AĞIRLIK (t)"), (100, 250, "0.1"), (200, 250, "0.3"), (0, 200, "GENEL TOPLAM"), (150, 200, "500")
)


@pytest.fixture(scope="module")
def read(spark):
    texts = spark.createDataFrame([*SIDE, *BELOW, *sheet(3, (0, 10, "Ø12"), (0, 5, "no table")), *sheet(4, (1, 1, "note"), (2, 1, "12"), (3, 1, "")), (5, None, 1.0, "Ø8", 1.0), (5, 1.0, 1.0, None, None)], SCHEMA).repartition(3)
    tables, diameters = bar_tables.bar_tables(texts)
    return [r.asDict() for r in tables.orderBy("drawing_id", "top", "part").collect()], [r.asDict() for r in diameters.orderBy("drawing_id", "top", "part", "dia").collect()]


def test_tables(read):
    tables, _ = read
    assert [(t["drawing_id"], t["anchor_x"], round(t["total_kg"], 2), t["declared_kg"] and round(t["declared_kg"], 2), t["pos_count"], t["differs"]) for t in tables] == [
        (1, 400.0, 849.5, 849.5, 1, False), (1, 1400.0, round(50 * 0.006165 * 196, 2), None, 1, False), (2, 100.0, round(0.006165 * (10 * 144 + 20 * 256), 2), None, 0, False), (2, 100.0, 400.0, 500.0, 0, True)
    ]


def test_diameters(read):
    _, rows = read
    got = [(r["drawing_id"], r["dia"], round(r["length_m"], 2), round(r["weight_kg"], 1), r["from_length"]) for r in rows]
    assert got == [
        (1, 8, 1150.0, 454.3, False), (1, 10, 640.5, 395.2, False), (1, 20, 0.0, 0.0, False), (1, 14, 50.0, 60.4, True), (2, 12, 10.0, 8.9, True), (2, 16, 20.0, 31.6, True), (2, 12, 0.0, 100.0, False), (2, 16, 0.0, 300.0, False)
    ]


def test_numbers_and_no_texts(spark):
    told = {"1.212,00": 1212.0, "762.00": 762.0, "1,234.5": 1234.5, "12,5": 12.5, "1.234.567": 1234567.0, "12 400": 12400.0, "-3": -3.0, "---": None, "3a": None, "": None}
    df = spark.createDataFrame([(t,) for t in told], "t string")
    assert {r["t"]: r["v"] for r in df.select("t", bar_tables.value(df["t"]).alias("v")).collect()} == told
    assert [d.count() for d in bar_tables.bar_tables(spark.createDataFrame([], SCHEMA))] == [0, 0]


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
def test_sheets_are_dealt_once(spark):
    plan = QUERIES["isl_bar_tables"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan and "kerf-" not in plan


def test_steps_stay_out_of_lambdas(spark):
    """Each sort of a sheet stands in its plan once, not in the steps that read it."""
    plan = bar_tables.by_diameter(spark.createDataFrame(SIDE, SCHEMA))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("sort_array(cells#") == 1 and plan.count("sort_array(filter(") == 1
