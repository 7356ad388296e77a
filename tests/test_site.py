"""Owners, excavation and uses of floors: known answers."""

import math

from pyspark.sql import functions as F

from kerf.operators import site


def test_foreign_owner(spark):
    rows = [("mim_cati", "duvar_ytong", "mim_kat_plani"), ("mim_kat_plani", "DUVAR_ytong", ""), ("mim_kesit", "duvar", ""), (None, "duvar", ""), ("mim_cati", "duvarlar", ""), ("mim_cati", None, ""), ("mim_cati", "", ""),
            ("mim_cati", "cati_oluk_bakir", ""), ("elk_tava", "boru_pvc", "elk_kuvvet"), ("mek_sihhi", "boru_pvc_110", ""), ("sta_kolon", "beton", "sta_kat_kalip")]
    df = spark.createDataFrame([(i, p, c, "extra") for i, (p, c, _) in enumerate(rows)], "id int, plan_type string, code string, first string")
    got = site.foreign_owner(df)
    assert got.columns == [*df.columns, "owner"]
    assert [r["owner"] for r in got.orderBy("id").collect()] == [r[2] for r in rows]
    assert site.foreign_owner(df.where("false")).count() == 0


def test_excavation(spark):
    box = [(0.0, 0.0), (10.0, 0.0), (10.0, 4.0), (0.0, 4.0)]
    triangle = [(0.0, 0.0), (6.0, 0.0), (0.0, 8.0)]
    rows = [(1, box, 40.0, 2.0, None, None, None, None), (2, box, 40.0, 2.0, 1.15, 0.8, None, None), (3, None, 40.0, 2.0, None, 0.8, None, None), (4, box, 40.0, 2.0, None, 1.0, 0.5, 0.5), (5, triangle, 24.0, 1.0, None, None, 1.0, None), (6, [], 40.0, 2.0, None, None, None, None)]
    df = spark.createDataFrame(rows, "id int, points array<struct<x:double,y:double>>, area double, depth double, margin double, note_work double, own_work double, slope double")
    got = {r["id"]: (r["volume"], r["work"], r["work_source"]) for r in site.excavation(df).collect()}
    assert math.isclose(got[1][0], 2 * 11.2 * 5.2) and got[1][1:] == (0.6, "default")
    assert math.isclose(got[2][0], 92.0) and got[2][1:] == (None, "param")
    assert got[3] == (80.0, None, "default") and got[6] == (80.0, None, "default")
    assert math.isclose(got[4][0], 2 / 6 * (12 * 6 + 4 * 13 * 7 + 14 * 8)) and got[4][1:] == (1.0, "drawing")
    # A right triangle 3-4-5 with inradius 2 widened by 1 is the same triangle with inradius 3.
    assert math.isclose(got[5][0], 24 * (3 / 2) ** 2) and got[5][2] == "param"


def test_usage(spark):
    rows = [(1, "A", 1, "konut"), (1, "a ", 1, "konut"), (1, "B", 1, "konut"), (1, "B", None, "konut"), (1, "B", 2, "sosyal"), (2, "A", 1, "ticari"), (2, None, 2, "ofis"), (3, "A", 1, None)]
    df = spark.createDataFrame(rows, "project_id int, block string, rank int, usage string")
    got = {r["project_id"]: (r["summary"], r["mixed"], r["whole_floors"]) for r in site.usage_summary(df).collect()}
    assert got == {1: ("konut: 4, sosyal: 1", False, 3), 2: ("ofis: 1, ticari: 1", True, 1), 3: ("", False, 0)}
    ranks = spark.createDataFrame([(98,), (-1,), (0,), (None,)], "r int")
    assert [x[0] for x in ranks.select(site.floor_role(F.col("r"))).collect()] == ["attic", "basement", "", ""]
