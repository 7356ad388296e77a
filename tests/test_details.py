"""Net lengths, title blocks, rebar tables, prices: known answers and plain Python versions."""

import os
from collections import defaultdict

import pytest

from kerf.operators import cost, rebar, segments, titleblock
from kerf.plans import details
from kerf.sources.views import view

SF = "/root/testdata/sf0.001"


def test_net_length(spark):
    s = spark.createDataFrame([(1, 1, 0.0, 0.0, 20.0, 0.0), (1, 2, 0.0, 0.0, 6.0, 8.0), (1, 3, 0.0, 5.0, 20.0, 5.0), (2, 4, 0.0, 0.0, 20.0, 0.0), (1, 5, 3.0, 0.0, 3.0, 0.0)], "drawing_id int, segment_id int, x0 double, y0 double, x1 double, y1 double")
    box = lambda a, b, c, d: [(a, b), (c, b), (c, d), (a, d)]
    o = spark.createDataFrame([(1, box(2.0, -1.0, 4.0, 1.0)), (1, box(3.0, -1.0, 12.0, 1.0)), (1, box(19.0, -1.0, 30.0, 1.0)), (1, [(10.0, 3.0), (14.0, 5.0), (10.0, 7.0)])], "drawing_id int, points array<struct<x:double,y:double>>")
    got = {r["segment_id"]: r["net_length"] for r in segments.net_length(s, o).collect()}
    # 2..12 and 19..20 are covered; the triangle covers 10..14; nothing of the other drawing.
    assert {k: round(v, 6) for k, v in got.items()} == {1: 9.0, 2: 10.0, 3: 16.0, 4: 20.0, 5: 0.0}
    assert segments.net_length(s.where("false"), o).count() == 0


def test_titleblock_pairs(spark):
    t = [(1, "Malzeme", 0.0, 0.0), (2, "C30/37", 20.0, 0.3), (3, "far", 50.0, 0.0), (4, "KAT ADEDI", 0.0, -10.0), (5, "--", 1.0, -10.0), (6, "5", 1.0, -12.0), (7, "below", 0.0, -2.0), (8, "KAT ADEDI", 100.0, 100.0)]
    df = spark.createDataFrame([(9, i, x, y, 1.0, s) for i, s, x, y in t], "drawing_id int, item_id int, x double, y double, h double, text string")
    got = titleblock.pair_values(df, {"MALZEME": "material", "KAT ADEDI": "storeys"}).collect()
    assert {r["field"]: r["value"] for r in got} == {"material": "C30/37", "storeys": "5"}


def test_priced_by_labour(spark):
    q = spark.createDataFrame([(1, "item", "a:x", 0.0, 0.0, False), (2, "item", "a:x", 0.0, 7.0, False), (3, "item", "b:x", 0.0, 0.0, False), (4, "item", "b:*", 5.0, 0.0, False), (5, "item", "c:x", 9.0, 0.0, False), (6, "item", "c:x", 0.0, 3.0, False), (7, "item", "d:x", 0.0, 0.0, False), (8, "item", "c:y", 9.0, 0.0, True), (9, "item", "c:y", 1.0, 0.0, True)], "quote_id int, scope string, key string, unit_price double, labor_price double, preferred boolean")
    best = cost.best_quote(q)
    assert {r["key"]: r["quote_id"] for r in best.collect()} == {"a:x": 2, "b:x": 3, "b:*": 4, "c:x": 5, "d:x": 7, "c:y": 8}
    items = spark.createDataFrame([("a:x",), ("b:x",), ("d:x",)], "key string")
    got = {r["key"]: (r["price"], r["labor"], r["price_source"]) for r in cost.lookup_price(items, best).collect()}
    assert got == {"a:x": (0.0, 7.0, "own"), "b:x": (5.0, 0.0, "general"), "d:x": (0.0, 0.0, "none")}


def test_inherited_prices(spark):
    items = spark.createDataFrame([(1, "duvar", "duvar:a", "m1"), (1, "duvar", "duvar:b", "m1"), (1, "boya", "boya:a", "boya:a"), (1, "siva", "siva:a", "m3"), (2, "siva", "siva:a", "m3"), (2, "saat", "saat:a", None)], "project_id int, kind string, key string, material string")
    prices = lambda rows, key: spark.createDataFrame(rows, f"project_id int, {key} string, price double")
    book = spark.createDataFrame([("boya:*", 4.0), ("m3", 0.0)], "material string, price double")
    got = cost.inherit_prices(items, prices([(2, "m3", 8.0)], "material"), prices([(1, "duvar:a", 0.0), (1, "duvar:b", 3.0), (1, "siva:*", 2.0), (1, "duvar:*", 1.0)], "key"), book)
    assert {(r["project_id"], r["material"]): (r["price"], r["price_source"]) for r in got.collect()} == {(1, "m1"): (3.0, "item"), (1, "boya:a"): (4.0, "book"), (1, "m3"): (2.0, "general"), (2, "m3"): (8.0, "own")}


def plain_rebar(lines, tables, most=1.5):
    level_kg, conc, total, none, at = (defaultdict(float) for _ in range(5))
    levels = defaultdict(set)
    for r in lines:
        k = r["project_id"], r["etype"], r["key"]
        level_kg[k, r["level"]] += r["ratio_kg"]
        conc[k] += r["concrete"]
        levels[k[:2]].add(r["level"])
    for r in tables:
        k = r["project_id"], r["etype"]
        total[k] += r["kg"]
        none[k] = none[k] or r["level"] is None
        at.setdefault(k, set())
        at[k] = at[k] | {r["level"]}
    out = {}
    for k in set(levels) | set(total):
        have = levels.get(k, set()) - {None}
        asked = at.get(k, set()) - {None} if k in total else set()
        met = have & asked
        free = have - met
        for t in sorted(asked - met):
            near = sorted((abs(p - t), p) for p in free if abs(p - t) <= most)
            if near:
                met.add(near[0][1])
                free.discard(near[0][1])
        keys = [g for g in conc if g[:2] == k]
        whole = not met or none.get(k) or k[1] == "foundation"
        type_conc = sum(conc[g] for g in keys) or 1.0
        for g in keys:
            kept = sum(v for (h, lv), v in level_kg.items() if h == g and (k not in total or lv not in met))
            kept = 0.0 if k in total and whole else kept
            table = total[k] * conc[g] / type_conc if k in total else 0.0
            out[g] = (table + kept, kept, "oran" if k not in total else "tablo+oran" if kept > 0 else "tablo")
        if not keys:
            out[(*k, k[1])] = (total[k], 0.0, "tablo")
    return out


def same(got, want):
    got = {(r["project_id"], r["etype"], r["key"]): (r["rebar_kg"], r["ratio_kg"], r["source"]) for r in got.collect()}
    assert got.keys() == want.keys()
    for k, (a, b, s) in want.items():
        assert got[k][2] == s and got[k][:2] == pytest.approx((a, b), abs=0.02)
    return got


def test_table_rebar_small(spark):
    lines = spark.createDataFrame([(1, "column", "column", 0.0, 10.0, 100.0), (1, "column", "column", 3.0, 10.0, 120.0), (1, "column", "column", None, 1.0, 5.0), (1, "foundation", "foundation:raft", 0.0, 30.0, 90.0), (1, "foundation", "foundation:strip", 0.0, 10.0, 30.0), (1, "slab", "slab", 0.0, 5.0, 50.0), (1, "beam", "beam", 0.0, 5.0, 50.0)], "project_id int, etype string, key string, level double, concrete double, ratio_kg double")
    tables = spark.createDataFrame([(1, "column", 0.5, 80.0), (1, "foundation", 9.0, 200.0), (1, "pile", None, 7.0), (1, "beam", 0.0, 40.0), (1, "beam", None, 2.0)], "project_id int, etype string, level double, kg double")
    got = same(rebar.replace_ratio(lines, tables), plain_rebar(lines.collect(), tables.collect()))
    assert got[1, "column", "column"] == (205.0, 125.0, "tablo+oran")
    assert got[1, "foundation", "foundation:raft"] == (150.0, 0.0, "tablo")
    assert got[1, "beam", "beam"] == (42.0, 0.0, "tablo") and got[1, "slab", "slab"] == (50.0, 50.0, "oran") and got[1, "pile", "pile"] == (7.0, 0.0, "tablo")


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
def test_table_rebar_of_tables(spark):
    lines, tables = details.rebar_inputs(view(spark, SF, "elements"), view(spark, SF, "drawings"))
    got = same(rebar.replace_ratio(lines, tables), plain_rebar(lines.collect(), tables.collect()))
    assert {x[2] for x in got.values()} == {"oran", "tablo", "tablo+oran"}


def test_price_list_of_long_numbers(spark):
    """an item number whose last part has five digits."""
    from kerf.functions import text

    lines = spark.createDataFrame([(1, "15.100.61000; Imalat 3; m3; 12,50"), (2, "15.100.1000; Imalat 4; KG; 7,50")], "line_no long, line string")
    got = {r["poz"]: (r["name"], r["unit"], r["price"]) for r in text.price_list(lines).collect()}
    assert got == {"15.100.61000": ("Imalat 3", "m3", 12.5), "15.100.1000": ("Imalat 4", "kg", 7.5)}


def test_rectangle_works_out_each_angle_once(spark):
    """F16: angles are taken an edge, not a point and use."""
    from pyspark.sql import functions as F

    from kerf.functions import geometry

    points = [(0.0, 0.0), (4.0, 3.0), (2.5, 5.0), (-1.5, 2.0)]
    df = spark.createDataFrame([(points,)], "p array<struct<x:double,y:double>>").select(geometry.min_rectangle(F.col("p")).alias("r"))
    assert df._jdf.queryExecution().analyzed().toString().lower().count("atan2") == 1
    r = df.first()["r"]
    assert (round(r["area"], 9), round(r["long"], 9), round(r["short"], 9)) == (12.5, 5.0, 2.5)


def test_plan_offset_forms_pairs_of_like_areas_only(spark):
    """areas are met in steps; those at the tolerance's edge count as before."""
    from kerf.operators import spatial

    areas = [0.02, 1.0, 4.99, 5.0, 5.01, 40.0, 900.0]
    target = [(1, "n", a, 10.0 * i, 0.0) for i, a in enumerate(areas)]
    source = [(1, "n", a + 0.99 * max(0.05, 0.01 * a) * (-1) ** i, 10.0 * i - 3, -7.0) for i, a in enumerate(areas)]
    schema = "project_id long, name string, area double, x double, y double"
    got = spatial.plan_offset(spark.createDataFrame(target, schema), spark.createDataFrame(source, schema))
    assert "step" in got._jdf.queryExecution().analyzed().toString()
    assert [tuple(r) for r in got.collect()] == [(1, 3.0, 7.0, len(areas))]


def test_plan_offset_reads_the_whole_plan(spark):
    """no drawing is left out of the query or its SQL, and a shift between hundredths keeps all its votes."""
    import random

    from kerf.operators import spatial
    from kerf.registry import ORACLE, QUERIES

    assert "% 40" not in ORACLE["join_plan_offset"]
    voted = QUERIES["join_plan_offset"](spark, SF)
    rooms = {r["project_id"]: r["count"] for r in view(spark, SF, "elements").groupBy("project_id").count().collect()}
    assert {r["project_id"]: r["votes"] >= rooms[r["project_id"]] for r in voted.collect()} == dict.fromkeys(rooms, True)

    schema = "project_id long, name string, area double, x double, y double"
    rng = random.Random(3)
    for by in (0.0, 0.0049):
        target = [(p, rng.choice("abcd"), rng.uniform(0.1, 60), round(rng.uniform(-90, 90), 2) + rng.uniform(0, by), round(rng.uniform(0, 40), 2)) for p in (1, 2) for _ in range(150)]
        source = [(p, n, a + rng.uniform(-0.04, 0.04), x + 12.34 + rng.uniform(0, by), y - 5.5) for p, n, a, x, y in target if p == 1 or rng.random() < 0.3] + [(2, None, None, None, 1.0)]
        votes = defaultdict(int)
        for p, n, a, x, y in target:
            for q, m, b, u, v in source:
                if p == q and n == m and abs(a - b) <= max(0.05, 0.01 * a):
                    votes[p, round(x - u, 2), round(y - v, 2)] += 1
        want = {p: (v, dx, dy) for (p, dx, dy), v in sorted(votes.items(), key=lambda e: (e[1], e[0])) if v * 2 >= 150}
        got = spatial.plan_offset(spark.createDataFrame(target, schema), spark.createDataFrame(source, schema)).collect()
        assert {r["project_id"]: (r["votes"], r["dx"], r["dy"]) for r in got} == want and len(want) == 1
