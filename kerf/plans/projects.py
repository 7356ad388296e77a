"""Queries over parameters, catalogs, walls, votes, schedules and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from kerf.operators import boq, projects
from kerf.plans.base import query, rounded
from kerf.plans.quantities import _ACC

_DEFAULTS = {"cable_drop": "0", "concrete_class": "C30/37", "screed_cm": "5", "wall_height": ""}


@query("flt_effective_params", "WITH p AS (SELECT DISTINCT project_id FROM drawings) SELECT project_id, CASE WHEN project_id % 2 = 0 THEN 'C40/50' ELSE 'C30/37' END AS concrete_class, '5' AS screed_cm, 4 AS n FROM p", "drawings")
def effective_params(drawings):
    own = F.when(F.col("project_id") % 2 == 0, F.create_map(F.lit("concrete_class"), F.lit("C40/50"), F.lit("unknown"), F.lit("1")))
    p = projects.effective_params(drawings.select("project_id").distinct().withColumn("params", own), _DEFAULTS)
    return p.select("project_id", p["params"]["concrete_class"].alias("concrete_class"), p["params"]["screed_cm"].alias("screed_cm"), F.size("params").alias("n"))


@query("flt_current_and_included", "SELECT project_id, etype, count(*) AS n FROM elements WHERE NOT superseded AND (manual OR confidence >= 0.4E0) AND NOT excluded GROUP BY ALL", "elements")
def current_and_included(elements):
    from kerf.operators import quantity

    return quantity.included(quantity.current(elements)).groupBy("project_id", "etype").agg(F.count(F.lit(1)).alias("n"))


@query("flt_tenant", "SELECT count(*) AS n, sum(drawing_id) AS ids FROM drawings WHERE project_id % 3 = 1 OR project_id % 3 = 2", "drawings")
def tenant(drawings):
    from kerf.operators import quantity

    d = drawings.withColumn("company_id", F.when(F.col("project_id") % 3 != 2, F.col("project_id") % 3))
    return quantity.owned_by(d, F.lit(1), F.lit(True)).agg(F.count(F.lit(1)).alias("n"), F.sum("drawing_id").alias("ids"))


@query("ext_catalog_overlay", "WITH c AS (SELECT DISTINCT concat(kind, ':', grp) AS code, unit FROM boq WHERE kind <> 'siva'), r AS (SELECT code FROM c WHERE hash(code) IS NOT NULL AND code LIKE '%g1%'), ch AS (SELECT DISTINCT code, 'x' AS unit FROM c WHERE code LIKE '%2') SELECT code, unit FROM c WHERE code NOT IN (SELECT code FROM r) AND code NOT IN (SELECT code FROM ch) UNION ALL SELECT code, unit FROM ch", "boq")
def catalog_overlay(rows):
    c = rows.where("kind <> 'siva'").select(boq.key().alias("code"), "unit").distinct()
    changed = c.where("code LIKE '%2'").select("code", F.lit("x").alias("unit")).distinct()
    return projects.overlay(c, changed, c.where("code LIKE '%g1%'"), "code")


@query("src_guess_unit", "WITH e AS (SELECT drawing_id, x * CASE WHEN drawing_id % 3 = 0 THEN 1000 WHEN drawing_id % 3 = 1 THEN 100 ELSE 0.1E0 END AS x, y FROM elements), g AS (SELECT drawing_id, greatest(max(x) - min(x), max(y) - min(y)) AS extent FROM e GROUP BY ALL) SELECT drawing_id, round(extent, 4) AS extent, CASE WHEN extent < 500 THEN 'm' WHEN extent < 50000 THEN 'cm' ELSE 'mm' END AS unit FROM g", "elements")
def guess_unit(elements):
    m = F.col("drawing_id") % 3
    return rounded(projects.guess_unit(elements.select("drawing_id", (F.col("x") * F.when(m == 0, 1000.0).when(m == 1, 100.0).otherwise(0.1)).alias("x"), "y")))


@query("qty_wall_faces", "SELECT element_id, round(greatest(length * 3 - b, 0) * CASE WHEN element_id % 3 = 0 THEN 1 ELSE 2 END, 5) AS plaster FROM elements WHERE etype = 'shear_wall'", "elements")
def wall_faces(elements):
    w = elements.where("etype = 'shear_wall'").select("element_id", (F.col("length") * 3).alias("gross"), F.col("b").alias("openings"), (F.col("element_id") % 3 == 0).alias("exterior"))
    return rounded(projects.wall_faces(w).select("element_id", "plaster"), 5)


@query("qty_wall_area", "SELECT element_id, round(length * coalesce(h, CASE WHEN project_id % 2 = 0 THEN 2.7E0 END, storey_height - slab_thickness), 7) AS wall_area FROM elements WHERE etype = 'shear_wall'", "elements")
def wall_area(elements):
    w = elements.where("etype = 'shear_wall'").withColumns({"layer_height": F.col("h"), "project_height": F.when(F.col("project_id") % 2 == 0, 2.7)})
    return rounded(projects.wall_area(w).select("element_id", "wall_area"), 7)


@query("qty_excavation_depth", "WITH p AS (SELECT project_id, min(level) AS bottom, max(level) AS top FROM drawings GROUP BY ALL) SELECT project_id, round(CASE project_id % 4 WHEN 0 THEN 2.4E0 WHEN 1 THEN 1 - bottom WHEN 2 THEN top / 10 + 0.5E0 + 0.1E0 ELSE 1.5E0 END, 6) AS depth, CASE project_id % 4 WHEN 0 THEN 'written' WHEN 1 THEN 'levels' WHEN 2 THEN 'foundation' ELSE 'default' END AS source FROM p", "drawings")
def excavation_depth(drawings):
    m = F.col("project_id") % 4
    p = drawings.groupBy("project_id").agg(F.min("level").alias("lo"), F.max("level").alias("hi"))
    p = p.select("project_id", F.when(m == 0, 2.4).alias("written"), F.when(m == 1, 1.0).alias("ground"), F.col("lo").alias("bottom"), F.when(m == 2, -F.col("hi") / 10).alias("foundation_level"), F.lit(0.5).alias("thickness"))
    d = projects.excavation_depth()
    return rounded(p.select("project_id", d["value"].alias("depth"), d["source"].alias("source")), 6)


@query("agg_cable_items", "SELECT project_id, concat('nyy_', CAST(drawing_id % 5 AS VARCHAR)) AS spec, round(sum((length + 1.5E0) * (1 + 5.0E0 / 100) * storey_count), 3) AS metres, CAST(sum(storey_count) AS BIGINT) AS runs FROM elements WHERE etype = 'beam' GROUP BY ALL", "elements")
def cable_items(elements):
    lines = elements.where("etype = 'beam'").withColumn("spec", F.concat(F.lit("nyy_"), (F.col("drawing_id") % 5).cast("string")))
    return rounded(projects.cable_items(lines, 1.5, 5.0), 3)


_SCHEDULE = "concat('Poz ', CASE element_id % 2 WHEN 0 THEN 'K' ELSE 'P' END, CAST(1 + element_id % 40 AS VARCHAR(9)), ' / ', CAST(1 + drawing_id % 9 AS VARCHAR(9)), CASE WHEN element_id % 3 = 0 THEN '' ELSE ' ADET' END)"


@query("agg_joinery_schedule", "SELECT project_id, concat(CASE element_id % 2 WHEN 0 THEN 'K' ELSE 'P' END, CAST(1 + element_id % 40 AS VARCHAR)) AS item, CAST(max(CASE WHEN element_id % 3 = 0 THEN 1 ELSE 1 + drawing_id % 9 END) AS INT) AS n FROM elements GROUP BY ALL", "elements")
def joinery_schedule(elements):
    return projects.schedule_counts(elements.selectExpr("project_id", f"{_SCHEDULE} AS text"))


@query("agg_fastener_sizes", "WITH s AS (SELECT project_id, CAST(12 + 4 * (element_id % 4) AS INT) AS dia, CAST(40 + 10 * (drawing_id % 6) AS INT) AS length, count(*) AS n FROM elements GROUP BY ALL) SELECT project_id, dia, length, n FROM (SELECT *, row_number() OVER (PARTITION BY project_id, dia ORDER BY n DESC, length) AS nth FROM s) WHERE nth = 1", "elements")
def fastener_sizes(elements):
    return projects.fastener_sizes(elements.selectExpr("project_id", "concat('4 adet M', CAST(12 + 4 * (element_id % 4) AS VARCHAR(9)), 'x', CAST(40 + 10 * (drawing_id % 6) AS VARCHAR(9)), ' bulon') AS text"))


_SOURCE = "CASE element_id % 3 WHEN 0 THEN 'plan' WHEN 1 THEN 'texts' ELSE 'table' END"


@query("agg_rebar_source_order", f"WITH s AS (SELECT drawing_id, element_id, {_SOURCE} AS source FROM elements), r AS (SELECT *, dense_rank() OVER (PARTITION BY drawing_id ORDER BY CASE source WHEN 'table' THEN 0 WHEN 'texts' THEN 1 ELSE 2 END) AS k FROM s) SELECT drawing_id, source, count(*) AS n FROM r WHERE k = 1 GROUP BY ALL", "elements")
def rebar_source_order(elements):
    return projects.source_priority(elements.selectExpr("drawing_id", "element_id", f"{_SOURCE} AS source")).groupBy("drawing_id", "source").agg(F.count(F.lit(1)).alias("n"))


@query("agg_joinery_facts", "SELECT project_id, element_id % 30 AS item, arg_max(storey_count, drawing_id * 10 + storey_count) AS value FROM elements GROUP BY ALL", "elements")
def joinery_facts(elements):
    return projects.last_by_sheet(elements.select("project_id", (F.col("element_id") % 30).alias("item"), F.col("storey_count").alias("value"), "drawing_id"))


@query("srt_top_layers", "WITH n AS (SELECT project_id, etype, count(*) AS n FROM elements GROUP BY ALL) SELECT project_id, etype, n, rank FROM (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY n DESC, etype) AS rank FROM n) WHERE rank <= 3", "elements")
def top_layers(elements):
    return projects.top_k(elements.groupBy("project_id", "etype").agg(F.count(F.lit(1)).alias("n")), ["project_id"], 3, F.desc("n"), F.col("etype"))


@query("srt_sheet_pick", "WITH s AS (SELECT project_id, drawing_id, plan_type, CASE WHEN drawing_id % 6 = 0 THEN NULL ELSE 't' END AS title, CAST(CASE drawing_id % 5 WHEN 0 THEN 500 WHEN 1 THEN 1000 ELSE 50 END AS INT) AS scale, drawing_id % 40 AS objects FROM drawings) SELECT drawing_id, CASE WHEN title IS NULL AND objects < 20 THEN 'skipped' WHEN scale >= 500 AND min(scale) OVER (PARTITION BY project_id, plan_type) < 500 THEN 'evidence' ELSE 'taken' END AS verdict FROM s", "drawings")
def sheet_pick(drawings):
    m = F.col("drawing_id") % 5
    s = drawings.select("project_id", "drawing_id", "plan_type", F.when(F.col("drawing_id") % 6 != 0, "t").alias("title"), F.when(m == 0, 500).when(m == 1, 1000).otherwise(50).alias("scale"), (F.col("drawing_id") % 40).alias("objects"))
    return projects.pick_sheets(s).select("drawing_id", "verdict")


@query("agg_headline", f"WITH a AS ({_ACC}), h AS (SELECT project_id, sum(CASE WHEN kind = 'beton' THEN quantity ELSE 0 END) AS beton_net, sum(CASE WHEN kind = 'kalip' THEN quantity ELSE 0 END) AS kalip_net, sum(CASE WHEN kind = 'demir' THEN quantity ELSE 0 END) AS demir_net, sum(CASE WHEN unit = 'saat' THEN quantity ELSE 0 END) AS hours FROM a GROUP BY project_id) SELECT *, round(beton_net * 1.03E0, 4) AS beton_total, round(demir_net * 1.03E0, 4) AS demir_total FROM h", "boq")
def headline(rows):
    return rounded(projects.headline(boq.accumulate(rows)))


@query("agg_coverage_gaps", "WITH p AS (SELECT DISTINCT project_id, unnest(['beton', 'asansor', 'kablo']) AS kind FROM drawings) SELECT project_id, kind FROM p WHERE (project_id, kind) NOT IN (SELECT (project_id, kind) FROM boq WHERE quantity > 0)", "boq", "drawings")
def coverage_gaps(rows, drawings):
    produced = drawings.select("project_id").distinct().withColumn("kind", F.explode(F.array(*[F.lit(k) for k in ("beton", "asansor", "kablo")])))
    return projects.coverage_gaps(rows, produced)


@query("agg_quality_issues", "WITH i AS (SELECT project_id, 'no_level' AS code, 'review' AS severity, count(*) AS n FROM drawings WHERE level IS NULL GROUP BY ALL UNION ALL SELECT project_id, 'rejected', 'blocking', count(*) FROM drawings WHERE status = 'P' AND price > 495000 GROUP BY ALL) SELECT *, CASE WHEN max(CASE WHEN severity = 'blocking' THEN 1 ELSE 0 END) OVER (PARTITION BY project_id) = 1 THEN 'incomplete' ELSE 'ready' END AS status FROM i", "drawings")
def quality_issues(drawings):
    return projects.quality_issues({"no_level": ("review", drawings.where("level IS NULL")), "rejected": ("blocking", drawings.where("status = 'P' AND price > 495000"))})


@query("agg_drawing_status", "WITH n AS (SELECT drawing_id, count(*) AS parts FROM elements WHERE etype = 'column' GROUP BY ALL) SELECT d.drawing_id, coalesce(parts, 0) AS parts, CASE WHEN d.drawing_id % 13 = 0 THEN 'untyped' WHEN parts IS NULL THEN 'empty' ELSE 'ok' END AS state FROM drawings d LEFT JOIN n USING (drawing_id)", "drawings", "elements")
def drawing_status(drawings, elements):
    d = drawings.select("drawing_id", F.when(F.col("drawing_id") % 13 != 0, F.col("plan_type")).alias("plan_type"))
    return projects.drawing_status(d, elements.where("etype = 'column'")).select("drawing_id", "parts", "state")


_LEVEL_TEXT = "concat('kot +', CAST(drawing_id % 9 AS VARCHAR(9)), '.', CAST(10 + element_id % 3 AS VARCHAR(9)), ' / +', CAST(drawing_id % 9 AS VARCHAR(9)), '.10')"


@query("agg_level_votes", "WITH v AS (SELECT drawing_id, (drawing_id % 9) + (10 + element_id % 3) / 100.0E0 AS level FROM elements UNION ALL SELECT drawing_id, (drawing_id % 9) + 0.1E0 FROM elements), n AS (SELECT drawing_id, round(level, 2) AS level, count(*) AS votes FROM v GROUP BY ALL) SELECT drawing_id, level, votes FROM (SELECT *, row_number() OVER (PARTITION BY drawing_id ORDER BY votes DESC, level) AS nth FROM n) WHERE nth = 1", "elements")
def level_votes(elements):
    return rounded(projects.level_votes(elements.selectExpr("drawing_id", f"{_LEVEL_TEXT} AS text")).select("drawing_id", "level", "votes"))


@query("join_steel_heights", "WITH s AS (SELECT project_id * 10 + drawing_id % 10 AS file, round(level, 2) AS level, drawing_id FROM drawings WHERE level IS NOT NULL), l AS (SELECT file, level, level - lag(level) OVER (PARTITION BY file ORDER BY level) AS height FROM (SELECT DISTINCT file, level FROM s)) SELECT drawing_id, round(height, 4) AS height FROM s JOIN l USING (file, level)", "drawings")
def steel_heights(drawings):
    s = drawings.where("level IS NOT NULL").select((F.col("project_id") * 10 + F.col("drawing_id") % 10).alias("file"), F.round("level", 2).alias("level"), "drawing_id")
    return rounded(projects.steel_heights(s).select("drawing_id", "height"))


#: Table levels meet a plan level, lie beside one, in the middle of two, or too far from any, by the sheet's number.
_FLOOR = "(drawing_id // 8 % 6) * 3.0E0"
_BESIDE = "CASE drawing_id % 7 WHEN 0 THEN 0.0E0 WHEN 1 THEN 0.4E0 WHEN 2 THEN -1.2E0 WHEN 3 THEN 1.5E0 WHEN 4 THEN 40.0E0 WHEN 5 THEN 0.1E0 ELSE 0.0E0 END"
_NEAREST_LEVEL = f"""WITH RECURSIVE t AS (SELECT project_id * 20 + drawing_id % 20 AS project_id, list_sort(list_distinct(list(round({_FLOOR} + {_BESIDE}, 2)))) AS t FROM drawings WHERE plan_type = 'donati' GROUP BY 1),
p AS (SELECT project_id * 20 + drawing_id % 20 + 3 - drawing_id % 4 AS project_id, list_sort(list_distinct(list(round({_FLOOR}, 2)))) AS p FROM drawings WHERE plan_type <> 'donati' AND drawing_id % 3 <> 0 GROUP BY 1),
j AS (SELECT project_id, list_filter(t, lambda v: NOT list_contains(p, v)) AS rest, list_filter(p, lambda v: NOT list_contains(t, v)) AS free, list_filter(t, lambda v: list_contains(p, v)) AS exact FROM t JOIN p USING (project_id)),
r AS (SELECT project_id, rest, free, CAST(NULL AS DOUBLE) AS level, CAST(NULL AS DOUBLE) AS plan FROM j
  UNION ALL SELECT project_id, rest[2:], CASE WHEN d IS NULL THEN free ELSE list_filter(free, lambda v: v <> near) END, rest[1], near FROM (
    SELECT *, list_min(list_filter(free, lambda v: abs(v - rest[1]) = d)) AS near FROM (SELECT *, list_min(list_filter(list_transform(free, lambda v: abs(v - rest[1])), lambda x: x <= 1.5E0)) AS d FROM r WHERE len(rest) > 0)))
SELECT project_id, level, plan FROM r WHERE plan IS NOT NULL UNION ALL SELECT project_id, v, v FROM (SELECT project_id, unnest(exact) AS v FROM j)"""


@query("join_nearest_level", _NEAREST_LEVEL, "drawings")
def nearest_level(drawings):
    floor, beside = _FLOOR.replace("//", "DIV"), _BESIDE
    table = drawings.where("plan_type = 'donati'").selectExpr("project_id * 20 + drawing_id % 20 AS project_id", f"round({floor} + {beside}, 2) AS level")
    plans = drawings.where("plan_type <> 'donati' AND drawing_id % 3 <> 0").selectExpr("project_id * 20 + drawing_id % 20 + 3 - drawing_id % 4 AS project_id", f"round({floor}, 2) AS level")
    return projects.nearest_free_level(table, plans)


@query("set_union_of_producers", "SELECT project_id, key, round(sum(q), 4) AS quantity FROM (SELECT project_id, concat(kind, ':', grp) AS key, quantity AS q FROM boq WHERE kind = 'beton' UNION ALL SELECT project_id, concat(kind, ':', grp), quantity FROM boq WHERE kind = 'kalip' UNION ALL SELECT project_id, 'beton:*', CAST(cnt AS DOUBLE) FROM boq WHERE kind = 'demir') GROUP BY ALL", "boq")
def union_of_producers(rows):
    part = lambda k: rows.where(F.col("kind") == k).select("project_id", boq.key().alias("key"), F.col("quantity").alias("q"))
    extra = rows.where("kind = 'demir'").select("project_id", F.lit("beton:*").alias("key"), F.col("cnt").alias("q"))
    return rounded(part("beton").unionByName(part("kalip")).unionByName(extra).groupBy("project_id", "key").agg(F.sum("q").alias("quantity")))


@query("set_shared_groups", "SELECT project_id, grp FROM boq WHERE kind = 'beton' INTERSECT SELECT project_id, grp FROM boq WHERE kind = 'kalip'", "boq")
def shared_groups(rows):
    return rows.where("kind = 'beton'").select("project_id", "grp").intersect(rows.where("kind = 'kalip'").select("project_id", "grp"))
