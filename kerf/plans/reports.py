"""Queries over rebar rows, storeys, usage, products and truth tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from kerf.operators import building, reports
from kerf.plans.base import query, rounded


@query("flt_contributing", "SELECT plan_type, count(*) AS n FROM drawings WHERE plan_type NOT IN ('donati', 'vaziyet') GROUP BY ALL", "drawings")
def contributing(drawings):
    return reports.contributing(drawings).groupBy("plan_type").agg(F.count(F.lit(1)).alias("n"))


_LAYER = "concat('BLD-', CASE element_id % 3 WHEN 0 THEN 'STA' WHEN 1 THEN 'MIM' ELSE 'ELK' END, '-C', CAST(element_id % 20 AS VARCHAR(9)), CASE WHEN element_id % 2 = 0 THEN concat('-', CAST(drawing_id % 9 AS VARCHAR(9)), 'x2') ELSE '' END)"


@query("lkp_layer_name_parts", f"SELECT DISTINCT {_LAYER} AS layer, CASE element_id % 3 WHEN 0 THEN 'STA' WHEN 1 THEN 'MIM' ELSE 'ELK' END AS discipline, concat('C', CAST(element_id % 20 AS VARCHAR)) AS code, CASE WHEN element_id % 2 = 0 THEN concat(CAST(drawing_id % 9 AS VARCHAR), 'x2') ELSE '' END AS spec FROM elements", "elements")
def layer_name_parts(elements):
    parts = reports.layer_parts(F.col("layer"))
    return elements.selectExpr(f"{_LAYER} AS layer").distinct().select("layer", *[c.alias(k) for k, c in parts.items()])


@query("lkp_item_scope", "SELECT DISTINCT kind, discipline, coalesce(CASE WHEN kind = 'boya' THEN 'building' END, CASE WHEN kind = 'kablo' THEN 'room' END, CASE discipline WHEN 'architectural' THEN 'room' ELSE 'building' END) AS scope FROM boq", "boq")
def item_scope(rows):
    k = F.col("kind")
    return rows.select("kind", "discipline").distinct().withColumn("scope", reports.scope_of(F.when(k == "boya", "building"), F.when(k == "kablo", "room"), F.col("discipline")))


_REBAR = "SELECT project_id, etype AS target, CAST(8 + 2 * (element_id % 12) AS INT) AS dia, CASE WHEN element_id % 3 = 0 THEN NULL ELSE length * 10 END AS weight_kg, length AS length_m, storey_count FROM elements"


@query("agg_rebar_table_rows", f"WITH r AS ({_REBAR}), k AS (SELECT *, coalesce(weight_kg, length_m * dia * dia * 0.006165E0) * CASE WHEN target = 'foundation' THEN 1 ELSE storey_count END AS kg FROM r) SELECT project_id, dia, round(sum(kg), 3) AS kg, count(DISTINCT target) AS targets FROM k GROUP BY ALL", "elements")
def rebar_table_rows(elements):
    r = elements.selectExpr("project_id", "etype AS target", "CAST(8 + 2 * (element_id % 12) AS INT) AS dia", "CASE WHEN element_id % 3 = 0 THEN NULL ELSE length * 10 END AS weight_kg", "length AS length_m", "storey_count")
    return rounded(reports.rebar_by_diameter(reports.rebar_rows(r)).select("project_id", "dia", "kg", F.size("targets").cast("long").alias("targets")), 3)


_TITLED = "SELECT project_id, drawing_id, plan_type, level, CASE WHEN drawing_id % 17 = 0 THEN CAST(drawing_id % 5 + 1 AS INT) END AS manual, CASE drawing_id % 4 WHEN 0 THEN concat(CAST(1 + drawing_id % 3 AS VARCHAR(9)), '.-', CAST(4 + drawing_id % 5 AS VARCHAR(9)), '. NORMAL KAT') WHEN 1 THEN concat(CAST(2 + drawing_id % 7 AS VARCHAR(9)), ' ADET KAT') ELSE 'KAT PLANI' END AS title FROM drawings"


def titled(drawings):
    return drawings.selectExpr(*_TITLED.removeprefix("SELECT ").removesuffix(" FROM drawings").replace("project_id, drawing_id, plan_type, level, ", "project_id|drawing_id|plan_type|level|").replace(" END AS manual, ", " END AS manual|").split("|"))


_STOREYS = f"s AS ({_TITLED}), n AS (SELECT drawing_id, project_id, CASE WHEN manual IS NOT NULL THEN manual WHEN plan_type = 'kesit' THEN 1 WHEN drawing_id % 4 = 0 THEN (4 + drawing_id % 5) - (1 + drawing_id % 3) + 1 WHEN drawing_id % 4 = 1 THEN 2 + drawing_id % 7 ELSE 1 END AS storeys, CASE WHEN manual IS NOT NULL THEN 'user' WHEN plan_type = 'kesit' THEN 'whole_building' WHEN drawing_id % 4 = 0 THEN 'title_range' WHEN drawing_id % 4 = 1 THEN 'title_count' WHEN level IS NOT NULL THEN 'own_level' ELSE 'default' END AS source FROM s)"


@query("agg_storey_counts", f"WITH {_STOREYS} SELECT project_id, drawing_id, CAST(storeys AS INT) AS storeys, source FROM n", "drawings")
def storey_counts(drawings):
    return reports.storey_counts(titled(drawings))


@query("agg_derivations", f"WITH {_STOREYS} SELECT source, count(*) AS n, round(sum(storeys), 3) AS total FROM n GROUP BY ALL", "drawings")
def derived_parameters(drawings):
    d = reports.derivations(building.storey_heights(drawings), reports.storey_counts(titled(drawings))).where("parameter = 'storeys'")
    return rounded(d.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")), 3)


@query("agg_usage", "WITH t AS (SELECT project_id, drawing_id % 6 AS floor, element_id % 5 AS k FROM elements), n AS (SELECT project_id, floor, count(*) FILTER (k IN (0, 1)) AS commercial, count(*) FILTER (k IN (2, 3)) AS dwelling FROM t WHERE k < 4 GROUP BY ALL) SELECT *, CASE WHEN commercial >= dwelling THEN 'commercial' ELSE 'dwelling' END AS usage FROM n", "elements")
def usage(elements):
    k = F.col("element_id") % 5
    t = elements.select("project_id", (F.col("drawing_id") % 6).alias("floor"), F.when(k == 0, "DUKKAN 1").when(k == 1, "Ofis").when(k == 2, "yatak odasi").when(k == 3, "SALON").otherwise("hol").alias("text"))
    return reports.usage(t)


@query("agg_joinery_exceptions", "SELECT project_id, CASE WHEN element_id % 9 = 0 THEN 'curved' ELSE 'no_size' END AS why, count(*) AS n FROM elements WHERE etype = 'parapet' AND (element_id % 9 = 0 OR h IS NULL) GROUP BY ALL", "elements")
def joinery_exceptions(elements):
    return reports.curved_joinery(elements.where("etype = 'parapet'").select("project_id", F.when(F.col("element_id") % 9 == 0, "Kemerli").otherwise("duz").alias("note"), F.col("h").alias("width")))


@query("agg_known_products", "SELECT DISTINCT key FROM (SELECT unnest(['beton:c25_30', 'beton:c30_37', 'demir:o8', 'demir:o10', 'demir:o12']) AS key UNION ALL SELECT concat(kind, ':*') FROM boq UNION ALL SELECT concat(kind, ':', grp) FROM boq)", "boq")
def known_products(rows):
    return reports.known_products(rows, ["c25_30", "c30_37"], [8, 10, 12])


@query("src_truth_corpus", "SELECT project_id AS corpus, drawing_id % 6 AS floor, etype AS measure, round(sum(area), 3) AS value FROM elements GROUP BY ALL", "elements")
def truth_corpus(elements):
    per = elements.groupBy(F.col("project_id").alias("corpus"), (F.col("drawing_id") % 6).alias("floor"), "etype").agg(F.sum("area").alias("a"))
    floors = per.groupBy("corpus", "floor").agg(F.map_from_entries(F.collect_list(F.struct("etype", "a"))).alias("truth"))
    return rounded(reports.truth_rows(floors, ["column", "shear_wall", "beam", "slab", "parapet", "foundation", "stair"]), 3)


@query("join_section_slopes", "WITH l AS (SELECT project_id, drawing_id AS line_id, level AS lo, level + 1.5E0 + drawing_id % 3 AS hi FROM drawings WHERE level IS NOT NULL AND plan_type = 'kesit'), s AS (SELECT project_id, CAST(rank AS BIGINT) AS sheet_id, min(rank * 3.0E0) AS bottom, max(rank * 3.0E0 + 3) AS top FROM drawings WHERE rank IS NOT NULL GROUP BY ALL), j AS (SELECT line_id, sheet_id, (least(hi, top) - greatest(lo, bottom)) / (hi - lo) AS share FROM l JOIN s USING (project_id) WHERE lo < top AND hi > bottom) SELECT line_id, sheet_id, round(share, 4) AS share FROM (SELECT *, row_number() OVER (PARTITION BY line_id ORDER BY share DESC, sheet_id) AS nth FROM j WHERE share >= 0.6E0) WHERE nth = 1", "drawings")
def section_slopes(drawings):
    lines = drawings.where("level IS NOT NULL AND plan_type = 'kesit'").select("project_id", F.col("drawing_id").alias("line_id"), F.col("level").alias("lo"), (F.col("level") + 1.5 + F.col("drawing_id") % 3).alias("hi"))
    sheets = drawings.where("rank IS NOT NULL").groupBy("project_id", F.col("rank").cast("long").alias("sheet_id")).agg(F.min(F.col("rank") * 3.0).alias("bottom"), F.max(F.col("rank") * 3.0 + 3).alias("top"))
    return rounded(reports.section_slopes(lines, sheets))
