"""Queries over prices, cost and norms."""

from __future__ import annotations

from pyspark.sql import functions as F

from kerf.operators import boq, cost
from kerf.plans.base import query, rounded
from kerf.plans.quantities import _ACC

_BEST = """SELECT * EXCLUDE (nth, class) FROM (SELECT *, row_number() OVER (PARTITION BY scope, key ORDER BY class, CASE WHEN class = 1 THEN CASE WHEN unit_price > 0 THEN unit_price ELSE 1e300 END END, quote_id) AS nth
  FROM (SELECT *, CASE WHEN preferred THEN 0 WHEN unit_price + labor_price > 0 THEN 1 ELSE 2 END AS class FROM quotes)) WHERE nth = 1"""


@query("win_best_quote", f"SELECT scope, key, supplier_id, quote_id, unit_price FROM ({_BEST})", "quotes")
def best_quote(quotes):
    return cost.best_quote(quotes).select("scope", "key", "supplier_id", "quote_id", "unit_price")


@query("src_pricebook_upsert", "WITH l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY scope, key, supplier_id ORDER BY updated DESC, quote_id DESC) AS nth FROM quotes) WHERE nth = 1) SELECT scope, key, supplier_id, quote_id, unit_price, preferred AND row_number() OVER (PARTITION BY scope, key ORDER BY preferred DESC, updated DESC, quote_id DESC) = 1 AS preferred FROM l", "quotes")
def pricebook_upsert(quotes):
    return cost.latest_quote(quotes).select("scope", "key", "supplier_id", "quote_id", "unit_price", "preferred")


@query(
    "join_price_lookup",
    f"""WITH best AS (SELECT key, unit_price, labor_price FROM ({_BEST}) WHERE scope = 'item' AND unit_price + labor_price > 0), i AS (SELECT DISTINCT concat('k', CAST(4 + element_id % 4 AS VARCHAR), ':g', CAST(drawing_id % 60 AS VARCHAR)) AS key FROM elements)
    SELECT i.key, coalesce(o.unit_price, g.unit_price, 0) AS price, coalesce(o.labor_price, g.labor_price, 0) AS labor, CASE WHEN o.key IS NOT NULL THEN 'own' WHEN g.key IS NOT NULL THEN 'general' ELSE 'none' END AS price_source
    FROM i LEFT JOIN best o ON o.key = i.key LEFT JOIN best g ON g.key = concat(split_part(i.key, ':', 1), ':*')""",
    "quotes", "elements",
)
def price_lookup(quotes, elements):
    items = elements.select(F.concat(F.lit("k"), (4 + F.col("element_id") % 4).cast("string"), F.lit(":g"), (F.col("drawing_id") % 60).cast("string")).alias("key")).distinct()
    return cost.lookup_price(items, cost.best_quote(quotes).where("scope = 'item'")).select("key", "price", "labor", "price_source")


@query("join_rebar_hours", "WITH d AS (SELECT DISTINCT project_id, CASE WHEN element_id % 10 = 0 THEN NULL ELSE CAST(4 + element_id % 45 AS INT) END AS dia FROM elements), n(lo, hi, prepare, carry, place) AS (VALUES (6, 10, 8.0E0, 4.0E0, 15.0E0), (11, 12, 6.0E0, 3.0E0, 11.0E0), (13, 16, 5.0E0, 3.0E0, 8.0E0), (17, 22, 4.5E0, 2.5E0, 6.5E0), (23, 40, 4.0E0, 2.5E0, 5.0E0)) SELECT project_id, dia, round(prepare * 0.75E0, 2) AS prepare, carry, round(place * 1.15E0, 2) AS place FROM d JOIN n ON least(CASE WHEN coalesce(dia, 0) = 0 THEN 14 ELSE greatest(dia, 6) END, 40) BETWEEN lo AND hi", "elements")
def rebar_hours(elements):
    rows = elements.select("project_id", F.when(F.col("element_id") % 10 != 0, (4 + F.col("element_id") % 45).cast("int")).alias("dia")).distinct()
    return cost.with_rebar_hours(rows, "cift", 25.0)


@query("join_formwork_hours", "SELECT DISTINCT etype, round(CASE etype " + " ".join(f"WHEN '{k}' THEN {v[0]}E0" for k, v in cost.FORM_HOURS.items()) + " END * 1.25E0 / 5, 4) AS make_h, round(CASE etype " + " ".join(f"WHEN '{k}' THEN {v[1]}E0" for k, v in cost.FORM_HOURS.items()) + " END * 1.15E0, 4) AS set_h FROM elements", "elements")
def formwork_hours(elements):
    h = cost.form_hours(F.col("etype"), "ahsap", 5.0)
    return elements.select("etype").distinct().select("etype", h["make"].alias("make_h"), h["set"].alias("set_h"))


_MATERIAL = "CASE WHEN unit = 'saat' THEN NULL WHEN kind = 'beton' THEN 'beton:c30_37' WHEN kind = 'demir' THEN CASE WHEN regexp_matches(grp, '^(.*:)?o?[0-9]+$') THEN concat('demir:o', regexp_extract(grp, '([0-9]+)$', 1)) ELSE 'demir:karisik' END WHEN kind = 'kalip' THEN 'kalip:plywood' ELSE concat(kind, ':', grp) END"


@query("agg_material_lines", f"WITH a AS ({_ACC}), m AS (SELECT *, {_MATERIAL} AS material FROM a), o AS (SELECT *, row_number() OVER (PARTITION BY project_id, material ORDER BY quantity DESC, kind, grp, unit) AS nth FROM m WHERE material IS NOT NULL) SELECT project_id, material, round(sum(quantity), 4) AS quantity, count(*) AS n_items, min(CASE WHEN nth = 1 THEN concat_ws(':', kind, grp, unit) END) AS first_item, CAST(sum(CASE WHEN nth <= 40 THEN 1 ELSE 0 END) AS BIGINT) AS listed FROM o GROUP BY ALL", "boq")
def material_lines(rows):
    return rounded(cost.material_lines(boq.accumulate(rows)))


_PRICES = """p AS (SELECT project_id, kind, min(quantity) AS unit_price, CASE WHEN project_id % 3 = 0 THEN 0 ELSE max(quantity) / 10 END AS labor_price,
  CASE WHEN project_id % 7 = 0 AND kind = 'boya' THEN 12.5E0 ELSE 0 END AS subcontract_price, CASE WHEN kind = 'beton' THEN 0.12E0 WHEN kind = 'duvar' THEN 0.6E0 ELSE 0 END AS hours_per_unit FROM boq GROUP BY project_id, kind)"""
_PRICED = f"""a AS (SELECT project_id, kind, grp, unit, discipline, sum(quantity) AS quantity FROM boq GROUP BY ALL), {_PRICES}, l0 AS (SELECT a.*, unit_price,
  CASE WHEN subcontract_price > 0 THEN 0 ELSE round(quantity * unit_price, 2) END AS material_total, CASE WHEN subcontract_price > 0 THEN 0 ELSE round(quantity * labor_price, 2) END AS labor_total,
  CASE WHEN subcontract_price > 0 THEN round(quantity * subcontract_price, 2) ELSE 0 END AS subcontract_total, quantity * CASE WHEN unit = 'saat' AND hours_per_unit = 0 THEN 1 ELSE hours_per_unit END AS hours,
  CASE kind WHEN 'demir' THEN 4 WHEN 'beton' THEN 6 WHEN 'kalip' THEN 3 ELSE 2 END AS crew, CASE discipline WHEN 'structural' THEN 'KABA' WHEN 'architectural' THEN 'INCE' ELSE 'ELK' END AS work_group FROM a JOIN p USING (project_id, kind)),
  l AS (SELECT *, material_total + labor_total + subcontract_total AS total, hours / (crew * 8) AS days FROM l0)"""


def priced(rows):
    items = rows.groupBy("project_id", "kind", "grp", "unit", "discipline").agg(F.sum("quantity").alias("quantity"))
    prices = rows.groupBy("project_id", "kind").agg(F.min("quantity").alias("unit_price"), F.max("quantity").alias("top")).select(
        "project_id", "kind", "unit_price", F.when(F.col("project_id") % 3 == 0, 0.0).otherwise(F.col("top") / 10).alias("labor_price"),
        F.when((F.col("project_id") % 7 == 0) & (F.col("kind") == "boya"), 12.5).otherwise(0.0).alias("subcontract_price"), F.when(F.col("kind") == "beton", 0.12).when(F.col("kind") == "duvar", 0.6).otherwise(0.0).alias("hours_per_unit"))
    return cost.price_lines(items, prices)


@query("agg_cost_lines", f"WITH {_PRICED} SELECT project_id, kind, grp, unit, round(material_total, 2) AS material_total, round(labor_total, 2) AS labor_total, round(subcontract_total, 2) AS subcontract_total, round(total, 2) AS total, round(hours, 4) AS hours, round(days, 4) AS days FROM l", "boq")
def cost_lines(rows):
    return rounded(priced(rows).select("project_id", "kind", "grp", "unit", "material_total", "labor_total", "subcontract_total", "total", "hours", "days"))


@query("agg_cost_grouping_sets", f"WITH {_PRICED} SELECT project_id, kind, work_group, discipline, round(sum(total), 2) AS total, round(sum(hours), 4) AS hours, count(*) AS n_lines FROM l GROUP BY GROUPING SETS ((project_id, kind), (project_id, work_group), (project_id, discipline), (project_id))", "boq")
def cost_grouping_sets(rows):
    return rounded(cost.cost_rollups(priced(rows)))


@query(
    "cost_of_projects",
    f"""WITH {_PRICED}, d AS (SELECT project_id, CAST(sum(total) AS DECIMAL(18,2)) AS direct FROM l GROUP BY ALL), t AS (SELECT *, CAST(round(direct * 0.035, 2) AS DECIMAL(18,2)) AS transport FROM d),
    o AS (SELECT *, CAST(round((direct + transport) * 0.08, 2) AS DECIMAL(18,2)) AS overhead FROM t), f AS (SELECT *, CAST(round((direct + transport + overhead) * 0.15, 2) AS DECIMAL(18,2)) AS profit FROM o),
    v AS (SELECT *, direct + transport + overhead + profit AS subtotal FROM f) SELECT project_id, CAST(direct AS DOUBLE) AS direct, CAST(transport AS DOUBLE) AS transport, CAST(overhead AS DOUBLE) AS overhead, CAST(profit AS DOUBLE) AS profit, CAST(subtotal AS DOUBLE) AS subtotal, CAST(round(subtotal * 0.2, 2) AS DOUBLE) AS vat, CAST(subtotal + CAST(round(subtotal * 0.2, 2) AS DECIMAL(18,2)) AS DOUBLE) AS grand_total FROM v""",
    "boq",
)
def cost_of_projects(rows):
    direct = priced(rows).groupBy("project_id").agg(F.sum("total").alias("direct"))
    return rounded(cost.indirect_chain(direct, 3.5, 8.0, 15.0, 0.2).select("project_id", "direct", "transport", "overhead", "profit", "subtotal", "vat", "grand_total"))


@query("agg_duration", f"WITH {_PRICED}, d AS (SELECT project_id, discipline, sum(hours) AS hours, sum(days) AS days FROM l GROUP BY ALL) SELECT project_id, round(sum(hours), 4) AS hours, round(sum(days), 4) AS sequential_days, round(max(days), 4) AS parallel_days FROM d GROUP BY ALL", "boq")
def duration(rows):
    return rounded(cost.duration(priced(rows)))


@query("agg_default_price_keys", "SELECT DISTINCT project_id, concat(kind, ':', grp) AS key FROM boq UNION SELECT project_id, concat(kind, ':*') FROM boq", "boq")
def default_price_keys(rows):
    return cost.default_price_keys(rows)


@query("agg_missing_ranked", f"WITH a AS ({_ACC}), m AS (SELECT project_id, {_MATERIAL} AS material, sum(quantity) AS quantity FROM a WHERE project_id % 2 = 1 AND unit <> 'saat' GROUP BY ALL), o AS (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY quantity DESC, material) AS rank FROM m) SELECT project_id, material, round(quantity, 4) AS quantity, rank FROM o WHERE rank <= 5", "boq")
def missing_ranked(rows):
    items = boq.accumulate(rows).withColumn("unit_price", F.when(F.col("project_id") % 2 == 0, 1.0))
    return rounded(cost.missing_ranked(items, 5))


@query("join_unit_factor", "WITH u AS (SELECT DISTINCT unit AS a, CASE project_id % 4 WHEN 0 THEN 'ton' WHEN 1 THEN 'km' WHEN 2 THEN NULL ELSE 'm2' END AS b FROM boq) SELECT a, b, CASE WHEN b IS NULL OR a = b THEN 1.0E0 WHEN a = 'kg' AND b = 'ton' THEN 0.001E0 WHEN a = 'm' AND b = 'km' THEN 0.001E0 ELSE NULL END AS factor FROM u", "boq")
def unit_factors(rows):
    m = F.col("project_id") % 4
    u = rows.select(F.col("unit").alias("a"), F.when(m == 0, "ton").when(m == 1, "km").when(m == 3, "m2").alias("b")).distinct()
    return u.withColumn("factor", cost.unit_factor(F.col("a"), F.col("b")))
