"""Queries over net lengths, title blocks, rebar tables and inherited prices."""

from __future__ import annotations

from pyspark.sql import functions as F

from kerf.operators import boq, cost, rebar, segments, titleblock
from kerf.plans.base import query, rounded
from kerf.plans.costs import _MATERIAL
from kerf.plans.quantities import lines_of


@query(
    "geo_net_length",
    """WITH s AS (SELECT drawing_id, element_id, x % 10 AS x0, y % 10 AS y0, length AS dx, 3 * b AS dy FROM elements WHERE etype IN ('beam', 'shear_wall')),
    o AS (SELECT drawing_id, x % 10 AS ax, y % 10 AS ay, x % 10 + 10 * b AS bx, y % 10 + 5 * b AS by_ FROM elements WHERE etype IN ('column', 'slab', 'foundation', 'stair')),
    t AS (SELECT element_id, x0, y0, dx, dy, greatest(0, (ax - x0) / dx, (ay - y0) / dy) AS lo, least(1, (bx - x0) / dx, (by_ - y0) / dy) AS hi FROM s JOIN o USING (drawing_id)),
    e AS (SELECT element_id, x0, y0, dx, dy, lo AS pos, 1 AS step FROM t WHERE hi > lo UNION ALL SELECT element_id, x0, y0, dx, dy, hi, -1 FROM t WHERE hi > lo),
    d AS (SELECT *, sum(step) OVER w AS depth, (lead(pos) OVER w) - pos AS wide FROM e WINDOW w AS (PARTITION BY element_id, x0, y0, dx, dy ORDER BY pos, step DESC ROWS UNBOUNDED PRECEDING)),
    c AS (SELECT element_id, x0, y0, dx, dy, sum(wide) AS covered FROM d WHERE depth > 0 GROUP BY ALL)
    SELECT drawing_id, element_id AS segment_id, round(sqrt(dx * dx + dy * dy), 4) AS length, round(sqrt(dx * dx + dy * dy) * (1 - coalesce(covered, 0)), 4) AS net_length FROM s LEFT JOIN c USING (element_id, x0, y0, dx, dy)""",
    "elements",
)
def net_length(elements):
    x, y = F.col("x") % 10, F.col("y") % 10
    lines = elements.where("etype IN ('beam', 'shear_wall')").select("drawing_id", F.col("element_id").alias("segment_id"), x.alias("x0"), y.alias("y0"), (x + F.col("length")).alias("x1"), (y + 3 * F.col("b")).alias("y1"))
    corner = lambda i, j: F.struct((x + i * F.col("b")).alias("x"), (y + j * F.col("b")).alias("y"))
    boxes = elements.where("etype IN ('column', 'slab', 'foundation', 'stair')").select("drawing_id", F.array(corner(0, 0), corner(10, 0), corner(10, 5), corner(0, 5)).alias("points"))
    return rounded(segments.net_length(lines, boxes))


_TEXT = "CASE element_id % 10 WHEN 1 THEN 'MALZEME' WHEN 2 THEN 'KAT ADEDI' WHEN 5 THEN 'MALZEME' WHEN 4 THEN '--' ELSE concat('v', CAST(treads AS VARCHAR(9)), '.', CAST(element_id % 10 AS VARCHAR(9))) END"


@query(
    "join_titleblock_values",
    f"""WITH t AS (SELECT drawing_id, element_id AS id, x % 30 AS x, y % 6 AS y, 0.5E0 + element_id % 3 AS h, {_TEXT} AS text FROM elements),
    p AS (SELECT a.drawing_id, CASE a.text WHEN 'MALZEME' THEN 'material' ELSE 'storeys' END AS field, a.id AS label, b.id, b.text AS value, b.x - a.x AS dx, b.y - a.y AS dy, a.h
      FROM t a JOIN t b ON a.drawing_id = b.drawing_id AND a.text IN ('MALZEME', 'KAT ADEDI') AND b.text LIKE 'v%'),
    s AS (SELECT *, dx AS score FROM p WHERE abs(dy) <= 0.6E0 * h AND dx > 0 AND dx <= 40 * h UNION ALL SELECT *, 40 * h - dy FROM p WHERE dx BETWEEN -h AND 6 * h AND dy >= -4 * h AND dy < -0.6E0 * h)
    SELECT drawing_id, field, value FROM (SELECT *, row_number() OVER (PARTITION BY drawing_id, field ORDER BY label, score, id, value) AS nth FROM s) WHERE nth = 1""",
    "elements",
)
def titleblock_values(elements):
    texts = elements.select("drawing_id", F.col("element_id").alias("item_id"), (F.col("x") % 30).alias("x"), (F.col("y") % 6).alias("y"), (0.5 + F.col("element_id") % 3).alias("h"), F.expr(_TEXT).alias("text"))
    return titleblock.pair_values(texts, {"MALZEME": "material", "KAT ADEDI": "storeys"})


def rebar_inputs(elements, drawings):
    lines = lines_of(elements).join(drawings.select("drawing_id", "level"), "drawing_id")
    n = F.col("multiplier")
    lines = lines.select("project_id", "etype", F.concat_ws(":", "etype", F.when(F.col("subtype") != "", F.col("subtype"))).alias("key"), "level", (F.col("concrete") * n).alias("concrete"), (F.col("rebar") * n).alias("ratio_kg"))
    target = F.expr("CASE drawing_id % 5 WHEN 0 THEN 'column' WHEN 1 THEN 'beam' WHEN 2 THEN 'foundation' WHEN 3 THEN 'slab' ELSE 'pile' END")
    tables = drawings.where("plan_type = 'donati' AND (level IS NOT NULL OR project_id % 2 = 0)").select("project_id", target.alias("etype"), (F.col("level") + 0.4).alias("level"), (F.col("price") / 100).cast("double").alias("kg"))
    return lines, tables


@query("agg_table_rebar", None, "elements", "drawings")
def table_rebar(elements, drawings):
    return rounded(rebar.replace_ratio(*rebar_inputs(elements, drawings)), 2)


@query(
    "join_inherited_prices",
    f"""WITH i AS (SELECT DISTINCT project_id, kind, concat(kind, ':', grp) AS key, {_MATERIAL} AS material FROM boq),
    old AS (SELECT project_id, concat(kind, ':', grp) AS key, max(cnt) AS price FROM boq WHERE row_id % 3 = 0 GROUP BY ALL),
    own AS (SELECT DISTINCT project_id, material, 99.0E0 AS price FROM i WHERE project_id % 5 = 0 AND kind <> 'beton'),
    book AS (SELECT {_MATERIAL} AS material, min(cnt) + 1 AS price FROM boq WHERE kind IN ('duvar', 'siva', 'demir') AND row_id % 4 <> 1 GROUP BY ALL),
    j AS (SELECT i.project_id, i.material, i.key, o.price AS item, g.price AS general FROM i LEFT JOIN old o ON o.project_id = i.project_id AND o.key = i.key LEFT JOIN old g ON g.project_id = i.project_id AND g.key = concat(i.kind, ':*') WHERE i.material IS NOT NULL),
    m AS (SELECT project_id, material, arg_min(item, key) FILTER (item > 0) AS item, arg_min(general, key) FILTER (general > 0) AS general FROM j GROUP BY ALL)
    SELECT m.project_id, m.material, coalesce(own.price, item, general, b.price, k.price, 0) AS price,
      CASE WHEN own.price > 0 THEN 'own' WHEN item > 0 THEN 'item' WHEN general > 0 THEN 'general' WHEN coalesce(b.price, k.price) > 0 THEN 'book' ELSE 'none' END AS price_source
    FROM m LEFT JOIN own USING (project_id, material) LEFT JOIN book b ON b.material = m.material LEFT JOIN book k ON k.material = concat(split_part(m.material, ':', 1), ':*')""",
    "boq",
)
def inherited_prices(rows):
    named = rows.select("*", boq.key().alias("key"), cost.material_key().alias("material"))
    items = named.select("project_id", "kind", "key", "material").distinct()
    old = named.where("row_id % 3 = 0").groupBy("project_id", "key").agg(F.max("cnt").alias("price"))
    own = items.where("project_id % 5 = 0 AND kind <> 'beton' AND material IS NOT NULL").select("project_id", "material", F.lit(99.0).alias("price")).distinct()
    book = named.where("kind IN ('duvar', 'siva', 'demir') AND row_id % 4 <> 1").groupBy("material").agg((F.min("cnt") + 1).alias("price"))
    return cost.inherit_prices(items, own, old, book)
