"""Queries over elements and bills of quantities."""

from __future__ import annotations

from pyspark.sql import functions as F

from kerf.operators import boq, quantity
from kerf.plans.base import query, rounded

_RATIO = "CASE etype " + " ".join(f"WHEN '{k}' THEN {v:.1f}E0" for k, v in quantity.REBAR_RATIO.items()) + " ELSE 0 END"
_STAIR = """SELECT *, storey_height / risers AS sh, sqrt(run * run + pow(storey_height / risers * risers, 2)) AS slope,
    coalesce(CASE WHEN h <> 0 THEN h END, CASE WHEN b <> 0 THEN beam_depth END) AS bh,
    CASE WHEN net_slab THEN storey_height ELSE greatest(storey_height - slab_thickness, 0) END AS cast_h,
    greatest(storey_height - CASE WHEN beam_depth IS NULL OR beam_depth = 0 THEN slab_thickness ELSE beam_depth END, 0) AS form_h FROM elements"""
LINES = f"""m0 AS ({_STAIR}), m1 AS (SELECT *,
  CASE WHEN etype IN ('column', 'shear_wall') THEN area * cast_h
    WHEN etype = 'beam' THEN CASE WHEN bh IS NULL OR b IS NULL THEN 0 ELSE b * CASE WHEN net_slab THEN bh ELSE greatest(bh - slab_thickness, 0) END * length END
    WHEN etype = 'slab' THEN area * coalesce(thickness, slab_thickness)
    WHEN etype = 'stair' THEN CASE WHEN sh BETWEEN 0.12 AND 0.21 THEN slope * b * 0.15E0 + run * sh / 2 * b + landing * 0.15E0 ELSE 0 END
    WHEN etype = 'parapet' OR (etype = 'foundation' AND subtype = 'strip') THEN coalesce(b * h * length, 0)
    WHEN etype = 'foundation' THEN area * coalesce(thickness, 0) ELSE 0 END AS concrete,
  CASE WHEN etype = 'column' THEN perimeter * form_h WHEN etype = 'shear_wall' THEN 2 * length * form_h
    WHEN etype = 'beam' THEN CASE WHEN bh IS NULL OR b IS NULL THEN 0 ELSE (CASE WHEN net_slab THEN b ELSE 0 END + 2 * greatest(bh - slab_thickness, 0)) * length END
    WHEN etype = 'slab' THEN area
    WHEN etype = 'stair' THEN CASE WHEN sh BETWEEN 0.12 AND 0.21 THEN slope * b + risers * sh * b + landing ELSE 0 END
    WHEN etype = 'parapet' OR (etype = 'foundation' AND subtype = 'strip') THEN coalesce(2 * h * length, 0)
    WHEN etype = 'foundation' THEN perimeter * coalesce(thickness, 0) ELSE 0 END AS formwork,
  CASE WHEN etype = 'foundation' THEN 1 ELSE storey_count END AS multiplier,
  CASE WHEN etype = 'beam' AND (bh IS NULL OR b IS NULL) THEN 'beam_section' WHEN etype = 'beam' AND h IS NULL THEN 'beam_depth_assumed'
    WHEN etype = 'stair' AND NOT (sh BETWEEN 0.12 AND 0.21) THEN 'stair_riser'
    WHEN (etype = 'parapet' OR subtype = 'strip') AND h IS NULL THEN 'section'
    WHEN etype = 'foundation' AND subtype <> 'strip' AND coalesce(thickness, 0) <= 0 THEN 'raft_thickness' END AS note
  FROM m0 WHERE NOT superseded AND (manual OR confidence >= 0.4E0) AND NOT excluded),
lines AS (SELECT *, concrete * {_RATIO} AS rebar FROM m1)"""
_SUMS = ", ".join(f"CAST(round(sum(CAST({k} * multiplier AS DECIMAL(28,9))), 4) AS DOUBLE) AS {k}" for k in ("concrete", "formwork", "rebar"))
_KEY = "CASE WHEN subtype <> '' THEN concat(etype, ':', subtype) ELSE etype END"


def lines_of(elements):
    return quantity.measure(quantity.included(quantity.current(elements)))


@query("qty_element_lines", f"WITH {LINES} SELECT project_id, element_id, multiplier, note, round(concrete, 4) AS concrete, round(formwork, 4) AS formwork, round(rebar, 4) AS rebar FROM lines", "elements")
def element_lines(elements):
    return rounded(lines_of(elements).select("project_id", "element_id", "multiplier", "note", "concrete", "formwork", "rebar"))


@query("agg_group_summary", f"WITH {LINES} SELECT project_id, {_KEY} AS key, CAST(sum(multiplier) AS BIGINT) AS pieces, {_SUMS}, count(DISTINCT drawing_id) AS drawings FROM lines GROUP BY ALL", "elements")
def group_summary(elements):
    return quantity.summarize(lines_of(elements))


_SECTION = "CASE WHEN etype IN ('column', 'beam', 'parapet', 'shear_wall') AND h IS NOT NULL THEN concat(CAST(round(b * 100) AS BIGINT), 'x', CAST(round(h * 100) AS BIGINT)) WHEN etype IN ('slab', 'foundation') AND thickness IS NOT NULL THEN concat('d', CAST(round(thickness * 100) AS BIGINT)) ELSE '-' END"


@query("agg_by_section", f"WITH {LINES} SELECT project_id, etype, {_SECTION} AS section, CAST(sum(multiplier) AS BIGINT) AS pieces, {_SUMS} FROM lines GROUP BY ALL", "elements")
def by_section(elements):
    return quantity.by_section(lines_of(elements))


@query("agg_project_totals", f"WITH {LINES} SELECT project_id, {_SUMS}, CAST(coalesce(round(sum(CAST(CASE WHEN etype = 'slab' THEN area * multiplier * greatest(storey_height - coalesce(thickness, slab_thickness), 0) END AS DECIMAL(28,9))), 4), 0) AS DOUBLE) AS scaffold FROM lines GROUP BY project_id", "elements")
def project_totals(elements):
    return quantity.project_totals(lines_of(elements))


@query("agg_by_drawing_rollup", f"WITH {LINES} SELECT project_id, drawing_id, etype, {_SUMS} FROM lines GROUP BY ROLLUP (project_id, drawing_id, etype) HAVING project_id IS NOT NULL", "elements")
def by_drawing(elements):
    return quantity.by_drawing(lines_of(elements))


@query("agg_weighted_median_slab", "WITH p AS (SELECT project_id, thickness, sum(area) AS w FROM elements WHERE etype = 'slab' AND thickness IS NOT NULL AND area > 0 GROUP BY ALL), c AS (SELECT *, sum(w) OVER (PARTITION BY project_id ORDER BY thickness ROWS UNBOUNDED PRECEDING) AS run, sum(w) OVER (PARTITION BY project_id) AS all_w FROM p) SELECT project_id, round(min(thickness), 4) AS thickness FROM c WHERE run * 2 >= all_w GROUP BY project_id", "elements")
def dominant_slab(elements):
    return rounded(quantity.weighted_median(elements.where("etype = 'slab'"), ["project_id"], "thickness", "area"))


@query("qty_stair_parts", "SELECT element_id, (storey_height / risers BETWEEN 0.12 AND 0.21) AS valid, round(storey_height / risers, 6) AS riser_h, round(sqrt(run * run + storey_height * storey_height), 4) AS railing, round(run * b + storey_height * b + landing, 4) AS cladding, round(sqrt(run * run + storey_height * storey_height) * b + landing, 4) AS soffit FROM elements WHERE etype = 'stair'", "elements")
def stair_parts(elements):
    s = quantity.stair(*[F.col(c) for c in ("b", "run", "treads", "risers", "landing", "storey_height")])
    out = elements.where("etype = 'stair'").select("element_id", s["valid"].alias("valid"), *[s[k].alias(k) for k in ("riser_h", "railing", "cladding", "soffit")])
    return out.select("element_id", "valid", F.round("riser_h", 6).alias("riser_h"), *[F.round(k, 4).alias(k) for k in ("railing", "cladding", "soffit")])


@query("qty_stirrups", "SELECT element_id, CAST(floor(length / 0.2E0) + 1 AS BIGINT) AS n, round((floor(length / 0.2E0) + 1) * (2 * (b + h) - 0.24E0 + 0.2E0) * 64 * 0.006165E0, 4) AS kg FROM elements WHERE etype = 'beam' AND h IS NOT NULL", "elements")
def stirrups(elements):
    s = quantity.stirrups(F.col("b"), F.col("h"), F.col("length"), F.lit(8), F.lit(0.2))
    return elements.where("etype = 'beam' AND h IS NOT NULL").select("element_id", s["n"].cast("long").alias("n"), F.round(s["kg"], 4).alias("kg"))


@query(
    "qty_measure_rule",
    """WITH c AS (SELECT *, CASE element_id % 5 WHEN 0 THEN 'count' WHEN 1 THEN 'length' WHEN 2 THEN 'area' WHEN 3 THEN 'wall_area' ELSE 'volume' END AS measure, concat(CAST(drawing_id % 30 AS VARCHAR), 'x', CAST(drawing_id % 200 AS VARCHAR)) AS spec FROM elements)
    SELECT element_id, measure, round(CASE measure WHEN 'count' THEN storey_count WHEN 'length' THEN length WHEN 'area' THEN area
      WHEN 'wall_area' THEN length * coalesce(h, CASE WHEN drawing_id % 200 > 50 THEN (drawing_id % 200) / 100.0E0 END, 2.85E0)
      ELSE area * coalesce(thickness, CASE WHEN drawing_id % 30 > 0 THEN (drawing_id % 30) / 100.0E0 END, 0) END, 4) AS measured FROM c""",
    "elements",
)
def measure_rule(elements):
    m = F.when(F.col("element_id") % 5 == 0, "count").when(F.col("element_id") % 5 == 1, "length").when(F.col("element_id") % 5 == 2, "area").when(F.col("element_id") % 5 == 3, "wall_area").otherwise("volume")
    rows = elements.withColumns({"measure": m, "spec": F.concat_ws("x", (F.col("drawing_id") % 30).cast("string"), (F.col("drawing_id") % 200).cast("string")), "n": F.col("storey_count")})
    return rounded(quantity.layer_measure(rows, 2.85).select("element_id", "measure", "measured"))


_TIERS = ", ".join(f"round(sum(CASE WHEN tier = '{t}' THEN quantity ELSE 0 END), 4) AS ev_{t}" for t in boq.TIERS)
_ACC = f"SELECT project_id, concat(kind, ':', grp) AS key, kind, grp, unit, sum(quantity) AS quantity, sum(cnt) AS cnt, list_sort(list(DISTINCT note) FILTER (note IS NOT NULL)) AS notes, {_TIERS} FROM boq GROUP BY ALL"


@query("agg_boq_merge", f"WITH a AS ({_ACC}) SELECT * EXCLUDE (notes), round(quantity, 4) AS q4, coalesce(array_to_string(notes, ','), '') AS notes FROM a", "boq")
def boq_merge(rows):
    return rounded(boq.accumulate(rows).withColumns({"q4": F.round("quantity", 4), "notes": F.array_join("notes", ",")}))


@query("agg_confidence_grade", f"WITH a AS ({_ACC}) SELECT project_id, key, unit, CASE WHEN ev_tahmin > 0 THEN 'tahmin' WHEN ev_turetildi > 0 THEN 'turetildi' WHEN ev_tanindi > 0 THEN 'tanindi' WHEN ev_olculdu > 0 THEN 'olculdu' ELSE 'turetildi' END AS grade, round(ev_olculdu / quantity, 4) AS share_olculdu, round(ev_tahmin / quantity, 4) AS share_tahmin FROM a", "boq")
def confidence_grade(rows):
    return rounded(boq.grade(boq.accumulate(rows)).select("project_id", "key", "unit", "grade", "share_olculdu", "share_tahmin"))


@query("agg_confidence_shift", f"WITH a AS ({_ACC}) SELECT project_id, key, unit, round(ev_olculdu + ev_tanindi + ev_turetildi, 4) AS ev_turetildi, ev_tahmin FROM a", "boq")
def confidence_shift(rows):
    return rounded(boq.shift_tier(boq.accumulate(rows), "turetildi").select("project_id", "key", "unit", "ev_turetildi", "ev_tahmin"))


@query("agg_per_project_max", "WITH d AS (SELECT project_id, drawing_id, concat(kind, ':', grp) AS key, unit, per_project, sum(quantity) AS q FROM boq GROUP BY ALL) SELECT project_id, key, unit, per_project, round(CASE WHEN per_project THEN max(q) ELSE sum(q) END, 4) AS quantity FROM d GROUP BY project_id, key, unit, per_project", "boq")
def per_project_max(rows):
    return rounded(boq.per_project_max(rows))


@query("agg_kind_rollup", f"WITH a AS ({_ACC}) SELECT kind, unit, round(sum(quantity), 4) AS quantity, count(*) AS n_rows FROM a GROUP BY ROLLUP (kind, unit)", "boq")
def kind_rollup(rows):
    return rounded(boq.kind_totals(boq.accumulate(rows)))


_KIND_RANK = "CASE kind " + " ".join(f"WHEN '{k}' THEN {i}" for i, k in enumerate(boq.KIND_ORDER)) + f" ELSE {len(boq.KIND_ORDER)} END"


@query("srt_boq_order", f"WITH a AS ({_ACC}) SELECT project_id, key, unit, row_number() OVER (PARTITION BY project_id ORDER BY {_KIND_RANK}, grp <> '*', grp, unit) AS place FROM a", "boq")
def boq_order(rows):
    return boq.ordered(boq.accumulate(rows)).select("project_id", "key", "unit", "place")


@query(
    "join_review_override",
    f"""WITH a AS ({_ACC}), d AS (SELECT project_id, concat('beton:', CASE drawing_id % 4 WHEN 0 THEN 'column' WHEN 1 THEN 'beam' WHEN 2 THEN 'slab' ELSE '*' END) AS key,
      arg_max(CASE status WHEN 'O' THEN 'check' WHEN 'F' THEN 'approve' ELSE 'reject' END, drawing_id) AS status, arg_max(price, drawing_id) AS price FROM drawings GROUP BY ALL)
    SELECT a.project_id, a.key, unit, status, round(a.quantity, 4) AS computed, round(CASE WHEN status = 'reject' THEN 0 WHEN status = 'approve' THEN price ELSE a.quantity END, 4) AS quantity FROM a LEFT JOIN d USING (project_id, key)""",
    "boq", "drawings",
)
def review_override(rows, drawings):
    d = F.col("drawing_id") % 4
    key = F.concat(F.lit("beton:"), F.when(d == 0, "column").when(d == 1, "beam").when(d == 2, "slab").otherwise("*"))
    status = F.when(F.col("status") == "O", "check").when(F.col("status") == "F", "approve").otherwise("reject")
    last = drawings.groupBy("project_id", key.alias("key")).agg(F.max_by(status, "drawing_id").alias("status"), F.max_by("price", "drawing_id").alias("price"))
    last = last.withColumn("manual_quantity", F.when(F.col("status") == "approve", F.col("price"))).drop("price")
    return rounded(boq.review(boq.accumulate(rows), last).select("project_id", "key", "unit", "status", "computed", "quantity"))


_MIX = """WITH c AS (SELECT project_id, etype AS target, CAST(8 + 2 * (element_id % 12) AS INT) AS dia, storey_count AS n, length FROM elements),
 v AS (SELECT project_id, target, dia, sum(n * dia * dia * length) AS v FROM c GROUP BY ALL), s AS (SELECT *, v / sum(v) OVER (PARTITION BY project_id, target) AS s1 FROM v WHERE v > 0),
 mix AS (SELECT project_id, target, dia, s1 / sum(s1) OVER (PARTITION BY project_id, target) AS share FROM s WHERE s1 >= 0.02E0)"""


def _callouts(elements):
    return elements.select("project_id", F.col("etype").alias("target"), (8 + 2 * (F.col("element_id") % 12)).cast("int").alias("dia"), F.col("storey_count").alias("n"), "length")


@query("agg_rebar_mix", f"{_MIX} SELECT project_id, target, dia, round(share, 6) AS share FROM mix", "elements")
def rebar_mix(elements):
    return boq.rebar_mix(_callouts(elements)).withColumn("share", F.round("share", 6))


@query("agg_rebar_split", f"{_MIX}, {LINES}, q AS (SELECT project_id, etype AS target, sum(rebar * multiplier) AS quantity FROM lines GROUP BY ALL) SELECT project_id, target, dia, round(quantity * share, 3) AS kg FROM q JOIN mix USING (project_id, target)", "elements")
def rebar_split(elements):
    q = lines_of(elements).groupBy("project_id", F.col("etype").alias("target")).agg(F.sum(F.col("rebar") * F.col("multiplier")).alias("quantity"))
    return rounded(boq.split_by_mix(q, boq.rebar_mix(_callouts(elements))).select("project_id", "target", "dia", "kg"), 3)


@query("agg_rebar_report", "WITH o AS (SELECT *, CASE WHEN regexp_matches(grp, '^o[0-9]+$') THEN CAST(substr(grp, 2) AS INT) ELSE 0 END AS dia, tier IN ('olculdu', 'tanindi') AS m FROM boq WHERE kind = 'demir'), s AS (SELECT project_id, dia, sum(CASE WHEN m THEN quantity ELSE 0 END) AS measured, sum(CASE WHEN m THEN 0 ELSE quantity END) AS by_ratio FROM o GROUP BY ALL) SELECT project_id, dia, round(measured, 4) AS measured, round(by_ratio, 4) AS by_ratio, round((measured + by_ratio) * 0.03E0, 4) AS waste, round((measured + by_ratio) * 1.03E0, 4) AS total FROM s", "boq")
def rebar_report(rows):
    return rounded(boq.rebar_report(rows))


@query("agg_layer_verdict", "WITH t AS (SELECT project_id, etype AS target, count(*) FILTER (element_id % 7 < 2) AS alt, count(*) FILTER (element_id % 7 >= 2) AS ust FROM elements GROUP BY ALL) SELECT *, CASE WHEN least(alt, ust) >= 4 AND least(alt, ust) >= 0.15E0 * (alt + ust) THEN 'cift' WHEN alt + ust >= 4 THEN 'tek' ELSE '' END AS layers FROM t", "elements")
def layer_verdict(elements):
    return boq.layer_verdict(elements.select("project_id", F.col("etype").alias("target"), F.when(F.col("element_id") % 7 < 2, "alt").otherwise("ust").alias("side")))


#: Recipes of the demonstration: parent, child, factor. Fixed values.
RECIPES = [("beton", "beton_iscilik", 0.12), ("beton", "vibrator", 0.05), ("kalip", "kalip_yagi", 0.05), ("duvar", "duvar_iscilik", 0.6), ("duvar", "duvar_tutkal", 4.0), ("duvar_tutkal", "nakliye", 0.01), ("siva", "siva_iscilik", 0.42), ("siva", "kose_profili", 0.2), ("kose_profili", "nakliye", 0.02), ("nakliye", "yakit", 0.5), ("yakit", "duvar", 1.0), ("boya", "boya_iscilik", 0.2), ("kablo", "kablo_cekme", 0.05)]
_REC = ", ".join(f"('{p}', '{c}', {f}E0)" for p, c, f in RECIPES)
_LEVELS, _UNION = "", []
for _k in range(1, boq.MOST_LEVELS + 1):
    _prev = "f0" if _k == 1 else f"g{_k - 1}"
    _LEVELS += f""", s{_k} AS (SELECT project_id, child AS kind, quantity * factor AS q, key, chain FROM {_prev} JOIN rec ON kind = parent WHERE NOT list_contains(chain, child)),
 g{_k} AS (SELECT project_id, kind, concat(kind, ':*') AS key, sum(q) AS quantity, count(DISTINCT key) AS parents, list_append(list_distinct(flatten(list(chain))), kind) AS chain FROM s{_k} GROUP BY project_id, kind)"""
    _UNION.append(f"SELECT project_id, key, kind, quantity, parents, {_k} AS level FROM g{_k}")


@query("agg_recipe_expansion", f"WITH a AS ({_ACC}), rec(parent, child, factor) AS (VALUES {_REC}), f0 AS (SELECT project_id, key, quantity, [kind] AS chain, kind FROM (SELECT project_id, key, kind, sum(quantity) AS quantity FROM a GROUP BY ALL) WHERE quantity > 0){_LEVELS}, u AS ({' UNION ALL '.join(_UNION)}) SELECT project_id, key, kind, round(sum(quantity), 4) AS quantity, CAST(sum(parents) AS BIGINT) AS parents, min(level) AS level FROM u WHERE (project_id, key) NOT IN (SELECT (project_id, key) FROM a) GROUP BY ALL", "boq")
def recipe_expansion(rows):
    items = boq.accumulate(rows).groupBy("project_id", "key", "kind").agg(F.sum("quantity").alias("quantity"))
    recipes = rows.sparkSession.createDataFrame(RECIPES, "parent_kind string, child_kind string, factor double")
    return rounded(boq.expand_recipes(items, recipes))


#: Components of the demonstration's systems. Fixed values.
SYSTEMS = [("duvar", "dubel", 6.0, True), ("duvar", "fileli_siva", 1.05, True), ("duvar", "levha", 1.1, False), ("boya", "astar", 1.0, True)]
_SYS = ", ".join(f"('{a}', '{b}', {f}E0, {str(e).lower()})" for a, b, f, e in SYSTEMS)


@query("agg_system_expansion", f"WITH sys(system_kind, code, factor, by_evidence) AS (VALUES {_SYS}), ch AS (SELECT DISTINCT project_id, 'levha' AS code, project_id % 2 = 0 AS chosen FROM boq UNION ALL SELECT DISTINCT project_id, 'dubel', project_id % 3 <> 0 FROM boq) SELECT b.project_id, code AS kind, round(sum(quantity * factor), 4) AS quantity FROM boq b JOIN sys ON kind = system_kind LEFT JOIN ch USING (project_id, code) WHERE coalesce(chosen, by_evidence) GROUP BY ALL", "boq")
def system_expansion(rows):
    components = rows.sparkSession.createDataFrame(SYSTEMS, "system_kind string, code string, factor double, by_evidence boolean")
    projects = rows.select("project_id").distinct()
    choices = projects.select("project_id", F.lit("levha").alias("code"), (F.col("project_id") % 2 == 0).alias("chosen")).unionByName(projects.select("project_id", F.lit("dubel").alias("code"), (F.col("project_id") % 3 != 0).alias("chosen")))
    return rounded(boq.expand_systems(rows, components, choices))


@query("join_already_measured", "WITH d AS (SELECT DISTINCT project_id, CASE WHEN project_id % 2 = 0 THEN 'siva' ELSE 'astar' END AS kind FROM elements WHERE project_id % 3 = 0) SELECT project_id, kind FROM d WHERE (project_id, kind) NOT IN (SELECT (project_id, kind) FROM boq)", "elements", "boq")
def already_measured(elements, rows):
    derived = elements.where("project_id % 3 = 0").select("project_id", F.when(F.col("project_id") % 2 == 0, "siva").otherwise("astar").alias("kind")).distinct()
    return boq.already_measured(derived, rows)
