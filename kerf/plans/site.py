"""Queries over owners of items, excavation and uses of floors."""

from __future__ import annotations

from pyspark.sql import functions as F

from kerf.operators import site
from kerf.plans.base import query, rounded

_RULES = ", ".join(f"('{p}', {n}, '{k}')" for n, (p, kinds) in enumerate(site.PRODUCED.items()) for k in kinds.split())
_TYPE = "CASE row_id % 6 WHEN 0 THEN 'mim_cati' WHEN 1 THEN 'sta_kat_kalip' WHEN 2 THEN 'mim_kat_plani' WHEN 3 THEN 'elk_tava' WHEN 4 THEN 'mim_kesit' ELSE NULL END"
_CODE = "CASE row_id % 5 WHEN 0 THEN concat(upper(kind), '_YTONG') WHEN 1 THEN concat(kind, 'x') ELSE kind END"


@query(
    "lkp_foreign_owner",
    f"""WITH t(teller, place, produced) AS (VALUES {_RULES}),
    i AS (SELECT row_id, {_TYPE} AS plan_type, lower({_CODE}) AS kind FROM boq),
    k AS (SELECT kind, teller, place FROM (SELECT DISTINCT kind FROM i) JOIN t ON kind = produced OR starts_with(kind, concat(produced, '_')))
    SELECT plan_type, owner, count(*) AS n FROM (SELECT plan_type, CASE WHEN plan_type IS NULL OR plan_type NOT IN (SELECT teller FROM t) OR EXISTS (SELECT 1 FROM k WHERE k.kind = i.kind AND teller = plan_type) THEN ''
      ELSE coalesce((SELECT arg_min(teller, place) FROM k WHERE k.kind = i.kind), '') END AS owner FROM i) GROUP BY ALL""",
    "boq",
)
def foreign_owner(rows):
    return site.foreign_owner(rows.select(F.expr(_TYPE).alias("plan_type"), F.expr(_CODE).alias("code"))).groupBy("plan_type", "owner").agg(F.count(F.lit(1)).alias("n"))


@query(
    "qty_excavation_volume",
    """WITH p AS (SELECT element_id, length AS l, b AS w, length * b AS area, 1.5E0 + element_id % 4 AS depth, CASE WHEN element_id % 7 = 0 THEN 1.15E0 END AS margin,
      CASE WHEN element_id % 3 = 0 THEN 0.8E0 WHEN element_id % 5 = 0 THEN 1.0E0 ELSE 0.6E0 END AS k, (element_id % 2) * 0.5E0 AS slope FROM elements WHERE etype = 'foundation'),
    q AS (SELECT *, l + 2 * k AS l0, w + 2 * k AS w0, 2 * slope * depth AS more FROM p)
    SELECT element_id, round(CASE WHEN margin > 0 THEN area * depth * margin WHEN element_id % 11 = 0 THEN area * depth ELSE depth * (l0 * w0 + more * (l0 + w0) / 2 + more * more / 3) END, 10) AS volume,
      CASE WHEN margin > 0 THEN 'param' WHEN element_id % 11 = 0 THEN 'default' WHEN element_id % 3 = 0 THEN 'drawing' WHEN element_id % 5 = 0 THEN 'param' ELSE 'default' END AS work_source FROM q""",
    "elements",
)
def excavation_volume(elements):
    e = F.col("element_id")
    corner = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    box = F.array(corner(F.lit(0), F.lit(0)), corner(F.col("length"), F.lit(0)), corner(F.col("length"), F.col("b")), corner(F.lit(0), F.col("b")))
    pits = elements.where("etype = 'foundation'").select(
        "element_id", F.when(e % 11 != 0, box).alias("points"), (F.col("length") * F.col("b")).alias("area"), (1.5 + e % 4).alias("depth"), F.when(e % 7 == 0, 1.15).alias("margin"),
        F.when(e % 3 == 0, 0.8).alias("note_work"), F.when(e % 5 == 0, 1.0).alias("own_work"), ((e % 2) * 0.5).alias("slope"),
    )
    return rounded(site.excavation(pits).select("element_id", "volume", "work_source"), 10)


_USE = "CASE drawing_id % 8 WHEN 0 THEN 'ticari' WHEN 1 THEN 'sosyal' WHEN 2 THEN NULL WHEN 3 THEN CASE WHEN project_id % 3 = 0 THEN 'konut' ELSE 'ticari' END ELSE CASE WHEN project_id % 2 = 0 THEN 'konut' ELSE 'ofis' END END"


@query(
    "agg_usage_summary",
    f"""WITH f AS (SELECT project_id, block, rank, coalesce({_USE}, '') AS u FROM drawings),
    n AS (SELECT project_id, u, count(*) AS n FROM f WHERE u <> '' GROUP BY ALL),
    s AS (SELECT project_id, string_agg(concat(u, ': ', CAST(n AS VARCHAR)), ', ' ORDER BY u) AS summary, count(*) FILTER (u <> 'sosyal') > 1 AS mixed FROM n GROUP BY ALL),
    w AS (SELECT project_id, count(*) AS whole FROM (SELECT DISTINCT project_id, block, rank, u FROM f WHERE u NOT IN ('', 'ticari') AND rank IS NOT NULL) GROUP BY ALL)
    SELECT project_id, coalesce(summary, '') AS summary, coalesce(mixed, false) AS mixed, coalesce(whole, 0) AS whole_floors FROM (SELECT DISTINCT project_id FROM f) LEFT JOIN s USING (project_id) LEFT JOIN w USING (project_id)""",
    "drawings",
)
def usage_summary(drawings):
    return site.usage_summary(drawings.select("project_id", "block", "rank", F.expr(_USE).alias("usage")))


@query(
    "agg_floor_roles",
    "SELECT project_id, CASE WHEN rank = 5 THEN 'attic' WHEN rank IN (0, 1) THEN 'basement' ELSE '' END AS role, count(*) AS n FROM drawings GROUP BY ALL",
    "drawings",
)
def floor_roles(drawings):
    rank = F.when(F.col("rank") == 5, 98).otherwise(F.col("rank") - 2)
    return drawings.groupBy("project_id", site.floor_role(rank).alias("role")).agg(F.count(F.lit(1)).alias("n"))
