"""Queries over geometry, sheets, floors, openings, rooms and checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from kerf.functions import geometry
from kerf.operators import boq, building, quantity, spatial
from kerf.plans.base import query, rounded
from kerf.plans.components import connected
from kerf.plans.sheets import greedy_sql
from kerf.plans.quantities import LINES, lines_of
from kerf.plans.work import written

_BOX = "SELECT drawing_id, element_id AS id, etype, x AS x0, y AS y0, x + length AS x1, y + b * 10 AS y1 FROM elements WHERE etype = 'slab'"


def boxes(elements):
    return elements.where("etype = 'slab'").select("drawing_id", F.col("element_id").alias("id"), "etype", F.col("x").alias("x0"), F.col("y").alias("y0"), (F.col("x") + F.col("length")).alias("x1"), (F.col("y") + F.col("b") * 10).alias("y1"))


_PROJECT_BOX = "SELECT project_id, element_id AS id, x AS x0, y AS y0, x + length AS x1, y + b * 10 AS y1 FROM elements WHERE etype = 'slab'"


def project_boxes(elements):
    return elements.where("etype = 'slab'").select("project_id", F.col("element_id").alias("id"), F.col("x").alias("x0"), F.col("y").alias("y0"), (F.col("x") + F.col("length")).alias("x1"), (F.col("y") + F.col("b") * 10).alias("y1"))


def polygon(x, y, w, h):
    pt = lambda a, b: F.struct(a.cast("double").alias("x"), b.cast("double").alias("y"))
    return F.array(pt(x, y), pt(x + w, y), pt(x + w * 1.25, y + h), pt(x + w * 0.25, y + h))


@query("geo_polygon_measures", "SELECT element_id, round(length * b, 9) AS area, round(2 * length + 2 * sqrt(power(length * 0.25E0, 2) + b * b), 9) AS outline, round(x + length * 1.25E0, 9) AS x1, round(y + b, 9) AS y1 FROM elements", "elements")
def polygon_measures(elements):
    p = elements.select("element_id", polygon(F.col("x"), F.col("y"), F.col("length"), F.col("b")).alias("p"))
    box = geometry.bbox(F.col("p"))
    # Shoelace sums of far coordinates lose the last digits; the origin is moved to the first corner.
    q = p.withColumn("p0", F.transform("p", lambda t: F.struct((t["x"] - F.get("p", 0)["x"]).alias("x"), (t["y"] - F.get("p", 0)["y"]).alias("y"))))
    return rounded(q.select("element_id", geometry.area(F.col("p0")).alias("area"), geometry.perimeter(F.col("p0")).alias("outline"), box["x1"].alias("x1"), box["y1"].alias("y1")), 9)


@query("geo_min_rectangle", "SELECT element_id, round(greatest(length, b * 2), 6) AS long_side, round(least(length, b * 2), 6) AS short_side FROM elements", "elements")
def min_rectangle(elements):
    x, y, w, h = F.lit(0.0), F.lit(0.0), F.col("length"), F.col("b") * 2
    pt = lambda a, b: F.struct((a * F.cos(F.lit(0.5)) - b * F.sin(F.lit(0.5))).alias("x"), (a * F.sin(F.lit(0.5)) + b * F.cos(F.lit(0.5))).alias("y"))
    p = elements.select("element_id", F.array(pt(x, y), pt(w, y), pt(w, h), pt(x, h)).alias("p")).withColumn("r", geometry.min_rectangle(F.col("p")))
    return rounded(p.select("element_id", F.col("r.long").alias("long_side"), F.col("r.short").alias("short_side")), 6)


@query("geo_point_in_polygon", "SELECT element_id, (element_id % 10) / 10.0E0 + 0.03E0 BETWEEN 0.25E0 * 0.5E0 AND 1 + 0.25E0 * 0.5E0 AS inside FROM elements", "elements")
def point_in_polygon(elements):
    unit = polygon(F.lit(0.0), F.lit(0.0), F.lit(1.0), F.lit(1.0))
    return elements.select("element_id", geometry.contains(unit, (F.col("element_id") % 10) / 10.0 + 0.03, F.lit(0.5)).alias("inside"))


@query("geo_facade_sides", "SELECT project_id, side, round(sum(len), 3) AS length FROM (SELECT project_id, unnest(['south', 'east', 'north', 'west']) AS side, unnest([length, b, length, b]) AS len FROM elements WHERE etype = 'slab') GROUP BY ALL", "elements")
def facade_sides(elements):
    edges = F.array(*[F.struct(dx.cast("double").alias("dx"), dy.cast("double").alias("dy")) for dx, dy in ((F.col("length"), F.lit(0.0)), (F.lit(0.0), F.col("b")), (-F.col("length"), F.lit(0.0)), (F.lit(0.0), -F.col("b")))])
    e = elements.where("etype = 'slab'").select("project_id", F.explode(edges).alias("e"))
    return rounded(e.groupBy("project_id", geometry.side_of(F.col("e.dx"), F.col("e.dy")).alias("side")).agg(F.sum(F.hypot("e.dx", "e.dy")).alias("length")), 3)


@query("ext_polygon_overlap", f"WITH b AS ({_PROJECT_BOX}) SELECT p.id AS a_id, q.id AS b_id, round((least(p.x1, q.x1) - greatest(p.x0, q.x0)) * (least(p.y1, q.y1) - greatest(p.y0, q.y0)), 8) AS shared FROM b p JOIN b q ON p.project_id = q.project_id AND p.id < q.id AND least(p.x1, q.x1) > greatest(p.x0, q.x0) AND least(p.y1, q.y1) > greatest(p.y0, q.y0)", "elements")
def polygon_overlap(elements):
    pairs = spatial.grid_overlaps(project_boxes(elements), ["project_id"], 20.0, corners=True)
    pt = lambda x, y: F.struct(F.col(x).alias("x"), F.col(y).alias("y"))
    shape = lambda s: F.array(pt(f"{s}_x0", f"{s}_y0"), pt(f"{s}_x1", f"{s}_y0"), pt(f"{s}_x1", f"{s}_y1"), pt(f"{s}_x0", f"{s}_y1"))
    return rounded(pairs.select("a_id", "b_id", geometry.overlap_area(shape("a"), shape("b")).alias("shared")), 8)


@query("join_overlap_dedupe", f"WITH b AS ({_PROJECT_BOX}), p AS (SELECT p.project_id, p.id AS a_id, q.id AS b_id, (least(p.x1, q.x1) - greatest(p.x0, q.x0)) * (least(p.y1, q.y1) - greatest(p.y0, q.y0)) AS s, (p.x1 - p.x0) * (p.y1 - p.y0) AS a, (q.x1 - q.x0) * (q.y1 - q.y0) AS c FROM b p JOIN b q ON p.project_id = q.project_id AND p.id < q.id AND least(p.x1, q.x1) > greatest(p.x0, q.x0) AND least(p.y1, q.y1) > greatest(p.y0, q.y0)) SELECT project_id, id FROM b WHERE id NOT IN (SELECT CASE WHEN a >= c THEN b_id ELSE a_id END FROM p WHERE s > 0.5E0 * least(a, c))", "elements")
def overlap_dedupe(elements):
    return spatial.drop_overlapped(project_boxes(elements), ["project_id"], 20.0, 0.5).select("project_id", "id")


@query("join_crossing_deduction", f"WITH b AS ({_PROJECT_BOX}), p AS (SELECT p.id AS a_id, q.id AS b_id, (least(p.x1, q.x1) - greatest(p.x0, q.x0)) * (least(p.y1, q.y1) - greatest(p.y0, q.y0)) AS s, (p.x1 - p.x0) * (p.y1 - p.y0) AS a, (q.x1 - q.x0) * (q.y1 - q.y0) AS c FROM b p JOIN b q ON p.project_id = q.project_id AND p.id < q.id AND least(p.x1, q.x1) > greatest(p.x0, q.x0) AND least(p.y1, q.y1) > greatest(p.y0, q.y0)), t AS (SELECT CASE WHEN a < c THEN a_id ELSE b_id END AS id, sum(s) AS s FROM p GROUP BY 1) SELECT b.project_id, b.id, round(greatest((x1 - x0) * (y1 - y0) - coalesce(s, 0), 0), 4) AS net FROM b LEFT JOIN t USING (id)", "elements")
def crossing_deduction(elements):
    b = project_boxes(elements)
    lost = spatial.grid_overlaps(b, ["project_id"], 20.0).groupBy(F.when(F.col("a_area") < F.col("b_area"), F.col("a_id")).otherwise(F.col("b_id")).alias("id")).agg(F.sum("shared").alias("s"))
    return rounded(b.join(lost, "id", "left").select("project_id", "id", F.greatest((F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0")) - F.coalesce("s", F.lit(0.0)), F.lit(0.0)).alias("net")))


_PTS = "l AS (SELECT project_id, element_id AS lid, x AS lx, y AS ly FROM elements WHERE etype = 'column'), r AS (SELECT project_id, element_id AS rid, x AS rx, y AS ry FROM elements WHERE etype = 'beam'), p AS (SELECT l.project_id, lid, rid, sqrt((lx - rx) * (lx - rx) + (ly - ry) * (ly - ry)) AS distance FROM l JOIN r ON l.project_id = r.project_id WHERE abs(lx - rx) <= 8 AND abs(ly - ry) <= 8 AND sqrt((lx - rx) * (lx - rx) + (ly - ry) * (ly - ry)) <= 8)"


def _pairs(elements):
    side = lambda t, s: elements.where(F.col("etype") == t).select("project_id", F.col("element_id").alias(f"{s}id"), F.col("x").alias(f"{s}x"), F.col("y").alias(f"{s}y"))
    return spatial.within(side("column", "l"), side("beam", "r"), ["project_id"], 8.0)


@query("join_nearest_label", f"WITH {_PTS} SELECT lid, rid, round(distance, 4) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY lid ORDER BY distance, rid) AS nth FROM p) WHERE nth = 1", "elements")
def nearest_label(elements):
    return rounded(spatial.nearest(_pairs(elements), ["lid"], F.col("distance"), F.col("rid")).select("lid", "rid", "distance"))


@query("join_mutual_nearest_first", f"WITH {_PTS} SELECT lid, rid, round(distance, 4) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY lid ORDER BY distance, lid, rid) AS a, row_number() OVER (PARTITION BY rid ORDER BY distance, lid, rid) AS b FROM p) WHERE a = 1 AND b = 1", "elements")
def mutual_first(elements):
    return rounded(spatial.mutual_nearest(_pairs(elements), "lid", "rid", 1).select("lid", "rid", "distance"))


@query("join_greedy_match", f"WITH RECURSIVE {_PTS}, q AS (SELECT DISTINCT lid AS a_id, rid AS b_id, distance FROM p), {greedy_sql('m', 'q')} SELECT a_id AS lid, b_id AS rid, round(distance, 4) AS distance FROM m WHERE hit", "elements")
def greedy_match(elements):
    return rounded(spatial.mutual_nearest(_pairs(elements), "lid", "rid").select("lid", "rid", "distance"))


_OBJ = "o AS (SELECT project_id, CAST(drawing_id % 6 AS INT) AS floor, etype, drawing_id, element_id, x, y, sqrt(b * b + length * length) AS diag, length AS q, manual, CAST(drawing_id % 3 AS INT) AS rank FROM elements)"


def _objects(elements):
    return elements.select("project_id", (F.col("drawing_id") % 6).cast("int").alias("floor"), "etype", "drawing_id", "element_id", "x", "y", F.sqrt(F.col("b") * F.col("b") + F.col("length") * F.col("length")).alias("diag"), F.col("length").alias("q"), "manual")


_SAME = f"WITH {_OBJ} SELECT a.project_id, a.floor, a.etype, a.element_id AS a_element_id, b.element_id AS b_element_id, round(sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)), 4) AS distance FROM o a JOIN o b ON a.project_id = b.project_id AND a.floor = b.floor AND a.etype = b.etype WHERE NOT b.manual AND (a.rank < b.rank OR (a.rank = b.rank AND a.drawing_id < b.drawing_id)) AND abs(a.x - b.x) < 10 AND abs(a.y - b.y) < 10 AND sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) <= greatest(0.35E0, 0.35E0 * greatest(a.diag, b.diag)) AND greatest(a.q, b.q) <= 1.6E0 * least(a.q, b.q)"


@query("join_same_object", _SAME, "elements")
def same_objects(elements):
    return rounded(spatial.duplicates_across(_objects(elements), (F.col("drawing_id") % 3).cast("int")))


@query("join_scope_dropped", f"{_SAME.replace('WITH o AS', 'WITH RECURSIVE o AS').replace(' SELECT a.project_id, a.floor', ', q AS (SELECT DISTINCT a_element_id AS a_id, b_element_id AS b_id, distance FROM (SELECT a.project_id, a.floor', 1).replace(', 4) AS distance', ', 12) AS distance')})), {greedy_sql('m', 'q')} SELECT b_id AS dropped, a_id AS owner FROM m WHERE hit", "elements")
def scope_dropped(elements):
    p = spatial.duplicates_across(_objects(elements), (F.col("drawing_id") % 3).cast("int"))
    return spatial.mutual_nearest(p, "a_element_id", "b_element_id").select(F.col("b_element_id").alias("dropped"), F.col("a_element_id").alias("owner"))


_WALLS = "w AS (SELECT drawing_id % 300 AS drawing_id, element_id AS wall_id, CAST(x AS DOUBLE) AS x0, x + length AS x1, y, b FROM elements WHERE etype = 'shear_wall'), op AS (SELECT drawing_id % 300 AS drawing_id, element_id AS opening_id, x + 1 AS ox, y + (element_id % 30) / 10.0E0 AS oy, b * 2 AS width, CASE WHEN h IS NULL THEN 0 ELSE h END AS height, CAST(element_id % 3 AS INT) AS cnt FROM elements WHERE etype = 'parapet')"
_ALLOC = f"""{_WALLS}, j AS (SELECT op.*, wall_id, x0, x1, b, sqrt(power(greatest(0, x0 - ox, ox - x1), 2) + power(oy - y, 2)) AS distance, greatest(0, least(x1, ox + width / 2) - greatest(x0, ox - width / 2)) / width AS inside FROM op JOIN w USING (drawing_id) WHERE width > 0 AND height > 0 AND cnt > 0),
 k AS (SELECT *, distance <= b / 2 + 0.05E0 AND inside >= 0.5E0 AS o FROM j WHERE distance <= 2.5E0), best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY drawing_id, opening_id ORDER BY o DESC, CASE WHEN o THEN floor(inside * 100 + 0.5E0) END DESC NULLS LAST, distance, wall_id) AS nth FROM k) WHERE nth = 1),
 al AS (SELECT op.drawing_id, op.opening_id, wall_id, op.width, op.height, op.cnt, CASE WHEN NOT (op.width > 0 AND op.height > 0 AND op.cnt > 0) THEN 'missing_dimensions' WHEN wall_id IS NULL THEN 'unmatched' WHEN o THEN 'geometry' ELSE 'gap' END AS method, CASE WHEN op.width > 0 AND op.height > 0 AND op.cnt > 0 THEN op.width * op.height * op.cnt ELSE 0 END AS area FROM op LEFT JOIN best USING (drawing_id, opening_id))"""


def _allocated(elements):
    d = (F.col("drawing_id") % 300).alias("drawing_id")
    walls = elements.where("etype = 'shear_wall'").select(d, F.col("element_id").alias("wall_id"), F.col("x").alias("x0"), (F.col("x") + F.col("length")).alias("x1"), "y", "b")
    openings = elements.where("etype = 'parapet'").select(d, F.col("element_id").alias("opening_id"), (F.col("x") + 1).alias("ox"), (F.col("y") + (F.col("element_id") % 30) / 10.0).alias("oy"), (F.col("b") * 2).alias("width"), F.coalesce("h", F.lit(0.0)).alias("height"), (F.col("element_id") % 3).cast("int").alias("count"))
    return spatial.allocate_openings(walls, openings)


@query("join_opening_wall", f"WITH {_ALLOC} SELECT drawing_id, opening_id, wall_id, method, round(area, 4) AS area FROM al", "elements")
def opening_wall(elements):
    return rounded(_allocated(elements).select("drawing_id", "opening_id", "wall_id", "method", "area"))


@query("flt_deductible_openings", f"WITH {_ALLOC} SELECT drawing_id, wall_id, round(sum(area), 4) AS all_area, round(sum(CASE WHEN width * height >= 0.1E0 THEN area ELSE 0 END), 4) AS deducted, round(sum(CASE WHEN method = 'gap' THEN width * cnt ELSE 0 END), 4) AS gap_length FROM al WHERE wall_id IS NOT NULL GROUP BY ALL", "elements")
def deductible_openings(elements):
    return rounded(spatial.deducted(_allocated(elements)))


_ROOMS = "rm AS (SELECT drawing_id % 200 AS drawing_id, element_id AS room_id, x AS x0, y AS y0, x + length AS x1, y + b * 20 AS y1 FROM elements WHERE etype = 'slab'), pt AS (SELECT drawing_id % 200 AS drawing_id, element_id AS point_id, x AS px, y AS py FROM elements WHERE etype = 'column')"


def _rooms(elements):
    return elements.where("etype = 'slab'").select((F.col("drawing_id") % 200).alias("drawing_id"), F.col("element_id").alias("room_id"), F.col("x").alias("x0"), F.col("y").alias("y0"), (F.col("x") + F.col("length")).alias("x1"), (F.col("y") + F.col("b") * 20).alias("y1"))


@query("join_smallest_room", f"WITH {_ROOMS}, h AS (SELECT pt.drawing_id, point_id, room_id, row_number() OVER (PARTITION BY pt.drawing_id, point_id ORDER BY (x1 - x0) * (y1 - y0), room_id) AS nth FROM pt JOIN rm ON pt.drawing_id = rm.drawing_id AND px BETWEEN x0 AND x1 AND py BETWEEN y0 AND y1) SELECT pt.drawing_id, pt.point_id, room_id FROM pt LEFT JOIN (SELECT * FROM h WHERE nth = 1) USING (drawing_id, point_id)", "elements")
def smallest_room(elements):
    pts = elements.where("etype = 'column'").select((F.col("drawing_id") % 200).alias("drawing_id"), F.col("element_id").alias("point_id"), F.col("x").alias("px"), F.col("y").alias("py"))
    return spatial.smallest_room(pts, _rooms(elements), 20.0).select("drawing_id", "point_id", "room_id")


@query("join_room_shares", f"WITH {_ROOMS}, a AS (SELECT drawing_id % 200 AS drawing_id, element_id, x AS x0, y AS y0, x + length AS x1, y + b * 10 AS y1 FROM elements WHERE etype = 'foundation'), p AS (SELECT a.drawing_id, element_id, room_id, (least(a.x1, rm.x1) - greatest(a.x0, rm.x0)) * (least(a.y1, rm.y1) - greatest(a.y0, rm.y0)) AS s FROM a JOIN rm ON a.drawing_id = rm.drawing_id AND least(a.x1, rm.x1) > greatest(a.x0, rm.x0) AND least(a.y1, rm.y1) > greatest(a.y0, rm.y0)) SELECT drawing_id, element_id, room_id, round(s / sum(s) OVER (PARTITION BY drawing_id, element_id), 6) AS share FROM p", "elements")
def room_shares(elements):
    areas = elements.where("etype = 'foundation'").select((F.col("drawing_id") % 200).alias("drawing_id"), "element_id", F.col("x").alias("x0"), F.col("y").alias("y0"), (F.col("x") + F.col("length")).alias("x1"), (F.col("y") + F.col("b") * 10).alias("y1"))
    return rounded(spatial.room_shares(areas, _rooms(elements), 20.0), 6)


_INT = "i AS (SELECT project_id, CAST(y AS BIGINT) % 20 AS line, x AS lo, x + length AS hi FROM elements WHERE etype = 'beam')"


@query("isl_merge_collinear", f"WITH {_INT}, m AS (SELECT *, CASE WHEN lo > max(hi) OVER w + 0.5E0 THEN 1 WHEN max(hi) OVER w IS NULL THEN 1 ELSE 0 END AS new FROM i WINDOW w AS (PARTITION BY project_id, line ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)), r AS (SELECT *, sum(new) OVER (PARTITION BY project_id, line ORDER BY lo, hi ROWS UNBOUNDED PRECEDING) AS island FROM m) SELECT project_id, line, CAST(island AS BIGINT) AS island, round(min(lo), 4) AS lo, round(max(hi), 4) AS hi, count(*) AS pieces FROM r GROUP BY ALL", "elements")
def merge_collinear(elements):
    i = elements.where("etype = 'beam'").select("project_id", (F.col("y").cast("long") % 20).alias("line"), F.col("x").alias("lo"), (F.col("x") + F.col("length")).alias("hi"))
    return rounded(spatial.merge_intervals(i, ["project_id", "line"], 0.5))


@query("isl_split_by_supports", "WITH r AS (SELECT project_id, min(x) AS lo, max(x) AS hi FROM elements WHERE etype = 'beam' GROUP BY ALL), s AS (SELECT project_id, x AS lo, x + b AS hi FROM elements WHERE etype = 'column'), u AS (SELECT project_id, lo AS a, lo AS b FROM r UNION ALL SELECT project_id, hi, hi FROM r UNION ALL SELECT s.project_id, s.lo, s.hi FROM s JOIN r ON s.project_id = r.project_id WHERE s.hi >= r.lo AND s.lo <= r.hi), f AS (SELECT project_id, max(b) OVER (PARTITION BY project_id ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS lo, lead(a) OVER (PARTITION BY project_id ORDER BY a, b) AS hi FROM u) SELECT project_id, round(lo, 4) AS lo, round(hi, 4) AS hi FROM f WHERE hi - lo >= 0.3E0", "elements")
def split_by_supports(elements):
    runs = elements.where("etype = 'beam'").groupBy("project_id").agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    supports = elements.where("etype = 'column'").select("project_id", F.col("x").alias("lo"), (F.col("x") + F.col("b")).alias("hi"))
    return rounded(spatial.complement(runs, supports, ["project_id"], 0.3))


@query("isl_floor_clusters", "WITH m AS (SELECT drawing_id % 500 AS sheet, x, CASE WHEN x - lag(x) OVER (PARTITION BY drawing_id % 500 ORDER BY x) <= 15 THEN 0 ELSE 1 END AS new FROM elements), r AS (SELECT *, sum(new) OVER (PARTITION BY sheet ORDER BY x ROWS UNBOUNDED PRECEDING) AS cluster FROM m) SELECT sheet, CAST(cluster AS BIGINT) AS cluster, min(x) AS x0, max(x) AS x1, count(*) AS points FROM r GROUP BY ALL HAVING count(*) >= 20", "elements")
def floor_clusters(elements):
    return spatial.clusters(elements.select((F.col("drawing_id") % 500).alias("sheet"), "x"), ["sheet"], 15.0, 20)


_REVISIONS = """
WITH i AS (
  SELECT project_id, drawing_id, revision, uploaded, concat_ws('|', block, plan_type, CASE WHEN level IS NOT NULL THEN concat('kot:', printf('%.2f', level)) ELSE concat('sira:', rank) END) AS identity
  FROM drawings WHERE level IS NOT NULL OR rank IS NOT NULL
), stale AS (
  SELECT DISTINCT n.project_id, n.drawing_id FROM i n JOIN i o ON o.project_id = n.project_id AND o.identity = n.identity AND o.uploaded < n.uploaded AND o.revision > n.revision
  WHERE NOT EXISTS (SELECT 1 FROM i u WHERE u.project_id = n.project_id AND u.identity = n.identity AND u.revision IS NULL AND u.uploaded > o.uploaded AND u.uploaded < n.uploaded)
), lead AS (
  SELECT * FROM i ANTI JOIN stale USING (project_id, drawing_id)
), near AS (
  SELECT i.project_id, i.drawing_id, CASE WHEN s.drawing_id IS NULL THEN arg_min(l.drawing_id, l.uploaded) FILTER (l.uploaded > i.uploaded) ELSE arg_max(l.drawing_id, l.uploaded) FILTER (l.uploaded < i.uploaded) END AS superseded_by
  FROM i LEFT JOIN stale s USING (project_id, drawing_id) LEFT JOIN lead l ON l.project_id = i.project_id AND l.identity = i.identity GROUP BY i.project_id, i.drawing_id, s.drawing_id
)
SELECT project_id, drawing_id, identity, superseded_by FROM i JOIN near USING (project_id, drawing_id)
"""


@query("win_revisions", _REVISIONS, "drawings")
def revisions(drawings):
    return building.superseded_by(drawings)


@query("win_level_steps", "WITH l AS (SELECT DISTINCT project_id, level FROM drawings WHERE level IS NOT NULL) SELECT project_id, round(level, 4) AS level, round(lag(level) OVER w, 4) AS below, round(lead(level) OVER w, 4) AS above FROM l WINDOW w AS (PARTITION BY project_id ORDER BY level)", "drawings")
def level_steps(drawings):
    return rounded(building.level_steps(drawings.where("level IS NOT NULL"), ["project_id"]))


@query("win_section_inheritance", "WITH s AS (SELECT drawing_id, element_id, CASE WHEN h IS NULL OR element_id % 2 = 0 THEN NULL ELSE concat(CAST(round(b * 10) AS INT), 'x') END AS section FROM elements) SELECT drawing_id, element_id, coalesce(section, CASE WHEN min(section) OVER w = max(section) OVER w THEN min(section) OVER w END) AS section FROM s WINDOW w AS (PARTITION BY drawing_id)", "elements")
def section_inheritance(elements):
    s = elements.select("drawing_id", "element_id", F.when(F.col("h").isNotNull() & (F.col("element_id") % 2 != 0), F.concat(F.floor(F.col("b") * 10 + 0.5).cast("string"), F.lit("x"))).alias("section"))
    return building.share_single(s, ["drawing_id"], "section")


@query("isl_storey_levels", "WITH RECURSIVE l AS (SELECT DISTINCT project_id, level FROM drawings WHERE level IS NOT NULL), k AS (SELECT project_id, min(level) AS level FROM l GROUP BY ALL UNION ALL SELECT k.project_id, (SELECT min(l.level) FROM l WHERE l.project_id = k.project_id AND l.level - k.level >= 2.0E0) FROM k WHERE k.level IS NOT NULL) SELECT project_id, round(level, 4) AS level FROM k WHERE level IS NOT NULL", "drawings")
def storey_levels(drawings):
    return rounded(spatial.kept_levels(drawings.where("level IS NOT NULL"), ["project_id"]))


@query("agg_building_floors", None, "drawings")
def building_floors(drawings):
    levels = drawings.where("level IS NOT NULL").select("project_id", F.round("level", 2).alias("level"))
    return building.building_floors(levels, drawings.where("level IS NOT NULL AND plan_type = 'kalip'").select("project_id", F.round("level", 2).alias("level")))


_STEP = "s AS (SELECT DISTINCT project_id, round(level, 2) AS level FROM drawings WHERE level IS NOT NULL), st AS (SELECT project_id, level, round(level - lag(level) OVER w, 2) AS down, round(lead(level) OVER w - level, 2) AS up FROM s WINDOW w AS (PARTITION BY project_id ORDER BY level))"


@query("agg_storey_heights", f"WITH {_STEP}, j AS (SELECT d.project_id, drawing_id, storey_height, CASE WHEN plan_type = 'kalip' THEN coalesce(down, up) ELSE coalesce(up, down) END AS lv FROM drawings d LEFT JOIN st ON d.project_id = st.project_id AND round(d.level, 2) = st.level) SELECT project_id, drawing_id, round(CASE WHEN storey_height IS NOT NULL THEN storey_height WHEN lv >= 2 THEN lv ELSE 3 END, 4) AS height, CASE WHEN storey_height IS NOT NULL THEN 'drawing' WHEN lv >= 2 THEN 'levels' ELSE 'default' END AS source FROM j", "drawings")
def storey_heights(drawings):
    return rounded(building.storey_heights(drawings))


@query("agg_unique_footprints", "WITH t AS (SELECT project_id, block, rank AS floor, drawing_id, price AS area, row_number() OVER (PARTITION BY project_id, block, rank ORDER BY price DESC, drawing_id) AS nth FROM drawings WHERE rank IS NOT NULL) SELECT project_id, block, floor, drawing_id, area, max(area) OVER (PARTITION BY project_id, block) AS roof_area FROM t WHERE nth = 1", "drawings")
def unique_footprints(drawings):
    return building.unique_footprints(drawings.where("rank IS NOT NULL").select("project_id", "block", F.col("rank").alias("floor"), "drawing_id", F.col("price").alias("area")))


@query("agg_plan_check", "WITH b AS (SELECT DISTINCT project_id % 25 AS project_id, block FROM drawings), d AS (SELECT DISTINCT project_id % 25 AS project_id, block, plan_type FROM drawings WHERE drawing_id % 97 = 0) SELECT project_id, block, plan_type FROM b CROSS JOIN (SELECT unnest(['kalip', 'mimari', 'kesit', 'elektrik']) AS plan_type) WHERE (project_id, block, plan_type) NOT IN (SELECT (project_id, block, plan_type) FROM d)", "drawings")
def plan_check(drawings):
    d = drawings.withColumn("project_id", F.col("project_id") % 25)
    kept = d.where("drawing_id % 97 = 0").select("project_id", "block", "plan_type")
    every = d.select("project_id", "block").distinct().withColumn("plan_type", F.lit("-"))
    return building.plan_check(kept.unionByName(every), ["kalip", "mimari", "kesit", "elektrik"])


@query("set_missing_blocks", "WITH c AS (SELECT DISTINCT project_id, block FROM drawings WHERE drawing_id % 11 = 0), s AS (SELECT DISTINCT project_id, block FROM drawings) SELECT project_id, coalesce(string_agg(CASE WHEN (project_id, block) NOT IN (SELECT (project_id, block) FROM c) THEN block END, ',' ORDER BY block), '') AS missing FROM s GROUP BY project_id", "drawings")
def missing_blocks(drawings):
    return building.block_coverage(drawings.where("drawing_id % 11 = 0"), drawings)


@query("agg_rebar_check", f"WITH {LINES}, g AS (SELECT project_id, etype, project_id % 2 = 0 AS by_ratio, CAST(round(sum(CAST(concrete * multiplier AS DECIMAL(28,9))), 4) AS DOUBLE) AS concrete, CAST(round(sum(CAST(rebar * multiplier AS DECIMAL(28,9))), 4) AS DOUBLE) * CASE WHEN project_id % 3 = 0 THEN 3 ELSE 1 END AS rebar FROM lines GROUP BY project_id, etype) SELECT project_id, etype, round(rebar / CASE WHEN concrete > 0 THEN concrete END, 3) AS ratio, CASE WHEN concrete <= 0 OR etype IN ('parapet', 'stair') THEN 'no_data' WHEN by_ratio THEN 'inconclusive' WHEN rebar / concrete BETWEEN CASE etype WHEN 'column' THEN 120 WHEN 'shear_wall' THEN 80 WHEN 'beam' THEN 90 ELSE 60 END AND CASE etype WHEN 'column' THEN 400 WHEN 'slab' THEN 130 WHEN 'foundation' THEN 160 ELSE 250 END THEN 'supports' ELSE 'conflicts' END AS verdict FROM g", "elements")
def rebar_check(elements):
    g = lines_of(elements).groupBy("project_id", "etype").agg(*quantity._sums()).withColumns({"by_ratio": F.col("project_id") % 2 == 0, "rebar": F.col("rebar") * F.when(F.col("project_id") % 3 == 0, 3).otherwise(1)})
    return rounded(building.rebar_check(g).select("project_id", "etype", "ratio", "verdict"), 3)


@query("agg_floor_outliers", "WITH f AS (SELECT project_id, etype, drawing_id % 6 AS floor, sum(area * (1 + (drawing_id % 6 = 5)::INT * 3)) AS concrete FROM elements GROUP BY ALL), m AS (SELECT project_id, etype, median(concrete) AS med, count(*) AS floors FROM f GROUP BY ALL) SELECT project_id, etype, floor, round(concrete, 3) AS concrete FROM f JOIN m USING (project_id, etype) WHERE floors >= 3 AND med > 0 AND (concrete > 2 * med OR concrete * 2 < med)", "elements")
def floor_outliers(elements):
    weight = F.when(F.col("drawing_id") % 6 == 5, 4).otherwise(1)
    f = elements.groupBy("project_id", "etype", (F.col("drawing_id") % 6).alias("floor")).agg(F.sum(F.col("area") * weight).alias("concrete"))
    return rounded(building.floor_outliers(f).select("project_id", "etype", "floor", "concrete"), 3)


@query("agg_calibration", "WITH q AS (SELECT project_id, etype AS measure, sum(area) AS value FROM elements WHERE project_id % 5 <> 1 OR etype <> 'slab' GROUP BY ALL), t AS (SELECT project_id, etype AS measure, sum(area) * (1 + (project_id % 7) / 100.0E0) AS expected FROM elements GROUP BY project_id, etype), e AS (SELECT t.project_id, abs(coalesce(value, 0) - expected) / expected * 100 AS error FROM t LEFT JOIN q USING (project_id, measure)) SELECT project_id, round(avg(error), 4) AS mean_error, round(max(error), 4) AS worst_error, count(*) AS measures, avg(error) > 3.0E0 + 0.01E0 AS regression FROM e GROUP BY project_id", "elements")
def calibration(elements):
    q = elements.where("project_id % 5 <> 1 OR etype <> 'slab'").groupBy("project_id", F.col("etype").alias("measure")).agg(F.sum("area").alias("value"))
    t = elements.groupBy("project_id", F.col("etype").alias("measure")).agg(F.sum("area").alias("s")).select("project_id", "measure", (F.col("s") * (1 + (F.col("project_id") % 7) / 100.0)).alias("expected"))
    return rounded(building.calibrate(q, t, 3.0))


@query("join_reanalysis_merge", "WITH o AS (SELECT element_id AS key, excluded, manual FROM elements WHERE element_id % 5 <> 0), n AS (SELECT element_id AS key FROM elements WHERE element_id % 4 <> 0) SELECT coalesce(o.key, n.key) AS key, CASE WHEN coalesce(manual, false) THEN 'manual_kept' WHEN n.key IS NULL THEN 'removed' WHEN o.key IS NULL THEN 'added' WHEN excluded THEN 'exclusion_inherited' ELSE 'replaced' END AS state FROM o FULL JOIN n ON o.key = n.key", "elements")
def reanalysis_merge(elements):
    e = elements.withColumn("key", F.col("element_id"))
    return building.merge_reanalysis(e.where("key % 5 <> 0"), e.where("key % 4 <> 0"))


@query("agg_titleblock_fill", "WITH p AS (SELECT project_id, CASE WHEN project_id % 3 = 0 THEN NULL ELSE 'own' END AS value FROM drawings GROUP BY ALL), t AS (SELECT project_id, max(block) AS found FROM drawings GROUP BY ALL) SELECT project_id, coalesce(value, found) AS value FROM p LEFT JOIN t USING (project_id)", "drawings")
def titleblock_fill(drawings):
    p = drawings.select("project_id", F.when(F.col("project_id") % 3 != 0, "own").alias("value")).distinct()
    return building.fill_parameters(p, drawings.groupBy("project_id").agg(F.max("block").alias("value")))


@query("agg_majority_unit", "WITH v AS (SELECT drawing_id, CASE WHEN element_id % 5 < 3 THEN 'cm' ELSE 'mm' END AS unit, count(*) AS votes FROM elements GROUP BY ALL), b AS (SELECT *, sum(votes) OVER (PARTITION BY drawing_id) AS total, row_number() OVER (PARTITION BY drawing_id ORDER BY votes DESC, unit) AS nth FROM v) SELECT drawing_id, unit, votes, CAST(total AS BIGINT) AS total FROM b WHERE nth = 1 AND votes >= 2 AND votes >= 0.6E0 * total", "elements")
def majority_unit(elements):
    return building.majority(elements.select("drawing_id", F.when(F.col("element_id") % 5 < 3, "cm").otherwise("mm").alias("unit")), ["drawing_id"], "unit", 2, 0.6)


@query("join_plan_offset", "WITH t AS (SELECT project_id, etype AS name, area, x, y FROM elements), s AS (SELECT project_id, name, area, x - 3 AS x, y - 7 AS y FROM t), p AS (SELECT t.project_id, round(t.x - s.x, 2) AS dx, round(t.y - s.y, 2) AS dy, count(*) AS votes FROM t JOIN s ON t.project_id = s.project_id AND t.name = s.name AND abs(t.area - s.area) <= greatest(0.05E0, 0.01E0 * t.area) GROUP BY ALL), b AS (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY votes DESC, dx DESC, dy DESC) AS nth FROM p), n AS (SELECT project_id, count(*) AS rooms FROM t GROUP BY ALL) SELECT project_id, dx, dy, votes FROM b JOIN n USING (project_id) WHERE nth = 1 AND votes >= 2 AND votes * 2 >= rooms", "elements")
def plan_offset(elements):
    # Read five times by the operator, so that the joins behind the elements run once.
    t = written(elements.select("project_id", F.col("etype").alias("name"), "area", "x", "y"))
    return spatial.plan_offset(t, t.withColumns({"x": F.col("x") - 3, "y": F.col("y") - 7}))


@query("join_floor_identity", "WITH RECURSIVE n AS (SELECT DISTINCT project_id * 100000 + drawing_id % 400 AS node, project_id, drawing_id % 400 AS d, drawing_id % 7 AS l FROM drawings), e AS (SELECT a.node AS u, b.node AS v FROM n a JOIN n b ON a.project_id = b.project_id AND a.l = b.l), r AS (SELECT u AS node, u AS low FROM e UNION SELECT e.v, r.low FROM r JOIN e ON r.node = e.u WHERE r.low < e.v) SELECT node, min(low) AS component FROM r GROUP BY node", "drawings")
def floor_identity(drawings):
    n = drawings.select((F.col("project_id") * 100000 + F.col("drawing_id") % 400).alias("node"), "project_id", (F.col("drawing_id") % 7).alias("l")).distinct()
    low = n.groupBy("project_id", "l").agg(F.min("node").alias("low"))
    return connected(n.join(low, ["project_id", "l"]).select(F.col("node").alias("a"), F.col("low").alias("b")))


@query("cc_merge_areas", f"WITH RECURSIVE b AS MATERIALIZED ({_PROJECT_BOX}), e AS MATERIALIZED (SELECT p.id AS u, q.id AS v FROM b p JOIN b q ON p.project_id = q.project_id AND least(p.x1, q.x1) > greatest(p.x0, q.x0) AND least(p.y1, q.y1) > greatest(p.y0, q.y0)), r AS (SELECT u AS node, u AS low FROM e UNION SELECT e.v, r.low FROM r JOIN e ON r.node = e.u WHERE r.low < e.v), c AS (SELECT node AS id, min(low) AS area_id FROM r GROUP BY node) SELECT coalesce(area_id, id) AS area_id, round(sum((x1 - x0) * (y1 - y0)), 4) AS area, count(*) AS parts FROM b LEFT JOIN c USING (id) GROUP BY 1", "elements")
def merge_areas(elements):
    """CC-3: slabs that touch are one, with the sum of their areas."""
    b = project_boxes(elements)
    comp = connected(spatial.grid_overlaps(b, ["project_id"], 20.0).select(F.col("a_id").alias("a"), F.col("b_id").alias("b")))
    return rounded(b.join(comp, b["id"] == comp["node"], "left").groupBy(F.coalesce("component", "id").alias("area_id")).agg(F.sum((F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))).alias("area"), F.count(F.lit(1)).alias("parts")))
