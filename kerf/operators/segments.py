"""Lengths of segments outside of obstacles (GEO-4)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CELL = 5.0
_SEGMENT = ["segment_id", "x0", "y0", "x1", "y1"]


def clipped(x0: Column, y0: Column, x1: Column, y1: Column, points: Column) -> Column:
    """The part of a segment in a convex polygon (points x, y counter-clockwise), as shares lo and hi of its length; hi is
    below lo if there is none."""
    edges = F.transform(points, lambda p, i: F.struct(p["x"].alias("px"), p["y"].alias("py"), F.get(points, (i + 1) % F.size(points)).alias("q")))

    def cut(s: Column, e: Column) -> Column:
        ex, ey = e["q"]["x"] - e["px"], e["q"]["y"] - e["py"]
        at, along = ex * (y0 - e["py"]) - ey * (x0 - e["px"]), ex * (y1 - y0) - ey * (x1 - x0)
        lo = F.when(along > 0, F.greatest(s["lo"], -at / along)).otherwise(s["lo"])
        hi = F.when(along < 0, F.least(s["hi"], -at / along)).when((along == 0) & (at < 0), F.lit(-1.0)).otherwise(s["hi"])
        return F.struct(lo.alias("lo"), hi.alias("hi"))

    return F.aggregate(edges, F.struct(F.lit(0.0).alias("lo"), F.lit(1.0).alias("hi")), cut)


def _cells(df: DataFrame, x: tuple[Column, Column], y: tuple[Column, Column], cell: float, prefix: str) -> DataFrame:
    at = lambda c: F.floor(c / cell)
    df = df.withColumns({f"{prefix}cx": at(x[0]), f"{prefix}cy": at(y[0])})
    return df.withColumn("cx", F.explode(F.sequence(F.col(f"{prefix}cx"), at(x[1])))).withColumn("cy", F.explode(F.sequence(F.col(f"{prefix}cy"), at(y[1]))))


def net_length(segments: DataFrame, obstacles: DataFrame, cell: float = CELL) -> DataFrame:
    """GEO-4: length and net_length of each segment; what several obstacles cover counts once.

    segments: drawing_id, segment_id (of one drawing), x0, y0, x1, y1. obstacles: drawing_id, points (convex, counter-clockwise). Both meet
    in grid cells of a drawing; a pair counts in one cell only, the first that both have. Segments with a null end have a
    null length, and obstacles without points cover nothing.
    """
    c = F.col
    long = F.hypot(c("x1") - c("x0"), c("y1") - c("y0"))
    s = _cells(segments, (F.least("x0", "x1"), F.greatest("x0", "x1")), (F.least("y0", "y1"), F.greatest("y0", "y1")), cell, "s")
    px, py = F.transform("points", lambda p: p["x"]), F.transform("points", lambda p: p["y"])
    o = _cells(obstacles.select("drawing_id", "points"), (F.array_min(px), F.array_max(px)), (F.array_min(py), F.array_max(py)), cell, "o")
    pairs = s.join(o, ["drawing_id", "cx", "cy"]).where("cx = greatest(scx, ocx) AND cy = greatest(scy, ocy)")
    parts = pairs.select(*_SEGMENT, clipped(c("x0"), c("y0"), c("x1"), c("y1"), c("points")).alias("t")).select(*_SEGMENT, "t.lo", "t.hi").where("hi > lo")
    before = F.max("hi").over(Window.partitionBy(*_SEGMENT).orderBy("lo", "hi").rowsBetween(Window.unboundedPreceding, -1))
    new = F.greatest(F.lit(0.0), c("hi") - F.greatest(c("lo"), F.coalesce(c("before"), F.lit(0.0))))
    covered = parts.withColumn("before", before).groupBy(*_SEGMENT).agg(F.sum(new).alias("covered"))
    return segments.join(covered, _SEGMENT, "left").select("drawing_id", "segment_id", long.alias("length"), (long * (1 - F.coalesce("covered", F.lit(0.0)))).alias("net_length"))
