"""Parameters, catalog overlays, walls and faces, evidence votes, schedules and sections of reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def effective_params(projects: DataFrame, defaults: dict[str, str]) -> DataFrame:
    """FLT-5: known defaults overlaid by the project's values; unknown keys are dropped."""
    known = F.create_map(*[F.lit(x) for pair in sorted(defaults.items()) for x in pair])
    own = F.map_filter(F.coalesce("params", F.create_map().cast("map<string,string>")), lambda k, v: F.map_contains_key(known, k) & v.isNotNull())
    rest = F.map_filter(known, lambda k, v: ~F.map_contains_key(own, k))
    return projects.withColumn("params", F.map_concat(rest, own))


def overlay(defaults: DataFrame, changed: DataFrame, removed: DataFrame, key: str) -> DataFrame:
    """EXT-1, EXT-2: defaults without the removed and changed rows, and the changed ones."""
    base = defaults.join(removed.select(key).distinct(), key, "left_anti").join(changed.select(key).distinct(), key, "left_anti")
    return base.unionByName(changed)


def unknown_components(components: DataFrame, catalog: DataFrame) -> DataFrame:
    """EXT-1: components that name no catalog item, or their own parent."""
    known = catalog.select(F.col("code").alias("known")).distinct()
    return components.join(known, components["code"] == known["known"], "left").where(F.col("known").isNull() | (F.col("code") == F.col("parent_code"))).drop("known")


def guess_unit(entities: DataFrame) -> DataFrame:
    """SRC-2: the unit of a drawing by its extent: below 500 metres, below 50,000 centimetres, else millimetres."""
    extent = F.greatest(F.max("x") - F.min("x"), F.max("y") - F.min("y"))
    return entities.groupBy("drawing_id").agg(extent.alias("extent")).withColumn("unit", F.when(F.col("extent") < 500, "m").when(F.col("extent") < 50000, "cm").otherwise("mm"))


def wall_faces(walls: DataFrame, user_faces: float | None = None) -> DataFrame:
    """QTY-11: plaster area of each wall: the user's number of faces, else one for exterior walls and two for others."""
    faces = F.lit(user_faces) if user_faces is not None else F.when(F.col("exterior"), 1.0).otherwise(2.0)
    return walls.withColumn("plaster", F.greatest(F.col("gross") - F.col("openings"), F.lit(0.0)) * faces)


def wall_area(walls: DataFrame, default_slab: float = 0.15) -> DataFrame:
    """QTY-7: length times the layer's height, else the project's, else storey less slab."""
    h = F.coalesce("layer_height", "project_height", F.col("storey_height") - F.coalesce("slab_thickness", F.lit(default_slab)))
    return walls.withColumn("wall_area", F.col("length") * h)


def excavation_depth() -> Column:
    """QTY-10: struct(value, source): written depth, ground to foundation bottom, levels less layers, or the default."""
    s = lambda c, name: F.when(c.isNotNull(), F.struct(c.alias("value"), F.lit(name).alias("source")))
    return F.coalesce(s(F.col("written"), "written"), s(F.col("ground") - F.col("bottom"), "levels"), s(-F.col("foundation_level") + F.col("thickness") + 0.10, "foundation"), F.struct(F.lit(1.5).alias("value"), F.lit("default").alias("source")))


def cable_items(lines: DataFrame, drop: float, waste_pct: float) -> DataFrame:
    """AGG-12: cable length with risers and waste, by kind and specification, times storeys."""
    metres = (F.col("length") + drop) * (1 + waste_pct / 100) * F.col("storey_count")
    return lines.groupBy("project_id", "spec").agg(F.sum(metres).alias("metres"), F.sum("storey_count").alias("runs"))


def schedule_counts(texts: DataFrame) -> DataFrame:
    """AGG-51: joinery items and their counts; a repeated item keeps the greatest count."""
    item, n = F.regexp_extract("text", r"\b([KP]\d{1,3})\b", 1), F.regexp_extract("text", r"(\d+)\s*(?:ADET|AD)\b", 1)
    return texts.withColumns({"item": item, "n": F.coalesce(n.try_cast("int"), F.lit(1))}).where("item <> ''").groupBy("project_id", "item").agg(F.max("n").alias("n"))


def fastener_sizes(texts: DataFrame) -> DataFrame:
    """AGG-55: of each bolt diameter the most frequent length (of equally frequent ones, the least)."""
    found = texts.select("project_id", F.explode(F.regexp_extract_all("text", F.lit(r"M(\d+x\d+)"), F.lit(1))).alias("s"))
    sized = found.select("project_id", F.split_part("s", F.lit("x"), F.lit(1)).cast("int").alias("dia"), F.split_part("s", F.lit("x"), F.lit(2)).cast("int").alias("length"))
    n = sized.groupBy("project_id", "dia", "length").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("project_id", "dia").orderBy(F.desc("n"), "length")
    return n.withColumn("nth", F.row_number().over(w)).where("nth = 1").drop("nth")


def source_priority(rows: DataFrame, order: tuple[str, ...] = ("table", "texts", "plan")) -> DataFrame:
    """AGG-56: of each sheet only the rebar rows of its best source."""
    rank = F.lit(len(order))
    for i, s in enumerate(order):
        rank = F.when(F.col("source") == s, i).otherwise(rank)
    return rows.withColumn("_r", F.dense_rank().over(Window.partitionBy("drawing_id").orderBy(rank))).where("_r = 1").drop("_r")


def last_by_sheet(rows: DataFrame) -> DataFrame:
    """AGG-57: facts of an item pooled over sheets; the later sheet overwrites."""
    return rows.groupBy("project_id", "item").agg(F.max_by("value", F.struct("drawing_id", "value")).alias("value"))


def top_k(rows: DataFrame, keys: list[str], k: int, *order: Column) -> DataFrame:
    """SRT-2."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= k)


def pick_sheets(sheets: DataFrame) -> DataFrame:
    """SRT-3: sheets at 1/500 or coarser are evidence only where a finer sheet of the type exists; untitled small
    fragments are skipped."""
    finer = F.min("scale").over(Window.partitionBy("project_id", "plan_type"))
    verdict = F.when(F.col("title").isNull() & (F.col("objects") < 20), "skipped").when((F.col("scale") >= 500) & (finer < 500), "evidence").otherwise("taken")
    return sheets.withColumn("verdict", verdict)


def headline(items: DataFrame, waste_pct: float = 3.0) -> DataFrame:
    """AGG-41: net, waste and total of concrete, formwork and rebar, and labour hours of all."""
    q = lambda k: F.sum(F.when(F.col("kind") == k, F.col("quantity")).otherwise(0.0))
    out = items.groupBy("project_id").agg(*[q(k).alias(f"{k}_net") for k in ("beton", "kalip", "demir")], F.sum(F.when(F.col("unit") == "saat", F.col("quantity")).otherwise(0.0)).alias("hours"))
    return out.withColumns({f"{k}_total": F.col(f"{k}_net") * (1 + waste_pct / 100) for k in ("beton", "demir")})


def coverage_gaps(items: DataFrame, produced: DataFrame) -> DataFrame:
    """AGG-45: kinds that a project's plans should produce and its bill has no quantity of."""
    have = items.where(F.col("quantity") > 0).select("project_id", "kind").distinct()
    return produced.join(have, ["project_id", "kind"], "left_anti")


def quality_issues(checks: dict[str, tuple[str, DataFrame]]) -> DataFrame:
    """AGG-46: issues of all checks by project, and its status: incomplete if any blocks."""
    every = None
    for code, (severity, df) in checks.items():
        own = df.select("project_id").groupBy("project_id").agg(F.count(F.lit(1)).alias("n")).select("project_id", F.lit(code).alias("code"), F.lit(severity).alias("severity"), "n")
        every = own if every is None else every.unionByName(own)
    blocked = F.max((F.col("severity") == "blocking").cast("int")).over(Window.partitionBy("project_id")) == 1
    return every.withColumn("status", F.when(blocked, "incomplete").otherwise("ready"))


def drawing_status(drawings: DataFrame, elements: DataFrame) -> DataFrame:
    """AGG-52: parts found on each sheet: ok, empty, or untyped."""
    n = elements.groupBy("drawing_id").agg(F.count(F.lit(1)).alias("parts"))
    j = drawings.join(n, "drawing_id", "left").na.fill(0, ["parts"])
    return j.withColumn("state", F.when(F.col("plan_type").isNull(), "untyped").when(F.col("parts") == 0, "empty").otherwise("ok"))


def level_votes(texts: DataFrame) -> DataFrame:
    """AGG-24: the level that most of a sheet's texts name; of equals the least."""
    found = texts.select("drawing_id", F.explode(F.regexp_extract_all("text", F.lit(r"([+-]\d+\.\d{2})"), F.lit(1))).alias("v")).withColumn("level", F.col("v").cast("double"))
    n = found.groupBy("drawing_id", "level").agg(F.count(F.lit(1)).alias("votes"))
    return top_k(n, ["drawing_id"], 1, F.desc("votes"), F.col("level")).drop("rank")


def steel_heights(sheets: DataFrame) -> DataFrame:
    """JOIN-37: height of the columns of a steel sheet: down to the nearest lower sheet of its file."""
    below = F.lag("level").over(Window.partitionBy("file").orderBy("level"))
    levels = sheets.select("file", "level").distinct().withColumn("height", F.col("level") - below)
    return sheets.join(levels, ["file", "level"])


def nearest_free_level(table: DataFrame, plans: DataFrame, most: float = 1.5) -> DataFrame:
    """JOIN-21: exact levels first; then each table level, ascending, its nearest plan level in reach that is free.

    Levels of a project are few, so the claims run over one small array per project.
    """
    t = table.groupBy("project_id").agg(F.sort_array(F.collect_set("level")).alias("t"))
    p = plans.groupBy("project_id").agg(F.sort_array(F.collect_set("level")).alias("p"))
    j = t.join(p, "project_id")
    exact, left, free = F.array_intersect("t", "p"), F.array_except("t", "p"), F.array_except("p", "t")
    empty = F.array().cast("array<struct<level:double,plan:double>>")
    state = F.struct(empty.alias("out"), free.alias("free"))

    def claim(s: Column, v: Column) -> Column:
        near = F.array_min(F.transform(F.filter(s["free"], lambda q: F.abs(q - v) <= most), lambda q: F.struct(F.abs(q - v).alias("d"), q.alias("q"))))
        taken = F.when(near.isNotNull(), F.array_append(s["out"], F.struct(v.alias("level"), near["q"].alias("plan")))).otherwise(s["out"])
        return F.struct(taken.alias("out"), F.when(near.isNotNull(), F.array_remove(s["free"], near["q"])).otherwise(s["free"]).alias("free"))

    claims = F.aggregate(left, state, claim, lambda s: s["out"])
    both = F.concat(F.transform(exact, lambda v: F.struct(v.alias("level"), v.alias("plan"))), claims)
    return j.select("project_id", F.explode(both).alias("m")).select("project_id", "m.level", "m.plan")
