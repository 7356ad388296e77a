"""Sheets, revisions, levels, floors and checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def identity() -> Column:
    """WIN-2: block, plan type and floor of a sheet; null if its floor is unknown."""
    floor = F.coalesce(F.concat(F.lit("kot:"), F.format_number(F.col("level"), 2)), F.concat(F.lit("sira:"), F.col("rank").cast("string")))
    return F.when(floor.isNotNull(), F.concat_ws("|", "block", "plan_type", floor))


def superseded_by(drawings: DataFrame) -> DataFrame:
    """WIN-2: each upload replaces the current sheet of its identity, unless both are dated and the upload is older; such
    a stale upload is itself replaced by the current sheet.

    An undated sheet always becomes current, so it starts a run; in a run a dated one does if none before it is newer.
    """
    known = drawings.withColumn("identity", identity()).where(F.col("identity").isNotNull())
    order = Window.partitionBy("project_id", "identity").orderBy("uploaded", "drawing_id")
    before = Window.unboundedPreceding, -1
    known = known.withColumn("run", F.sum(F.col("revision").isNull().cast("int")).over(order))
    newest = F.max("revision").over(Window.partitionBy("project_id", "identity", "run").orderBy("uploaded", "drawing_id").rowsBetween(*before))
    known = known.withColumn("leader", F.when(F.col("revision").isNull() | newest.isNull() | (F.col("revision") >= newest), F.col("drawing_id")))
    after = F.first("leader", ignorenulls=True).over(order.rowsBetween(1, Window.unboundedFollowing))
    held = F.last("leader", ignorenulls=True).over(order.rowsBetween(*before))
    return known.withColumn("superseded_by", F.when(F.col("leader").isNotNull(), after).otherwise(held)).select("project_id", "drawing_id", "identity", "superseded_by")


def level_steps(levels: DataFrame, keys: list[str]) -> DataFrame:
    """WIN-3: distinct levels with the next one above and below."""
    w = Window.partitionBy(*keys).orderBy("level")
    return levels.select(*keys, "level").distinct().withColumns({"below": F.lag("level").over(w), "above": F.lead("level").over(w)})


def share_single(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """WIN-3b: rows without a value take the group's only one, if it has exactly one."""
    w = Window.partitionBy(*keys)
    one = F.min(value).over(w) == F.max(value).over(w)
    return df.withColumn(value, F.coalesce(F.col(value), F.when(one, F.min(value).over(w))))


def building_floors(levels: DataFrame, anchors: DataFrame, gap: float = 2.0) -> DataFrame:
    """AGG-25: levels that plans state themselves, then others by support, each at least gap from all kept before."""
    support = levels.groupBy("project_id", "level").agg(F.count(F.lit(1)).alias("n"))
    ranked = support.groupBy("project_id").agg(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("n"), "level"))).alias("others"))
    own = anchors.groupBy("project_id").agg(F.sort_array(F.collect_set("level")).alias("base"))
    far = lambda a, v: ~F.exists(a, lambda f: F.abs(f - v) < gap)
    grown = F.aggregate("others", F.col("base"), lambda a, o: F.when(far(a, o["level"]), F.array_append(a, o["level"])).otherwise(a))
    return own.join(ranked, "project_id").select("project_id", F.explode(F.sort_array(grown)).alias("level"))


def storey_heights(drawings: DataFrame, project_height: float | None = None, default: float = 3.0) -> DataFrame:
    """AGG-27: height of each sheet and where it is from: its own, the project's, the level difference, or the default.

    Form plans look down to the level below, others up.
    """
    w = Window.partitionBy("project_id").orderBy("level")
    steps = drawings.where(F.col("level").isNotNull()).select("project_id", F.round("level", 2).alias("level")).distinct()
    steps = steps.withColumns({"down": F.round(F.col("level") - F.lag("level").over(w), 2), "up": F.round(F.lead("level").over(w) - F.col("level"), 2)})
    joined = drawings.withColumn("level", F.round("level", 2)).join(steps, ["project_id", "level"], "left")
    form = F.col("plan_type") == "kalip"
    by_level = F.when(form, F.coalesce("down", "up")).otherwise(F.coalesce("up", "down"))
    found = F.coalesce(
        F.when(F.col("storey_height").isNotNull(), F.struct(F.col("storey_height").alias("h"), F.lit("drawing").alias("source"))),
        F.when(F.lit(project_height).isNotNull(), F.struct(F.lit(project_height).cast("double").alias("h"), F.lit("project").alias("source"))),
        F.when(by_level >= 2.0, F.struct(by_level.alias("h"), F.lit("levels").alias("source"))),
        F.struct(F.lit(default).alias("h"), F.lit("default").alias("source")),
    )
    return joined.select("project_id", "drawing_id", found["h"].alias("height"), found["source"].alias("source"))


def unique_footprints(footprints: DataFrame) -> DataFrame:
    """AGG-30: the largest footprint of each floor, and the roof of each block (its largest footprint)."""
    w = Window.partitionBy("project_id", "block", "floor").orderBy(F.desc("area"), "drawing_id")
    top = footprints.withColumn("nth", F.row_number().over(w)).where("nth = 1").drop("nth")
    return top.withColumn("roof_area", F.max("area").over(Window.partitionBy("project_id", "block")))


def plan_check(drawings: DataFrame, required: list[str]) -> DataFrame:
    """AGG-44: required plan types that a block of a project lacks."""
    blocks = drawings.select("project_id", "block").distinct()
    wanted = blocks.withColumn("plan_type", F.explode(F.array(*[F.lit(t) for t in required])))
    return wanted.join(drawings.select("project_id", "block", "plan_type").distinct(), ["project_id", "block", "plan_type"], "left_anti")


def block_coverage(drawings: DataFrame, site: DataFrame) -> DataFrame:
    """AGG-29, SET-2: blocks of the site plan that no sheet covers, as a list per project."""
    covered = drawings.groupBy("project_id").agg(F.collect_set("block").alias("covered"))
    s = site.groupBy("project_id").agg(F.collect_set("block").alias("site"))
    missing = F.array_sort(F.array_except("site", F.coalesce("covered", F.array().cast("array<string>"))))
    return s.join(covered, "project_id", "left").select("project_id", F.array_join(missing, ",").alias("missing"))


#: Plausible rebar per concrete, kg/m3: least and most. Fixed values.
REBAR_BAND = {"column": (120.0, 400.0), "shear_wall": (80.0, 250.0), "beam": (90.0, 250.0), "slab": (60.0, 130.0), "foundation": (60.0, 160.0)}


def rebar_check(groups: DataFrame) -> DataFrame:
    """AGG-47: rebar ratio against a band; what came from a ratio proves nothing and is inconclusive."""
    lo, hi = (F.coalesce(*[F.when(F.col("etype") == k, F.lit(v[i])) for k, v in REBAR_BAND.items()]) for i in (0, 1))
    ratio = F.when(F.col("concrete") > 0, F.col("rebar") / F.col("concrete"))
    verdict = F.when(ratio.isNull() | lo.isNull(), "no_data").when(F.col("by_ratio"), "inconclusive").when(ratio.between(lo, hi), "supports").otherwise("conflicts")
    return groups.withColumns({"ratio": ratio, "verdict": verdict})


def floor_outliers(per_floor: DataFrame, factor: float = 2.0) -> DataFrame:
    """AGG-47: floors more than factor times off the median of their project and type."""
    med = per_floor.groupBy("project_id", "etype").agg(F.median("concrete").alias("median"), F.count(F.lit(1)).alias("floors"))
    j = per_floor.join(med, ["project_id", "etype"]).where((F.col("floors") >= 3) & (F.col("median") > 0))
    return j.where((F.col("concrete") > factor * F.col("median")) | (F.col("concrete") * factor < F.col("median")))


def calibrate(measured: DataFrame, truth: DataFrame, baseline: float | None = None, slack: float = 0.01) -> DataFrame:
    """AGG-48: error of each measure against the truth; mean and worst of each project; a regression is a worse mean
    than the baseline's by more than slack."""
    e = truth.join(measured, ["project_id", "measure"], "left").withColumn("error", F.abs(F.coalesce("value", F.lit(0.0)) - F.col("expected")) / F.col("expected") * 100)
    out = e.groupBy("project_id").agg(F.avg("error").alias("mean_error"), F.max("error").alias("worst_error"), F.count(F.lit(1)).alias("measures"))
    return out.withColumn("regression", F.lit(False) if baseline is None else F.col("mean_error") > baseline + slack)


def merge_reanalysis(old: DataFrame, new: DataFrame) -> DataFrame:
    """JOIN-27: rows added by hand survive; a new row at an old one's key inherits its exclusion; others are replaced."""
    o = old.select("key", F.col("excluded").alias("old_excluded"), F.col("manual").alias("old_manual"))
    n = new.select("key", F.lit(True).alias("fresh"))
    j = o.join(n, "key", "full_outer")
    state = F.when(F.coalesce("old_manual", F.lit(False)), "manual_kept").when(F.col("fresh").isNull(), "removed").when(F.col("old_excluded").isNull(), "added").when(F.col("old_excluded"), "exclusion_inherited").otherwise("replaced")
    return j.select("key", state.alias("state"))


def fill_parameters(projects: DataFrame, titleblock: DataFrame) -> DataFrame:
    """AGG-62: title-block values fill only what the project leaves empty."""
    t = titleblock.select("project_id", F.col("value").alias("found"))
    return projects.join(t, "project_id", "left").withColumn("value", F.coalesce("value", "found")).drop("found")


def majority(votes: DataFrame, keys: list[str], value: str, least: int, share: float) -> DataFrame:
    """AGG-21, LKP-5: the value with most votes, if it has enough of them and of the total; ties go to the least."""
    n = votes.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("votes"))
    total = F.sum("votes").over(Window.partitionBy(*keys))
    w = Window.partitionBy(*keys).orderBy(F.desc("votes"), value)
    best = n.withColumns({"total": total, "nth": F.row_number().over(w)}).where("nth = 1").drop("nth")
    return best.where((F.col("votes") >= least) & (F.col("votes") >= share * F.col("total")))
