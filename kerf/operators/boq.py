"""Bill of quantities: merging, confidence, reviews, rebar diameters, recipes and systems."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Confidence tiers from best to worst. Fixed values.
TIERS = ("olculdu", "tanindi", "turetildi", "tahmin")
KIND_ORDER = ("beton", "kalip", "demir", "duvar", "siva", "boya", "kablo")
MOST_LEVELS = 4


def key() -> Column:
    return F.concat_ws(":", "kind", "grp")


def accumulate(rows: DataFrame) -> DataFrame:
    """AGG-8, AGG-9: one row per project, key and unit: sums, distinct notes, and quantity by confidence tier."""
    tiers = [F.sum(F.when(F.col("tier") == t, F.col("quantity")).otherwise(0.0)).alias(f"ev_{t}") for t in TIERS]
    return rows.groupBy("project_id", key().alias("key"), "kind", "grp", "unit").agg(F.sum("quantity").alias("quantity"), F.sum("cnt").alias("cnt"), F.sort_array(F.collect_set("note")).alias("notes"), *tiers)


def grade(items: DataFrame) -> DataFrame:
    """AGG-38: the worst tier with a quantity, and the share of each tier."""
    total = F.lit(0.0)
    badge = F.lit("turetildi")
    for t in TIERS:
        total = total + F.col(f"ev_{t}")
        badge = F.when(F.abs(F.col(f"ev_{t}")) > 1e-9, F.lit(t)).otherwise(badge)
    share = {f"share_{t}": F.when(total != 0, F.col(f"ev_{t}") / total).otherwise(0.0) for t in TIERS}
    return items.withColumns({"grade": badge, **share})


def shift_tier(items: DataFrame, tier: str) -> DataFrame:
    """AGG-38: evidence of a derived row is never better than tier; what was better moves there."""
    at = TIERS.index(tier)
    moved = {f"ev_{t}": F.lit(0.0) if i < at else F.col(f"ev_{t}") for i, t in enumerate(TIERS)}
    moved[f"ev_{tier}"] = sum((F.col(f"ev_{t}") for t in TIERS[: at + 1]), F.lit(0.0))
    return items.withColumns(moved)


def per_project_max(rows: DataFrame) -> DataFrame:
    """AGG-13: sums within a drawing; then the most over drawings for per-project items, the sum for others."""
    drawing = rows.groupBy("project_id", "drawing_id", key().alias("key"), "unit", "per_project").agg(F.sum("quantity").alias("q"))
    return drawing.groupBy("project_id", "key", "unit", "per_project").agg(F.when(F.col("per_project"), F.max("q")).otherwise(F.sum("q")).alias("quantity"))


def review(items: DataFrame, decisions: DataFrame) -> DataFrame:
    """JOIN-26: a rejected row counts 0, a manual quantity replaces; the computed one is kept beside it."""
    joined = items.join(decisions, ["project_id", "key"], "left")
    return joined.withColumns({"computed": F.col("quantity"), "quantity": F.when(F.col("status") == "reject", 0.0).otherwise(F.coalesce("manual_quantity", "quantity"))})


def sort_rank() -> Column:
    """SRT-1: rank of the kind; unknown kinds come last."""
    out = F.lit(len(KIND_ORDER))
    for i, k in enumerate(KIND_ORDER):
        out = F.when(F.col("kind") == k, i).otherwise(out)
    return out


def ordered(items: DataFrame) -> DataFrame:
    """SRT-1: rows numbered by kind, general rows first, then group and unit."""
    w = Window.partitionBy("project_id").orderBy(sort_rank(), F.col("grp") != "*", "grp", "unit")
    return items.withColumn("place", F.row_number().over(w))


def kind_totals(items: DataFrame) -> DataFrame:
    """AGG-39: totals of each kind and unit, of each kind, and of all."""
    return items.rollup("kind", "unit").agg(F.sum("quantity").alias("quantity"), F.count(F.lit(1)).alias("n_rows"))


def rebar_mix(callouts: DataFrame, least_share: float = 0.02) -> DataFrame:
    """AGG-22: share of each diameter of each target by n * d^2 * length; small shares are dropped and the rest scaled."""
    raw = callouts.groupBy("project_id", "target", "dia").agg(F.sum(F.col("n") * F.col("dia") * F.col("dia") * F.col("length")).alias("v"))
    w = Window.partitionBy("project_id", "target")
    kept = raw.where(F.col("v") > 0).withColumn("share", F.col("v") / F.sum("v").over(w)).where(F.col("share") >= least_share)
    return kept.withColumn("share", F.col("share") / F.sum("share").over(w)).select("project_id", "target", "dia", "share")


def split_by_mix(quantities: DataFrame, mix: DataFrame) -> DataFrame:
    """AGG-22: a quantity of rebar without diameter, split by the mix of its target."""
    return quantities.join(mix, ["project_id", "target"]).withColumn("kg", F.col("quantity") * F.col("share"))


def layer_verdict(tags: DataFrame, least_share: float = 0.15, least: int = 4) -> DataFrame:
    """AGG-23: double if the weaker side has enough tags, single if there are enough at all, else unknown."""
    t = tags.groupBy("project_id", "target").pivot("side", ["alt", "ust"]).agg(F.count(F.lit(1))).na.fill(0)
    low, total = F.least("alt", "ust"), F.col("alt") + F.col("ust")
    return t.withColumn("layers", F.when((low >= least) & (low >= least_share * total), "cift").when(total >= least, "tek").otherwise(""))


def expand_recipes(items: DataFrame, recipes: DataFrame, most_levels: int = MOST_LEVELS) -> DataFrame:
    """AGG-37: rows derived from items by recipes, level by level; each level is summed before it is a parent.

    items: project_id, kind, key, quantity. recipes: parent_kind, child_kind, factor (broadcast; a fixed dimension). A
    kind among a row's ancestors is not derived again, and rows already among items are not added.
    """
    front = items.select("project_id", "key", "quantity", F.array("kind").alias("chain"), "kind").where(F.col("quantity") > 0)
    out = None
    dim = F.broadcast(recipes)
    for level in range(1, most_levels + 1):
        step = front.join(dim, front["kind"] == dim["parent_kind"]).where(~F.array_contains("chain", F.col("child_kind")))
        step = step.select("project_id", F.col("child_kind").alias("kind"), (F.col("quantity") * F.col("factor")).alias("q"), F.col("key").alias("parent"), "chain")
        level_rows = step.groupBy("project_id", "kind").agg(F.sum("q").alias("quantity"), F.array_distinct(F.flatten(F.collect_set("chain"))).alias("above"), F.countDistinct("parent").alias("parents"))
        level_rows = level_rows.withColumns({"key": F.concat("kind", F.lit(":*")), "chain": F.array_union("above", F.array("kind")), "level": F.lit(level)})
        own = level_rows.select("project_id", "key", "kind", "quantity", "parents", "level", "chain")
        out = own if out is None else out.unionByName(own)
        front = own.select("project_id", "key", "quantity", "chain", "kind")
    merged = out.groupBy("project_id", "key", "kind").agg(F.sum("quantity").alias("quantity"), F.sum("parents").alias("parents"), F.min("level").alias("level"))
    return merged.join(items.select("project_id", "key").distinct(), ["project_id", "key"], "left_anti")


def expand_systems(items: DataFrame, components: DataFrame, choices: DataFrame) -> DataFrame:
    """AGG-36: components of each system row, where the user or else the evidence includes them."""
    rows = items.join(F.broadcast(components), items["kind"] == components["system_kind"]).join(choices, ["project_id", "code"], "left")
    taken = rows.where(F.coalesce("chosen", "by_evidence"))
    return taken.groupBy("project_id", F.col("code").alias("kind")).agg(F.sum(F.col("quantity") * F.col("factor")).alias("quantity"))


def already_measured(derived: DataFrame, items: DataFrame) -> DataFrame:
    """JOIN-28: derived rows whose kind the project measured itself are dropped."""
    return derived.join(items.select("project_id", "kind").distinct(), ["project_id", "kind"], "left_anti")


def rebar_report(items: DataFrame) -> DataFrame:
    """AGG-40: by diameter, kg measured and by ratio (estimated tiers), and 3 % waste."""
    d = F.regexp_extract("grp", r"^o([0-9]+)$", 1)
    own = items.where(F.col("kind") == "demir").withColumn("dia", F.when(d != "", d.cast("int")).otherwise(0))
    by = own.groupBy("project_id", "dia").agg(F.sum(F.when(F.col("tier").isin("olculdu", "tanindi"), F.col("quantity")).otherwise(0.0)).alias("measured"), F.sum(F.when(~F.col("tier").isin("olculdu", "tanindi"), F.col("quantity")).otherwise(0.0)).alias("by_ratio"))
    return by.withColumns({"waste": (F.col("measured") + F.col("by_ratio")) * 0.03, "total": (F.col("measured") + F.col("by_ratio")) * 1.03})
