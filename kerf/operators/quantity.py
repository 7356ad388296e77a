"""Element quantities: concrete, formwork and rebar as column expressions (QTY, FLT, AGG-1, 3, 4, 6, 20, 42)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: kg of rebar per m3 of concrete where no schedule was read. Fixed values.
REBAR_RATIO = {"column": 180.0, "shear_wall": 140.0, "beam": 140.0, "slab": 85.0, "foundation": 95.0, "parapet": 100.0, "stair": 120.0}
LEAST_CONFIDENCE = 0.4
LEAST_RISER, MOST_RISER, STAIR_SLAB = 0.12, 0.21, 0.15


def by_value(column: Column, values: dict, default=None) -> Column:
    out = F.lit(default)
    for k, v in values.items():
        out = F.when(column == k, F.lit(v)).otherwise(out)
    return out


def current(df: DataFrame) -> DataFrame:
    """FLT-1: rows of drawings that no newer revision replaces."""
    return df.where(~F.col("superseded"))


def included(df: DataFrame) -> DataFrame:
    """FLT-2: rows sure enough and not excluded by the user; rows added by hand always count."""
    return df.where((F.col("manual") | (F.col("confidence") >= LEAST_CONFIDENCE)) & ~F.col("excluded"))


def owned_by(df: DataFrame, company: Column, is_default: Column) -> DataFrame:
    """FLT-3: rows of one company, and rows without one where it is the default company."""
    return df.where((F.col("company_id") == company) | (is_default & F.col("company_id").isNull()))


def positive(x: Column) -> Column:
    return F.greatest(x, F.lit(0.0))


def stair(width: Column, run: Column, treads: Column, risers: Column, landing: Column, storey_height: Column, riser: Column | None = None) -> dict[str, Column]:
    """QTY-2: inclined slab, steps and landing of one flight; not valid unless the riser is a stair's."""
    h = storey_height / risers if riser is None else F.coalesce(riser, storey_height / risers)
    slope = F.hypot(run, risers * h)
    tread = F.when(treads > 0, run / treads).otherwise(0.0)
    return {
        "riser_h": h,
        "valid": (h >= LEAST_RISER) & (h <= MOST_RISER),
        "concrete": slope * width * STAIR_SLAB + treads * tread * h / 2 * width + landing * STAIR_SLAB,
        "formwork": slope * width + risers * h * width + landing,
        "cladding": treads * tread * width + risers * h * width + landing,
        "railing": slope,
        "soffit": slope * width + landing,
    }


def measure(elements: DataFrame) -> DataFrame:
    """QTY-1: concrete m3, formwork m2 and rebar kg of each element, the storey multiplier and a note if a size lacks."""
    c = F.col
    depth = c("slab_thickness")
    cast_h = F.when(c("net_slab"), c("storey_height")).otherwise(positive(c("storey_height") - depth))
    form_h = positive(c("storey_height") - F.when(c("beam_depth") != 0, c("beam_depth")).otherwise(depth).cast("double"))
    form_h = F.when(c("beam_depth").isNull() | (c("beam_depth") == 0), positive(c("storey_height") - depth)).otherwise(form_h)
    beam_h = F.coalesce(F.when(c("h") != 0, c("h")), F.when(c("b") != 0, c("beam_depth")))
    sized = beam_h.isNotNull() & c("b").isNotNull()
    web, side = F.when(c("net_slab"), beam_h).otherwise(positive(beam_h - depth)), positive(beam_h - depth)
    step = stair(c("b"), c("run"), c("treads"), c("risers"), c("landing"), c("storey_height"))
    t = F.coalesce("thickness", depth)
    raft = F.coalesce("thickness", F.lit(0.0))
    is_ = lambda k: c("etype") == k
    strip = is_("foundation") & (c("subtype") == "strip")
    concrete = (
        F.when(is_("column") | is_("shear_wall"), c("area") * cast_h)
        .when(is_("beam"), F.when(sized, c("b") * web * c("length")).otherwise(0.0))
        .when(is_("slab"), c("area") * t)
        .when(is_("stair"), F.when(step["valid"], step["concrete"]).otherwise(0.0))
        .when(is_("parapet") | strip, F.coalesce(c("b") * c("h") * c("length"), F.lit(0.0)))
        .when(is_("foundation"), c("area") * raft)
        .otherwise(0.0)
    )
    formwork = (
        F.when(is_("column"), c("perimeter") * form_h)
        .when(is_("shear_wall"), 2 * c("length") * form_h)
        .when(is_("beam"), F.when(sized, F.when(c("net_slab"), c("b") + 2 * side).otherwise(2 * side) * c("length")).otherwise(0.0))
        .when(is_("slab"), c("area"))
        .when(is_("stair"), F.when(step["valid"], step["formwork"]).otherwise(0.0))
        .when(is_("parapet") | strip, F.when(c("b").isNotNull(), F.coalesce(2 * c("h") * c("length"), F.lit(0.0))).otherwise(0.0))
        .when(is_("foundation"), c("perimeter") * raft)
        .otherwise(0.0)
    )
    note = F.when(is_("beam") & ~sized, "beam_section").when(is_("beam") & c("h").isNull(), "beam_depth_assumed").when(is_("stair") & ~step["valid"], "stair_riser").when((is_("parapet") | strip) & c("h").isNull(), "section").when(is_("foundation") & ~strip & (raft <= 0), "raft_thickness")
    return elements.withColumns({"multiplier": F.when(is_("foundation"), 1).otherwise(c("storey_count")), "concrete": concrete, "formwork": formwork, "note": note}).withColumn("rebar", c("concrete") * by_value(c("etype"), REBAR_RATIO, 0.0))


def group_key() -> Column:
    return F.when(F.col("subtype") != "", F.concat_ws(":", "etype", "subtype")).otherwise(F.col("etype"))


_TOTALS = ("concrete", "formwork", "rebar")


def exact_sum(x: Column) -> Column:
    """A sum in decimals, which does not depend on the order of rows."""
    return F.round(F.sum(x.cast("decimal(28,9)")), 4).cast("double")


def _sums() -> list[Column]:
    return [exact_sum(F.col(k) * F.col("multiplier")).alias(k) for k in _TOTALS]


def summarize(lines: DataFrame) -> DataFrame:
    """AGG-1: totals of each project and group, with the number of drawings they come from."""
    return lines.groupBy("project_id", group_key().alias("key")).agg(F.sum("multiplier").alias("pieces"), *_sums(), F.countDistinct("drawing_id").alias("drawings"))


def section_label() -> Column:
    """AGG-42: a column or beam by its sides in cm, a slab or raft by its thickness, others by their type."""
    cm = lambda x: F.round(F.col(x) * 100).cast("long").cast("string")
    return F.when(F.col("etype").isin("column", "beam", "parapet", "shear_wall") & F.col("h").isNotNull(), F.concat(cm("b"), F.lit("x"), cm("h"))).when(F.col("etype").isin("slab", "foundation") & F.col("thickness").isNotNull(), F.concat(F.lit("d"), cm("thickness"))).otherwise("-")


def by_section(lines: DataFrame) -> DataFrame:
    """AGG-3."""
    return lines.groupBy("project_id", "etype", section_label().alias("section")).agg(F.sum("multiplier").alias("pieces"), *_sums())


def project_totals(lines: DataFrame) -> DataFrame:
    """AGG-4: totals of each project, and the scaffold volume under its slabs."""
    under = F.when(F.col("etype") == "slab", F.col("area") * F.col("multiplier") * positive(F.col("storey_height") - F.coalesce("thickness", "slab_thickness")))
    return lines.groupBy("project_id").agg(*_sums(), F.coalesce(exact_sum(under), F.lit(0.0)).alias("scaffold"))


def by_drawing(lines: DataFrame) -> DataFrame:
    """AGG-6: totals of each drawing and type, of each drawing, and of each project (null where summed over)."""
    return lines.rollup("project_id", "drawing_id", "etype").agg(*_sums()).where(F.col("project_id").isNotNull())


def weighted_median(df: DataFrame, keys: list[str], value: str, weight: str) -> DataFrame:
    """AGG-20: the least value at which half of the weight is reached."""
    per = df.where(F.col(value).isNotNull() & (F.col(weight) > 0)).groupBy(*keys, value).agg(F.sum(weight).alias("w"))
    w = Window.partitionBy(*keys)
    run = per.withColumns({"run": F.sum("w").over(w.orderBy(value).rowsBetween(Window.unboundedPreceding, 0)), "all": F.sum("w").over(w)})
    return run.where(F.col("run") * 2 >= F.col("all")).groupBy(*keys).agg(F.min(value).alias(value))


def layer_measure(df: DataFrame, wall_height: float) -> DataFrame:
    """QTY-5: what a catalog item counts: pieces, metres, square metres of wall or plan, or cubic metres."""
    spec2 = F.try_element_at(F.split("spec", "x"), F.lit(2)).cast("double")
    spec1 = F.try_element_at(F.split("spec", "x"), F.lit(1)).cast("double")
    height = F.coalesce("h", F.when(spec2 > 50, spec2 / 100), F.lit(wall_height))
    depth = F.coalesce("thickness", F.when(spec1 > 0, spec1 / 100), F.lit(0.0))
    m = F.col("measure")
    return df.withColumn("measured", F.when(m.isin("count", "label_count"), F.col("n").cast("double")).when(m == "length", F.col("length")).when(m == "area", F.col("area")).when(m == "wall_area", F.col("length") * height).when(m == "volume", F.col("area") * depth))


def bar_weight(diameter_mm: Column) -> Column:
    """QTY-3: kg per metre."""
    return diameter_mm * diameter_mm * F.lit(0.006165)


def stirrups(b: Column, h: Column, length: Column, diameter_mm: Column, spacing: Column, cover: float = 0.03, hook: float = 0.1) -> dict[str, Column]:
    """QTY-4: number and kg of the stirrups of a beam or column."""
    n = F.floor(length / spacing) + 1
    return {"n": n, "kg": n * (2 * (b + h) - 8 * cover + 2 * hook) * bar_weight(diameter_mm)}
