"""Rebar by target, storey counts, usage, evidence, product lists, truth tables and written reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Disciplines and plan types that never own or add quantity. Fixed values.
NOT_MEASURED = ("donati", "vaziyet")
#: Scope of an item where its catalog row does not say, by discipline. Fixed values.
SCOPE_OF = {"structural": "building", "architectural": "room", "electrical": "building"}


def contributing(drawings: DataFrame) -> DataFrame:
    """FLT-6."""
    return drawings.where(~F.col("plan_type").isin(*NOT_MEASURED))


def layer_parts(layer: Column) -> dict[str, Column]:
    """LKP-2: discipline, item code and specification of a layer named PREFIX-DISCIPLINE-CODE[-SPEC]."""
    g = lambda i: F.regexp_extract(layer, r"^[A-Z0-9]+-([A-Z]{3})-([A-Z0-9_]+)(?:-(.+))?$", i)
    return {"discipline": g(1), "code": g(2), "spec": g(3)}


def scope_of(catalog_scope: Column, code_scope: Column, discipline: Column) -> Column:
    """LKP-9: the catalog's word, else the code's exception, else the discipline's default, else building."""
    by = F.coalesce(*[F.when(discipline == k, F.lit(v)) for k, v in SCOPE_OF.items()])
    return F.coalesce(catalog_scope, code_scope, by, F.lit("building"))


def rebar_by_diameter(rows: DataFrame) -> DataFrame:
    """AGG-5: kg of each diameter, with its parts by target."""
    by = rows.groupBy("project_id", "dia", "target").agg(F.sum("kg").alias("kg"))
    return by.groupBy("project_id", "dia").agg(F.sum("kg").alias("kg"), F.map_from_entries(F.sort_array(F.collect_list(F.struct("target", "kg")))).alias("targets"))


def rebar_rows(rows: DataFrame) -> DataFrame:
    """AGG-7: kg of table rows, from length and unit weight where no weight stands, times storeys but for foundations."""
    kg = F.coalesce("weight_kg", F.col("length_m") * F.col("dia") * F.col("dia") * 0.006165)
    return rows.withColumn("kg", kg * F.when(F.col("target") == "foundation", 1).otherwise(F.col("storey_count")))


def storey_counts(drawings: DataFrame) -> DataFrame:
    """AGG-26: storeys of a sheet by the best evidence: the user's, one for whole-building sheets, a range or count in
    the title, its own level, or one."""
    first, last = (F.regexp_extract("title", r"(\d+)\s*\.?\s*-\s*(\d+)\s*\.", i).try_cast("int") for i in (1, 2))
    span = F.when(last >= first, last - first + 1)
    count = F.regexp_extract("title", r"(\d+)\s*ADET KAT", 1).try_cast("int")
    s = lambda c, name: F.when(c.isNotNull(), F.struct(c.cast("int").alias("n"), F.lit(name).alias("source")))
    found = F.coalesce(s(F.col("manual"), "user"), s(F.when(F.col("plan_type") == "kesit", 1), "whole_building"), s(span, "title_range"), s(count, "title_count"), s(F.when(F.col("level").isNotNull(), 1), "own_level"), F.struct(F.lit(1).alias("n"), F.lit("default").alias("source")))
    return drawings.select("project_id", "drawing_id", found["n"].alias("storeys"), found["source"].alias("source"))


def usage(texts: DataFrame) -> DataFrame:
    """AGG-50: of each floor the use that its texts tell; commercial wins ties."""
    kind = F.when(F.col("text").rlike("(?i)dukkan|magaza|ofis"), "commercial").when(F.col("text").rlike("(?i)yatak|salon|mutfak"), "dwelling")
    n = texts.withColumn("kind", kind).where("kind IS NOT NULL").groupBy("project_id", "floor").pivot("kind", ["commercial", "dwelling"]).agg(F.count(F.lit(1))).na.fill(0)
    return n.withColumn("usage", F.when(F.col("commercial") >= F.col("dwelling"), "commercial").otherwise("dwelling"))


def curved_joinery(items: DataFrame) -> DataFrame:
    """AGG-58: joinery that is curved or has no size, counted."""
    why = F.when(F.col("note").rlike("(?i)kavis|kemer|yay"), "curved").when(F.col("width").isNull() | (F.col("width") <= 0), "no_size")
    return items.withColumn("why", why).where("why IS NOT NULL").groupBy("project_id", "why").agg(F.count(F.lit(1)).alias("n"))


def known_products(items: DataFrame, classes: list[str], diameters: list[int]) -> DataFrame:
    """AGG-60: concrete classes, bar diameters, general keys and items, one row a key."""
    spark = items.sparkSession
    fixed = spark.createDataFrame([(f"beton:{c}",) for c in classes] + [(f"demir:o{d}",) for d in diameters], "key string")
    both = F.array(F.concat(F.col("kind"), F.lit(":*")), F.concat_ws(":", "kind", "grp"))
    return fixed.unionByName(items.select(F.explode(both).alias("key"))).distinct()


def derivations(heights: DataFrame, storeys: DataFrame) -> DataFrame:
    """AGG-63: one view of derived parameters with value and source."""
    h = heights.select("drawing_id", F.lit("height").alias("parameter"), F.col("height").alias("value"), "source")
    return h.unionByName(storeys.select("drawing_id", F.lit("storeys").alias("parameter"), F.col("storeys").cast("double").alias("value"), "source"))


def truth_rows(floors: DataFrame, measures: list[str]) -> DataFrame:
    """SRC-6: floors with a map of measures as rows; a measure that is not known fails the job."""
    rows = floors.select("corpus", "floor", F.explode("truth").alias("measure", "value"))
    known = F.col("measure").isin(*measures)
    return rows.where(F.when(known, True).otherwise(F.raise_error(F.concat(F.lit("unknown measure "), F.col("measure")))))


def section_slopes(lines: DataFrame, sheets: DataFrame, least: float = 0.6) -> DataFrame:
    """JOIN-38: each sloped line of a section goes to the sheet whose level range holds most of it (at least 60 %)."""
    share = (F.least("hi", "top") - F.greatest("lo", "bottom")) / (F.col("hi") - F.col("lo"))
    j = lines.where("hi > lo").join(sheets, "project_id").where((F.col("lo") < F.col("top")) & (F.col("hi") > F.col("bottom"))).withColumn("share", share).where(F.col("share") >= least)
    w = Window.partitionBy("line_id").orderBy(F.desc("share"), "sheet_id")
    return j.withColumn("nth", F.row_number().over(w)).where("nth = 1").select("line_id", "sheet_id", "share")


def write_report(tables: dict[str, DataFrame], path: str) -> None:
    """SNK-1: one folder per sheet of the report, by project."""
    for name, df in tables.items():
        df.write.mode("overwrite").partitionBy("project_id").parquet(f"{path}/{name}")
