"""Rebar of tables in place of rebar by ratio (AGG-2)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kerf.operators.projects import nearest_free_level


def replace_ratio(lines: DataFrame, tables: DataFrame, most: float = 1.5) -> DataFrame:
    """AGG-2: of each project and group its concrete, rebar_kg, what of it is by ratio and by table, and the source.

    lines: project_id, etype, key, level, concrete, ratio_kg. tables: project_id, etype, level, kg. Table levels meet plan
    levels as in JOIN-21. A type's ratio rebar goes as a whole if no level meets, if a table has no level, or for
    foundations; else only that of the levels met goes. Tables are shared among the groups of a type by concrete. A table
    of a type without lines is a group of its own. Null levels of lines are never met.
    """
    pair = F.concat_ws("|", F.col("project_id").cast("string"), "etype").alias("project_id")
    levels = lambda df: df.where("level IS NOT NULL").select(pair, "level")
    met = nearest_free_level(levels(tables), levels(lines), most).select(F.col("project_id").alias("pair"), F.col("plan").alias("level"), F.lit(True).alias("met"))
    by_level = lines.groupBy("project_id", "etype", "key", "level").agg(F.sum("concrete").alias("concrete"), F.sum("ratio_kg").alias("ratio_kg"))
    by_level = by_level.withColumn("pair", pair).join(met, ["pair", "level"], "left")
    kept = F.sum(F.when(F.col("met"), 0.0).otherwise(F.col("ratio_kg")))
    groups = by_level.groupBy("project_id", "etype", "key").agg(F.sum("concrete").alias("concrete"), F.sum("ratio_kg").alias("all_kg"), kept.alias("kept"), F.max("met").alias("any_met"))
    types = groups.groupBy("project_id", "etype").agg(F.sum("concrete").alias("type_concrete"), F.max("any_met").alias("type_met"))
    table = tables.groupBy("project_id", "etype").agg(F.sum("kg").alias("kg"), F.max(F.col("level").isNull()).alias("no_level"))
    whole = F.col("type_met").isNull() | F.col("no_level") | (F.col("etype") == "foundation")
    share = F.when(F.col("type_concrete") != 0, F.col("concrete") / F.col("type_concrete")).otherwise(F.col("concrete"))
    j = groups.join(types, ["project_id", "etype"]).join(table, ["project_id", "etype"], "left")
    j = j.withColumns({"table_kg": F.coalesce(F.col("kg") * share, F.lit(0.0)), "by_ratio": F.when(F.col("kg").isNull(), F.col("all_kg")).when(whole, 0.0).otherwise(F.col("kept"))})
    source = F.when(F.col("kg").isNull(), "oran").when(F.col("by_ratio") > 0, "tablo+oran").otherwise("tablo")
    out = j.select("project_id", "etype", "key", "concrete", (F.col("table_kg") + F.col("by_ratio")).alias("rebar_kg"), F.col("by_ratio").alias("ratio_kg"), "table_kg", source.alias("source"))
    alone = table.join(types, ["project_id", "etype"], "left_anti")
    return out.unionByName(alone.select("project_id", "etype", F.col("etype").alias("key"), F.lit(0.0).alias("concrete"), F.col("kg").alias("rebar_kg"), F.lit(0.0).alias("ratio_kg"), F.col("kg").alias("table_kg"), F.lit("tablo").alias("source")))
