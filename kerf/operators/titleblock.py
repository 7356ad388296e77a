"""Labels of a title block and their values (JOIN-29)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kerf.operators.quantity import by_value

#: How far a value may lie from its label, in text heights. Fixed values.
ROW, RIGHT, LEFT, ASIDE, BELOW = 0.6, 40, 1, 6, 4


def pair_values(texts: DataFrame, fields: dict[str, str], no_value: str = r"^\W*$") -> DataFrame:
    """JOIN-29: drawing_id, field and value: of each label the nearest text to its right, else the nearest one below.

    texts: drawing_id, item_id, x, y, h, text; fields: label (upper case) to field name. Labels and texts like no_value
    are no values. Equal scores go to the least item_id. A field that several labels name takes the first of them (by item_id) that has a value. Only labels
    are joined with the texts of their drawing, which are as few as the dictionary.
    """
    c = F.col
    own = texts.withColumn("field", by_value(F.upper(F.trim("text")), fields))
    labels = own.where("field IS NOT NULL").select("drawing_id", "field", c("item_id").alias("label_id"), c("x").alias("lx"), c("y").alias("ly"), F.when(c("h") > 0, c("h")).otherwise(1.0).alias("lh"))
    values = own.where(c("field").isNull() & c("text").isNotNull() & ~c("text").rlike(no_value)).select("drawing_id", "item_id", "x", "y", F.trim("text").alias("value"))
    dx, dy, h = c("x") - c("lx"), c("y") - c("ly"), c("lh")
    right = (F.abs(dy) <= ROW * h) & (dx > 0) & (dx <= RIGHT * h)
    below = dx.between(-LEFT * h, ASIDE * h) & (dy >= -BELOW * h) & (dy < -ROW * h)
    score = F.when(right, dx).when(below, RIGHT * h + F.abs(dy))
    scored = labels.join(values, "drawing_id").withColumn("score", score).where("score IS NOT NULL")
    best = scored.groupBy("drawing_id", "field", "label_id").agg(F.min_by("value", F.struct("score", "item_id", "value")).alias("value"))
    return best.groupBy("drawing_id", "field").agg(F.min_by("value", "label_id").alias("value"))
