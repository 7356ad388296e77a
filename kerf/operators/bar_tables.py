"""ISL-5: bar tables rebuilt from the loose texts of a sheet.

texts: drawing_id, x, y, text, height. A table is a row of diameter headers and what stands below it in its columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kerf.plans.work import written

#: Signs of a diameter, rows by their label (the first that matches a cell tells the row), units.
DIAMETER = r"^\s*(?:[ØøΦφ∅ƒ]|%%[cC]|[qQ])\s*(\d{1,2})\s*(?:mm|MM)?\s*$"
NUMBER = r"^-?\d{1,3}([.,]\d{3})*([.,]\d+)?$|^-?\d+([.,]\d+)?$"
#: One comma alone, points that group thousands, or a comma after the only point.
DECIMAL_COMMA = r"^[^.,]*,[^.,]*$|\..*\.|^[^.]*\.[^.]*,[^.]*$"
LABELS = [
    ("length", r"(?i)TOPLAM\s*BOY|TOTAL\s*LENGTH"),
    ("unit", r"(?i)B[Iİ]R[Iİ]M\s*A[GĞ]IRLIK|UNIT\s*WEIG"),
    ("declared", r"(?i)TOPLAM\s*A[GĞ]IRLIK|TOTAL\s*WEIG|GENEL\s*TOPLAM|GENERAL"),
    ("weight", r"(?i)^\s*A[GĞ]IRLIK|^\s*WEIG"),
]
TONNES, CENTIMETRES = r"(?i)\(\s*t(on)?\s*\)", r"(?i)\(\s*cm\s*\)"
#: Kilograms a metre and square millimetre of diameter; shares of the text height that are one line and that
#: a column reaches; least reach; gap between tables by the least gap; share that sums may differ from what is declared.
KG = 0.006165
LINE, REACH, LEAST_REACH, APART, DIFFERS = 0.6, 12.0, 0.5, 3.0, 0.02
NO_HEIGHT = 0.08


def value(text: Column) -> Column:
    """The number of a cell, or null: of the signs . and , the last one is the decimal sign, unless it comes twice or
    commas group thousands before a point."""
    return _value(F.replace(F.trim(text), F.lit(" "), F.lit("")))


def _value(bare: Column) -> Column:
    signed = F.when(bare.rlike(DECIMAL_COMMA), F.translate(bare, ",.", ".")).otherwise(F.translate(bare, ",", ""))
    plain = F.when(bare.contains(",") | bare.contains("."), signed).otherwise(bare)
    return F.when(bare.rlike(NUMBER), plain.try_cast("double"))


def once(df: DataFrame, **columns: str) -> DataFrame:
    """df with the columns, each worked out once a row: without the explode Spark puts their expressions into the lambdas
    and filters that read them, which then work them out for each element."""
    return df.select("*", F.inline(F.array(F.struct(*[F.expr(e).alias(c) for c, e in columns.items()]))))


def sheets_of(texts: DataFrame) -> DataFrame:
    """One row a sheet that has a header cell: its rows from above, each an array of cells (a step down of more than LINE of
    the median height begins one), and the reach of its columns. A cell is a dia, a number, a label or none of them."""
    t = texts.where("x IS NOT NULL AND y IS NOT NULL").select("drawing_id", "x", "y", F.trim("text").alias("text"), "height").where("text <> ''")
    t = t.withColumn("bare", F.replace("text", F.lit(" "), F.lit(""))).withColumn("number", _value(F.col("bare")))
    # Texts without a diameter are not cast: a cast that fails costs Spark more than all the rest of a cell.
    dia = F.when(F.col("number").isNull(), F.regexp_extract("text", DIAMETER, 1))
    t = t.withColumn("dia", dia).withColumn("dia", F.when(F.col("dia") != "", F.col("dia").cast("int"))).withColumn("dia", F.when(F.col("dia").between(6, 50), F.col("dia")))
    label = F.when(F.col("number").isNull() & F.col("dia").isNull() & F.col("text").rlike("|".join(f"(?:{p})" for _, p in LABELS)), F.col("text"))
    # The struct is made before the aggregate, which would not compile it.
    s = t.select("drawing_id", F.struct("y", "x", "dia", "number", label.alias("label"), "height").alias("cell")).groupBy("drawing_id").agg(F.collect_list("cell").alias("cells"))
    s = once(s.where("exists(cells.dia, d -> d IS NOT NULL)"), sorted="sort_array(cells, false)", heights="sort_array(filter(cells.height, h -> h > 0), false)")
    s = once(s, ys="sorted.y", median=f"coalesce(get(heights, shiftright(size(heights) + 1, 1) - 1), {NO_HEIGHT}D)")
    s = once(s, starts=f"filter(sequence(0, size(ys) - 1), i -> i = 0 OR get(ys, i - 1) - get(ys, i) > {LINE}D * median)")
    s = once(s, rows="transform(starts, (s, k) -> slice(sorted, s + 1, coalesce(get(starts, k + 1), size(sorted)) - s))", reach=f"greatest({LEAST_REACH}D, {REACH}D * median)")
    return s.select("drawing_id", "rows", "reach")


def with_tables(sheets: DataFrame) -> DataFrame:
    """The sheets with their tables: header row (top, from 1), part of it, columns (x, dia), extent, anchor, reaches and the
    row before which it ends. A row of headers is several tables where gaps exceed APART of its least one; a later header
    over the same extent ends it."""
    steps = {
        "heads": "filter(transform(rows, (r, k) -> struct(k + 1 AS top, sort_array(transform(filter(r, c -> c.dia IS NOT NULL), c -> struct(c.x AS x, c.dia AS dia, c.y AS y))) AS h)), a -> size(a.h) > 0)",
        "gapped": "transform(heads, a -> struct(a.top AS top, a.h AS h, transform(a.h, (c, i) -> c.x - get(a.h, i - 1).x) AS gaps))",
        "based": "transform(gapped, a -> struct(a.top AS top, a.h AS h, a.gaps AS gaps, coalesce(array_min(filter(a.gaps, g -> g > 1e-6D)), 1D) AS base))",
        "broken": f"transform(based, a -> struct(a.top AS top, a.h AS h, filter(sequence(0, size(a.h) - 1), i -> i = 0 OR get(a.gaps, i) > {APART}D * a.base) AS breaks))",
        "parts": "flatten(transform(broken, a -> transform(a.breaks, (b, p) -> struct(a.top AS top, p AS part, slice(a.h, b + 1, coalesce(get(a.breaks, p + 1), size(a.h)) - b) AS h))))",
        # A diameter that stands twice in a header has its last place.
        "columned": "transform(parts, a -> struct(a.top AS top, a.part AS part, a.h[0].x AS anchor_x, array_max(a.h.y) AS anchor_y, sort_array(transform(array_distinct(a.h.dia), d -> struct(array_max(filter(a.h, c -> c.dia = d)).x AS x, d AS dia))) AS columns))",
        "spaced": "transform(columned, a -> struct(a.top AS top, a.part AS part, a.anchor_x AS anchor_x, a.anchor_y AS anchor_y, a.columns AS columns, array_min(a.columns).x AS lo, array_max(a.columns).x AS hi, array_min(filter(transform(a.columns, (c, i) -> c.x - get(a.columns, i - 1).x), g -> g > 1e-6D)) AS gap))",
        "tables": """transform(spaced, a -> struct(a.top AS top, a.part AS part, a.anchor_x AS anchor_x, a.anchor_y AS anchor_y, a.columns AS columns, a.lo AS lo, a.hi AS hi, coalesce(a.gap / 2, reach) AS near,
            if(size(a.columns) > 1, coalesce(a.gap, 1D), reach) AS beside, array_min(filter(spaced, b -> b.top > a.top AND b.hi + reach >= a.lo AND b.lo - reach <= a.hi).top) AS end))""",
    }
    for name, step in steps.items():
        sheets = once(sheets, **{name: step})
    return sheets.select("drawing_id", "rows", "reach", "tables")


def met_rows(sheets: DataFrame) -> DataFrame:
    """The rows of numbers that stand below open tables: kind, numbers (x, number in metres and kilograms) and the tables in
    scope. The label of a row is its first, from the left."""
    r = sheets.select("drawing_id", "reach", "tables", F.posexplode(F.col("rows")).alias("row", "cells")).where("NOT exists(cells.dia, d -> d IS NOT NULL)")
    r = once(r, numbers="transform(filter(cells, c -> c.number IS NOT NULL), c -> struct(c.x AS x, c.number AS number))", open="filter(tables, t -> row + 1 > t.top AND (t.end IS NULL OR row + 1 < t.end))", label="array_min(transform(filter(cells, c -> c.label IS NOT NULL), c -> struct(c.x AS x, c.label AS text)))")
    r = r.where("size(numbers) > 0 AND size(open) > 0").select("drawing_id", "reach", "numbers", "open", F.col("label.x").alias("label_x"), F.col("label.text").alias("text"))
    kinds = "CASE " + " ".join(f"WHEN text RLIKE r'{p}' THEN '{k}'" for k, p in LABELS) + " END"
    r = once(r, kind=kinds).where("kind IS NULL OR kind <> 'unit'")
    factor = f"CASE WHEN kind = 'length' AND text RLIKE r'{CENTIMETRES}' THEN 0.01D WHEN kind <> 'length' AND text RLIKE r'{TONNES}' THEN 1000D ELSE 1D END"
    r = once(r, factor=factor, fits="if(label_x IS NULL, NULL, filter(open, t -> t.hi >= label_x - reach))")
    nearest = "array(array_min(transform(fits, t -> struct(abs(t.lo - label_x) AS d, t.top AS top, t.part AS part, t AS t))).t)"
    r = once(r, scope=f"CASE WHEN size(fits) > 1 THEN {nearest} WHEN size(fits) = 1 THEN fits ELSE open END", scaled="if(factor = 1D, numbers, transform(numbers, n -> struct(n.x AS x, n.number * factor AS number)))")
    return r.select("drawing_id", "kind", F.col("scaled").alias("numbers"), "scope")


def by_diameter(texts: DataFrame) -> DataFrame:
    """One row a diameter of a table: drawing_id, top, part, anchor_x, anchor_y, dia, length_m, weight_kg, from_length, and
    of its table total_kg, declared_kg, pos_count, differs; see bar_tables. Texts are grouped by sheet once, and all that
    follows stays in their partitions."""
    met = met_rows(with_tables(sheets_of(texts)))
    # A row of positions has no label and three numbers at least; its last number tells the table.
    sought = "CASE WHEN kind IS NULL THEN if(size(numbers) >= 3, array(array_max(numbers)), array()) WHEN kind = 'declared' THEN array() ELSE numbers END"
    hit = """array_min(flatten(transform(scope, t -> transform(filter(t.columns, c -> abs(c.x - n.x) <= t.near),
        c -> struct(round(abs(c.x - n.x), 9) AS d, t.top AS top, t.part AS part, c.x AS x, c.dia AS dia, t.anchor_x AS anchor_x, t.anchor_y AS anchor_y)))))"""
    declared = "transform(scope, t -> struct(array_max(filter(numbers, n -> n.x >= t.lo - t.beside AND n.x <= t.hi + t.beside).number) AS number, struct(0D AS d, t.top AS top, t.part AS part, t.lo AS x, NULL AS dia, t.anchor_x AS anchor_x, t.anchor_y AS anchor_y) AS hit))"
    met = once(met, sought=sought)
    hits = met.select("drawing_id", "kind", F.explode(F.expr(f"CASE WHEN kind = 'declared' THEN {declared} ELSE transform(sought, n -> struct(n.number AS number, {hit} AS hit)) END")).alias("m"))
    hits = hits.select("drawing_id", "kind", "m.number", "m.hit.*").where("top IS NOT NULL")
    of = lambda kind: F.when(F.col("kind") == kind, F.col("number"))
    dia = F.when(F.col("kind").isin("length", "weight"), F.col("dia")).alias("dia")
    per = hits.groupBy("drawing_id", "top", "part", dia).agg(
        F.max("anchor_x").alias("anchor_x"), F.max("anchor_y").alias("anchor_y"), F.coalesce(F.sum(of("length")), F.lit(0.0)).alias("length_m"), F.coalesce(F.sum(of("weight")), F.lit(0.0)).alias("weight"),
        F.max(of("declared")).alias("declared"), F.count(F.when(F.col("kind").isNull(), 1)).alias("positions"),
    )
    by_length = (F.col("weight") <= 0) & (F.col("length_m") > 0)
    per = per.withColumn("from_length", by_length).withColumn("weight_kg", F.when(by_length, F.col("length_m") * KG * F.col("dia") * F.col("dia")).otherwise(F.col("weight")))
    table = Window.partitionBy("drawing_id", "top", "part")
    per = per.withColumns({"total_kg": F.sum("weight_kg").over(table), "declared_kg": F.max("declared").over(table), "pos_count": F.sum("positions").over(table)}).where("dia IS NOT NULL AND total_kg > 0")
    differs = F.coalesce((F.col("declared_kg") > 0) & (F.abs(F.col("total_kg") - F.col("declared_kg")) > DIFFERS * F.col("declared_kg")), F.lit(False))
    return per.select("drawing_id", "top", "part", "anchor_x", "anchor_y", "dia", "length_m", "weight_kg", "from_length", "total_kg", "declared_kg", "pos_count", differs.alias("differs"))


def bar_tables(texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Tables and their diameters.

    tables: drawing_id, top, part, anchor_x, anchor_y, total_kg, declared_kg, pos_count, differs (sums and declared total
    are more than DIFFERS apart). diameters: drawing_id, top, part, dia, length_m, weight_kg, from_length.

    A labelled row belongs to the open table whose left edge is nearest to the label, among those that reach right of
    it; other rows to all open tables. A number goes to the nearest column within half the least gap. A weight that is
    missing or nothing is the length times the unit weight. Tables without weight are none. Texts without an x or y go.
    """
    # Written, as each of the two would run it anew.
    rows = written(by_diameter(texts))
    name = ["drawing_id", "top", "part"]
    tables = rows.select(*name, "anchor_x", "anchor_y", "total_kg", "declared_kg", "pos_count", "differs").dropDuplicates(name)
    return tables, rows.select(*name, "dia", "length_m", "weight_kg", "from_length")
