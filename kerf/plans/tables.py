"""Query on bar tables that are drawn as loose texts; its SQL reads the quantities behind the texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kerf.operators import bar_tables
from kerf.plans.base import query_on_tables, rounded
from kerf.sources.views import size_of

_LINES = "SELECT l_orderkey, l_linenumber AS n, min(l_partkey) AS p, CAST(min(l_quantity) AS INT) AS q FROM lineitem GROUP BY ALL"


#: Bytes of the table's file that one task gets: a line becomes about six texts.
TASK_BYTES = 2 << 20


def bar_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order is a sheet with a table of a column a line: headers, rows of positions, lengths, and on some sheets
    weights, a declared total (a tenth too much on some) and a second table beside it with a length in centimetres.
    Lines are dealt by sheet once; their texts stay where they are."""
    path = f"{sf_dir}/lineitem.parquet"
    parts = max(spark.sparkContext.defaultParallelism, -(-size_of(spark, path) // TASK_BYTES))
    lines = spark.read.parquet(path).select(F.col("l_orderkey").alias("drawing_id"), F.col("l_linenumber").cast("int").alias("n"), "l_partkey", "l_quantity")
    lines = lines.repartition(parts, "drawing_id").groupBy("drawing_id", "n").agg(F.min("l_partkey").alias("p"), F.min("l_quantity").cast("int").alias("q"))
    sheet = Window.partitionBy("drawing_id").orderBy("n")
    whole = sheet.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    lines = lines.withColumns({"k": F.row_number().over(sheet), "sq": F.sum("q").over(whole), "cnt": F.count(F.lit(1)).over(whole)})
    sign = "CASE p % 2 WHEN 0 THEN '.' ELSE ',' END"
    weighed, second = "drawing_id % 3 <> 0", "drawing_id % 4 = 1 AND cnt > 1"
    label = "CASE WHEN drawing_id % 5 = 0 THEN 'AĞIRLIK (ton)' ELSE 'AGIRLIK / WEIGHT (kg)' END"
    # x, y, text and where it stands; texts of the sheet stand with its first line.
    of_line = [
        ("100 * k", "100 + n % 2 * 0.4", "concat(CASE p % 3 WHEN 0 THEN 'Ø' WHEN 1 THEN 'ƒ ' ELSE '%%c' END, 6 + 2 * n)", "true"),
        ("0", "90 - 3 * n", "concat('0', n)", "true"),
        ("20", "90 - 3 * n", "CAST(6 + 2 * n AS STRING)", "true"),
        ("40", "90 - 3 * n", "CAST(q AS STRING)", "true"),
        ("100 * k + 10", "90 - 3 * n", "concat(q * 12, '.50')", "true"),
        ("100 * k", "60 - n % 2 * 0.5", f"concat(q * 12, {sign}, '50')", "true"),
        ("100 * k - 5", "50", "CASE WHEN drawing_id % 5 = 0 THEN concat('0.', lpad(CAST(q * 10 AS STRING), 3, '0')) ELSE concat(q * 10, '.0') END", weighed),
    ]
    of_sheet = [
        ("-50", "60", "'TOPLAM BOY (m)'", "true"),
        ("-50", "50", label, weighed),
        ("-50", "40", "'GENEL TOPLAM / GENERAL'", weighed),
        ("103", "40", "CAST(CASE WHEN drawing_id % 7 = 0 THEN sq * 11 ELSE sq * 10 END AS STRING)", weighed),
        ("3000", "100", "'Ø32'", second),
        ("2950", "56", "'TOTAL LENGTH (cm)'", second),
        ("3000", "56", "'2500'", second),
        ("9000", "40", "'777'", "true"),
    ]
    cells = [(x, y, f"CASE WHEN {where} THEN {text} END") for x, y, text, where in of_line + [(x, y, text, f"k = 1 AND {where}") for x, y, text, where in of_sheet]]
    stacked = ", ".join(f"CAST({x} AS DOUBLE), CAST({y} AS DOUBLE), {text}" for x, y, text in cells)
    return lines.selectExpr("drawing_id", f"stack({len(cells)}, {stacked}) AS (x, y, text)").where("text IS NOT NULL").withColumn("height", F.lit(3.0))


_WANT = f"""WITH l AS ({_LINES}), s AS (SELECT l_orderkey, min(n) AS n, sum(q) AS q, count(*) AS cnt FROM l GROUP BY l_orderkey),
d AS (SELECT l_orderkey AS drawing_id, CAST(0 AS BIGINT) AS part, CAST(6 + 2 * n AS INT) AS dia, q * 12 + 0.5E0 AS length_m, CASE WHEN l_orderkey % 3 <> 0 THEN q * 10.0E0 ELSE (q * 12 + 0.5E0) * 0.006165E0 * (6 + 2 * n) * (6 + 2 * n) END AS weight_kg, l_orderkey % 3 = 0 AS from_length FROM l
  UNION ALL SELECT l_orderkey, 1, 32, 25, 25 * 0.006165E0 * 1024, true FROM s WHERE l_orderkey % 4 = 1 AND cnt > 1),
t AS (SELECT drawing_id, part, sum(weight_kg) AS total_kg FROM d GROUP BY ALL)
SELECT drawing_id, part, dia, round(length_m, 5) AS length_m, round(weight_kg, 5) AS weight_kg, from_length, round(total_kg, 5) AS total_kg,
  CASE WHEN part = 0 AND drawing_id % 3 <> 0 THEN CASE WHEN drawing_id % 7 = 0 THEN q * 11.0E0 ELSE q * 10.0E0 END END AS declared_kg, CASE WHEN part = 0 THEN cnt ELSE 0 END AS pos_count, part = 0 AND drawing_id % 3 <> 0 AND drawing_id % 7 = 0 AS differs
FROM d JOIN t USING (drawing_id, part) JOIN s ON l_orderkey = drawing_id"""


@query_on_tables("isl_bar_tables", _WANT)
def tables(spark, sf_dir):
    found = bar_tables.by_diameter(bar_texts(spark, sf_dir))
    return rounded(found.select("drawing_id", F.col("part").cast("long").alias("part"), "dia", "length_m", "weight_kg", "from_length", "total_kg", "declared_kg", F.col("pos_count").cast("long").alias("pos_count"), "differs"), 5)
