"""Queries over texts, labels, rule tables and price lists."""

from __future__ import annotations

from pyspark.sql import functions as F

from kerf.functions import text
from kerf.plans.base import query, query_on_tables, rounded

#: Rules from layer names to element types, in order; the first match wins. Fixed values.
LAYER_RULES = [("(?i)KOLON|COLUMN", "column"), ("(?i)PERDE|SHEAR", "shear_wall"), ("(?i)KIRIS|BEAM", "beam"), ("(?i)DOSEME|SLAB", "slab"), ("(?i)TEMEL|RADYE", "foundation"), ("(?i)DUVAR|WALL", "wall"), ("(?i)KAPI|DOOR", "door"), ("(?i)AKS|GRID|OLCU", "ignore")]
#: Rules from item groups to rate-list numbers, by kind and in order. Fixed values.
RATE_RULES = [("beton", ".*", "15.150.1006"), ("kalip", ".*", "15.180.1003"), ("demir", "^(?:.*:)?o?(8|10|12)$", "15.160.1003"), ("demir", "^(?:.*:)?o?(14|16|18|20|22|24|26|28)$", "15.160.1004"), ("demir", ".*", "15.160.1004"), ("siva", ".*", "15.280.1008"), ("boya", ".*", "15.540.1509")]
_RATE = " ".join(f"WHEN kind = '{k}' AND regexp_matches(grp, '{p}') THEN '{v}'" for k, p, v in RATE_RULES)


@query("lkp_rate_number", f"SELECT DISTINCT kind, grp, CASE {_RATE} END AS poz FROM boq", "boq")
def rate_number(rows):
    rules = rows.sparkSession.createDataFrame([(i, k, p, v) for i, (k, p, v) in enumerate(RATE_RULES)], "rule_no int, kind string, pattern string, poz string")
    return text.first_rule(rows.select("kind", "grp").distinct(), rules, "grp", "poz", "kind")


_LAYER = "concat(CASE element_id % 4 WHEN 0 THEN 'A$0$' ELSE '' END, CASE element_id % 9 WHEN 0 THEN 'S-KOLON' WHEN 1 THEN 'st_perde_kolon' WHEN 2 THEN 'KIRIS' WHEN 3 THEN 'A-WALL' WHEN 4 THEN 'AKS' WHEN 5 THEN 'slab-1' WHEN 6 THEN 'TEMEL' WHEN 7 THEN 'X' ELSE 'A-DOOR' END)"
_LAYER_CASE = " ".join(f"WHEN regexp_matches(name, '{p}') THEN '{t}'" for p, t in LAYER_RULES)


@query("lkp_layer_type", f"WITH l AS (SELECT element_id, {_LAYER} AS layer FROM elements), n AS (SELECT *, regexp_replace(layer, '^.*[$]', '') AS name FROM l) SELECT element_id, layer, CASE {_LAYER_CASE} END AS etype FROM n", "elements")
def layer_type(elements):
    rules = elements.sparkSession.createDataFrame([(i, p, t) for i, (p, t) in enumerate(LAYER_RULES)], "rule_no int, pattern string, etype string")
    l = elements.selectExpr("element_id", f"{_LAYER} AS layer").withColumn("name", F.regexp_replace("layer", r"^.*[$]", ""))
    return text.first_rule(l, rules, "name", "etype").select("element_id", "layer", "etype")


_DISC = "CASE discipline WHEN 'structural' THEN 'KABA' WHEN 'rebar' THEN 'KABA' WHEN 'architectural' THEN 'INCE' WHEN 'electrical' THEN 'ELK' WHEN 'mechanical' THEN 'MEK' ELSE 'ALT' END"


@query("lkp_work_group", f"SELECT DISTINCT discipline, {_DISC} AS work_group FROM boq", "boq")
def work_group(rows):
    from kerf.operators.cost import WORK_GROUP
    from kerf.operators.quantity import by_value

    return rows.select("discipline").distinct().withColumn("work_group", by_value(F.col("discipline"), WORK_GROUP, "ALT"))


@query("lkp_rebar_diameter", "SELECT DISTINCT grp, CASE WHEN regexp_matches(grp, '^o[0-9]+$') AND CAST(substr(grp, 2) AS INT) BETWEEN 6 AND 40 THEN CAST(substr(grp, 2) AS INT) ELSE 0 END AS dia FROM boq WHERE kind = 'demir'", "boq")
def rebar_diameter(rows):
    d = F.regexp_extract("grp", r"(?:^|:)o?([0-9]+)(?:$|:)", 1).try_cast("int")
    return rows.where("kind = 'demir'").select("grp").distinct().withColumn("dia", F.when(d.between(6, 40), d).otherwise(0))


@query_on_tables("fn_title_slug", "SELECT p_partkey AS id, trim(regexp_replace(regexp_replace(upper(concat(p_name, '_(', p_brand, ')-', p_type)), '[_\\-./\\\\()\\[\\]:,;]+', ' ', 'g'), '\\s+', ' ', 'g')) AS title, trim(regexp_replace(lower(concat(p_name, ' / ', p_brand)), '[^a-z0-9.]+', '_', 'g'), '_') AS slug FROM part")
def title_slug(spark, sf_dir):
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    return p.select(F.col("p_partkey").alias("id"), text.normalize_title(F.concat("p_name", F.lit("_("), "p_brand", F.lit(")-"), "p_type")).alias("title"), text.slug(F.concat("p_name", F.lit(" / "), "p_brand")).alias("slug"))


_NUM = "CASE l_linenumber WHEN 1 THEN concat(CAST(l_partkey AS VARCHAR(9)), ',', CAST(10 + l_suppkey % 90 AS VARCHAR(9))) WHEN 2 THEN concat('1.', CAST(100 + l_partkey % 900 AS VARCHAR(9))) WHEN 3 THEN concat(CAST(l_suppkey AS VARCHAR(9)), '.', CAST(10 + l_partkey % 90 AS VARCHAR(9))) WHEN 4 THEN concat('1.234.', CAST(100 + l_partkey % 900 AS VARCHAR(9)), ',5 TL') ELSE 'yok' END"


@query_on_tables("fn_parse_number", f"WITH t AS (SELECT l_orderkey AS a, l_linenumber AS b, l_partkey, l_suppkey, l_linenumber, {_NUM} AS s FROM lineitem) SELECT DISTINCT s, CASE l_linenumber WHEN 1 THEN l_partkey + (10 + l_suppkey % 90) / 100.0E0 WHEN 2 THEN CAST(1000 + 100 + l_partkey % 900 AS DOUBLE) WHEN 3 THEN l_suppkey + (10 + l_partkey % 90) / 100.0E0 WHEN 4 THEN 1234000 + 100 + l_partkey % 900 + 0.5E0 END AS v FROM t")
def parse_numbers(spark, sf_dir):
    s = spark.read.parquet(f"{sf_dir}/lineitem.parquet").selectExpr(f"{_NUM} AS s").distinct()
    return s.withColumn("v", text.parse_number(F.col("s")))


_CALL = "concat(CASE WHEN l_suppkey % 3 = 0 THEN '' ELSE concat(CAST(2 + l_partkey % 30 AS VARCHAR(9)), ' ') END, 'Ø', CAST(8 + 2 * (l_partkey % 12) AS VARCHAR(9)), CASE WHEN l_suppkey % 2 = 0 THEN concat('/', CAST(10 + l_suppkey % 15 AS VARCHAR(9))) ELSE '' END, CASE WHEN l_linenumber % 2 = 0 THEN concat(' l=', CAST(100 + l_partkey % 500 AS VARCHAR(9))) ELSE '' END)"


@query_on_tables("fn_bar_callouts", f"WITH t AS (SELECT DISTINCT {_CALL} AS s, CASE WHEN l_suppkey % 3 <> 0 THEN 2 + l_partkey % 30 WHEN l_suppkey % 2 = 0 THEN 100.0E0 / (10 + l_suppkey % 15) ELSE 1 END AS n, CAST(8 + 2 * (l_partkey % 12) AS INT) AS dia, CASE WHEN l_linenumber % 2 = 0 THEN (100 + l_partkey % 500) / 100.0E0 ELSE 1 END AS length FROM lineitem) SELECT s, round(n, 4) AS n, dia, round(length, 4) AS length FROM t")
def bar_callouts(spark, sf_dir):
    s = spark.read.parquet(f"{sf_dir}/lineitem.parquet").selectExpr(f"{_CALL} AS s").distinct()
    c = text.callout(F.col("s"))
    return rounded(s.select("s", c["n"].alias("n"), c["dia"].alias("dia"), c["length"].alias("length")))


_LABEL = "concat(CASE l_linenumber % 4 WHEN 0 THEN 'S' WHEN 1 THEN 'K' WHEN 2 THEN 'D' ELSE 'P' END, CAST(100 + l_partkey % 90 AS VARCHAR(9)), CASE WHEN l_linenumber % 4 = 2 THEN concat(' d=', CAST(10 + l_suppkey % 20 AS VARCHAR(9))) ELSE concat(' ', CAST(20 + l_suppkey % 30 AS VARCHAR(9)), '/', CAST(40 + l_partkey % 50 AS VARCHAR(9))) END)"


@query_on_tables("fn_structural_label", f"SELECT DISTINCT {_LABEL} AS s, concat(CASE l_linenumber % 4 WHEN 0 THEN 'S' WHEN 1 THEN 'K' WHEN 2 THEN 'D' ELSE 'P' END, CAST(100 + l_partkey % 90 AS VARCHAR(9))) AS name, CASE l_linenumber % 4 WHEN 0 THEN 'column' WHEN 1 THEN 'beam' WHEN 2 THEN 'slab' ELSE 'shear_wall' END AS kind, CASE WHEN l_linenumber % 4 <> 2 THEN (20 + l_suppkey % 30) / 100.0E0 END AS b, CASE WHEN l_linenumber % 4 <> 2 THEN (40 + l_partkey % 50) / 100.0E0 END AS h, CASE WHEN l_linenumber % 4 = 2 THEN (10 + l_suppkey % 20) / 100.0E0 END AS thickness FROM lineitem")
def structural_label(spark, sf_dir):
    s = spark.read.parquet(f"{sf_dir}/lineitem.parquet").selectExpr(f"{_LABEL} AS s").distinct()
    return s.select("s", *[c.alias(k) for k, c in text.parse_label(F.col("s")).items()])


_FILE = "concat('A2 BLOK - ', CASE WHEN o_orderkey % 9 = 0 THEN '31.02.2021' WHEN o_orderkey % 5 = 0 THEN 'son' ELSE {d} END, '.dwg')"


@query_on_tables("fn_file_date", "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 9 = 0 OR o_orderkey % 5 = 0 THEN NULL ELSE strftime(o_orderdate, '%Y-%m-%d') END AS revision FROM orders")
def file_date(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    name = F.concat(F.lit("A2 BLOK - "), F.when(F.col("o_orderkey") % 9 == 0, "31.02.2021").when(F.col("o_orderkey") % 5 == 0, "son").otherwise(F.date_format("o_orderdate", "dd.MM.yyyy")), F.lit(".dwg"))
    return o.select(F.col("o_orderkey").alias("id"), text.file_date(name).cast("string").alias("revision"))


@query_on_tables("fn_recipe_text", "SELECT p_partkey AS id, unnest(['LENTO', 'PERVAZ']) AS code, unnest([1.0E0 + p_size / 2.0E0, 1.0E0]) AS factor, unnest(['PER', '']) AS times, unnest(['', concat('olcu ', p_size)]) AS spec FROM part")
def recipe_text(spark, sf_dir):
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    t = F.concat(F.lit("LENTO×"), (1 + F.col("p_size") / 2).cast("string"), F.lit("PER; PERVAZ: olcu "), F.col("p_size").cast("string"))
    return p.select(F.col("p_partkey").alias("id"), F.explode(text.components(t)).alias("c")).select("id", "c.*")


_TITLE = "CASE o_orderkey % 12 WHEN 8 THEN '1.-2. NORMAL KAT PLANI' WHEN 9 THEN 'TEM PLANI' WHEN 10 THEN 'STA-03' WHEN 11 THEN 'STA-03 5. KAT' WHEN 0 THEN 'TEMEL PLANI' WHEN 1 THEN '2. BODRUM KAT' WHEN 2 THEN 'Bodrum kat planı' WHEN 3 THEN 'ZEMİN KAT' WHEN 4 THEN '3. NORMAL KAT' WHEN 5 THEN 'Çatı planı' WHEN 6 THEN 'asma kat' ELSE 'DETAY' END"


@query_on_tables("agg_floor_rank", f"SELECT o_orderkey AS id, {_TITLE} AS title, CASE o_orderkey % 12 WHEN 8 THEN 1 WHEN 9 THEN -100 WHEN 10 THEN 3 WHEN 11 THEN 5 WHEN 0 THEN -100.0E0 WHEN 1 THEN -2 WHEN 2 THEN -1 WHEN 3 THEN 0 WHEN 4 THEN 3 WHEN 5 THEN 99 WHEN 6 THEN 0.5E0 END AS rank FROM orders")
def floor_ranks(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").selectExpr("o_orderkey AS id", f"{_TITLE} AS title")
    return o.withColumn("rank", text.floor_rank(F.col("title")))


_LINE = "CASE WHEN l_linenumber = 7 THEN 'baslik satiri' ELSE concat('15.', CAST(100 + l_partkey % 50 AS VARCHAR(9)), '.', CAST(1000 + l_suppkey AS VARCHAR(9)), '; Imalat ', CAST(l_partkey % 50 AS VARCHAR(9)), '; ', CASE l_linenumber WHEN 1 THEN 'm3' WHEN 2 THEN 'KG' ELSE 'adet' END, '; ', CAST(CAST(l_quantity AS INT) AS VARCHAR(9)), ',50') END"


@query_on_tables("src_price_list", f"WITH t AS (SELECT l_orderkey * 10 + l_linenumber AS line_no, max({_LINE}) AS line FROM lineitem GROUP BY 1), p AS (SELECT line_no, split_part(line, ';', 1) AS poz, trim(split_part(line, ';', 2)) AS name, lower(trim(split_part(line, ';', 3))) AS unit, CAST(replace(trim(split_part(line, ';', 4)), ',', '.') AS DOUBLE) AS price FROM t WHERE line <> 'baslik satiri') SELECT line_no, poz, name, unit, price, repeats FROM (SELECT *, row_number() OVER (PARTITION BY poz ORDER BY line_no DESC) AS nth, count(*) OVER (PARTITION BY poz) AS repeats FROM p) WHERE nth = 1")
def price_list(spark, sf_dir):
    l = spark.read.parquet(f"{sf_dir}/lineitem.parquet").selectExpr("l_orderkey * 10 + l_linenumber AS line_no", f"{_LINE} AS line")
    return text.price_list(l.groupBy("line_no").agg(F.max("line").alias("line")))


@query_on_tables("agg_material_evidence", "WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM documents), r(code, pattern) AS (VALUES ('the', '(?i)^the '), ('junk', '[#$%&*]{3}'), ('table', ' [|] ')) SELECT code, count(*) AS hits, count(DISTINCT doc_id) AS docs FROM l JOIN r ON regexp_matches(line, pattern) GROUP BY code")
def material_evidence(spark, sf_dir):
    """AGG-49: hits of a table of patterns on the lines of all texts."""
    lines = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.explode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("line"))
    rules = spark.createDataFrame([("the", "(?i)^the "), ("junk", "[#$%&*]{3}"), ("table", " [|] ")], "code string, pattern string")
    return lines.join(F.broadcast(rules), F.expr("line RLIKE pattern")).groupBy("code").agg(F.count(F.lit(1)).alias("hits"), F.countDistinct("doc_id").alias("docs"))
