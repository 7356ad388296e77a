"""Prices, cost, duration and norms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kerf.operators.quantity import by_value

#: Hours per ton by bar diameter: from, to, preparation, carrying, placing. Fixed values.
REBAR_HOURS = [(6, 10, 8.0, 4.0, 15.0), (11, 12, 6.0, 3.0, 11.0), (13, 16, 5.0, 3.0, 8.0), (17, 22, 4.5, 2.5, 6.5), (23, 40, 4.0, 2.5, 5.0)]
REBAR_DEFAULT_DIA, DOUBLE_LAYER = 14, 1.15
#: Hours per m2 of formwork by element: making, setting, stripping. Fixed values.
FORM_HOURS = {"column": (0.35, 0.75, 0.35), "shear_wall": (0.25, 0.55, 0.25), "beam": (0.40, 0.85, 0.40), "slab": (0.25, 0.55, 0.30), "foundation": (0.20, 0.40, 0.20), "parapet": (0.30, 0.70, 0.30), "stair": (0.60, 1.20, 0.50)}
FORM_DEFAULT = (0.30, 0.60, 0.30)
#: Factors of the formwork material on these three. Fixed values.
FORM_FACTOR = {"plywood": (1.0, 1.0, 1.0), "ahsap": (1.25, 1.15, 1.10), "celik": (0.0, 0.70, 0.60), "tunel": (0.0, 0.45, 0.40)}
#: People in a crew by kind of labour. Fixed values.
CREW = {"demir": 4.0, "beton": 6.0, "duvar": 2.0, "siva": 2.0, "boya": 2.0, "kalip": 3.0}
CREW_DEFAULT = 2.0
#: Factor from a price's unit to an item's unit. Fixed values.
UNIT_FACTOR = {("kg", "ton"): 0.001, ("ton", "kg"): 1000.0, ("m", "km"): 0.001, ("km", "m"): 1000.0, ("L", "m3"): 0.001, ("m3", "L"): 1000.0}
WORK_GROUP = {"structural": "KABA", "rebar": "KABA", "architectural": "INCE", "electrical": "ELK", "mechanical": "MEK"}
LABOR_UNIT = "saat"


def priced(df: DataFrame) -> Column:
    """A row counts as priced by its unit price, its labour or its hours, whichever of these columns it has."""
    return sum((F.coalesce((F.col(c) > 0).cast("int"), F.lit(0)) for c in ("unit_price", "labor_price", "hours_per_unit") if c in df.columns), F.lit(0)) > 0


def best_quote(quotes: DataFrame) -> DataFrame:
    """WIN-1: of each scope and key the first preferred row, else the priced row of least positive unit price (rows priced
    by labour or hours alone come after these), else the first row."""
    rank = F.when(F.col("preferred"), 0).when(priced(quotes), 1).otherwise(2)
    money = F.when((rank == 1) & (F.col("unit_price") > 0), F.col("unit_price").cast("double")).when(rank == 1, float("inf")).otherwise(0.0)
    best = quotes.groupBy("scope", "key").agg(F.min_by(F.struct(*quotes.columns), F.struct(rank, money, "quote_id")).alias("q"))
    return best.select("q.*")


def latest_quote(quotes: DataFrame) -> DataFrame:
    """SRC-5: of each scope, key and supplier the last write; one preferred row per key at most (the last such)."""
    w = Window.partitionBy("scope", "key", "supplier_id").orderBy(F.desc("updated"), F.desc("quote_id"))
    last = quotes.withColumn("nth", F.row_number().over(w)).where("nth = 1").drop("nth")
    p = Window.partitionBy("scope", "key").orderBy(F.desc("preferred"), F.desc("updated"), F.desc("quote_id"))
    return last.withColumn("preferred", F.col("preferred") & (F.row_number().over(p) == 1))


def lookup_price(items: DataFrame, best: DataFrame) -> DataFrame:
    """JOIN-23: the row of the exact key if it is priced, else that of the kind's general key."""
    row = lambda name: best.where(priced(best)).select(F.col("key").alias(f"{name}_key"), F.struct("unit_price", "labor_price").alias(name))
    own, general = row("own").withColumnRenamed("own_key", "key"), row("general")
    joined = items.withColumn("general_key", F.concat(F.split_part("key", F.lit(":"), F.lit(1)), F.lit(":*"))).join(own, "key", "left").join(general, "general_key", "left")
    found = F.coalesce("own", "general")
    source = F.when(F.col("own").isNotNull(), "own").when(F.col("general").isNotNull(), "general").otherwise("none")
    zero = F.lit(0.0)
    return joined.withColumns({"price": F.coalesce(found["unit_price"], zero), "labor": F.coalesce(found["labor_price"], zero), "price_source": source}).drop("own", "general", "general_key")


def inherit_prices(items: DataFrame, own: DataFrame, old: DataFrame, book: DataFrame) -> DataFrame:
    """JOIN-25: the price of each project's product: its own, else the old price of the first of its items (by key), else
    that of the first one's kind, else the price book's (exact product, then kind). Prices of 0 do not count.

    items: project_id, kind, key, material. own: project_id, material, price. old: project_id, key, price. book: material,
    price. Items without a product are left out.
    """
    priced_ = lambda df, name: df.where("price > 0").withColumnRenamed("price", name)
    j = items.where("material IS NOT NULL").withColumn("general_key", F.concat("kind", F.lit(":*")))
    j = j.join(priced_(old, "item"), ["project_id", "key"], "left").join(priced_(old, "general").withColumnRenamed("key", "general_key"), ["project_id", "general_key"], "left")
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("key"))).alias(c)
    m = j.groupBy("project_id", "material").agg(first("item"), first("general"))
    m = m.withColumn("kind_book", F.concat(F.split_part("material", F.lit(":"), F.lit(1)), F.lit(":*"))).join(priced_(own, "own"), ["project_id", "material"], "left")
    m = m.join(priced_(book, "exact"), "material", "left").join(priced_(book, "kind_price").withColumnRenamed("material", "kind_book"), "kind_book", "left").withColumn("book", F.coalesce("exact", "kind_price"))
    order = ("own", "item", "general", "book")
    source = F.coalesce(*[F.when(F.col(c).isNotNull(), c) for c in order], F.lit("none"))
    return m.select("project_id", "material", F.coalesce(*order, F.lit(0.0)).alias("price"), source.alias("price_source"))


def unit_factor(item_unit: Column, price_unit: Column) -> Column:
    """JOIN-24: null where a price's unit cannot be converted."""
    out = F.lit(None).cast("double")
    for (a, b), f in UNIT_FACTOR.items():
        out = F.when((item_unit == a) & (price_unit == b), f).otherwise(out)
    return F.when(F.coalesce(price_unit, F.lit("")).isin("") | F.coalesce(item_unit, F.lit("")).isin("") | (item_unit == price_unit), 1.0).otherwise(out)


def rebar_norms(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(REBAR_HOURS, "lo int, hi int, prepare double, carry double, place double")


def with_rebar_hours(rows: DataFrame, layers: str = "", prefab_pct: float = 0.0) -> DataFrame:
    """JOIN-2: hours per ton by diameter band; unknown diameters count as 14, thicker ones as the last band."""
    d = F.least(F.when(F.coalesce("dia", F.lit(0)) == 0, REBAR_DEFAULT_DIA).otherwise(F.greatest("dia", F.lit(REBAR_HOURS[0][0]))), F.lit(REBAR_HOURS[-1][1]))
    n = F.broadcast(rebar_norms(rows.sparkSession))
    joined = rows.withColumn("_d", d).join(n, F.col("_d").between(F.col("lo"), F.col("hi"))).drop("_d", "lo", "hi")
    ready = min(max(prefab_pct, 0.0), 100.0) / 100
    return joined.withColumns({"place": F.round(F.col("place") * (DOUBLE_LAYER if layers == "cift" else 1.0), 2), "prepare": F.round(F.col("prepare") * (1 - ready), 2)})


def form_hours(etype: Column, material: str = "plywood", reuse: float = 1.0) -> dict[str, Column]:
    """JOIN-3: hours per m2; making is spread over the uses of a panel."""
    f = FORM_FACTOR.get(material, FORM_FACTOR["plywood"])
    base = [by_value(etype, {k: v[i] for k, v in FORM_HOURS.items()}, FORM_DEFAULT[i]) for i in range(3)]
    return {"make": F.round(base[0] * f[0] / max(reuse, 1.0), 4), "set": F.round(base[1] * f[1], 4), "strip": F.round(base[2] * f[2], 4)}


def material_key(concrete_class: str = "c30_37", formwork: str = "plywood") -> Column:
    """LKP-11: the product of an item; null for labour."""
    d = F.regexp_extract("grp", r"^(?:.*:)?o?([0-9]+)$", 1)
    return (
        F.when(F.col("unit") == LABOR_UNIT, F.lit(None).cast("string"))
        .when(F.col("kind") == "beton", f"beton:{concrete_class}")
        .when(F.col("kind") == "demir", F.when(d != "", F.concat(F.lit("demir:o"), d)).otherwise("demir:karisik"))
        .when(F.col("kind") == "kalip", f"kalip:{formwork}")
        .otherwise(F.concat_ws(":", "kind", "grp"))
    )


def material_lines(items: DataFrame, most: int = 40) -> DataFrame:
    """AGG-14: quantity of each product, how many items it goes into, and the first of them by quantity."""
    own = items.withColumn("material", material_key()).where(F.col("material").isNotNull()).withColumn("q", F.greatest("quantity", F.lit(0.0)))
    w = Window.partitionBy("project_id", "material").orderBy(F.desc("q"), "kind", "grp", "unit")
    own = own.withColumn("nth", F.row_number().over(w))
    return own.groupBy("project_id", "material").agg(F.sum("q").alias("quantity"), F.count(F.lit(1)).alias("n_items"), F.min(F.when(F.col("nth") == 1, F.concat_ws(":", "kind", "grp", "unit"))).alias("first_item"), F.sum((F.col("nth") <= most).cast("int")).alias("listed"))


def price_lines(items: DataFrame, prices: DataFrame) -> DataFrame:
    """AGG-15: of each item material, labour and subcontract totals; a subcontract price covers all else."""
    own = items.join(prices, ["project_id", "kind"], "left")
    money = lambda x: F.round(F.col("quantity") * F.coalesce(x, F.lit(0.0)), 2).cast("decimal(18,2)")
    sub = F.coalesce("subcontract_price", F.lit(0.0)) > 0
    zero = F.lit(0).cast("decimal(18,2)")
    hours = F.col("quantity") * F.when((F.col("unit") == LABOR_UNIT) & (F.coalesce("hours_per_unit", F.lit(0.0)) == 0), 1.0).otherwise(F.coalesce("hours_per_unit", F.lit(0.0)))
    out = own.where(F.col("quantity") > 0).withColumns({"material_total": F.when(sub, zero).otherwise(money("unit_price")), "labor_total": F.when(sub, zero).otherwise(money("labor_price")), "subcontract_total": F.when(sub, money("subcontract_price")).otherwise(zero), "hours": hours, "crew": by_value(F.col("kind"), CREW, CREW_DEFAULT), "work_group": by_value(F.col("discipline"), WORK_GROUP, "ALT")})
    return out.withColumns({"total": (F.col("material_total") + F.col("labor_total") + F.col("subcontract_total")).cast("decimal(18,2)"), "days": F.col("hours") / (F.col("crew") * 8)})


def cost_rollups(lines: DataFrame) -> DataFrame:
    """AGG-16: totals by kind, work group and discipline of each project, in one pass over the lines."""
    grouped = lines.groupingSets([["project_id", "kind"], ["project_id", "work_group"], ["project_id", "discipline"], ["project_id"]], "project_id", "kind", "work_group", "discipline")
    return grouped.agg(F.sum("total").alias("total"), F.sum("hours").alias("hours"), F.count(F.lit(1)).alias("n_lines"))


def indirect_chain(totals: DataFrame, transport: float, overhead: float, profit: float, vat: float) -> DataFrame:
    """AGG-17: transport, overhead and profit, each a share of all before it, and VAT on the sum."""
    out = totals.withColumn("base", F.col("direct").cast("decimal(18,2)"))
    for name, pct in (("transport", transport), ("overhead", overhead), ("profit", profit)):
        out = out.withColumn(name, F.round(F.col("base") * F.lit(str(pct)).cast("decimal(9,4)") / 100, 2).cast("decimal(18,2)")).withColumn("base", (F.col("base") + F.col(name)).cast("decimal(18,2)"))
    return out.withColumn("vat", F.round(F.col("base") * F.lit(str(vat)).cast("decimal(9,4)"), 2).cast("decimal(18,2)")).withColumn("grand_total", (F.col("base") + F.col("vat")).cast("decimal(18,2)")).withColumnRenamed("base", "subtotal")


def duration(lines: DataFrame) -> DataFrame:
    """AGG-18: hours, days one after another, and days with disciplines side by side."""
    d = lines.groupBy("project_id", "discipline").agg(F.sum("hours").alias("hours"), F.sum("days").alias("days"))
    return d.groupBy("project_id").agg(F.sum("hours").alias("hours"), F.sum("days").alias("sequential_days"), F.max("days").alias("parallel_days"))


def default_price_keys(items: DataFrame) -> DataFrame:
    """AGG-19: one key per item and a general one per kind."""
    both = F.array(F.concat_ws(":", "kind", "grp"), F.concat(F.col("kind"), F.lit(":*")))
    return items.select("project_id", F.explode(both).alias("key")).distinct()


def missing_ranked(lines: DataFrame, most: int) -> DataFrame:
    """AGG-43: the products without price of each project, largest quantity first."""
    own = lines.withColumn("material", material_key()).where(F.col("material").isNotNull() & (F.coalesce("unit_price", F.lit(0.0)) <= 0))
    g = own.groupBy("project_id", "material").agg(F.sum("quantity").alias("quantity"))
    w = Window.partitionBy("project_id").orderBy(F.desc("quantity"), "material")
    return g.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)
