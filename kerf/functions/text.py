"""Text helpers and ordered rule tables as column expressions (FN-*, LKP-*, AGG-28, SRC-4)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Turkish letters and their plain forms. Fixed values.
TURKISH, PLAIN = "çğıöşüÇĞİÖŞÜ", "cgiosuCGIOSU"


def plain(text: Column) -> Column:
    return F.translate(text, TURKISH, PLAIN)


def normalize_title(text: Column) -> Column:
    """FN-1: plain capitals, separators as single spaces."""
    up = F.upper(plain(F.coalesce(text, F.lit(""))))
    return F.trim(F.regexp_replace(F.regexp_replace(up, r"[_\-./\\()\[\]:,;]+", " "), r"\s+", " "))


def slug(text: Column) -> Column:
    """FN-2: lower case, anything else than letters, digits and points as one underscore."""
    return F.trim(F.regexp_replace(F.lower(plain(F.coalesce(text, F.lit("")))), r"[^a-z0-9.]+", "_"), F.lit("_"))


def parse_number(text: Column) -> Column:
    """FN-3: local numbers: a comma is the decimal sign and points group; one point before three digits groups too."""
    s = F.regexp_replace(F.coalesce(text, F.lit("")), r"\s|₺|TL", "")
    comma = F.replace(F.replace(s, F.lit("."), F.lit("")), F.lit(","), F.lit("."))
    grouped = F.replace(s, F.lit("."), F.lit(""))
    picked = F.when(s.contains(","), comma).when(s.rlike(r"\..*\.") | s.rlike(r"^-?[0-9]{1,3}\.[0-9]{3}$"), grouped).otherwise(s)
    return F.when(s.rlike(r"^-?[0-9][0-9.,]*$"), picked.try_cast("double"))


def numbers_in(text: Column) -> Column:
    """FN-4: the numbers of a specification, in order."""
    return F.transform(F.regexp_extract_all(F.replace(F.coalesce(text, F.lit("")), F.lit(","), F.lit(".")), F.lit(r"([0-9]+(?:\.[0-9]+)?)"), F.lit(1)), lambda x: x.cast("double"))


def file_date(name: Column) -> Column:
    """FN-9: dd.mm.yy or dd.mm.yyyy in a file name; null where there is none or it is no date."""
    pattern = r"(\d{1,2})[.\-_](\d{1,2})[.\-_](\d{4}|\d{2})"
    part = lambda i: F.regexp_extract(name, pattern, i)
    year = part(3).try_cast("int")
    year = F.when(year < 100, year + 2000).otherwise(year)
    return F.when(part(1) != "", F.try_to_date(F.concat_ws("-", year.cast("string"), F.lpad(part(2), 2, "0"), F.lpad(part(1), 2, "0")), "yyyy-MM-dd"))


def parse_label(text: Column) -> dict[str, Column]:
    """FN-5: name, sides in metres and thickness of a structural label such as `K101 25/50` or `D2 d=15`."""
    side = lambda i: F.regexp_extract(text, r"(\d{2,3})\s*[/xX]\s*(\d{2,3})", i)
    d = F.regexp_extract(text, r"[dDhH]\s*=\s*(\d{1,3})", 1)
    cm = lambda s: F.when(s != "", s.cast("double") / 100)
    name = F.regexp_extract(text, r"^\s*([A-Za-z]{1,3}\d{1,4})\b", 1)
    kind = F.when(name.rlike("^(SB|S|C)"), "column").when(name.rlike("^(P|SW)"), "shear_wall").when(name.rlike("^K"), "beam").when(name.rlike("^D"), "slab")
    return {"name": F.when(name != "", name), "kind": kind, "b": cm(side(1)), "h": cm(side(2)), "thickness": cm(d)}


def callout(text: Column) -> dict[str, Column]:
    """FN-8: count, diameter and length in metres of a bar text such as `12 Ø14/20 l=350`."""
    g = lambda p: F.regexp_extract(text, p, 1)
    n, d, s, length = g(r"(\d+)\s*[ØƒøФ]"), g(r"[ØƒøФ]\s*(\d+)"), g(r"[ØƒøФ]\s*\d+\s*/\s*(\d+)"), g(r"[lL]\s*=\s*(\d+)")
    num = lambda x: F.when(x != "", x.cast("double"))
    metres = F.when(num(length) >= 20, num(length) / 100).otherwise(num(length))
    count = F.coalesce(num(n), 100 / F.when(num(s) > 0, num(s)), F.lit(1.0))
    return {"n": count, "dia": num(d).cast("int"), "length": F.coalesce(metres, F.lit(1.0))}


def components(text: Column) -> Column:
    """FN-7: `CODE×1.6H: spec; ...` as an array of code, factor, times and spec."""
    part = F.filter(F.split(F.coalesce(text, F.lit("")), r"\s*;\s*"), lambda x: x != "")
    pattern = r"^\s*([A-Z0-9_]+)\s*(?:[×x*]\s*([0-9.]+)\s*(H|PER|WID|AREA)?)?\s*(?::\s*(.*))?$"
    g = lambda x, i: F.regexp_extract(x, pattern, i)
    return F.transform(part, lambda x: F.struct(g(x, 1).alias("code"), F.coalesce(F.when(g(x, 2) != "", g(x, 2).try_cast("double")), F.lit(1.0)).alias("factor"), g(x, 3).alias("times"), g(x, 4).alias("spec")))


#: What a word of a floor title stands for, and its rank. Words with an ending count too ("BODRUMU").
FLOOR_WORDS = [
    ("TEMEL", "foundation", -100.0),
    ("BODRUM", "basement", -1.0),
    ("CATI", "roof", 99.0),
    ("TERAS", "roof", 99.0),
    ("ASMA", "mezzanine", 0.5),
    ("ZEMIN", "ground", 0.0),
    ("GIRIS", "ground", 0.0),
    ("NORMAL", "typical", 1.0),
    ("TIP", "typical", 1.0),
    ("BIRINCI", "ordinal", 1.0),
    ("IKINCI", "ordinal", 2.0),
    ("UCUNCU", "ordinal", 3.0),
    ("DORDUNCU", "ordinal", 4.0),
    ("BESINCI", "ordinal", 5.0),
    ("ALTINCI", "ordinal", 6.0),
    ("YEDINCI", "ordinal", 7.0),
    ("SEKIZINCI", "ordinal", 8.0),
    ("DOKUZUNCU", "ordinal", 9.0),
    ("ONUNCU", "ordinal", 10.0),
]
#: Rank of the floor below the roof; what tells more stands first.
ATTIC_RANK = 98.0
FLOOR_CLASSES = ["foundation", "span", "code", "numbered basement", "basement", "attic", "roof", "mezzanine", "ground", "ordinal", "number", "typical"]


def floor_rank(title: Column) -> Column:
    """AGG-28: rank of a floor by its title; null if no word or number of it names a floor.

    The title is cut into words, numbers and joining signs. Each word proposes a class and a rank: by FLOOR_WORDS, by the
    numbers joined before it, or by the number behind it (a sheet code); the proposal of the first class wins. Numbers
    joined before a floor word are several floors and count as the lowest place named first. A sheet code counts where no
    numbered floor is named.
    """
    tokens = F.regexp_extract_all(F.upper(plain(F.coalesce(title, F.lit("")))), F.lit(r"([A-Z]+|[0-9]+|[-/,_])"), F.lit(1))
    number = lambda x: F.when(x.rlike("^[0-9]+$"), x.try_cast("double"))
    say = lambda kind, rank: F.struct(F.lit(FLOOR_CLASSES.index(kind)).alias("order"), rank.cast("double").alias("rank"))
    nothing = F.lit(None).cast("struct<order:int,rank:double>")

    def joined(i: Column) -> Column:
        """first and n of the numbers that lead up to token i: `1 - 2` or `2 VE 3`."""
        start = F.struct(F.lit(None).cast("double").alias("first"), F.lit(0).alias("n"), F.lit(True).alias("number"), F.lit(True).alias("open"))

        def step(s: Column, x: Column) -> Column:
            fits = s["open"] & F.when(s["number"], number(x).isNotNull()).otherwise(x.isin("-", "/", ",", "VE"))
            takes = fits & s["number"]
            return F.struct(F.when(takes, number(x)).otherwise(s["first"]).alias("first"), (s["n"] + takes.cast("int")).alias("n"), (s["number"] != fits).alias("number"), fits.alias("open"))

        return F.aggregate(F.reverse(F.slice(tokens, 1, i)), start, step)

    def proposals(x: Column, i: Column) -> Column:
        before, after, next_but_one = joined(i), F.get(tokens, i + 1), F.get(tokens, i + 2)
        ahead = F.when(after.isin("-", "_"), next_but_one).otherwise(after)
        below_roof = after.startswith("KAT") | after.startswith("ARASI")
        out = [F.when(x == "TEM", say("foundation", F.lit(FLOOR_WORDS[0][2])))]
        for word, kind, rank in FLOOR_WORDS:
            told = say(kind, F.lit(rank))
            if kind == "basement":
                told = F.when(before["n"] > 0, say("numbered basement", -before["first"])).otherwise(told)
            elif kind == "roof":
                told = F.when(below_roof, say("attic", F.lit(ATTIC_RANK))).otherwise(told)
            out.append(F.when((x == word) if kind == "ordinal" else x.startswith(word), told))
        floor = x.startswith("KAT") | x.startswith("NORMAL")
        out.append(F.when(floor & (before["n"] > 0), F.when(before["n"] > 1, say("span", before["first"])).otherwise(say("number", before["first"]))))
        out.append(F.when(x.rlike("^[A-Z]{2,4}$") & ahead.rlike("^[0-9]{1,2}$"), say("code", number(ahead))))
        return F.array(*[F.coalesce(p, nothing) for p in out])

    said = F.filter(F.flatten(F.transform(tokens, proposals)), lambda p: p.isNotNull())
    of = lambda *kinds: [FLOOR_CLASSES.index(k) for k in kinds]
    numbered = F.exists(said, lambda p: p["order"].isin(of("span", "number")))
    return F.array_min(F.filter(said, lambda p: ~(numbered & p["order"].isin(of("code")))))["rank"]


def first_rule(rows: DataFrame, rules: DataFrame, value: str, result: str, scope: str | None = None) -> DataFrame:
    """LKP-1, LKP-4, LKP-7: the first rule (by rule_no) whose pattern a value matches; null without one.

    rules: rule_no, pattern, result, and scope where one is named; a fixed dimension, so it is broadcast. Patterns are
    tried on the distinct values only.
    """
    keys = [value] + ([scope] if scope else [])
    distinct = rows.select(*keys).distinct()
    on = F.expr(f"{value} RLIKE pattern")
    r = rules.withColumnRenamed(scope, "_scope") if scope else rules
    on = on & (F.col(scope) == F.col("_scope")) if scope else on
    hit = distinct.join(F.broadcast(r), on).groupBy(*keys).agg(F.min_by(F.col(result), "rule_no").alias(result))
    return rows.join(hit, keys, "left")


#: An item number; its last part has four digits or more.
POZ = r"\d{2}\.\d{3}\.\d{4,}"


def price_list(lines: DataFrame) -> DataFrame:
    """SRC-4: item number, name, unit and price of each readable line; of repeated numbers the last line wins.

    lines: line_no, line. Lines without a number or a price are skipped; repeats tells how often a number came.
    """
    poz = F.regexp_extract("line", rf"\b({POZ})\b", 1)
    parts = F.filter(F.transform(F.split("line", r"\s*[;|\t]\s*"), lambda x: F.trim(x)), lambda x: x != "")
    numbers = F.filter(parts, lambda x: ~x.rlike(f"^{POZ}$") & (parse_number(x) > 0))
    unit = F.filter(parts, lambda x: x.rlike(r"^(?i)(m|m2|m3|m²|m³|kg|ton|adet|saat|l)$"))
    name = F.filter(parts, lambda x: ~x.rlike(f"^{POZ}$") & parse_number(x).isNull() & ~x.rlike(r"^(?i)(m|m2|m3|m²|m³|kg|ton|adet|saat|l)$"))
    read = lines.select("line_no", poz.alias("poz"), F.array_join(name, " ").alias("name"), F.lower(F.coalesce(F.get(unit, 0), F.lit(""))).alias("unit"), parse_number(F.try_element_at(numbers, F.lit(-1))).alias("price"))
    good = read.where((F.col("poz") != "") & F.col("price").isNotNull())
    w = Window.partitionBy("poz").orderBy(F.desc("line_no"))
    return good.withColumns({"nth": F.row_number().over(w), "repeats": F.count(F.lit(1)).over(Window.partitionBy("poz"))}).where("nth = 1").drop("nth")
