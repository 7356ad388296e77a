"""Quality rules with adaptive thresholds, in DataFrame functions only.

Each text is measured once. For every language and source, mergeable quantile sketches of the measures (Spark's
percentile_approx: partial sketches in the map tasks, merged after the shuffle) give upper fences in place of fixed
cutoffs, and the measures are joined with the fences of their group. A fence is third quartile + SPREAD * (distance from
first to third quartile + one unit). The unit is what a single symbol, line or letter adds to the rate of a text of the
group's median size, so it comes from sketches too: where most texts have none at all, a few are no failure yet. Groups
of less than LEAST texts that pass the base rule have the fences of their language, and small languages those of all.

Cases: a null text has no words and fails the base rule. Null languages and sources form groups of their own. A text
whose windows fall among three others of the same 34 hash bits might lose a repeat; no other bound cuts a count short. Texts of
any length are measured whole. Equal measures share a verdict. Repeated rows are judged row by row. Empty tables give
empty results. Other columns of the input are not read and are not returned.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kerf.llm.common import WORD_GAP, materialize

#: Rates per 10,000, and the size that a unit of each is one part of: symbols by word, repeated lines by line, letters by
#: word.
MEASURES = {"symbol_rate": "n_words", "dup_line_rate": "n_lines", "word_length_rate": "n_words"}
SPREAD = 4
LEAST = 50
ACCURACY = 10000
SYMBOLS = "#*$%&|<>"
MIN_WORDS, MOST_REPEATED = 50, 50


def _repeat_words(words: Column) -> Column:
    """Words in windows of three words that stand in the text at least twice.

    34 hash bits of each window and its place are one number; sorted, equal windows are neighbours, and neighbours count
    only if their words are really equal. The places in order then tell how many words their windows cover.
    """
    place = (1 << 30) - 1
    code = lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)).bitwiseAND(~place).bitwiseOR(i.cast("long"))
    codes = F.transform(F.sequence(F.lit(0), F.size(words) - 3), code)

    def covered(c: Column) -> Column:
        at = lambda k: F.get(c, k).bitwiseAND(place).cast("int")
        near = lambda x, k: (F.get(c, k).bitwiseXOR(x) <= place) & (F.get(c, k).bitwiseXOR(x) >= 0)
        equal = lambda p, q: (F.get(words, p) == F.get(words, q)) & (F.get(words, p + 1) == F.get(words, q + 1)) & (F.get(words, p + 2) == F.get(words, q + 2))

        def twin(x: Column, i: Column, step: int, left: int = 3) -> Column:
            k = i + (4 - left) * step
            found = equal(at(i), at(k)) if left == 1 else equal(at(i), at(k)) | twin(x, i, step, left - 1)
            return F.coalesce(near(x, k) & found, F.lit(False))

        hit = F.filter(c, lambda x, i: twin(x, i, 1) | twin(x, i, -1))
        places = F.sort_array(F.transform(hit, lambda x: x.bitwiseAND(place).cast("int")))
        state = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-3).alias("last"))
        step = lambda s, p: F.struct((s["n"] + F.least(F.lit(3), p - s["last"])).alias("n"), p.alias("last"))
        return F.aggregate(places, state, step, lambda s: s["n"])

    # A lambda's argument is evaluated once; the expression itself would be evaluated anew for each element.
    once = lambda x, f: F.get(F.transform(F.array(x), f), 0)
    return F.when(F.size(words) >= 4, once(F.sort_array(codes), covered)).otherwise(F.lit(0).cast("long"))


def measure(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source and the measures of each row."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    base = docs.select("doc_id", F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"), text.alias("text"))
    base = base.withColumn("words", F.filter(F.split("text", WORD_GAP + "+"), lambda w: w != ""))
    base = base.withColumn("lines", F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    bare = F.col("text")
    for c in SYMBOLS:
        bare = F.replace(bare, F.lit(c))
    n_lines = F.size("lines").cast("long")
    out = base.select(
        "doc_id",
        "lang",
        "source",
        F.size("words").cast("long").alias("n_words"),
        F.char_length(F.array_join("words", "")).cast("long").alias("word_chars"),
        (F.octet_length("text") - F.octet_length(bare)).cast("long").alias("n_symbols"),
        (n_lines - F.size(F.array_distinct("lines"))).alias("n_dup_lines"),
        n_lines.alias("n_lines"),
        _repeat_words(F.col("words")).alias("n_repeat_words"),
    )
    rate = lambda a, b: F.when(F.col(b) > 0, F.expr(f"{a} * 10000 DIV {b}")).otherwise(F.lit(0).cast("long"))
    return out.withColumns({"symbol_rate": rate("n_symbols", "n_words"), "dup_line_rate": rate("n_dup_lines", "n_lines"), "word_length_rate": rate("word_chars", "n_words")}).withColumn(
        "base_failed", (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MOST_REPEATED)
    )


def _quartiles() -> list[Column]:
    sizes = dict.fromkeys(MEASURES.values())
    own = [F.percentile_approx(m, F.array(F.lit(0.25), F.lit(0.75)), ACCURACY).alias(m) for m in MEASURES]
    return [F.count(F.lit(1)).alias("n"), *own, *[F.percentile_approx(c, F.lit(0.5), ACCURACY).alias(c) for c in sizes]]


def fences(measured: DataFrame) -> DataFrame:
    """f_lang, f_source and the upper fence of each measure, from the texts that pass the base rule."""
    good = measured.where(~F.col("base_failed"))

    def fence(m: str, c: str) -> Column:
        unit = F.floor(F.lit(10000) / F.greatest(F.col(c), F.lit(1)))
        return (F.get(m, 1) + SPREAD * (F.get(m, 1) - F.get(m, 0) + unit)).cast("long")

    made = [fence(m, c).alias(m) for m, c in MEASURES.items()]
    every = good.agg(*_quartiles()).select(*made).first()
    by_lang = good.groupBy(F.col("lang").alias("p_lang")).agg(*_quartiles()).select("p_lang", F.when(F.col("n") >= LEAST, F.struct(*made)).alias("parent"))
    own = good.groupBy(F.col("lang").alias("f_lang"), F.col("source").alias("f_source")).agg(*_quartiles()).select("f_lang", "f_source", F.when(F.col("n") >= LEAST, F.struct(*made)).alias("own"))
    both = own.join(by_lang, F.col("f_lang").eqNullSafe(F.col("p_lang")), "left")
    chosen = lambda m: F.coalesce(F.col("own")[m], F.col("parent")[m], F.lit(every[m]).cast("long"))
    return both.select("f_lang", "f_source", *[chosen(m).alias(f"{m}_fence") for m in MEASURES])


def apply_rules(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed and kept of each row of docs
    (doc_id, text, lang, source). Cases as in the module's text."""
    measured = materialize(measure(docs))
    limit = fences(measured)
    joined = measured.join(limit, measured["lang"].eqNullSafe(limit["f_lang"]) & measured["source"].eqNullSafe(limit["f_source"]), "left")
    within = F.lit(True)
    for m in MEASURES:
        # Without fences there is no text of the group that passes the base rule.
        within = within & F.coalesce(F.col(m) <= F.col(f"{m}_fence"), F.lit(False))
    return joined.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & within).alias("kept"))


_Q = ", ".join(f"quantile_disc({m}, [0.25, 0.75]) AS {m}_q, quantile_disc({c}, 0.5) AS {m}_c" for m, c in MEASURES.items())
_FENCE = {m: f"({m}_q[2] + {SPREAD} * ({m}_q[2] - {m}_q[1] + 10000 // greatest({m}_c, 1)))" for m in MEASURES}
ORACLE = f"""
WITH t AS (
  SELECT doc_id, lang, source, coalesce(text, '') AS text FROM documents
), w AS (
  SELECT *, list_filter(regexp_split_to_array(text, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS words,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines
  FROM t
), win AS (
  SELECT doc_id, i, words[i] AS a, words[i + 1] AS b, words[i + 2] AS c
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 1)) AS i FROM w)
), rep AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, a, b, c) AS n FROM win) WHERE n > 1
), cov AS (
  SELECT doc_id, count(DISTINCT j) AS n_repeat_words FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS j FROM rep) GROUP BY doc_id
), m AS (
  SELECT w.doc_id, lang, source, len(words)::BIGINT AS n_words,
    length(array_to_string(words, ''))::BIGINT AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
    (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, len(lines)::BIGINT AS n_lines,
    coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words
  FROM w LEFT JOIN cov USING (doc_id)
), r AS (
  SELECT *, CASE WHEN n_words > 0 THEN n_symbols * 10000 // n_words ELSE 0 END AS symbol_rate,
    CASE WHEN n_lines > 0 THEN n_dup_lines * 10000 // n_lines ELSE 0 END AS dup_line_rate,
    CASE WHEN n_words > 0 THEN word_chars * 10000 // n_words ELSE 0 END AS word_length_rate,
    n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED} * n_words AS base_failed
  FROM m
), good AS (
  SELECT * FROM r WHERE NOT base_failed
), q0 AS (
  SELECT count(*) AS n, {_Q} FROM good
), q1 AS (
  SELECT lang, count(*) AS n, {_Q} FROM good GROUP BY lang
), q2 AS (
  SELECT lang, source, count(*) AS n, {_Q} FROM good GROUP BY lang, source
), f AS (
  SELECT q2.lang, q2.source, {", ".join(f"CASE WHEN q2.n >= {LEAST} THEN {_FENCE[m].replace(m, 'q2.' + m)} WHEN q1.n >= {LEAST} THEN {_FENCE[m].replace(m, 'q1.' + m)} ELSE (SELECT {_FENCE[m]} FROM q0) END AS {m}_fence" for m in MEASURES)}
  FROM q2 LEFT JOIN q1 ON q1.lang IS NOT DISTINCT FROM q2.lang
)
SELECT r.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND {" AND ".join(f"{m} <= {m}_fence" for m in MEASURES)} AS kept
FROM r LEFT JOIN f ON r.lang IS NOT DISTINCT FROM f.lang AND r.source IS NOT DISTINCT FROM f.source
"""
