"""Benchmark decontamination by spaced seeds, in DataFrame functions only.

Words are runs of characters other than white space, in lower case. Each window of SPAN words of a benchmark item and
of a document gives one hash per mask; a mask leaves out every third word, so substitutions that fall on one residue
of the place modulo 3 (any single one, for instance) leave one of the three hashes untouched. Equal hashes are hits.
Around a hit, item and document are compared word by word at the hit's offset over WINDOW words of the item (the whole
item if shorter), and the hit stands if at least SHARE percent are equal. Items of SHORTEST to SPAN - 1 words have no room for
a mask; they are found word for word, by a hash of all their words.

The seeds of the benchmark are broadcast while they are few and small (BROADCAST_SEEDS, BROADCAST_BYTES, both measured
first). Beyond that only ids, places and hashes are shuffled, and texts are fetched for the hits.

Cases: null and empty texts have no words. Items of fewer words than `shortest` give no hits: by default those of 1 to 4
words, which common phrases hold too.
Texts of any length are searched whole. Rows of documents with one id, or with none, count as one document, and each
row is compared by its own words; repeated items count once per id. Empty tables give an empty result. Other columns are not read and are not returned.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kerf.llm.common import WORD_GAP, materialize

SPAN, SHORTEST = 12, 5
#: Places in a window that each mask compares.
MASKS = [[p for p in range(SPAN) if p % 3 != skip] for skip in (2, 1, 0)]
WINDOW, SHARE = 20, 80
BROADCAST_SEEDS, BROADCAST_BYTES = 1_000_000, 1 << 28


def words_of(text: Column) -> Column:
    trimmed = F.btrim(F.lower(F.coalesce(text.cast("string"), F.lit(""))), F.lit(" \t\n\x0b\x0c\r"))
    return F.split(trimmed, WORD_GAP + "+")


def seeds(df: DataFrame, words: str, place: str) -> DataFrame:
    """One row per window and mask, with the columns of df, place and seed."""
    at = df.withColumn(place, F.explode(F.when(F.size(words) >= SPAN, F.sequence(F.lit(0), F.size(words) - SPAN))))
    hashes = [F.xxhash64(F.lit(m), *[F.get(F.col(words), F.col(place) + p) for p in mask]) for m, mask in enumerate(MASKS)]
    return at.withColumn("seed", F.explode(F.array(*hashes)))


def whole_seeds(df: DataFrame, words: str, place: str, n: int) -> DataFrame:
    """One row per window of n words, with the columns of df, place and the seed of all its words."""
    at = df.withColumn(place, F.explode(F.when(F.size(words) >= n, F.sequence(F.lit(0), F.size(words) - n))))
    return at.withColumn("seed", F.xxhash64(F.lit(-n), *[F.get(F.col(words), F.col(place) + i) for i in range(n)]))


def find_leaks(docs: DataFrame, benchmark: DataFrame, shortest: int = SHORTEST) -> DataFrame:
    """One row per document that holds benchmark text: doc_id, n_items, first_item (least item_id), equal_words (most
    in one window), compared_words (of that window). Items of less than `shortest` words are not looked for."""
    own = docs.select("doc_id", words_of(F.col("text")).alias("words")).withColumn("mark", F.xxhash64("words"))
    items = benchmark.select("item_id", words_of(F.col("text")).alias("item_words")).distinct()
    size = F.least(F.lit(WINDOW), F.size("item_words"))
    start = F.greatest(F.lit(0), F.least(F.col("q") - (WINDOW - SPAN) // 2, F.size("item_words") - size))
    wanted = seeds(items, "item_words", "q").select("item_id", "seed", (F.col("q") - start).alias("into"), F.slice("item_words", start + 1, size).alias("item_window")).distinct()
    found = seeds(own, "words", "p")
    short = items.where(F.size("item_words").between(max(1, shortest), SPAN - 1)).where("item_words[0] <> ''")
    for n in sorted(r[0] for r in short.select(F.size("item_words")).distinct().collect()):
        whole = whole_seeds(short.where(F.size("item_words") == n), "item_words", "q", n)
        wanted = wanted.unionByName(whole.select("item_id", "seed", F.lit(0).alias("into"), F.col("item_words").alias("item_window")))
        found = found.unionByName(whole_seeds(own, "words", "p", n))
    # The document's words beside the item's window; `lead` of them would lie before its beginning.
    low = F.col("p") - F.col("into")
    lead = F.greatest(F.lit(0), -low)
    window = [lead.alias("lead"), F.slice("words", F.greatest(low, F.lit(0)) + 1, F.size("item_window") - lead).alias("window")]
    n_seeds, n_bytes = wanted.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length(F.array_join("item_window", " "))), F.lit(0))).first()
    if n_seeds <= BROADCAST_SEEDS and n_bytes <= BROADCAST_BYTES:
        hits = found.join(F.broadcast(wanted), "seed").select("doc_id", "item_id", "item_window", *window)
    else:
        pairs = found.select(F.col("doc_id").alias("hit_id"), F.col("mark").alias("hit_mark"), "p", "seed").join(wanted, "seed").drop("seed").distinct()
        same = F.col("doc_id").eqNullSafe(F.col("hit_id")) & (F.col("mark") == F.col("hit_mark"))
        hits = pairs.join(own, same).select("doc_id", "item_id", "item_window", *window)
    # Written before the comparison: put into the join, it would make its generated code too long to compile well.
    hits = materialize(hits.distinct())
    beside = F.slice("item_window", F.col("lead") + 1, F.size("item_window") - F.col("lead"))
    equal = F.size(F.filter(F.zip_with(beside, "window", lambda a, b: a == b), lambda x: x)).cast("long")
    stands = hits.select("doc_id", "item_id", F.size("item_window").cast("long").alias("compared"), equal.alias("equal")).where(F.col("equal") * 100 >= F.col("compared") * SHARE)
    best = F.max(F.col("equal") * 1000 + F.col("compared"))
    return stands.groupBy("doc_id").agg(F.countDistinct("item_id").alias("n_items"), F.min("item_id").alias("first_item"), best.alias("best")).select(
        "doc_id", "n_items", "first_item", F.expr("best DIV 1000").alias("equal_words"), F.expr("best % 1000").alias("compared_words")
    )


def remove_leaks(docs: DataFrame, benchmark: DataFrame, shortest: int = SHORTEST) -> DataFrame:
    """Rows of docs without benchmark text, all columns kept. Rows are told by id and text together, so of rows that share
    an id, or have none, only those with benchmark text go."""
    mark = F.xxhash64(F.coalesce(docs["text"].cast("string"), F.lit("")))
    own = docs.select(F.struct(docs["doc_id"].alias("id"), mark.alias("mark")).alias("doc_id"), docs["text"].alias("text"))
    bad = find_leaks(own, benchmark, shortest).select(F.col("doc_id.id").alias("leak_id"), F.col("doc_id.mark").alias("leak_mark"))
    return docs.join(bad, docs["doc_id"].eqNullSafe(bad["leak_id"]) & (mark == bad["leak_mark"]), "left_anti")


def _oracle() -> str:
    words = "list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')"
    keys = " UNION ALL ".join("SELECT *, {m} AS mask, {k} AS seed FROM {{t}}".format(m=m, k=" || chr(0) || ".join(f"{{w}}[{{p}} + {p + 1}]" for p in mask)) for m, mask in enumerate(MASKS))
    of = lambda t, w, p: keys.format(t=t, w=w, p=p)
    short = " UNION ALL ".join(
        f"SELECT doc_id, words, p, {100 + n} AS mask, array_to_string(words[p + 1:p + {n}], chr(0)) AS seed FROM (SELECT doc_id, words, unnest(range(0, len(words) - {n - 1})) AS p FROM d WHERE {n} IN (SELECT len(item_words) FROM b))"
        for n in range(SHORTEST, SPAN)
    )
    return f"""
WITH d AS (SELECT doc_id, {words} AS words FROM documents),
b AS (SELECT DISTINCT item_id, {words} AS item_words FROM benchmark),
dp AS (SELECT doc_id, words, unnest(range(0, len(words) - {SPAN - 1})) AS p FROM d),
bq AS (SELECT item_id, item_words, unnest(range(0, len(item_words) - {SPAN - 1})) AS q FROM b),
ds AS ({of("dp", "words", "p")} UNION ALL {short}),
bs AS ({of("bq", "item_words", "q")}
  UNION ALL SELECT item_id, item_words, 0 AS q, 100 + len(item_words) AS mask, array_to_string(item_words, chr(0)) AS seed FROM b WHERE len(item_words) BETWEEN {SHORTEST} AND {SPAN - 1}),
hits AS (SELECT DISTINCT doc_id, item_id, words, item_words, p, q, least({WINDOW}, len(item_words)) AS n
  FROM ds JOIN bs USING (mask, seed)),
c AS (SELECT *, greatest(0, least(q - {(WINDOW - SPAN) // 2}, len(item_words) - n)) AS s FROM hits),
e AS (SELECT doc_id, item_id, n AS compared,
    len(list_filter(range(s, s + n), lambda i: p - q + i >= 0 AND coalesce(item_words[i + 1] = words[p - q + i + 1], false))) AS equal FROM c)
SELECT doc_id, count(DISTINCT item_id) AS n_items, min(item_id) AS first_item,
  max(equal * 1000 + compared) // 1000 AS equal_words, max(equal * 1000 + compared) % 1000 AS compared_words
FROM e WHERE equal * 100 >= compared * {SHARE} GROUP BY doc_id
"""


ORACLE = _oracle()
