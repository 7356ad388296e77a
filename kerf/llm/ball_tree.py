"""Ranked lexical search: exact inner products by sparse ball trees.

A document is the sparse vector of the impacts of its terms, (10**9 * tf) DIV (1000 * tf + 8 * m), an item the vector of
the weights of its terms, and a score is their inner product.

1. Statistics. All texts are read once; of each, the number of its terms and the counts of those terms that some item
   has are written to the shared folder. Numbers of documents and terms and document frequencies are sums over that table.
2. Trees. A task cuts its rows into blocks of BLOCK documents and builds a tree for each: a node is split by the nearer
   one of two documents that lie far apart, down to LEAF documents. A node has the centroid of its documents, and radii:
   terms are dealt to subspaces (each of the commonest terms alone, the others with those of the item that has them
   first), and in each the radius is the greatest distance of a document from the centroid. By Cauchy and Schwarz no
   document of the node scores more than q . c + sum over the subspaces of |q| * radius. Radii and bounds are
   rounded up by more than sums of doubles can lose.
3. Search. For each item nodes wait in a queue, greatest bound first; a node below the item's TOP-th score so far prunes
   its whole subtree, and a queue whose first is below it ends the search. Leaves are scored in 64-bit integers. A task keeps
   TOP documents of each item over all its blocks, and those of all tasks are ranked by a window.

Items beyond MOST_POSTINGS terms in all are searched in chunks of that size, so what is sent to every task is bounded.

Cases: null texts, and texts without terms, count for nothing. Rows of one item id (or of none) are one item with all
their terms; an item without terms, or whose terms no document has, has no rows. Each row of documents counts, repeated ids
too. Equal scores go by ascending doc_id, null ids last. Texts of any length are read whole. Empty tables give an empty
result. Other columns are not read and are not returned.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kerf.llm.common import byte_view, discard, id_and_text, materialize

TOP, LEAF, BLOCK = 10, 32, 4096
#: Items' terms that one search holds, and the number of terms with a subspace of their own.
MOST_POSTINGS, COMMON, SUBSPACES = 1_000_000, 64, 256
#: Relative allowance for what sums of doubles lose.
SLACK = 1e-9
#: Everything but letters and digits of ASCII, and bytes of other characters, separates terms; A-Z become a-z.
_TERMS = bytes(b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))


def terms_of(text: bytes) -> list[bytes]:
    return text.translate(_TERMS).split(b" ") if text else []


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


@dataclass
class Items:
    """Items to search for: their ids, and the numbers of their terms (positions in `number`)."""

    ids: list
    terms: list[np.ndarray]
    number: dict[bytes, int]


def items_of(rows: list) -> Items:
    """Items of rows (id, text); rows of one id are one item."""
    own: dict = {}
    for r in rows:
        own.setdefault(r[0], set()).update(t for t in terms_of((r[1] or "").encode()) if t)
    number: dict[bytes, int] = {}
    ids = sorted(own, key=lambda i: (i is None, i))
    terms = [np.array([number.setdefault(t, len(number)) for t in sorted(own[i])], np.int64) for i in ids]
    return Items(ids, terms, number)


def _count(batches: Iterator[pa.RecordBatch], number: dict[bytes, int]) -> Iterator[pa.RecordBatch]:
    """Rows doc_id, text: doc_id, n, terms and counts of documents with at least one term."""
    for batch in batches:
        data, off = byte_view(batch.column(1))
        keep, n, terms, counts = [], [], [], []
        for i in range(batch.num_rows):
            words = [w for w in terms_of(data[off[i] : off[i + 1]].tobytes()) if w]
            if words:
                found = Counter([number[w] for w in words if w in number])
                keep.append(i)
                n.append(len(words))
                terms.append(sorted(found))
                counts.append([found[t] for t in terms[-1]])
        kinds = [pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int64())]
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keep, pa.int64())), *[pa.array(c, k) for c, k in zip((n, terms, counts), kinds)]], names=["doc_id", "n", "terms", "counts"])


def _frequencies(batches: Iterator[pa.RecordBatch], n_terms: int) -> Iterator[pa.RecordBatch]:
    df = np.zeros(n_terms, np.int64)
    for batch in batches:
        df += np.bincount(batch.column(0).flatten().to_numpy(), minlength=n_terms)
    has = np.flatnonzero(df)
    yield pa.RecordBatch.from_arrays([pa.array(has), pa.array(df[has])], names=["term", "df"])


class Block:
    """A ball tree over sparse rows (indptr, terms, impacts)."""

    def __init__(self, indptr: np.ndarray, terms: np.ndarray, impacts: np.ndarray, space: np.ndarray, n_spaces: int, leaf: int = LEAF):
        self.indptr, self.terms, self.impacts = indptr, terms, impacts
        self.space, self.n_spaces, self.leaf = space, n_spaces, leaf
        self.scratch = np.zeros(len(space))
        self.rows: list[np.ndarray] = []
        self.children: list[tuple[int, int] | None] = []
        self.centroids: list[tuple[np.ndarray, np.ndarray]] = []
        self.radii: list[np.ndarray] = []
        stack = [(self._node(np.arange(len(indptr) - 1)))]
        while stack:
            at = stack.pop()
            parts = self._split(self.rows[at])
            if parts:
                self.children[at] = (self._node(parts[0]), self._node(parts[1]))
                stack += self.children[at]
        self.radius = np.array(self.radii)

    def part(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row number (within rows), term and impact of each entry of the rows."""
        size = self.indptr[rows + 1] - self.indptr[rows]
        owner = np.repeat(np.arange(len(rows)), size)
        at = np.arange(len(owner)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(self.indptr[rows], size)
        return owner, self.terms[at], self.impacts[at]

    def _node(self, rows: np.ndarray) -> int:
        owner, term, impact = self.part(rows)
        value = impact.astype(np.float64)
        used, code = np.unique(term, return_inverse=True)
        mean = np.bincount(code, value, len(used)) / len(rows)
        # |d - c|**2 in each subspace is |c|**2 + sum over d's terms of d * (d - 2 * c).
        space, n = self.space[used], self.n_spaces
        cell = owner * n + space[code]
        whole = np.bincount(space, mean * mean, n)
        square = np.bincount(cell, value * (value - 2 * mean[code]), len(rows) * n).reshape(-1, n) + whole
        lost = (np.bincount(cell, value * value, len(rows) * n).reshape(-1, n) + whole) * SLACK
        self.rows.append(rows)
        self.children.append(None)
        self.centroids.append((used, mean))
        self.radii.append(np.sqrt(np.maximum(square + lost, 0).max(axis=0)) * (1 + SLACK))
        return len(self.rows) - 1

    def _split(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
        """Two parts of the rows, each nearer to one of two rows that lie far apart; None for a leaf."""
        if len(rows) <= self.leaf:
            return None
        owner, term, impact = self.part(rows)
        value = impact.astype(np.float64)
        norm = np.bincount(owner, value * value, len(rows))

        def distance(to: int) -> np.ndarray:
            mine = owner == to
            self.scratch[term[mine]] = value[mine]
            out = norm + norm[to] - 2 * np.bincount(owner, value * self.scratch[term], len(rows))
            self.scratch[term[mine]] = 0
            return out

        a = int(distance(0).argmax())
        from_a = distance(a)
        b = int(from_a.argmax())
        side = from_a <= distance(b)
        if side.all() or not side.any():
            # Equal rows: halves are as good as any other parts.
            side = np.arange(len(rows)) < len(rows) // 2
        return rows[side], rows[~side]

    def bounds(self, q: np.ndarray, w: np.ndarray) -> np.ndarray:
        """For each node, a number that no document below it exceeds."""
        self.scratch[q] = w
        dot = np.array([mean @ self.scratch[used] for used, mean in self.centroids])
        self.scratch[q] = 0
        norms = np.sqrt(np.bincount(self.space[q], w * w, self.n_spaces))
        return (dot + self.radius @ norms) * (1 + SLACK) + 1

    def search(self, q: np.ndarray, w: np.ndarray, best: list, ids: list, top: int) -> int:
        """Put the documents with the greatest scores into best (a heap of top entries); the number of leaves scored."""
        bound, exact = self.bounds(q, w.astype(np.float64)), np.zeros(len(self.space), np.int64)
        exact[q] = w
        queue, scored = [(-bound[0], 0)], 0
        while queue:
            most, node = heapq.heappop(queue)
            if len(best) == top and -most < best[0].score:
                break
            if self.children[node]:
                for child in self.children[node]:
                    heapq.heappush(queue, (max(most, -bound[child]), child))
                continue
            scored += 1
            rows = self.rows[node]
            owner, term, impact = self.part(rows)
            score = np.zeros(len(rows), np.int64)
            np.add.at(score, owner, impact * exact[term])
            for i in np.flatnonzero(score > 0):
                hit = Hit(int(score[i]), ids[rows[i]])
                if len(best) < top:
                    heapq.heappush(best, hit)
                elif best[0] < hit:
                    heapq.heapreplace(best, hit)
        return scored


class Hit:
    """A scored document; of equal scores the one with the lesser id is the greater hit, and no id comes last."""

    __slots__ = ("doc", "score")

    def __init__(self, score: int, doc):
        self.score, self.doc = score, doc

    def __lt__(self, other: Hit) -> bool:
        if self.score != other.score:
            return self.score < other.score
        if self.doc is None or other.doc is None:
            return self.doc is None and other.doc is not None
        return self.doc > other.doc


def impacts_of(counts: np.ndarray, n: np.ndarray, n_docs: int, n_words: int) -> np.ndarray:
    """Impact of each term count in a document of n terms."""
    m = 10 + 90 * n * n_docs // n_words
    return 10**9 * counts // (1000 * counts + 8 * m)


def subspaces(items: Items, df: np.ndarray) -> tuple[np.ndarray, int]:
    """The subspace of each term, and their number."""
    out, first = np.zeros(len(df), np.int64), {}
    for i, terms in enumerate(items.terms):
        for t in terms.tolist():
            first.setdefault(t, i)
    rest = max(1, min(SUBSPACES - COMMON, len(items.terms)))
    for t, i in first.items():
        out[t] = COMMON + i * rest // len(items.terms)
    for k, t in enumerate(np.argsort(-df, kind="stable")[:COMMON]):
        out[t] = k
    return out, COMMON + rest


def _search(batches: Iterator[pa.RecordBatch], items: Items, df: np.ndarray, n_docs: int, n_words: int, top: int, block: int, leaf: int) -> Iterator[pa.RecordBatch]:
    """Rows doc_id, n, terms, counts of a task: item (its place), doc_id, score of the best, and leaves and leaves scored."""
    space, n_spaces = subspaces(items, df)
    w = np.array([weight(n_docs, d) for d in df.tolist()], np.int64)
    asked = [(k, t, w[t]) for k, t in enumerate(items.terms) if len(t)]
    best: list[list[Hit]] = [[] for _ in items.terms]
    held: list[pa.RecordBatch] = []
    id_type = None

    def take(rows: pa.Table) -> None:
        ids, size = rows["doc_id"].to_pylist(), rows["terms"].combine_chunks()
        lists = size.value_lengths().to_numpy()
        terms, counts = size.flatten().to_numpy().astype(np.int64), rows["counts"].combine_chunks().flatten().to_numpy()
        impacts = impacts_of(counts, np.repeat(rows["n"].to_numpy(), lists), n_docs, n_words)
        tree = Block(np.append(0, np.cumsum(lists)), terms, impacts, space, n_spaces, leaf)
        for k, q, weights in asked:
            tree.search(q, weights, best[k], ids, top)

    for batch in batches:
        id_type = batch.schema.field(0).type
        for i in range(0, batch.num_rows, block):
            held.append(batch.slice(i, block))
            if sum(b.num_rows for b in held) >= block:
                take(pa.Table.from_batches(held))
                held = []
    if held and sum(b.num_rows for b in held):
        take(pa.Table.from_batches(held))
    found = [(k, h.doc, h.score) for k, hits in enumerate(best) for h in hits]
    if found:
        place, docs, score = zip(*found)
        yield pa.RecordBatch.from_arrays([pa.array(place, pa.int32()), pa.array(docs, id_type), pa.array(score, pa.int64())], names=["item", "doc_id", "score"])


def search(docs: DataFrame, benchmark: DataFrame, top: int = TOP, block: int = BLOCK, leaf: int = LEAF, most_postings: int = MOST_POSTINGS) -> DataFrame:
    """item_id, rank, doc_id and score of the `top` best documents of each item. Cases as in the module's text."""
    spark = docs.sparkSession
    own = id_and_text(docs)
    queries = benchmark.select("item_id", F.col("text").cast("string").alias("text"))
    id_type = own.schema["doc_id"].dataType.simpleString()
    # A term has a byte and a separator at least, so an item has no more terms than half its bytes.
    postings = queries.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    chunks = postings // (2 * most_postings) + 1
    out = None
    for chunk in range(chunks):
        items = items_of(queries.where(F.pmod(F.xxhash64("item_id"), F.lit(chunks)) == chunk).collect())
        number = items.number
        counted = materialize(own.mapInArrow(lambda it, number=number: _count(it, number), f"doc_id {id_type}, n long, terms array<int>, counts array<long>"))
        n_docs, n_words = counted.agg(F.count(F.lit(1)), F.sum("n")).first()
        found = spark.createDataFrame([], f"item int, doc_id {id_type}, score long")
        if n_docs and number:
            df = np.zeros(len(number), np.int64)
            for r in counted.select("terms").mapInArrow(lambda it, n=len(number): _frequencies(it, n), "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).collect():
                df[r["term"]] = r["df"]
            hits = counted.where("size(terms) > 0").mapInArrow(
                lambda it, items=items, df=df, n_docs=n_docs, n_words=n_words: _search(it, items, df, n_docs, n_words, top, block, leaf), f"item int, doc_id {id_type}, score long"
            )
            first = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
            found = hits.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= top)
        else:
            found = found.withColumn("rank", F.lit(1))
        names = spark.createDataFrame(list(enumerate(items.ids)), f"item int, item_id {queries.schema['item_id'].dataType.simpleString()}")
        found = materialize(found.join(F.broadcast(names), "item").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score"), [counted])
        out = found if out is None else out.unionByName(found)
    return out


ORACLE = r"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
d AS (SELECT r, doc_id, terms, len(terms) AS n FROM t WHERE len(terms) > 0),
s AS (SELECT count(*) AS big_n, CAST(sum(n) AS BIGINT) AS big_l FROM d),
q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
tf AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(terms) AS term FROM d) GROUP BY r, term),
w AS (SELECT term, CAST(floor(1000 * ln((2 * big_n + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM tf, s GROUP BY term, big_n),
m AS (SELECT r, doc_id, 10 + (90 * n * big_n) // big_l AS m FROM d, s),
score AS (SELECT item_id, r, any_value(doc_id) AS doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score
  FROM q JOIN tf USING (term) JOIN w USING (term) JOIN m USING (r) GROUP BY item_id, r),
k AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id ASC NULLS LAST) AS INT) AS rank, doc_id, score FROM score WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM k WHERE rank <= 10
"""
