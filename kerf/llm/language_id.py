"""Language ID: prediction by partial matching over bytes.

For each language a context tree holds how often each byte followed each of its contexts of up to three bytes. The
statistics are frozen after fitting. Escape probabilities (method C: distinct followers against all) blend the orders,
so that every text has an exact code length under every language; the shortest one wins.

Bytes are those of the text with A-Z in lower case, all 256 of them; zeros stand before a text. Every learned language
has a tree: texts are scored by BLOCK languages at a time, and only the least code length and the sum of shares go on to
the next block, so a task's memory does not grow with the number of languages.

Cases: a null text, and one without a letter, gives `und` and score 0. Texts of any length are read whole. Equal code
lengths go to the language that sorts first. Repeated rows are predicted row by row. Without training rows all texts
give `und`. Other columns of the input are not read and are not returned.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kerf.llm.common import LOWER, STEP_BYTES, byte_view, crc_mod, steps

HELD_MOD, HELD = 4, 2
#: About so many texts of each language are learned from, chosen by a hash of the id: the bound of the fitting sample.
TEXTS_PER_LANGUAGE = 3000
#: Languages whose trees are looked up side by side.
BLOCK = 8
ORDER = 3
_TABLES: dict = {}


def _codes(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Of each byte the number of the three bytes before it (zeros before the text's start) and itself."""
    s = LOWER[data].astype(np.int64)
    n, begin = len(s), off[:-1]
    code = s.copy()
    for back in range(1, ORDER + 1):
        before = np.zeros(n, np.int64)
        before[back:] = s[: max(0, n - back)]
        for k in range(back):
            at = begin + k
            before[at[at < n]] = 0
        code |= before << (8 * back)
    return code


def _pieces(data: np.ndarray, off: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Rows i to j, the offsets of their bytes and their codes. A longer row comes in parts that know the bytes before."""
    for i, j in steps(off, STEP_BYTES):
        for a in range(off[i], max(off[i] + 1, off[j]), STEP_BYTES if j == i + 1 else max(1, off[j] - off[i])):
            b = min(a + STEP_BYTES, off[j]) if j == i + 1 else off[j]
            lead = min(ORDER, a - off[i])
            part = off[i : j + 1] - off[i] if j > i + 1 else np.array([0, b - a])
            yield i, j, part, _codes(data[a - lead : b], part if not lead else np.array([0, b - a + lead]))[lead:]


def _count_followers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for batch in batches:
        data, off = byte_view(batch.column(1))
        lang = batch.column(0).to_numpy(zero_copy_only=False)
        for i, j, part, codes in _pieces(data, off):
            owner = np.repeat(lang[i:j], np.diff(part))
            for k in np.unique(owner):
                code, n = np.unique(codes[owner == k], return_counts=True)
                if k in total:
                    code, at = np.unique(np.concatenate([total[k][0], code]), return_inverse=True)
                    n = np.bincount(at, np.concatenate([total[k][1], n])).astype(np.int64)
                total[k] = code, n
    for k, (code, n) in total.items():
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(code), k, np.int32)), pa.array(code), pa.array(n.astype(np.int64))], names=["lang_no", "code", "n"])


def _found(table: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of x in a sorted table, and which of them are there."""
    at = np.minimum(np.searchsorted(table, x), max(0, len(table) - 1))
    return at, (table[at] == x) if len(table) else np.zeros(len(x), bool)


class Trees:
    """Code lengths in bits of the followers of every context, of some languages side by side."""

    def __init__(self, parts: list[tuple[np.ndarray, np.ndarray]]):
        self.langs = len(parts)
        self.orders: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
        for order in range(ORDER + 1):
            own = []
            for code, n in parts:
                kept, at = np.unique(code & ((1 << 8 * (order + 1)) - 1), return_inverse=True)
                own.append((kept, np.bincount(at, n, len(kept))))
            known = np.unique(np.concatenate([c for c, _ in own]))
            contexts = np.unique(known >> 8)
            escape = np.zeros((len(contexts), self.langs), np.float32)
            # What a language has not seen here is an escape and the code length of the shorter context.
            lower = self.bits(known & ((1 << 8 * order) - 1)) if order else np.full((len(known), self.langs), 8, np.float32)
            cost = np.empty((len(known), self.langs), np.float32)
            for k, (code, n) in enumerate(own):
                at = np.searchsorted(contexts, code >> 8)
                total, kinds = np.bincount(at, n, len(contexts)), np.bincount(at, minlength=len(contexts))
                seen = total > 0
                escape[seen, k] = -np.log2(kinds[seen] / (total + kinds)[seen])
                cost[:, k] = escape[np.searchsorted(contexts, known >> 8), k] + lower[:, k]
                cost[np.searchsorted(known, code), k] = -np.log2(n / (total + kinds)[at])
            self.orders.append((known, cost, contexts, escape))

    def bits(self, code: np.ndarray, order: int | None = None) -> np.ndarray:
        """Code lengths of codes of one order (that of the longest tables so far)."""
        order = len(self.orders) - 1 if order is None else order
        if order < 0:
            return np.full((len(code), self.langs), 8, np.float32)
        known, cost, contexts, escape = self.orders[order]
        at, has = _found(known, code)
        out = cost[at] if len(known) else np.empty((len(code), self.langs), np.float32)
        new = np.flatnonzero(~has)
        if len(new):
            out[new] = self.bits(code[new] & ((1 << 8 * order) - 1), order - 1)
            c, there = _found(contexts, code[new] >> 8)
            out[new[there]] += escape[c[there]]
        return out


def _score_block(batches: Iterator[pa.RecordBatch], shared: Broadcast, key: str, first: int) -> Iterator[pa.RecordBatch]:
    """Rows doc_id, text, letter, no, least, share: with the languages of one block, numbered from first, taken in."""
    if key not in _TABLES:
        _TABLES.clear()
        _TABLES[key] = Trees(shared.value)
    trees = _TABLES[key]
    for batch in batches:
        data, off = byte_view(batch.column(1))
        no, least, share = (batch.column(k).to_numpy(zero_copy_only=False).copy() for k in (3, 4, 5))
        bits = np.zeros((len(no), trees.langs))
        for i, _, part, codes in _pieces(data, off):
            full = np.flatnonzero(np.diff(part))
            if len(full):
                code, at = np.unique(codes, return_inverse=True)
                bits[i + full] += np.add.reduceat(trees.bits(code)[at], part[:-1][full], axis=0, dtype=np.float64)
        full = np.flatnonzero(np.diff(off))
        bits = bits[full]
        best = bits.min(axis=1)
        mine, low = np.exp2(-(bits - best[:, None]) / 8).sum(axis=1), np.minimum(best, least[full])
        share[full] = share[full] * np.exp2(-(least[full] - low) / 8) + mine * np.exp2(-(best - low) / 8)
        no[full] = np.where(best < least[full], first + bits.argmin(axis=1), no[full])
        least[full] = low
        yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(3)), pa.array(no), pa.array(least), pa.array(share)], names=["doc_id", "text", "letter", "no", "least", "share"])


def predict_language(docs: DataFrame, per_language: int = TEXTS_PER_LANGUAGE, block: int = BLOCK) -> DataFrame:
    """doc_id, held_out, lang_pred, score (share of the winner in 2**-bits, per 8 bytes) of each row of docs."""
    spark = docs.sparkSession
    own = docs.select(F.col("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    train = own.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (crc_mod(F.col("doc_id"), HELD_MOD) != HELD))
    size = {r["lang"]: r["n"] for r in train.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    langs = sorted(size)
    letter = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("letter")
    scored = own.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), letter, F.lit(-1).alias("no"), F.lit(float("inf")).alias("least"), F.lit(0.0).alias("share"))
    kind = f"doc_id {own.schema['doc_id'].dataType.simpleString()}, text string, letter boolean, no int, least double, share double"
    for first in range(0, len(langs), block):
        some = langs[first : first + block]
        pick = F.lit(-1)
        for i, x in enumerate(some):
            bound = int(min(1.0, per_language / size[x]) * 2**31)
            pick = F.when((F.col("lang") == x) & (F.pmod(F.xxhash64(F.lit("ppm"), "doc_id"), F.lit(2**31)) < bound), F.lit(i)).otherwise(pick)
        sample = train.select(pick.alias("lang_no"), "text").where(F.col("lang_no") >= 0)
        got = sample.mapInArrow(_count_followers, "lang_no int, code long, n long").groupBy("lang_no", "code").agg(F.sum("n").alias("n")).toArrow()
        no, code, n = (got.column(c).to_numpy() for c in ("lang_no", "code", "n"))
        parts = [(code[no == k], n[no == k].astype(np.float64)) for k in range(len(some))]
        shared = spark.sparkContext.broadcast(parts)
        scored = scored.mapInArrow(partial(_score_block, shared=shared, key=uuid.uuid4().hex, first=first), kind)
    name = F.get(F.array(*[F.lit(x) for x in langs]), F.col("no")) if langs else F.lit(None).cast("string")
    told = F.col("letter") & (F.col("no") >= 0)
    return scored.select(
        "doc_id",
        (crc_mod(F.col("doc_id"), HELD_MOD) == HELD).alias("held_out"),
        F.coalesce(F.when(told, name), F.lit("und")).alias("lang_pred"),
        F.when(told, 1 / F.col("share")).otherwise(F.lit(0.0)).alias("score"),
    )
