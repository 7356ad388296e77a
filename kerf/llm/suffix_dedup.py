"""Removal of repeated passages: suffixes sampled by a difference cover, told apart by hashes of their first bytes, one
bucket at a time. No suffix is compared with another byte by byte, so it is no full suffix sort.

A byte goes if a string of LENGTH bytes over it also starts earlier (in a smaller doc_id, or earlier in the same text).

1. Of each text only the suffixes at places of a difference cover modulo PERIOD are sampled. For any two places there is
   a shift below PERIOD that brings both onto the cover, so of two equal strings of LENGTH bytes some sampled suffixes
   at one shift agree in their first LENGTH - PERIOD + 1 bytes. Sampled suffixes are dealt to buckets by a hash of these
   bytes, and a bucket is sorted at a time: suffixes that tie are one rank of the cover, whose first place is known.
2. Every sampled suffix is set against the first place of its rank. Along one diagonal, sampled ties that touch make up
   a longer tie; where that reaches LENGTH bytes, its bytes are repeated. Near its ends the cover alone does not decide.
   There the strings of LENGTH bytes, those of the text and those of the first place, are hashed and sorted, again one
   bucket at a time; all but the first of equals are repeated.
3. Spans are united by text.

This is complete: let a string at i have an earlier equal at j. They share a shift with sampled ties, whose rank's first
place is f. If the tie of i with f is undecided, both i's string and f's are sorted; j's tie with f is either undecided
too, so j's string is sorted, or decided, so f's string is equal to j's and stands for it. Nothing is ever sorted beyond
one bucket, and texts are never joined pair by pair.

Copies of a whole text are told by its digest: all but the first go whole, and within a batch they are not sampled.

Cases: null and empty texts have no bytes. Texts below LENGTH bytes keep all. Texts of any length are read whole. Ids
are taken to be unique; rows that share an id share its spans, cut to their length. A null id counts as the least id.
Equal texts with equal ids are one document. Empty tables give empty results. Other columns of the input are not read
and are not returned.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from kerf.llm.common import U64, IdFilter, Rolling, byte_view, materialize, steps

LENGTH = 100
PERIOD = 31
#: A perfect difference set modulo 31: each shift is the difference of exactly one pair.
COVER = np.array([0, 1, 3, 8, 12, 18])
ANCHOR = LENGTH - PERIOD + 1
SAMPLES_PER_BUCKET = 1_000_000
SLICE_BYTES = 4 << 20
NO_ID = -(1 << 63)
ON_COVER = np.isin(np.arange(PERIOD), COVER)
EMPTY_SHA = hashlib.sha256(b"").hexdigest()

_PLACES = "bucket int, hi binary, lo binary, docs binary, runs binary, low binary, high binary"


def _runs(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First places and lengths of the runs of equal numbers."""
    first = np.flatnonzero(np.append(True, x[1:] != x[:-1])) if len(x) else np.empty(0, np.int64)
    return first, np.diff(np.append(first, len(x)))


def _packed(h: np.ndarray, doc: np.ndarray, at: np.ndarray, buckets: int) -> pa.RecordBatch | None:
    """Hashes and places by bucket of the hash; within a bucket in the given order, documents as runs."""
    # An odd number of buckets, so that equal low bits do not make equal buckets.
    bucket = ((h >> U64(32)) % U64(buckets)).astype(np.int16 if buckets < 1 << 15 else np.int32)
    order = np.argsort(bucket, kind="stable")
    h, doc, at, bucket = h[order], doc[order], at[order], bucket[order]
    rows = []
    for s, n in zip(*_runs(bucket)):
        part = slice(s, s + n)
        first, runs = _runs(doc[part])
        rows.append((int(bucket[s]), (h[part] & U64(0xFFFFFFFF)).astype(np.uint32).tobytes(), (h[part] >> U64(32) & U64(0xFFFF)).astype(np.uint16).tobytes(), doc[part][first].tobytes(), runs.astype(np.uint32).tobytes(), (at[part] & 0xFFFF).astype(np.uint16).tobytes(), (at[part] >> 16).astype(np.uint16).tobytes()))
    if not rows:
        return None
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), [pa.int32()] + [pa.binary()] * 6)], names=["bucket", "hi", "lo", "docs", "runs", "low", "high"])


def _unpacked(t: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    join = lambda c, k: np.frombuffer(b"".join(t.column(c).to_pylist()), k)
    h = join("hi", np.uint32).astype(np.uint64) | join("lo", np.uint16).astype(np.uint64) << U64(32)
    doc = np.repeat(join("docs", np.int64), join("runs", np.uint32))
    at = join("low", np.uint16).astype(np.int64) | join("high", np.uint16).astype(np.int64) << 16
    return h, doc, at


def _tied(t: pa.Table) -> tuple[np.ndarray, ...]:
    """One bucket sorted: of each place with a tie that is not the first of its rank, its document and place, and those
    of the first."""
    h, doc, at = _unpacked(t)
    order = np.argsort(h)
    s = h[order]
    same = np.append(s[1:] == s[:-1], False) if len(s) else np.empty(0, bool)
    tie = same | np.append(False, same[:-1]) if len(s) else same
    own = order[tie]
    own = own[np.lexsort((at[own], doc[own], h[own]))]
    first, n = _runs(h[own])
    lead = np.repeat(own[first], n)
    rest = np.ones(len(own), bool)
    rest[first] = False
    # A place may come twice where rows repeat; it is no tie with itself.
    rest &= (doc[own] != doc[lead]) | (at[own] != at[lead])
    return doc[own][rest], at[own][rest], doc[lead][rest], at[lead][rest]


def _by_document(columns: list[np.ndarray], buckets: int, names: list[str]) -> pa.Table:
    """Rows by a bucket of their document (the first column), packed."""
    bucket = ((columns[0].view(np.uint64) * U64(0x9E3779B97F4A7C15)) >> U64(40)) % U64(buckets)
    order = np.lexsort((columns[1], columns[0], bucket))
    columns, bucket = [c[order] for c in columns], bucket[order].astype(np.int32)
    rows = [(int(bucket[s]), *[np.ascontiguousarray(c[s : s + n]).tobytes() for c in columns]) for s, n in zip(*_runs(bucket))]
    kinds = [pa.int32()] + [pa.binary()] * len(columns)
    return pa.table([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [()] * len(kinds), kinds)], names=["bucket", *names])


def unite(doc: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Unions of the intervals [lo, hi) of each document; intervals that touch are one."""
    keep = hi > lo
    doc, lo, hi = doc[keep], lo[keep], hi[keep]
    order = np.lexsort((lo, doc))
    doc, lo, hi = doc[order], lo[order], hi[order]
    if not len(doc):
        return doc, lo, hi
    change = np.append(True, doc[1:] != doc[:-1])
    base = np.cumsum(change) * (1 << 33)  # beyond any place, so that one running maximum serves all documents
    top = np.maximum.accumulate(hi + base) - base
    new = change | np.append(True, lo[1:] > top[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(doc)) - 1
    return doc[first], lo[first], top[last]


def _segments(t: pa.Table) -> pa.Table:
    """Of the documents of one bucket: decided spans (kind 0) and places whose strings are to be sorted (kind 1)."""
    join = lambda c, k: np.frombuffer(b"".join(t.column(c).to_pylist()), k)
    doc, at, to, to_at = join("doc", np.int64), join("at", np.int64), join("to", np.int64), join("to_at", np.int64)
    diagonal = at - to_at
    order = np.lexsort((at, diagonal, to, doc))
    doc, at, to, diagonal = doc[order], at[order], to[order], diagonal[order]
    if len(doc):
        new = np.append(True, (doc[1:] != doc[:-1]) | (to[1:] != to[:-1]) | (diagonal[1:] != diagonal[:-1]) | (at[1:] - at[:-1] > ANCHOR))
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(doc)) - 1
    else:
        first = last = np.empty(0, np.int64)
    d, e, g, p, q = doc[first], to[first], diagonal[first], at[first], at[last]
    long = q + ANCHOR - p >= LENGTH
    spans = unite(d[long], p[long], q[long] + ANCHOR)
    # Starts of undecided strings: before the segment, and those that reach beyond it. The first place's text may begin
    # later than a string's counterpart would; the text's own strings are sorted all the same.
    a_lo, a_hi = np.maximum(p - (PERIOD - 1), 0), np.where(long, p, q + 1)
    b_lo, b_hi = q[long] + ANCHOR - LENGTH + 1, q[long] + 1
    lo, hi = np.concatenate([a_lo, b_lo]), np.concatenate([a_hi, b_hi])
    owner, other, shift = np.concatenate([d, d[long]]), np.concatenate([e, e[long]]), np.concatenate([g, g[long]])
    asks = unite(np.concatenate([owner, other]), np.concatenate([lo, np.maximum(lo - shift, 0)]), np.concatenate([hi, hi - shift]))
    out = [np.concatenate([s, a]) for s, a in zip(spans, asks)]
    kind = np.repeat(np.array([0, 1], np.int32), [len(spans[0]), len(asks[0])])
    return pa.table({"kind": kind, "doc": out[0], "lo": out[1], "hi": out[2]})


class SuffixDedup:
    def __init__(self, docs: DataFrame, samples_per_bucket: int = SAMPLES_PER_BUCKET):
        self.spark = docs.sparkSession
        if not isinstance(docs.schema["doc_id"].dataType, IntegralType):
            raise TypeError("doc_id has to be an integer")
        self.own = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
        self.facts = materialize(self.own.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2(F.col("text").cast("binary"), 256).alias("sha")))
        total = self.facts.agg(F.sum("n_bytes")).first()[0] or 0
        self.buckets = max(8, int(total * len(COVER) / PERIOD / samples_per_bucket) + 1) | 1

    def _samples(self) -> DataFrame:
        buckets = self.buckets

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids = batch.column(0).to_numpy()
                data, off = byte_view(batch.column(1))
                seen: dict[bytes, int] = {}
                skip = np.zeros(len(ids), bool)
                for i in np.argsort(ids, kind="stable"):  # of equal texts only the least id is sampled
                    if off[i + 1] - off[i] < LENGTH:
                        skip[i] = True
                        continue
                    digest = hashlib.blake2b(data[off[i] : off[i + 1]], digest_size=16).digest()
                    skip[i] = digest in seen
                    seen[digest] = i
                for i, j in steps(off, SLICE_BYTES):
                    n = np.diff(off[i : j + 1])
                    raw = data[off[i] : off[j]]
                    place = np.arange(len(raw)) - np.repeat(off[i:j] - off[i], n)
                    ok = ON_COVER[place % PERIOD]
                    at = np.flatnonzero(ok)
                    owner = np.repeat(np.arange(i, j), n)[at]
                    good = ~skip[owner] & (place[at] + ANCHOR <= (off[1:] - off[:-1])[owner])
                    at, owner = at[good], owner[good]
                    out = _packed(Rolling(raw).span(at, at + ANCHOR), ids[owner], place[at], buckets)
                    if out is not None:
                        yield out

        return self.own.mapInArrow(run, _PLACES)

    def decided(self) -> DataFrame:
        """kind 0: spans that the cover decides; kind 1: places whose strings are to be sorted."""
        buckets = self.buckets

        def ranks(t: pa.Table) -> pa.Table:
            return _by_document(list(_tied(t)), buckets, ["doc", "at", "to", "to_at"])

        links = self._samples().groupBy("bucket").applyInArrow(ranks, "bucket int, doc binary, at binary, to binary, to_at binary")
        return materialize(links.groupBy("bucket").applyInArrow(_segments, "kind int, doc long, lo long, hi long"))

    def spans(self) -> DataFrame:
        """doc_id, lo, hi: spans that go; those of one text may touch or overlap."""
        found = self.decided()
        more = self.sorted_spans(found.where("kind = 1"))
        return found.where("kind = 0").select("doc", "lo", "hi").unionByName(more).select(F.col("doc").alias("doc_id"), "lo", "hi")

    def sorted_spans(self, asks: DataFrame) -> DataFrame:
        """Spans of the asked strings that also start earlier."""
        buckets = self.buckets
        asked = asks.groupBy(F.col("doc").alias("doc_id")).agg(F.collect_set(F.struct("lo", "hi")).alias("asks"))
        texts = IdFilter(asks.select("doc").distinct(), "doc").keep(self.own).dropDuplicates(["doc_id"])

        def strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids = batch.column(0).to_numpy()
                data, off = byte_view(batch.column(1))
                asks = batch.column(2)
                o = asks.offsets.to_numpy()
                lo, hi = (asks.values.field(k).to_numpy()[o[0] : o[-1]] for k in (0, 1))
                row = np.repeat(np.arange(len(ids)), np.diff(o))
                row, lo, hi = unite(row, lo, np.minimum(hi, (off[1:] - off[:-1])[row] - LENGTH + 1))
                for i, j in steps(off, SLICE_BYTES):
                    mine = (row >= i) & (row < j)
                    n = hi[mine] - lo[mine]
                    if not n.sum():
                        continue
                    place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo[mine], n)
                    owner = np.repeat(row[mine], n)
                    at = off[owner] - off[i] + place
                    out = _packed(Rolling(data[off[i] : off[j]]).span(at, at + LENGTH), ids[owner], place, buckets)
                    if out is not None:
                        yield out

        def repeated(t: pa.Table) -> pa.Table:
            doc, at, _, _ = _tied(t)
            return _by_document([doc, at], buckets, ["doc", "at"])

        def spans_of(t: pa.Table) -> pa.Table:
            join = lambda c: np.frombuffer(b"".join(t.column(c).to_pylist()), np.int64)
            doc, lo, hi = unite(join("doc"), join("at"), join("at") + LENGTH)
            return pa.table({"doc": doc, "lo": lo, "hi": hi})

        sorted_strings = texts.join(asked, "doc_id").select("doc_id", "text", "asks").mapInArrow(strings, _PLACES).groupBy("bucket").applyInArrow(repeated, "bucket int, doc binary, at binary")
        return materialize(sorted_strings.groupBy("bucket").applyInArrow(spans_of, "doc long, lo long, hi long"))

    def result(self) -> DataFrame:
        """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of each row."""
        spans = self.spans()
        firsts = materialize(self.facts.where(F.col("n_bytes") >= LENGTH).groupBy("sha").agg(F.min("doc_id").alias("first")))
        told = materialize(self.facts.join(firsts, "sha", "left").withColumn("copy", F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False))))
        own = spans.join(told.where("copy").select("doc_id").distinct(), "doc_id", "left_anti")
        by_text = own.groupBy("doc_id").agg(F.collect_set(F.struct("lo", "hi")).alias("spans"))
        texts = IdFilter(own.select("doc_id").distinct(), "doc_id").keep(self.own)

        def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = []
                for text, spans in zip(batch.column(1), batch.column(2).to_pylist()):
                    raw = text.as_py().encode()
                    _, lo, hi = unite(np.zeros(len(spans), np.int64), np.array([s["lo"] for s in spans]), np.minimum([s["hi"] for s in spans], len(raw)))
                    kept = b"".join(raw[a:b] for a, b in zip(np.append(0, hi), np.append(lo, len(raw))))
                    rows.append((len(raw) - len(kept), len(lo), hashlib.sha256(kept).hexdigest(), hashlib.sha256(raw).hexdigest()))
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.string()]
                yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, k) for c, k in zip(zip(*rows) if rows else [()] * 4, kinds)]], names=["doc_id", "n_removed", "n_spans", "kept_sha256", "sha"])

        removed = texts.join(by_text, "doc_id").select("doc_id", "text", "spans").mapInArrow(cut, "doc_id long, n_removed long, n_spans long, kept_sha256 string, sha string").dropDuplicates(["doc_id", "sha"])
        whole = F.col("copy")
        return told.join(removed, ["doc_id", "sha"], "left").select(
            F.when(F.col("doc_id") != NO_ID, F.col("doc_id")).alias("doc_id"),
            "n_bytes",
            F.when(whole, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
            F.when(whole, F.lit(1)).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
            F.when(whole, F.lit(EMPTY_SHA)).otherwise(F.coalesce("kept_sha256", "sha")).alias("kept_sha256"),
        )


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of each row of docs. Cases as in the module's text."""
    return SuffixDedup(docs).result()
