"""Shared helpers: work folders, Arrow byte views and vectorised hashing."""

from __future__ import annotations

import ctypes
import gc
import os
import tempfile
import uuid
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64
#: Bytes of text that one vectorised step works on.
STEP_BYTES = 1 << 18
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32
#: White space of every contract in this package, as a regular expression class.
WORD_GAP = r"[\x20\x09-\x0D]"


def work_dir(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir, which all executors share; a local one only where that is
    unset and all runs on one machine."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that all executors share")
        root = os.environ.get("KERF_LOCAL_WORK") or tempfile.mkdtemp(prefix="kerf-")
        os.environ["KERF_LOCAL_WORK"] = root
    return f"{root.rstrip('/')}/kerf-{uuid.uuid4().hex}"


#: Spark then drops a query's shuffle files when the query ends, in place of some time after a collection.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: What materialize sets while it writes. Smaller Arrow batches keep the memory of Python workers small.
WRITING = {CLEANUP: "true", "spark.sql.execution.arrow.maxBytesPerBatch": "8m"}


def materialize(df: DataFrame, spent: Iterable[DataFrame] = ()) -> DataFrame:
    """Cut lineage: write df as a table in the shared folder and read it back.

    The shuffle files of the write go when it ends. Tables of earlier calls named in spent are deleted after it; no plan
    that is still to run may refer to them.
    """
    spark = df.sparkSession
    path, before = work_dir(spark), {k: spark.conf.get(k) for k in WRITING}
    for k, v in WRITING.items():
        spark.conf.set(k, v)
    try:
        df.write.parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    for old in spent:
        discard(old)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def discard(df: DataFrame) -> None:
    """Delete the table that materialize wrote for df."""
    spark, path = df.sparkSession, df.written_to
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(where, True)


def tidy(spark: SparkSession) -> None:
    """Give memory of the driver back that a fit or a round of a loop no longer needs: what its Python freed, which the C
    library keeps otherwise, and what is garbage on its heap, which grows to its limit before the JVM shrinks it."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)
    spark.sparkContext._jvm.System.gc()


#: Bits of the bitmaps by which tasks skip rows that nobody asks for: a fixed bound, whatever the number of ids.
BITMAP_BITS = 1 << 26


class IdFilter:
    """A bitmap of hashed ids. It passes every id it was made from and few others; it only saves work."""

    def __init__(self, ids: DataFrame, column: str):
        at = ids.select(self.place(F.col(column)).alias("h"))
        maps = at.groupBy(F.expr("bitmap_bucket_number(h + 1)").alias("k")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(h + 1))").alias("m")).toArrow().to_pylist()
        bits = np.zeros(BITMAP_BITS // 8, np.uint8)
        for r in maps:
            bits[(r["k"] - 1) * 4096 : r["k"] * 4096] = np.frombuffer(r["m"], np.uint8)
        self.shared = ids.sparkSession.sparkContext.broadcast(bits)

    @staticmethod
    def place(column: Column) -> Column:
        return F.pmod(F.xxhash64(column), F.lit(BITMAP_BITS))

    def mask(self, places: pa.Array) -> pa.Array:
        """Which rows may be asked for, from their places; for use inside a task."""
        h = places.to_numpy()
        return pa.array((self.shared.value[h >> 3] >> (h & 7).astype(np.uint8) & 1).astype(bool))

    def keep(self, docs: DataFrame, column: str = "doc_id") -> DataFrame:
        """Rows of docs that may be asked for."""
        schema, n = docs.schema, len(docs.columns)

        def run(batches):
            for batch in batches:
                yield batch.filter(self.mask(batch.column(n))).select(range(n))

        return docs.withColumn("_place", self.place(F.col(column))).mapInArrow(run, schema)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def crc_mod(col: Column, mod: int) -> Column:
    """crc32 of the id's text, modulo mod; null ids count as the empty text."""
    return F.crc32(F.coalesce(col.cast("string"), F.lit("")).cast("binary")) % mod


def id_and_text(df: DataFrame) -> DataFrame:
    """Only the two columns that the operators read, so that other columns can have any name."""
    return df.select(F.col("doc_id"), F.col("text").cast("string").alias("text"))


def byte_view(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column, end to end, and the n+1 offsets. Null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    _, offsets, data = column.buffers()
    if len(column) == 0 or offsets is None:
        return np.empty(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    off = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.empty(0, np.uint8)
    return raw, off - off[0]


def steps(off: np.ndarray, most: int = STEP_BYTES):
    """Ranges of rows with about most bytes; a longer row stands alone."""
    n, i = len(off) - 1, 0
    while i < n:
        j = int(np.searchsorted(off, off[i] + most, side="right")) - 1
        j = min(n, max(j, i + 1))
        yield i, j
        i = j


def mix(x: np.ndarray) -> np.ndarray:
    """Finish a 64-bit hash so that all its bits depend on all of the input."""
    x = x ^ (x >> U64(32))
    x = x * U64(0xD6E8FEB86659FD93)
    x = x ^ (x >> U64(29))
    x = x * U64(0x9FB21C651E98DF25)
    return x ^ (x >> U64(32))


class Rolling:
    """Hashes of any span of a byte array, modulo 2**64, from prefix sums of byte * BASE**position."""

    BASE = 0x9E3779B97F4A7C15
    _pow = np.ones(1, dtype=np.uint64)
    _inv = np.ones(1, dtype=np.uint64)

    @classmethod
    def _grow(cls, n: int) -> None:
        if len(cls._pow) < n:
            size = 1 << int(n - 1).bit_length()
            for name, base in (("_pow", cls.BASE), ("_inv", pow(cls.BASE, -1, 1 << 64))):
                t = np.full(size, base, dtype=np.uint64)
                t[0] = 1
                setattr(cls, name, np.multiply.accumulate(t))

    def __init__(self, data: np.ndarray):
        self._grow(len(data) + 1)
        self.ph = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum((data.astype(np.uint64) + U64(1)) * self._pow[: len(data)], out=self.ph[1:])

    def span(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.ph[end] - self.ph[start]) * self._inv[start] + (end - start).astype(np.uint64))


def words(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of all rows, and the index of each row's first word (n+1 numbers)."""
    if len(data) == 0:
        empty = np.empty(0, np.int64)
        return empty, empty, np.zeros(len(off), np.int64)
    inside = ~SPACE[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    cut = off[1:-1]
    cut = cut[cut < len(data)]
    first[cut] = inside[cut]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    cut = cut[cut > 0]
    last[cut - 1] = inside[cut - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, off)
