"""Centroid clustering (Lloyd's rounds) of integer vectors by bit planes.

1. Planes. Component x becomes the integer floor(SCALE * x). In two's complement of B bits, plane k of a vector holds bit
   k of its 64 components in one 64-bit word, so a vector is B words. B is the least width for the greatest component of
   all vectors, and B * 8 bytes a vector are all that the rounds read.
2. Products. x . c is the sum over planes j and k of weight[j] * weight[k] * popcount(X[j] & C[k]), where a weight is
   2**k and that of the sign plane is negative. So distance = x . x - 2 * x . c + c . c is exact in 64 bits.
3. Rounds. Each task assigns its vectors and sums their components by cluster; one row a cluster and batch is
   shuffled, and the driver holds k centroids. A cluster or vector that most rows share is a sum like any other.

Cases: vectors that are null, have another number of components than 64 or one that is null, NaN or infinite are left out.
Components beyond 2**27 in size after scaling raise an error, as distances would not fit into 64 bits. Equal distances go
to the cluster of the lesser number, so equal vectors always share one. Fewer vectors than k give as many centroids.
Repeated rows count each; a null id counts as the empty text in the order of the first centroids, and equal ids go by their components.
Empty tables give an empty result. Other columns of the input are not read and are not returned.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kerf.llm.common import materialize

DIMS, SCALE = 64, 256
K, ROUNDS, SEED = 40, 5, 2
#: Greatest size of a component: 64 * (2 * 2**27) ** 2 is less than 2 ** 63.
LARGEST = 1 << 27
STEP_ROWS = 4096


def scaled(vectors: DataFrame, id_column: str = "vec_id", column: str = "embedding", scale: int = SCALE, dims: int = DIMS) -> DataFrame:
    """vec_id and x (array<long>, floor(scale * component)) of the vectors that are whole."""
    v = F.transform(F.col(column), lambda c: c.cast("double"))
    good = (F.size(v) == dims) & F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return vectors.where(good).select(F.col(id_column).alias("vec_id"), F.transform(v, lambda c: F.floor(c * scale)).alias("x"))


def planes_of(x: np.ndarray, width: int) -> np.ndarray:
    """Rows of 64 integers as rows of `width` words, the sign plane last."""
    bits = (x[:, None, :] >> np.arange(width)[None, :, None] & 1).astype(np.uint8)
    return np.packbits(bits, axis=2, bitorder="little").view("<u8")[:, :, 0]


def components_of(planes: np.ndarray) -> np.ndarray:
    """The integers whose planes these are."""
    bits = np.unpackbits(np.ascontiguousarray(planes).view(np.uint8).reshape(*planes.shape, 8), axis=2, bitorder="little")
    return np.einsum("nkd,k->nd", bits.astype(np.int64), weights(planes.shape[1]))


def weights(width: int) -> np.ndarray:
    w = np.int64(1) << np.arange(width, dtype=np.int64)
    w[-1] = -w[-1]
    return w


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Dot products of each row of planes a with each of b."""
    out = np.zeros((len(a), len(b)), np.int64)
    for j, wj in enumerate(weights(a.shape[1])):
        for k, wk in enumerate(weights(b.shape[1])):
            out += np.bitwise_count(a[:, j, None] & b[None, :, k]).astype(np.int64) * (wj * wk)
    return out


def squares(a: np.ndarray) -> np.ndarray:
    """Dot product of each row of planes with itself."""
    out, w = np.zeros(len(a), np.int64), weights(a.shape[1])
    for j in range(len(w)):
        for k in range(j, len(w)):
            out += np.bitwise_count(a[:, j] & a[:, k]).astype(np.int64) * (w[j] * w[k] * (1 if j == k else 2))
    return out


def nearest(planes: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of the nearest centroid (the lesser one of equals) and the squared distance to it."""
    d = squares(planes)[:, None] - 2 * products(planes, centroids) + squares(centroids)[None, :]
    best = d.argmin(axis=1)
    return best, d[np.arange(len(d)), best]


def _read(batch: pa.RecordBatch, column: int, width: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for i in range(0, batch.num_rows, STEP_ROWS):
        part = batch.slice(i, STEP_ROWS)
        yield part, np.frombuffer(b"".join(part.column(column).to_pylist()), "<u8").reshape(-1, width)


class Clustering:
    """Vectors in planes, and the centroids found for them."""

    def __init__(self, vectors: DataFrame, k: int = K, rounds: int = ROUNDS, seed: int = SEED, id_column: str = "vec_id", column: str = "embedding"):
        own = scaled(vectors, id_column, column)
        self.id_type = own.schema["vec_id"].dataType.simpleString()
        low, high = own.agg(F.min(F.array_min("x")), F.max(F.array_max("x"))).first()
        if low is not None and max(-low, high) > LARGEST:
            raise ValueError(f"a component exceeds {LARGEST} after scaling, so distances may not fit into 64 bits")
        self.width = width = 1 + max(1, max(-(low or 0) - 1, high or 0).bit_length())

        def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x = batch.column(1).flatten().to_numpy().reshape(-1, DIMS)
                rows = planes_of(x, width)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r.tobytes() for r in rows], pa.binary())], names=["vec_id", "planes"])

        self.planes = materialize(own.mapInArrow(packed, f"vec_id {self.id_type}, planes binary"))
        name = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
        start = own.orderBy(name, "x").limit(k).select("x").collect()
        self.centroids = np.array([r["x"] for r in start], np.int64).reshape(-1, DIMS)
        for _ in range(rounds if start else 0):
            self.centroids = self._next()

    def _next(self) -> np.ndarray:
        """Centroids of one more round."""
        width, planes = self.width, planes_of(self.centroids, self.width)

        def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            count, total = np.zeros(len(planes), np.int64), np.zeros((len(planes), DIMS), np.int64)
            for batch in batches:
                for _, x in _read(batch, 0, width):
                    best, _ = nearest(x, planes)
                    order = np.argsort(best, kind="stable")
                    cluster, first = np.unique(best[order], return_index=True)
                    total[cluster] += np.add.reduceat(components_of(x)[order], first, axis=0)
                    count += np.bincount(best, minlength=len(planes))
            has = np.flatnonzero(count)
            yield pa.RecordBatch.from_arrays([pa.array(has.astype(np.int32)), pa.array(count[has]), pa.array(list(total[has]), pa.list_(pa.int64()))], names=["cluster", "n", "total"])

        each = self.planes.select("planes").mapInArrow(sums, "cluster int, n long, total array<long>")
        out = self.centroids.copy()
        for r in each.groupBy("cluster").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.get("total", d)) for d in range(DIMS)]).alias("total")).collect():
            out[r["cluster"]] = [t // r["n"] for t in r["total"]]
        return out

    def assigned(self) -> DataFrame:
        """vec_id, cluster and distance of each vector."""
        width, planes = self.width, planes_of(self.centroids, self.width)

        def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part, x in _read(batch, 1, width):
                    best, d = nearest(x, planes)
                    yield pa.RecordBatch.from_arrays([part.column(0), pa.array(best.astype(np.int32)), pa.array(d)], names=["vec_id", "cluster", "distance"])

        return self.planes.mapInArrow(assign, f"vec_id {self.id_type}, cluster int, distance long")


def cluster_vectors(vectors: DataFrame, k: int = K, rounds: int = ROUNDS, seed: int = SEED, id_column: str = "vec_id", column: str = "embedding") -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia and centroid_sha256 of each whole vector."""
    found = Clustering(vectors, k, rounds, seed, id_column, column)
    rows = materialize(found.assigned())
    spark = vectors.sparkSession
    totals = {r["cluster"]: int(r["d"]) for r in rows.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d")).collect()}
    named = [(c, d, sum(totals.values()), hashlib.sha256(",".join(map(str, found.centroids[c].tolist())).encode()).hexdigest()) for c, d in totals.items()]
    about = spark.createDataFrame(named, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return rows.join(F.broadcast(about), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _oracle() -> str:
    div = lambda a, b: f"CAST(({a} - (({a} % {b}) + {b}) % {b}) // {b} AS BIGINT)"
    parts = [
        f"""
WITH good AS (SELECT row_number() OVER () AS r, vec_id, embedding AS e FROM embeddings
  WHERE len(embedding) = {DIMS} AND len(list_filter(embedding, lambda c: c IS NOT NULL AND isfinite(c))) = {DIMS}),
q AS MATERIALIZED (SELECT r, vec_id, unnest(range({DIMS})) AS i, unnest(list_transform(e, lambda c: CAST(floor({SCALE} * CAST(c AS DOUBLE)) AS BIGINT))) AS x FROM good),
start AS (SELECT r, row_number() OVER (ORDER BY sha256('{SEED}:' || coalesce(CAST(vec_id AS VARCHAR), '')), e) - 1 AS cluster FROM good),
c0 AS MATERIALIZED (SELECT cluster, i, x AS c FROM start JOIN q USING (r) WHERE cluster < {K})"""
    ]
    for n in range(ROUNDS + 1):
        parts.append(f"d{n} AS (SELECT r, any_value(vec_id) AS vec_id, cluster, CAST(sum((x - c) * (x - c)) AS BIGINT) AS d FROM q JOIN c{n} USING (i) GROUP BY r, cluster)")
        parts.append(f"a{n} AS MATERIALIZED (SELECT r, any_value(vec_id) AS vec_id, min(d * {K} + cluster) % {K} AS cluster, min(d * {K} + cluster) // {K} AS distance FROM d{n} GROUP BY r)")
        if n < ROUNDS:
            parts.append(f"m{n} AS (SELECT cluster, i, {div('sum(x)', 'count(*)')} AS c FROM a{n} JOIN q USING (r) GROUP BY cluster, i)")
            parts.append(f"c{n + 1} AS MATERIALIZED (SELECT cluster, i, coalesce(m.c, o.c) AS c FROM c{n} o LEFT JOIN m{n} m USING (cluster, i))")
    last = f"a{ROUNDS}"
    return (
        ",\n".join(parts)
        + f""",
h AS (SELECT cluster, sha256(string_agg(CAST(c AS VARCHAR), ',' ORDER BY i)) AS centroid_sha256 FROM c{ROUNDS} GROUP BY cluster)
SELECT vec_id, CAST(cluster AS INT) AS cluster, CAST(distance AS BIGINT) AS distance, CAST(sum(distance) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia,
  CAST(sum(distance) OVER () AS BIGINT) AS inertia, centroid_sha256
FROM {last} JOIN h USING (cluster)
"""
    )


ORACLE = _oracle()
