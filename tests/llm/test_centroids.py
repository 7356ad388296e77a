"""Bit-plane distances and Lloyd's rounds against plain integers."""

import hashlib
import random

import numpy as np
import pytest

from kerf.llm import centroids

SCHEMA = "vec_id long, embedding array<float>, cluster int, distance long, planes string"


@pytest.mark.parametrize("width", [2, 5, 10, 28])
def test_planes_and_products(width):
    r = np.random.default_rng(width)
    a, b = (r.integers(-(1 << width - 1), 1 << width - 1, (n, 64)) for n in (70, 9))
    a[0], a[1] = -(1 << width - 1), (1 << width - 1) - 1
    x, y = centroids.planes_of(a, width), centroids.planes_of(b, width)
    assert (centroids.components_of(x) == a).all()
    assert (centroids.products(x, y) == a @ b.T).all() and (centroids.squares(x) == (a * a).sum(axis=1)).all()
    best, d = centroids.nearest(x, y)
    want = ((a[:, None, :] - b[None]) ** 2).sum(axis=2)
    assert (best == want.argmin(axis=1)).all() and (d == want.min(axis=1)).all()


def plain(vectors, k, rounds, seed):
    """Rows vec_id, cluster, distance, cluster_inertia, inertia, digest by the definition, in Python integers."""
    kept = [(i, [int(np.floor(256 * float(x))) for x in v]) for i, v in vectors if v is not None and len(v) == 64 and all(x is not None and np.isfinite(x) for x in v)]
    start = sorted(kept, key=lambda r: (hashlib.sha256(f"{seed}:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    c = [x for _, x in start[:k]]
    away = lambda x, y: sum((p - q) ** 2 for p, q in zip(x, y))
    for turn in range(rounds + 1):
        where = [min((away(x, y), n) for n, y in enumerate(c)) for _, x in kept]
        if turn < rounds:
            for n in range(len(c)):
                mine = [x for (_, x), (_, m) in zip(kept, where) if m == n]
                c[n] = [sum(col) // len(mine) for col in zip(*mine)] if mine else c[n]
    total = {n: sum(d for d, m in where if m == n) for n in range(len(c))}
    return sorted(((i, n, d, total[n], sum(total.values()), hashlib.sha256(",".join(map(str, c[n])).encode()).hexdigest()) for (i, _), (d, n) in zip(kept, where)), key=repr)


def test_against_plain_rounds(spark):
    r = random.Random(6)
    vectors = [(i, [float(np.float32(r.gauss(i % 5, 0.4))) for _ in range(64)]) for i in range(160)]
    same = vectors[3][1]
    vectors += [(200 + i, same) for i in range(90)] + [vectors[7], vectors[7], (None, same), (None, vectors[9][1])]
    vectors += [(300, None), (301, []), (302, same[:63]), (303, same + [1.0]), (304, [None, *same[1:]]), (305, [float("nan"), *same[1:]]), (306, [float("-inf"), *same[1:]])]
    df = spark.createDataFrame([(i, v, 1, 2, "z") for i, v in vectors], SCHEMA).repartition(3)
    got = centroids.cluster_vectors(df, k=12, rounds=3)
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert sorted(map(tuple, got.collect()), key=repr) == plain(vectors, 12, 3, 2)
    # Fewer vectors than centroids.
    few = df.where("vec_id < 5")
    assert sorted(map(tuple, centroids.cluster_vectors(few).collect()), key=repr) == plain(vectors[:5], 40, 5, 2)


def test_empty_and_large(spark):
    assert centroids.cluster_vectors(spark.createDataFrame([], SCHEMA)).count() == 0
    assert centroids.cluster_vectors(spark.createDataFrame([(1, None, 1, 1, "")], SCHEMA)).count() == 0
    edge = [[float(1 << 19)] + [0.0] * 63, [-float(1 << 19)] + [0.0] * 63, [0.0] * 64]
    got = centroids.cluster_vectors(spark.createDataFrame(list(enumerate(edge)), "vec_id long, embedding array<double>"), k=1, rounds=1)
    assert sorted(map(tuple, got.collect())) == plain(list(enumerate(edge)), 1, 1, 2)
    with pytest.raises(ValueError):
        centroids.cluster_vectors(spark.createDataFrame([(1, [1e9] * 64)], "vec_id long, embedding array<double>"))
