"""A linear classifier over hashed n-gram indicators, scaled by naive Bayes log-count ratios.

Indicators of the n-grams of a text are multiplied by log((p + a) / |p|) - log((q + a) / |q|), p and q being the
numbers of texts of each class with that n-gram. On these features a linear model with hinge loss is fitted by dual
coordinate descent, one dual variable at a time, and a sigmoid maps its margin to a score.

Cases: null and empty texts have no features and score by the intercept alone. Texts of any length are read whole.
Ties and repeated rows are scored row by row. With labels of one class only, or none, the score is that class's
smoothed share.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kerf.llm.common import LOWER, SPACE, U64, Rolling, byte_view, crc_mod, id_and_text, mix, steps, tidy

BITS = 20
#: For each text, the hashed features (they may repeat).
Features = Callable[[np.ndarray, np.ndarray], Iterator[np.ndarray]]

KIND = np.full(256, 1, dtype=np.uint8)  # letters and bytes beyond ASCII
KIND[0:128] = 3  # symbols
for _c in range(128):
    if chr(_c).isalpha():
        KIND[_c] = 1
    elif chr(_c).isdigit():
        KIND[_c] = 2
KIND[SPACE] = 0


def char_ngrams(data: np.ndarray, off: np.ndarray) -> Iterator[np.ndarray]:
    """Byte n-grams of 3 to 5 of the text in lower case (A-Z), with a space before and after each text."""
    n = len(off) - 1
    padded = np.full(len(data) + 2 * n, 32, dtype=np.uint8)
    at = off + 2 * np.arange(n + 1)
    padded[np.arange(len(data)) + 1 + 2 * np.repeat(np.arange(n), np.diff(off))] = LOWER[data]
    x = padded.astype(np.uint64)
    if len(x) < 5:
        x = np.concatenate([x, np.full(5 - len(x), 32, np.uint64)])
    g3 = x[:-2] | x[1:-1] << U64(8) | x[2:] << U64(16)
    g4 = g3[:-1] | x[3:] << U64(24)
    g5 = g4[:-1] | x[4:] << U64(32)
    grams = [((g * U64(c)) >> U64(64 - BITS)).astype(np.int32) for g, c in ((g3, 0x9E3779B97F4A7C15), (g4, 0xC2B2AE3D27D4EB4F), (g5, 0x165667B19E3779F9))]
    for i in range(n):
        s, e = at[i], at[i + 1]
        yield np.concatenate([g[s : max(s, e - k)] for k, g in zip((2, 3, 4), grams)]) if e - s > 2 else grams[0][:0]


def token_ngrams(data: np.ndarray, off: np.ndarray) -> Iterator[np.ndarray]:
    """Tokens (runs of letters, digits or symbols) and pairs of neighbouring tokens."""
    if len(data) == 0:
        for _ in range(len(off) - 1):
            yield np.empty(0, np.int32)
        return
    kind = KIND[data]
    first = np.ones(len(data), dtype=bool)
    first[1:] = kind[1:] != kind[:-1]
    cut = off[:-1]
    first[cut[cut < len(data)]] = True
    starts = np.flatnonzero(first)
    ends = np.append(starts[1:], len(data))
    keep = kind[starts] != 0
    starts, ends = starts[keep], ends[keep]
    h = Rolling(data).span(starts, ends)
    uni = (h >> U64(64 - BITS)).astype(np.int32)
    bi = (mix(h[:-1] * U64(3) + h[1:]) >> U64(64 - BITS)).astype(np.int32)
    at = np.searchsorted(starts, off)
    for i in range(len(off) - 1):
        s, e = at[i], at[i + 1]
        yield np.concatenate([uni[s:e], bi[s : max(s, e - 1)]])


@dataclass
class Model:
    weight: np.ndarray  # by hashed feature: ratio * linear weight
    bias: float
    slope: float
    shift: float
    square: np.ndarray | None = None  # by hashed feature: ratio squared, where texts are scaled to unit length

    def margin(self, idx: np.ndarray) -> float:
        """Of one text, from its distinct features."""
        total = float(self.weight[idx].sum(dtype=np.float64))
        if self.square is not None:
            total /= max(float(self.square[idx].sum(dtype=np.float64)), 1.0) ** 0.5
        return total + self.bias

    def score(self, margin: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(self.slope * margin + self.shift, -500, 500)))


def dual_descent(rows: list[np.ndarray], values: np.ndarray, y: np.ndarray, cost: np.ndarray, epochs: int, seed: int, one: float = 1.0, unit: bool = False) -> tuple[np.ndarray, float]:
    """Minimise |w|^2 / 2 + sum cost * hinge over the dual variables, one row at a time.

    The intercept is the weight of a constant feature of value `one`; a larger one is held back less.
    """
    rng = np.random.default_rng(seed)
    w, b, a = np.zeros(1 << BITS), 0.0, np.zeros(len(rows))
    xs = [values[r] for r in rows] if not unit else [values[r] / max(float(values[r] @ values[r]), 1.0) ** 0.5 for r in rows]
    norm = np.array([x @ x + one * one for x in xs])
    for _ in range(epochs):
        worst = 0.0
        for i in rng.permutation(len(rows)):
            x, r = xs[i], rows[i]
            g = y[i] * (w[r] @ x + b) - 1.0
            new = min(max(a[i] - g / norm[i], 0.0), cost[i])
            if new != a[i]:
                d = (new - a[i]) * y[i]
                worst = max(worst, abs(new - a[i]) / cost[i])
                a[i] = new
                w[r] += d * x
                b += d * one * one
        if worst < 1e-3:
            break
    return w, b


def sigmoid_fit(margin: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a sigmoid by Newton steps on the weighted log loss, with smoothed targets."""
    pos, neg = weight[y == 1].sum(), weight[y == 0].sum()
    t = np.where(y == 1, (pos + 1) / (pos + 2), 1 / (neg + 2))
    s, c = 1.0, np.log((pos + 1) / (neg + 1))
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(s * margin + c, -40, 40)))
        d, h = weight * (p - t), weight * p * (1 - p) + 1e-9
        m = np.array([[(h * margin * margin).sum() + 1e-6, (h * margin).sum()], [(h * margin).sum(), h.sum() + 1e-6]])
        step = np.linalg.solve(m, np.array([(d * margin).sum() + 1e-6 * s, d.sum()]))
        step = np.clip(step, -2, 2)
        s, c = s - step[0], c - step[1]
        if abs(step).max() < 1e-6:
            break
    return max(float(s), 1e-3), float(c)


def fit(texts: list[bytes], y: np.ndarray, share: float, features: Features, *, alpha: float = 1.0, cost: float = 0.02, epochs: int = 25, min_texts: int = 3, one: float = 1.0, unit: bool = False, seed: int = 7) -> Model:
    """share: of class 1 among all labels, which calibration restores where the sample is balanced."""
    order = np.random.default_rng(seed).permutation(len(texts))
    rows: list[np.ndarray] = []
    for i in range(0, len(order), 64):
        part = [texts[k] for k in order[i : i + 64]]
        off = np.concatenate([[0], np.cumsum([len(t) for t in part])]).astype(np.int64)
        rows += [np.unique(r) for r in features(np.frombuffer(b"".join(part), np.uint8), off)]
    y = y[order]
    if len(set(y.tolist())) < 2:
        return Model(np.zeros(1 << BITS, np.float32), 0.0, 0.0, float(np.log(((y == 1).sum() + 0.5) / ((y == 0).sum() + 0.5))))
    fold = np.arange(len(rows)) % 5 == 0
    train = [i for i in range(len(rows)) if not fold[i]]
    p = np.bincount(np.concatenate([rows[i] for i in train if y[i] == 1] or [rows[0][:0]]), minlength=1 << BITS).astype(float)
    q = np.bincount(np.concatenate([rows[i] for i in train if y[i] == 0] or [rows[0][:0]]), minlength=1 << BITS).astype(float)
    n1, n0 = max(1, sum(y[i] == 1 for i in train)), max(1, sum(y[i] == 0 for i in train))
    ratio = np.log((p + alpha) / (n1 + 2 * alpha)) - np.log((q + alpha) / (n0 + 2 * alpha))
    ratio[p + q < min_texts] = 0.0
    used = [rows[i][ratio[rows[i]] != 0] for i in train]
    sign = np.where(y[train] == 1, 1.0, -1.0)
    per_row = cost * np.where(sign > 0, len(train) / (2 * n1), len(train) / (2 * n0))
    w, b = dual_descent(used, ratio, sign, per_row, epochs, seed, one, unit)
    weight = (w * ratio).astype(np.float32)
    model = Model(weight, b, 1.0, 0.0, (ratio * ratio).astype(np.float32) if unit else None)
    margin = np.array([model.margin(rows[i]) for i in np.flatnonzero(fold)])
    yf = y[fold]
    wf = np.where(yf == 1, share / max(1, (yf == 1).sum()), (1 - share) / max(1, (yf == 0).sum())) * len(yf)
    if len(set(yf.tolist())) == 2:
        model.slope, model.shift = sigmoid_fit(margin, yf, wf)
    return model


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, mod: int, held: int, per_class: int) -> tuple[list[bytes], np.ndarray, float]:
    """At most per_class labelled texts of each class, taken by a hash of the id: the bound of what the driver gets.

    The whole label table is counted for the share of class 1. Rows of the held-out remainder are never used.
    """
    own = labels.select(F.col("doc_id").alias("lid"), F.col(label).cast("int").alias("y")).where(F.col("lid").isNotNull() & F.col("y").isin(0, 1) & (crc_mod(F.col("lid"), mod) != held))
    count = {r["y"]: r["n"] for r in own.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not count:
        return [], np.empty(0, int), 0.5
    take = None
    for c in sorted(count):
        part = own.where(F.col("y") == c).groupBy("lid").agg(F.max("y").alias("y")).orderBy(F.xxhash64("lid"), "lid").limit(per_class)
        take = part if take is None else take.unionByName(part)
    got = id_and_text(docs).join(F.broadcast(take), F.col("doc_id") == F.col("lid")).select("doc_id", "text", "y").dropDuplicates(["doc_id", "y"]).toArrow()
    order = np.argsort(got.column("doc_id").to_numpy(), kind="stable")
    texts = got.column("text").to_pylist()
    y = got.column("y").to_numpy()
    return [(texts[i] or "").encode() for i in order], y[order], count.get(1, 0) / sum(count.values())


def score_texts(docs: DataFrame, model: Model, features: Features, whole_rows: bool = False) -> DataFrame:
    """doc_id and score of each row; with whole_rows, all columns of docs and, last, the score."""
    tidy(docs.sparkSession)  # the texts and features of the fit
    shared = docs.sparkSession.sparkContext.broadcast(model)
    own = docs if whole_rows else id_and_text(docs)
    text_at = own.columns.index("text")
    keep = list(range(len(own.columns))) if whole_rows else [0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        stamp = np.zeros(1 << BITS, dtype=np.int32)
        for batch in batches:
            data, off = byte_view(batch.column(text_at))
            margin = np.full(len(off) - 1, m.bias)
            for i, j in steps(off):
                for k, idx in enumerate(features(data[off[i] : off[j]], off[i : j + 1] - off[i])):
                    if len(idx):
                        seq = np.arange(len(idx), dtype=np.int32)
                        stamp[idx] = seq
                        margin[i + k] = m.margin(idx[stamp[idx] == seq])
            part = batch.select(keep)
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(m.score(margin))], names=[*part.schema.names, "score"])

    schema = T.StructType([own.schema[k] for k in keep] + [T.StructField("score", T.DoubleType())])
    return own.mapInArrow(run, schema)
