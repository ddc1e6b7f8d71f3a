"""Operator 5: toxicity by a character n-gram linear classifier with naive Bayes scaling.

A text is the set of its lower-cased character 3-, 4- and 5-grams, hashed into
2^20 buckets.  On the labelled training rows every bucket gets a log-count
ratio r = log P(bucket | toxic) - log P(bucket | clean) with add-one smoothing.
A text's feature for a bucket is r if the bucket occurs and 0 otherwise; the
weights of these features are fitted by L2-regularised logistic regression.
A part of the training rows is kept from that fit and maps the linear score to
a probability at the class ratio of all training labels.

The classifier is fitted on a bounded sample of the labelled rows
(``max_per_class`` of each class, smallest hashes first) and on ``n_features``
buckets (the largest chi-square), so the model that reaches the tasks has a
fixed size; every whole text is scored where it is read, without a shuffle.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textbench.llm.common import materialise, row_slices, text_buffers
from textbench.llm.words import U64, mix64

ORDERS = (3, 4, 5)
BITS = 20
MAX_PER_CLASS = 6000
N_FEATURES = 16384  # below 2^16
THRESHOLD = 0.7


def held_out(doc_id) -> F.Column:
    """Rows whose labels are never learnt from: crc32 of the id as text, modulo 3, is 1."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def code_points(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased (A-Z, Latin-1 capitals) code points, any white space as a
    space, and the row offsets among them."""
    start = np.flatnonzero((data & 0xC0) != 0x80)
    c = data[start].astype(np.uint32)
    for lead, mask, extra in ((0xC0, 0x1F, 1), (0xE0, 0x0F, 2), (0xF0, 0x07, 3)):
        at = np.flatnonzero((c >= lead) & (c < (lead | mask) + (extra == 3)) & (data[start] >= lead)
                            & (data[start] < {1: 0xE0, 2: 0xF0, 3: 0xF8}[extra]))
        value = c[at] & mask
        for k in range(1, extra + 1):
            value = (value << 6) | (data[np.minimum(start[at] + k, len(data) - 1)] & 0x3F)
        c[at] = value | 0x80000000  # marked until all widths are done
    c &= 0x7FFFFFFF
    c[((c >= 65) & (c <= 90)) | ((c >= 0xC0) & (c <= 0xDE) & (c != 0xD7))] += 32
    c[(c >= 9) & (c <= 13)] = 32
    return c, np.searchsorted(start, offsets)


def gram_buckets(points: np.ndarray) -> np.ndarray:
    """Buckets of all n-grams of one text, repeats included."""
    x = points.astype(U64)
    out = []
    for n in ORDERS:
        m = len(x) - n + 1
        if m <= 0:
            continue
        acc = x[:m] + U64(n << 32)
        for j in range(1, n):
            acc = acc * U64(0x9E3779B97F4A7C15) + x[j:j + m]
        out.append((mix64(acc) >> U64(64 - BITS)).astype(np.int64))
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def _texts(batch_col):
    offsets, data = text_buffers(batch_col)
    for i, j in row_slices(offsets):
        points, at = code_points(data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i])
        for r in range(j - i):
            yield points[at[r]:at[r + 1]]


def _training_rows(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, max_per_class: int):
    """(toxic, text) of the bounded sample, and the training label counts of both classes."""
    known = labels.select(F.col(id_col).alias("lid"), F.col("toxic").alias("y")).where(
        F.col("lid").isNotNull() & F.col("y").isin(0, 1) & ~held_out(F.col("lid")))
    known = known.groupBy("lid").agg(F.max("y").alias("y"))
    counts = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    draw = F.shiftrightunsigned(F.xxhash64("lid", F.lit(5)), 24)

    def drawn(y):  # the share by hash first, so that the sort behind the exact bound stays small
        share = min(1.0, 1.1 * max_per_class / max(1, counts.get(y, 0)))
        rows = known.where((F.col("y") == y) & (draw < int(share * (1 << 40))))
        return rows.orderBy(draw, "lid").limit(max_per_class)

    sample = drawn(0).unionAll(drawn(1))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(
        F.broadcast(sample), F.col("id") == F.col("lid"))  # at most 2 * max_per_class ids
    return materialise(rows.select("id", "y", "text").dropDuplicates(["id"]), "train"), counts


def _bucket_counts(train: DataFrame) -> DataFrame:
    """bucket, c0, c1: training texts of each class that hold the bucket."""

    def run(batches):
        count = np.zeros((2, 1 << BITS), np.int64)
        for batch in batches:
            y = batch.column(0).to_numpy()
            for r, points in enumerate(_texts(batch.column(1))):
                count[y[r], np.unique(gram_buckets(points))] += 1
        has = np.flatnonzero(count.sum(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(has), pa.array(count[0, has]), pa.array(count[1, has])],
                                         names=["bucket", "c0", "c1"])

    parts = train.select("y", "text").mapInArrow(run, "bucket long, c0 long, c1 long")
    return parts.groupBy("bucket").agg(F.sum("c0").alias("c0"), F.sum("c1").alias("c1"))


def _features(train: DataFrame, slot_bc) -> DataFrame:
    """id, y and the chosen features that each training text holds."""

    def run(batches):
        slot = slot_bc.value
        for batch in batches:
            rows = []
            for points in _texts(batch.column(2)):
                f = slot[gram_buckets(points)]
                rows.append(np.unique(f[f >= 0]).astype(np.uint16).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(rows, pa.binary())],
                                             names=["id", "y", "f"])

    return train.select("id", "y", "text").mapInArrow(run, "id long, y int, f binary")


def _sigmoid(z):
    return 1.0 / (1.0 + np.exp(-np.clip(z, -40, 40)))


class Sparse:
    """Sets of feature numbers, row after row, walked in slices so that no
    temporary is larger than a slice."""

    SLICE = 500

    def __init__(self, flat: np.ndarray, end: np.ndarray):
        self.flat, self.end, self.n = flat, end, len(end) - 1

    def slices(self, rows: np.ndarray):
        """(row numbers, feature numbers, lengths) of the given rows."""
        for i in range(0, len(rows), self.SLICE):
            r = rows[i:i + self.SLICE]
            parts = [self.flat[self.end[k]:self.end[k + 1]] for k in r]
            yield slice(i, i + len(r)), np.concatenate(parts).astype(np.int64), self.end[r + 1] - self.end[r]

    def scores(self, rows: np.ndarray, w: np.ndarray) -> np.ndarray:
        z = np.zeros(len(rows))
        for at, f, length in self.slices(rows):
            total = np.concatenate(([0.0], np.cumsum(w[f])))
            stop = np.cumsum(length)
            z[at] = total[stop] - total[stop - length]
        return z


def _fit(x: Sparse, rows: np.ndarray, y, scale, weight, l2, steps=300):
    """Weighted logistic regression by Adam on features ``scale`` (present) or 0."""
    d = len(scale)
    w, b = np.zeros(d), 0.0
    m, v = np.zeros(d + 1), np.zeros(d + 1)
    for t in range(1, steps + 1):
        ws, grad, bias = w * scale, np.zeros(d), 0.0
        for at, f, length in x.slices(rows):
            total = np.concatenate(([0.0], np.cumsum(ws[f])))
            stop = np.cumsum(length)
            g = weight[at] * (_sigmoid(total[stop] - total[stop - length] + b) - y[at])
            grad += np.bincount(f, weights=np.repeat(g, length), minlength=d)
            bias += g.sum()
        grad = np.append(grad * scale + l2 * w, bias)
        m = 0.9 * m + 0.1 * grad
        v = 0.999 * v + 0.001 * grad * grad
        step = 0.05 * (1 - t / (steps + 1)) * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.999 ** t)) + 1e-9)
        w -= step[:-1]
        b -= step[-1]
    return w, b


def _calibrate(z, y, weight, steps=200):
    """Scale and shift that turn linear scores into probabilities (Newton)."""
    x = np.stack([z, np.ones_like(z)], axis=1)
    t = np.where(y > 0, 1 - 1e-3, 1e-3)
    theta = np.array([1.0, 0.0])
    prior = np.array([1.0, 0.0])
    for _ in range(steps):
        p = _sigmoid(x @ theta)
        grad = x.T @ (weight * (p - t)) + 1e-2 * (theta - prior)
        hess = (x * (weight * p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(2)
        move = np.linalg.solve(hess, grad)
        theta = theta - np.clip(move, -1, 1)
        if np.abs(move).max() < 1e-8:
            break
    return max(theta[0], 1e-3), theta[1]


def train_model(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                max_per_class: int = MAX_PER_CLASS, n_features: int = N_FEATURES, l2: float = 1e-3) -> dict:
    """The fitted model: slot (bucket -> feature or -1), weight per feature, bias."""
    spark = docs.sparkSession
    train, counts = _training_rows(docs, labels, id_col, text_col, max_per_class)
    n0, n1 = counts.get(0, 0), counts.get(1, 0)
    seen = {r["y"]: r["n"] for r in train.groupBy("y").agg(F.count("*").alias("n")).collect()}
    s0, s1 = seen.get(0, 0), seen.get(1, 0)
    slot = np.full(1 << BITS, -1, np.int32)
    if not s0 or not s1:  # one class alone: the prior decides, every text scores alike
        return {"slot": slot, "weight": np.zeros(1), "bias": float(np.log((s1 + 1) / (s0 + 1)))}
    c0, c1 = F.col("c0"), F.col("c1")
    lead = (c1 * s0 - c0 * s1).cast("double")
    share = (c0 + c1) / F.lit(float(s0 + s1))
    chi = lead * lead / (F.greatest(share * (1 - share), F.lit(1e-9)) * float(s0) * float(s1))
    top = _bucket_counts(train).withColumn("chi", chi).where("chi > 0").orderBy(
        F.col("chi").desc(), "bucket").limit(n_features).collect()
    if not top:
        return {"slot": slot, "weight": np.zeros(1), "bias": float(np.log((s1 + 1) / (s0 + 1)))}
    slot[[r["bucket"] for r in top]] = np.arange(len(top), dtype=np.int32)
    ratio = np.array([np.log((r["c1"] + 1) / (s1 + 2)) - np.log((r["c0"] + 1) / (s0 + 2)) for r in top])
    sample = _features(train, spark.sparkContext.broadcast(slot)).orderBy(F.xxhash64("id", F.lit(7)), "id").toArrow()
    y = sample.column("y").to_numpy().astype(np.float64)
    parts = [text_buffers(c) for c in sample.column("f").chunks]
    flat = np.concatenate([data.view(np.uint16) for _, data in parts])
    end = np.concatenate(([0], np.cumsum(np.concatenate([np.diff(o) for o, _ in parts]) // 2)))
    x = Sparse(flat, end)
    del sample, parts
    weight = np.where(y > 0, n1 / s1, n0 / s0)  # the class ratio of all training labels
    weight = weight / weight.mean()
    late = np.arange(len(y)) % 4 == 3
    early = np.flatnonzero(~late)
    w, b = _fit(x, early, y[early], ratio, weight[early] / max(1, len(early)), l2)
    a, shift = 1.0, 0.0
    if late.any() and 0 < y[late].sum() < late.sum():
        a, shift = _calibrate(x.scores(np.flatnonzero(late), w * ratio) + b, y[late], weight[late])
    return {"slot": slot, "weight": a * w * ratio, "bias": float(a * b + shift)}


def score_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   keep: list[str] | None = None, threshold: float = THRESHOLD, **options) -> DataFrame:
    """One row per document: the columns ``keep`` (all by default), then
    held_out, score (0 to 1) and predicted (1 if score >= threshold).

    Only the text enters a score.  A null text scores as an empty one: by the
    prior alone.  Labels that are null or not 0 or 1 are not learnt; repeated
    labels of one id count once, as toxic if any of them is; a null id is
    never held out and has no label.  With one class (or none) in the training
    rows every text gets the same score.  Extra columns pass through; those
    named like a result are left out.
    """
    model = docs.sparkSession.sparkContext.broadcast(train_model(docs, labels, id_col, text_col, **options))
    keep = [c for c in (docs.columns if keep is None else keep) if c.lower() not in ("held_out", "score", "predicted")]
    source = docs.select(*[F.col(f"`{c}`") for c in keep], held_out(F.col(f"`{id_col}`")).alias("held_out"),
                         F.col(f"`{text_col}`").alias("score"))
    schema = T.StructType(source.schema.fields[:-1] + [T.StructField("score", T.DoubleType())])

    def run(batches):
        m = model.value
        for batch in batches:
            score = np.empty(batch.num_rows)
            for r, points in enumerate(_texts(batch.column(batch.num_columns - 1))):
                f = m["slot"][gram_buckets(points)]
                score[r] = m["weight"][np.unique(f[f >= 0])].sum() + m["bias"]
            cols = [batch.column(c) for c in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(_sigmoid(score))], names=batch.schema.names)

    out = source.mapInArrow(run, schema)
    return out.withColumn("predicted", F.when(F.col("score") >= threshold, 1).otherwise(0).cast("int"))
