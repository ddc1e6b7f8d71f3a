"""Operator 12: document quality from random-indexing word vectors and a small network.

Tokens are runs of letters and digits (any script, case kept) and runs of other
marks.  A token is hashed to one of ``buckets``; every bucket has a fixed index
vector of ``DIM`` numbers, four of them +1 or -1, the rest 0.  The vector of a bucket
is the mean of the index vectors around its occurrences in all documents (itself
and two tokens on either side), less the mean around all tokens, scaled to length 1.

A text is the mean of its tokens' vectors, and the mean of the products, number by
number, of neighbouring tokens' vectors (large where words repeat).  A network of
one hidden layer is fitted on a bounded sample of the labelled rows
(``max_per_class`` of each label, smallest hashes first); rows kept from that fit
give the temperature by which its output is divided before it becomes a probability.

Plan: one scan sums the vectors: each task adds up a table of fixed size in
numpy and returns it in blocks, which are dealt by block and added again.  The
model that reaches the tasks has a fixed size (``buckets`` * DIM numbers), however
large the corpus is.  The second scan scores whole texts where they are read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textbench.llm.common import materialise, row_slices, text_buffers
from textbench.llm.words import U64, mix64

DIM = 64
BUCKETS = 1 << 15
WINDOW = 2
NONZERO = 4
HIDDEN = 24
MAX_PER_CLASS = 6000
THRESHOLD = 0.3
PARTIALS = 4096  # tasks of the counting scan, at most
BLOCK = 64  # buckets in a row between tasks
CHUNK = 1 << 20  # bytes tokenised at once
SPAN = 1 << 17  # tokens counted at once
ROWS = 1 << 13  # tokens whose vectors are in memory at once


def held_out(doc_id) -> F.Column:
    """Rows whose labels are never learnt from: crc32 of the id as text, modulo 5, is 0."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


# -- tokens --

class Tokens:
    """Token hashes of UTF-8 text."""

    def __init__(self):
        byte = np.arange(256)
        letter = ((byte >= 48) & (byte <= 57)) | ((byte >= 65) & (byte <= 90)) | ((byte >= 97) & (byte <= 122)) | (byte >= 0x80)
        space = (byte == 0x20) | ((byte >= 0x09) & (byte <= 0x0D))
        self.kind = np.where(space, 0, np.where(letter, 1, 2)).astype(np.int8)
        self.value = mix64(np.arange(1, 257, dtype=U64) * U64(0x9E3779B97F4A7C15)) | U64(1)
        self._powers(CHUNK)

    def _powers(self, n: int) -> None:
        base = 0x5851F42D4C957F2D
        self.up = np.cumprod(np.full(n, base, U64))
        self.down = np.cumprod(np.full(n, pow(base, -1, 1 << 64), U64))

    def _piece(self, data: np.ndarray):
        kind = self.kind[data]
        edge = np.flatnonzero(kind[1:] != kind[:-1]) + 1
        start = np.concatenate(([0], edge))
        stop = np.concatenate((edge, [len(data)]))
        word = kind[start] > 0
        start, stop = start[word], stop[word]
        if len(data) > len(self.up):
            self._powers(2 * len(data))
        total = np.concatenate((np.zeros(1, U64), np.cumsum(self.value[data] * self.up[:len(data)])))
        return mix64((total[stop] - total[start]) * self.down[start]), start

    def scan(self, data: np.ndarray, offsets: np.ndarray):
        """(hash, row) of every token of the rows.  A row longer than a chunk
        is tokenised piece by piece, cut at white space."""
        hashes, rows = [np.zeros(0, U64)], [np.zeros(0, np.int64)]
        for r in range(len(offsets) - 1):
            at, end = int(offsets[r]), int(offsets[r + 1])
            while at < end:
                cut = end
                if end - at > CHUNK:
                    blank = np.flatnonzero(self.kind[data[at:at + CHUNK]] == 0)
                    k = at + CHUNK
                    while not len(blank) and k < end:  # a word longer than a chunk
                        blank = np.flatnonzero(self.kind[data[k:k + CHUNK]] == 0) + (k - at)
                        k += CHUNK
                    cut = at + int(blank[-1]) + 1 if len(blank) else end
                h, _ = self._piece(data[at:cut])
                hashes.append(h)
                rows.append(np.full(len(h), r, np.int64))
                at = cut
        return np.concatenate(hashes), np.concatenate(rows)


def _batches(column, tokens: Tokens, buckets: int):
    """(rows from, rows to, bucket and row of every token) for slices of a batch."""
    offsets, data = text_buffers(column)
    for i, j in row_slices(offsets):
        h, row = tokens.scan(data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i])
        yield i, j, (h % U64(buckets)).astype(np.int64), row


def index_vectors(buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Where each bucket's index vector is not 0, and its signs."""
    seed = np.arange(buckets * NONZERO, dtype=U64).reshape(buckets, NONZERO)
    place = (mix64(seed + U64(1)) % U64(DIM)).astype(np.int64)
    sign = np.where(mix64(seed + U64(1 << 40)) & U64(1), 1.0, -1.0)
    return place, sign


# -- word vectors of the corpus --

def word_vectors(texts: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Unit vectors of all buckets, from all rows of ``texts`` (one column);
    buckets that never occur are 0."""

    def count(batches):
        tokens, (place, sign) = Tokens(), index_vectors(buckets)
        table, seen = np.zeros(buckets * DIM), np.zeros(buckets)
        for batch in batches:
            for _, _, b, row in _batches(batch.column(0), tokens, buckets):
                seen += np.bincount(b, minlength=buckets)
                for s in range(0, len(b), SPAN):
                    x, r = b[s:s + SPAN + WINDOW], row[s:s + SPAN + WINDOW]
                    n = min(SPAN, len(b) - s)
                    pairs = [(x[:n], x[:n])]
                    for o in range(1, WINDOW + 1):
                        near = np.flatnonzero(r[:len(r) - o][:n] == r[o:][:n])
                        pairs += [(x[near], x[near + o]), (x[near + o], x[near])]
                    word = np.concatenate([p[0] for p in pairs])
                    other = np.concatenate([p[1] for p in pairs])
                    table += np.bincount((word[:, None] * DIM + place[other]).ravel(), weights=sign[other].ravel(), minlength=len(table))
        rows = np.column_stack((table.reshape(buckets, DIM), seen)).astype(np.int64).reshape(-1, BLOCK * (DIM + 1))
        some = np.flatnonzero(rows.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array([rows[k].tobytes() for k in some], pa.binary())], names=["block", "v"])

    def add(batches):
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, v in zip(batch.column(0).to_pylist(), batch.column(1)):
                part = np.frombuffer(v.as_buffer(), np.int64)
                total[k] = total[k] + part if k in total else part.copy()
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array([v.tobytes() for v in total.values()], pa.binary())],
                                         names=["block", "v"])

    schema = "block long, v binary"
    sums = texts.coalesce(PARTIALS).mapInArrow(count, schema).repartition("block").mapInArrow(add, schema).toArrow()
    out = np.zeros((buckets // BLOCK, BLOCK * (DIM + 1)))
    for k, v in zip(sums.column("block").to_pylist(), sums.column("v").to_pylist()):
        out[k] = np.frombuffer(v, np.int64)
    out = out.reshape(buckets, DIM + 1)
    out, seen = out[:, :DIM], out[:, DIM:]
    out = np.where(seen > 0, out / np.maximum(seen, 1) - out.sum(axis=0) / max(1, seen.sum()), 0)
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return (out / np.where(norm > 0, norm, 1)).astype(np.float32)


def pooled(column, tokens: Tokens, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Features of each row of an Arrow string column, and its number of tokens."""
    out, size = np.zeros((len(column), 2 * DIM)), np.zeros(len(column), np.int64)
    for i, j, b, row in _batches(column, tokens, len(vectors)):
        size[i:j] = np.bincount(row, minlength=j - i)
        for s in range(0, len(b), ROWS):  # also inside a long text
            x, r = vectors[b[s:s + ROWS + 1]], row[s:s + ROWS + 1]
            n = min(ROWS, len(b) - s)
            ends = np.flatnonzero(r[1:] != r[:-1])
            head = np.concatenate(([0], ends[ends < n - 1] + 1))
            out[i + r[head], :DIM] += np.add.reduceat(x[:n], head, axis=0)
            near = x[:-1] * x[1:]
            near[ends] = 0  # the last token of a text has no neighbour after it
            if len(near):
                head = head[head < len(near)]
                out[i + r[head], DIM:] += np.add.reduceat(near, head, axis=0)
    out[:, :DIM] /= np.maximum(size, 1)[:, None]
    out[:, DIM:] /= np.maximum(size - 1, 1)[:, None]
    return out, size


# -- the network --

def _sigmoid(z):
    return 1.0 / (1.0 + np.exp(-np.clip(z, -40, 40)))


def _logit(net: dict, x: np.ndarray) -> np.ndarray:
    hidden = np.tanh(((x - net["mean"]) / net["std"]) @ net["w1"] + net["b1"])
    return hidden @ net["w2"] + net["b2"]


def fit_network(x, y, weight, steps: int = 400, rate: float = 0.01, l2: float = 1e-3) -> dict:
    """Two layers (tanh, then one logit) by Adam on the weighted logistic loss."""
    rng = np.random.default_rng(12)
    net = {"mean": x.mean(axis=0), "std": x.std(axis=0) + 1e-6}
    z = (x - net["mean"]) / net["std"]
    share = weight / weight.sum()
    p = {"w1": rng.normal(0, 1 / np.sqrt(z.shape[1]), (z.shape[1], HIDDEN)), "b1": np.zeros(HIDDEN),
         "w2": rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), "b2": np.zeros(())}
    m = {k: np.zeros_like(v) for k, v in p.items()}
    v = {k: np.zeros_like(w) for k, w in p.items()}
    for t in range(1, steps + 1):
        hidden = np.tanh(z @ p["w1"] + p["b1"])
        g = share * (_sigmoid(hidden @ p["w2"] + p["b2"]) - y)
        back = np.outer(g, p["w2"]) * (1 - hidden * hidden)
        grad = {"w1": z.T @ back + l2 * p["w1"], "b1": back.sum(axis=0), "w2": hidden.T @ g + l2 * p["w2"], "b2": g.sum()}
        for k in p:
            m[k] = 0.9 * m[k] + 0.1 * grad[k]
            v[k] = 0.999 * v[k] + 0.001 * grad[k] ** 2
            p[k] = p[k] - rate * (m[k] / (1 - 0.9 ** t)) / (np.sqrt(v[k] / (1 - 0.999 ** t)) + 1e-8)
    return {**net, **p}


def temperature(logit, y, weight) -> float:
    """The divisor of the logits with the least weighted loss, between 1/8 and
    8; few or easily separated rows do not move it far from 1."""
    def loss(t):
        z = logit / t
        return (weight * (np.logaddexp(0, z) - y * z)).sum() + np.log(t) ** 2

    lo, hi = np.log(1 / 8), np.log(8)
    for _ in range(60):  # the loss has one valley
        a, b = lo + (hi - lo) / 3, hi - (hi - lo) / 3
        lo, hi = (lo, b) if loss(np.exp(a)) <= loss(np.exp(b)) else (a, hi)
    return float(np.exp((lo + hi) / 2))


def _sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, max_per_class: int):
    """(id, y, text) of the bounded sample, and the training label counts."""
    known = labels.select(F.col(f"`{id_col}`").alias("lid"), F.col("quality").alias("y")).where(
        F.col("lid").isNotNull() & F.col("y").isin(0, 1) & ~held_out(F.col("lid")))
    known = known.groupBy("lid").agg(F.min("y").cast("int").alias("y"))
    counts = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    draw = F.shiftrightunsigned(F.xxhash64("lid", F.lit(12)), 24)

    def drawn(y):  # a share by hash first, so that the sort behind the exact bound stays small
        share = min(1.0, 1.2 * max_per_class / max(1, counts.get(y, 0)))
        return known.where((F.col("y") == y) & (draw < int(share * (1 << 40)))).orderBy(draw, "lid").limit(max_per_class)

    sample = drawn(0).unionAll(drawn(1))
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text")).join(
        F.broadcast(sample), F.col("id") == F.col("lid"))  # at most 2 * max_per_class ids
    rows = rows.groupBy("id").agg(F.first("y").alias("y"), F.min("text").alias("text"))
    return materialise(rows, "quality-train"), counts


def train_model(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                max_per_class: int = MAX_PER_CLASS, buckets: int = BUCKETS) -> dict:
    """vectors, prior (the share of label 1, which texts without a token get), net (or None) and temperature."""
    train, counts = _sample(docs, labels, id_col, text_col, max_per_class)
    n0, n1 = counts.get(0, 0), counts.get(1, 0)
    model = {"vectors": word_vectors(docs.select(F.col(f"`{text_col}`")), buckets), "prior": (n1 + 1) / (n0 + n1 + 2), "net": None, "t": 1.0}
    vectors = docs.sparkSession.sparkContext.broadcast(model["vectors"])

    def features(batches):
        tokens = Tokens()
        for batch in batches:
            x, size = pooled(batch.column(2), tokens, vectors.value)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(size), pa.array(list(x))], names=["id", "y", "n", "x"])

    rows = train.select(F.xxhash64("id", F.lit(7)).alias("id"), "y", "text").mapInArrow(features, "id long, y int, n long, x array<double>")
    rows = rows.where("n > 0").orderBy("id").toArrow()  # at most 2 * max_per_class short arrays
    y = rows.column("y").to_numpy().astype(float)
    if 0 < y.sum() < len(y):
        x = np.array(rows.column("x").to_pylist())
        weight = np.where(y > 0, n1 / (y > 0).sum(), n0 / (y == 0).sum())  # the class ratio of all training labels
        late = np.arange(len(y)) % 4 == 3
        if not 0 < y[~late].sum() < (~late).sum():
            late[:] = False
        model["net"] = fit_network(x[~late], y[~late], weight[~late])
        if late.any():
            model["t"] = temperature(_logit(model["net"], x[late]), y[late], weight[late])
    return model


def score_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  keep: list[str] | None = None, threshold: float = THRESHOLD, **options) -> DataFrame:
    """One row per document: the columns ``keep`` (all by default), then
    held_out, score (0 to 1) and predicted (1 if score >= threshold).

    Only the text enters a score.  A text without a token (null, empty, white
    space) gets the share of label 1 among the training labels.  Labels that are
    null or not 0 or 1 are not learnt; repeated labels of one id count once,
    as 0 if any of them is; of the texts of one repeated id the first by its bytes
    is learnt; a null id is never held out and has no label.  With one class (or
    none) in the training rows all texts get that share.  Extra columns pass
    through; those named like a result are left out.  An empty table gives no rows.
    """
    model = docs.sparkSession.sparkContext.broadcast(train_model(docs, labels, id_col, text_col, **options))
    keep = [c for c in (docs.columns if keep is None else keep) if c.lower() not in ("held_out", "score", "predicted")]
    source = docs.select(*[F.col(f"`{c}`") for c in keep], held_out(F.col(f"`{id_col}`")).alias("held_out"),
                         F.col(f"`{text_col}`").alias("score"))
    schema = T.StructType(source.schema.fields[:-1] + [T.StructField("score", T.DoubleType())])

    def run(batches):
        m, tokens = model.value, Tokens()
        for batch in batches:
            last = batch.num_columns - 1
            score = np.full(batch.num_rows, m["prior"])
            if m["net"] is not None:
                x, size = pooled(batch.column(last), tokens, m["vectors"])
                score = np.where(size > 0, _sigmoid(_logit(m["net"], x) / m["t"]), score)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in range(last)], pa.array(score)], names=batch.schema.names)

    out = source.mapInArrow(run, schema)
    return out.withColumn("predicted", F.when(F.col("score") >= threshold, 1).otherwise(0).cast("int"))
