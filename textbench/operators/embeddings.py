"""E1-E4, JN5, JN6, A16, SNK5: embeddings as keyed Parquet, computed where
the rows are.

The reference keeps a float32 matrix aligned by row position plus a JSON
progress file.  Here vectors are ``(doc_id, embedding: array<float>)`` rows:
"what is still missing" is an anti-join (no position bookkeeping), a resumed
run appends only the missing ids, and the Parquet commit protocol (or a
streaming checkpoint, ST1) makes every batch atomic.  Encoders run on Arrow
batches where the texts are read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Encoder = Callable[[list[str]], np.ndarray]

# Fixed values of the precompute gate: 768 dims, 4 bytes per value, 250 GB cap.
DEFAULT_DIMS = 768
DTYPE_BYTES = 4
MAX_PRECOMPUTE_GB = 250.0


class HashedBagOfWords:
    """The default encoder: each whitespace token adds +-1 to the bucket given by
    its md5 (first 32 bits mod ``dim``; sign from the next byte's parity)."""

    CACHE = 1 << 18  # remembered words; the memory is cleared when it is full

    def __init__(self, dim: int = 64):
        self.dim = dim
        self.known: dict[str, tuple[int, float]] = {}

    def _place(self, word: str) -> tuple[int, float]:
        hit = self.known.get(word)
        if hit is None:
            h = hashlib.md5(word.encode("utf-8")).hexdigest()
            hit = (int(h[:8], 16) % self.dim, 1.0 if int(h[8:10], 16) % 2 == 0 else -1.0)
            if len(self.known) >= self.CACHE:
                self.known.clear()
            self.known[word] = hit
        return hit

    def __call__(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dim), dtype=np.float32)
        for r, t in enumerate(texts):
            placed = [self._place(w) for w in (t or "").split()]
            if placed:
                at, sign = zip(*placed)
                out[r] = np.bincount(at, weights=sign, minlength=self.dim)
        return out


def _vector_column(vectors, n: int) -> pa.Array:
    """An encoder's answer as an Arrow list column; entries may be None."""
    if isinstance(vectors, np.ndarray):
        flat = np.ascontiguousarray(vectors, np.float32)
        return pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * flat.shape[1], pa.int32()), pa.array(flat.ravel()))
    return pa.array([None if v is None else np.asarray(v, np.float32) for v in vectors], pa.list_(pa.float32()))


def embed_texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", encoder: Encoder | None = None,
                batch_rows: int = 64, dim: int = 64) -> DataFrame:
    """``(id, embedding)``, one row for every row of ``df`` (repeated and null
    ids included), whatever the encoder and for a stream as for a table.  Texts go
    to the encoder where they are read, ``batch_rows`` (the reference's encode
    batch size) at a time; no shuffle.  An encoder may return None for a text, whose
    vector is then null."""
    enc = encoder or HashedBagOfWords(dim)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, batch_rows):
                part = batch.slice(start, batch_rows)
                vectors = _vector_column(enc(part.column(1).to_pylist()), part.num_rows)
                yield pa.RecordBatch.from_arrays([part.column(0), vectors], names=[id_col, "embedding"])

    id_type = df.schema[id_col].dataType.simpleString()
    return df.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {id_type}, embedding array<float>")


def pending_embeddings(corpus: DataFrame, vectors: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """JN5: corpus rows that have no vector yet, or a null one (the resume point)."""
    return corpus.join(vectors.where(F.col("embedding").isNotNull()).select(id_col), id_col, "left_anti")


def embedding_coverage(corpus: DataFrame, vectors: DataFrame, expected_dim: int | Column, id_col: str = "doc_id") -> DataFrame:
    """JN6: one row ``rows, vectors, covered, missing, orphans, duplicates,
    null_vectors, bad_dims, verdict``.

    Vectors are aggregated by id first, so a repeated id covers its row once.
    A null vector is one that is still to come: it counts under ``null_vectors``
    alone.  ``covered``/``missing``: corpus rows with and without a usable
    vector; ``orphans``: ids that the corpus does not have (they are kept);
    ``duplicates``: vectors beyond the first of an id; ``bad_dims``: vectors
    that are not of the expected length.  The verdict is ``rebuild`` for any
    wrong length, else ``resume`` if rows are missing, else ``duplicates`` or
    ``complete``."""
    dim = expected_dim if isinstance(expected_dim, Column) else F.lit(expected_dim)
    there = F.col("embedding").isNotNull()
    c = corpus.groupBy(id_col).agg(F.count(F.lit(1)).alias("__c"))
    v = vectors.groupBy(id_col).agg(
        F.count(F.when(there, 1)).alias("__v"), F.count(F.when(there & (F.size("embedding") != dim), 1)).alias("__b"),
        F.count(F.when(~there, 1)).alias("__z"))
    j = c.join(v, id_col, "full_outer").select(
        *[F.coalesce(x, F.lit(0)).alias(x) for x in ("__c", "__v", "__b", "__z")])
    usable = F.col("__v") > F.col("__b")
    total = lambda x, n: F.coalesce(F.sum(x), F.lit(0)).cast("long").alias(n)
    agg = j.groupBy().agg(
        total(F.col("__c"), "rows"), total(F.col("__v"), "vectors"),
        total(F.when(usable, F.col("__c")).otherwise(0), "covered"),
        total(F.when(usable, 0).otherwise(F.col("__c")), "missing"),
        total(F.when((F.col("__c") == 0) & (F.col("__v") > 0), 1).otherwise(0), "orphans"),
        total(F.greatest(F.col("__v") - 1, F.lit(0)), "duplicates"), total(F.col("__z"), "null_vectors"),
        total(F.col("__b"), "bad_dims"))
    verdict = (F.when(F.col("bad_dims") > 0, "rebuild").when(F.col("missing") > 0, "resume")
               .when(F.col("duplicates") > 0, "duplicates").otherwise("complete"))
    return agg.withColumn("verdict", verdict)


def write_bucketed(df: DataFrame, name: str, path: str, id_col: str = "doc_id", buckets: int = 64, mode: str = "overwrite") -> DataFrame:
    """``df`` as the table ``name``, stored in ``path`` in ``buckets`` buckets of
    ``id_col`` with one file each per write.  Tables of one bucketing (a corpus and its
    vectors) are joined and counted by id bucket by bucket, without a shuffle:
    JN2, JN5 and JN6 of such tables read each side once, where it lies."""
    dealt = df.repartition(buckets, F.col(f"`{id_col}`"))
    dealt.write.format("parquet").bucketBy(buckets, id_col).sortBy(id_col).option("path", path).mode(mode).saveAsTable(name)
    return df.sparkSession.table(name)


def open_bucketed(spark: SparkSession, name: str, path: str, schema: str, id_col: str = "doc_id", buckets: int = 64) -> DataFrame:
    """Name a folder that :func:`write_bucketed` wrote in an earlier session
    (``schema``: its columns as DDL); its files already carry their buckets."""
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({schema}) USING parquet "
              f"CLUSTERED BY ({id_col}) SORTED BY ({id_col}) INTO {buckets} BUCKETS LOCATION '{path}'")
    return spark.table(name)


def _generation(spark: SparkSession, path: str) -> int | None:
    """Number of the newest complete generation below ``path`` (a listing of
    the folder on the driver), None without one.  Any error of the file system
    is passed on; only a missing folder means that there is nothing yet."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(conf)
    if not fs.exists(root):
        return None
    found = [s.getPath() for s in fs.listStatus(root)]
    done = [int(p.getName()[4:]) for p in found if p.getName().startswith("gen-")
            and fs.exists(jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
    return max(done, default=None)


def read_precomputed(spark: SparkSession, path: str) -> DataFrame:
    """The vectors of the newest generation that :func:`precompute_embeddings` wrote."""
    gen = _generation(spark, path)
    if gen is None:
        raise ValueError(f"no precomputed embeddings at {path}")
    return spark.read.parquet(f"{path}/gen-{gen}")


def precompute_embeddings(spark: SparkSession, corpus: DataFrame, path: str, encoder: Encoder | None = None,
                          dim: int = 64, id_col: str = "doc_id", text_col: str = "text", resume: bool = True,
                          buckets: int = 64) -> DataFrame:
    """Resumable precompute into Parquet below ``path``.

    With ``resume`` and stored vectors of the right shape, only the ids that
    miss one are encoded and appended to the newest generation (a text for which the
    encoder has no vector is not stored and is asked for again); vectors of ids
    outside ``corpus`` stay, so a run on a part of the corpus takes nothing
    away.  A wrong dimension (or ``resume=False``) starts a new generation
    folder and leaves the old one alone.  A folder that cannot be read is an
    error, never an empty one.  Re-running a finished precompute writes nothing.
    """
    gen, todo = _generation(spark, path), corpus
    if gen is None:
        gen = 0
    elif not resume:
        gen += 1
    else:
        existing = spark.read.parquet(f"{path}/gen-{gen}").select(id_col, "embedding")
        verdict = embedding_coverage(corpus, existing, dim, id_col).first()["verdict"]
        if verdict == "rebuild":
            gen += 1
        elif verdict == "resume":
            todo = pending_embeddings(corpus, existing, id_col)
        else:
            return read_precomputed(spark, path)
    out = embed_texts(todo.select(id_col, text_col), id_col, text_col, encoder, dim=dim).where(F.col("embedding").isNotNull())
    write_embeddings(out, f"{path}/gen-{gen}", "append", id_col, buckets)
    return read_precomputed(spark, path)


def write_embeddings(vectors: DataFrame, path: str, mode: str = "append", id_col: str = "doc_id",
                     buckets: int = 64) -> None:
    """SNK5: vectors to Parquet, partitioned by a hash bucket of the id.  A
    bucket is written by as many tasks as its size asks for (the rebalance
    splits it by the advisory partition size), so the number of buckets does
    not bound the number of writers."""
    (vectors.withColumn("bucket", F.pmod(F.xxhash64(id_col), F.lit(buckets)).cast("int"))
     .hint("rebalance", "bucket").write.mode(mode).partitionBy("bucket").parquet(path))


def random_adapter(embedding_dim: int, model_dim: int, prefix_tokens: int, layers: int = 0, hidden: int = 64,
                   seed: int = 0) -> list[tuple[np.ndarray, np.ndarray]]:
    """Deterministic weights for a linear (``layers = 0``) or MLP adapter."""
    rng = np.random.default_rng(seed)
    shapes, d = [], embedding_dim
    for _ in range(layers):
        shapes.append((d, hidden))
        d = hidden
    shapes.append((d, prefix_tokens * model_dim))
    return [(rng.standard_normal(s) / math.sqrt(s[0]), rng.standard_normal(s[1]) * 0.01) for s in shapes]


# erf by the rational approximation 7.1.26 of Abramowitz and Stegun (error below 1.5e-7).
# Its constant and coefficients.
ERF_P = 0.3275911
ERF_A = [0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429]


def _erf(x: np.ndarray) -> np.ndarray:
    t = 1.0 / (1.0 + ERF_P * np.abs(x))
    poly = t * (ERF_A[0] + t * (ERF_A[1] + t * (ERF_A[2] + t * (ERF_A[3] + t * ERF_A[4]))))
    return np.sign(x) * (1.0 - poly * np.exp(-x * x))


def _gelu(x: np.ndarray) -> np.ndarray:
    return x * 0.5 * (1.0 + _erf(x / math.sqrt(2.0)))


def adapter_forward(vectors: DataFrame, weights, id_col: str = "doc_id", out_type: str = "float") -> DataFrame:
    """Embedding → (linear + GELU) x layers → linear → the flattened
    ``K x model_dim`` prefix (``prefix: array<float>``).

    ``weights`` is a list of ``(W, b)`` numpy pairs (shipped once per
    executor with ``SparkContext.broadcast``) or a callable ``dim ->
    weights`` evaluated inside the task (deterministic initialisations)."""
    if callable(weights):
        factory, bc = weights, None
    else:
        factory, bc = None, vectors.sparkSession.sparkContext.broadcast(weights)
    np_type = np.float32 if out_type == "float" else np.float64

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cache: dict[int, list] = {}
        for pdf in batches:
            if len(pdf) == 0:
                continue
            x = np.stack(pdf["embedding"].to_numpy()).astype(np.float64)
            if bc is not None:
                ws = bc.value
            else:
                if x.shape[1] not in cache:
                    cache[x.shape[1]] = factory(x.shape[1])
                ws = cache[x.shape[1]]
            for i, (w, b) in enumerate(ws):
                x = x @ w + b
                if i < len(ws) - 1:
                    x = _gelu(x)
            yield pd.DataFrame({id_col: pdf[id_col].to_numpy(), "prefix": list(x.astype(np_type))})

    id_type = vectors.schema[id_col].dataType.simpleString()
    return vectors.select(id_col, "embedding").mapInPandas(run, f"{id_col} {id_type}, prefix array<{out_type}>")


def no_adapter_check(vectors: DataFrame, model_dim: int) -> DataFrame:
    """Embeddings can condition the decoder directly only when their
    dimension equals the decoder's hidden size."""
    return vectors.withColumn("usable_without_adapter", F.size("embedding") == model_dim)


def storage_estimate(df: DataFrame, dims: int = DEFAULT_DIMS, dtype_bytes: int = DTYPE_BYTES, mode: str = "auto",
                     max_gb: float = MAX_PRECOMPUTE_GB) -> DataFrame:
    """One row ``num_rows, dims, bytes_per_row, total_bytes, total_gb,
    precompute``; ``mode`` auto (<= cap), true, false; anything else is an error."""
    m = str(mode).lower()
    if m not in ("auto", "true", "false"):
        raise ValueError(f"Unsupported precompute setting: {mode}")
    est = df.groupBy().agg(F.count(F.lit(1)).alias("num_rows")).select(
        "num_rows", F.lit(dims).cast("long").alias("dims"), F.lit(dims * dtype_bytes).cast("long").alias("bytes_per_row"),
        (F.col("num_rows") * F.lit(dims * dtype_bytes)).cast("long").alias("total_bytes"))
    est = est.withColumn("total_gb", F.col("total_bytes") / F.lit(float(1024 ** 3)))
    decision = {"auto": F.col("total_gb") <= F.lit(max_gb), "true": F.lit(True), "false": F.lit(False)}[m]
    return est.withColumn("precompute", decision)
