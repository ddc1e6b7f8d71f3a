"""Shared pieces of the training-data operators: reading, materialising, Arrow text access."""

from __future__ import annotations

import contextlib
import uuid
import weakref

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textbench.session import checkpoint_dir

_PATHS: weakref.WeakKeyDictionary = weakref.WeakKeyDictionary()  # where a table of materialise() lies
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_path(spark: SparkSession, tag: str) -> str:
    """A fresh path below the shared checkpoint folder of the cluster."""
    return f"{checkpoint_dir(spark).rstrip('/')}/llm/{tag}-{uuid.uuid4().hex}"


@contextlib.contextmanager
def conf(spark: SparkSession, key: str, value: str):
    """Set a session option for the time of one action and put it back."""
    old = spark.conf.get(key)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.set(key, old)


def materialise(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends there,
    a lost executor loses nothing, and the shuffle files of the step go."""
    spark = df.sparkSession
    path = shared_path(spark, tag)
    schema = df.schema
    with conf(spark, CLEANUP, "true"):
        df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(schema).parquet(path)
    _PATHS[out] = path
    return out


def release(*tables: DataFrame) -> None:
    """Delete the files of tables that ``materialise`` returned, once all that
    was made of them is written."""
    for t in tables:
        spark, path = t.sparkSession, _PATHS.pop(t)
        path = spark._jvm.org.apache.hadoop.fs.Path(path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def unused_name(df: DataFrame, base: str) -> str:
    """A column name that ``df`` does not have (names compare without case)."""
    taken = {c.lower() for c in df.columns}
    name = base
    while name.lower() in taken:
        name = "_" + name
    return name


def pick(df: DataFrame, **cols: str) -> DataFrame:
    """``select`` under new names; extra columns of any name are left out."""
    return df.select(*[F.col(f"`{c}`").alias(n) for n, c in cols.items()])


FILTER_BITS = 26  # a bit table of 2^26 bits, broadcast as 2^20 longs at most


def maybe_in(df: DataFrame, key: str, keys: DataFrame, bits: int = FILTER_BITS) -> DataFrame:
    """Rows of ``df`` whose ``key`` (a hash) may be among ``keys`` (one column of
    such hashes): all that are, and few others.  It spares a join's shuffle the
    rows that cannot match; the bit table that is broadcast has a fixed size,
    however many keys there are (with very many, it just lets everything pass)."""
    word, bit = unused_name(df, "word"), unused_name(df, "bits")

    def place(c):
        return F.shiftrightunsigned(c, 64 - bits)

    k = place(F.col(keys.columns[0]))
    one = F.lit(1).cast("long")
    one_bit = F.call_function("shiftleft", one, k.bitwiseAND(63).cast("int"))
    table = keys.select(F.shiftright(k, 6).alias(word), one_bit.alias(bit)).groupBy(word).agg(F.bit_or(bit).alias(bit))
    mine = place(F.col(key))
    hit = df.withColumn(word, F.shiftright(mine, 6)).join(F.broadcast(table), word)
    on = F.call_function("shiftrightunsigned", F.col(bit), mine.bitwiseAND(63).cast("int")).bitwiseAND(one) == 1
    return hit.where(on).select(*[F.col(f"`{c}`") for c in df.columns])


def text_buffers(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Row offsets (n + 1, from 0) and bytes of an Arrow string column, without a copy."""
    wide = pa.types.is_large_string(arr.type) or pa.types.is_large_binary(arr.type)
    _, off, data = arr.buffers()
    if off is None or len(arr) == 0:
        return np.zeros(len(arr) + 1, np.int64), np.zeros(0, np.uint8)
    offsets = np.frombuffer(off, np.int64 if wide else np.int32)[arr.offset:arr.offset + len(arr) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return offsets - offsets[0], raw[offsets[0]:offsets[-1]]


def row_slices(offsets: np.ndarray, limit: int = 1 << 20):
    """Consecutive row ranges of at most ``limit`` bytes (one row at least)."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


def int64_list(flat: np.ndarray, counts) -> pa.Array:
    """An Arrow list<int64> column from flat values and row lengths."""
    offs = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=offs[1:])
    return pa.ListArray.from_arrays(pa.array(offs, pa.int32()), pa.array(flat.view(np.int64), pa.int64()))
