"""A4: metrics by reference-length bucket.

Rows are ranked by (length, id) and cut into ``b = min(buckets, n)``
near-equal contiguous parts: part ``i`` holds ranks ``[i*n//b, (i+1)*n//b)``,
so row of rank ``r`` lands in ``floor(((r + 1) * b - 1) / n)`` (``ntile``
would put the larger parts first, which is not the same cut).

Plan: only (length, id) is ranked, by the range slices of P2.  The rows at
which a bucket begins (at most ``b`` per experiment) are all that the label of
any other row needs, so the rows themselves are labelled in a map-only pass that
feeds partial aggregation: no shuffle and no sort of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textbench.operators.bleu import bleu_from_sums, bleu_sums, STAT_COLS
from textbench.operators.metric import Metric, finished, resolve, sums
from textbench.operators.ranking import DEFAULT_TARGET_ROWS, attach_cuts, label_at, rank_cuts


def bucket_of(rank: Column, n: Column, b: Column) -> Column:
    return F.floor(((rank + 1) * b - 1) / n).cast("int")


def label_by_rank(
    df: DataFrame,
    key: str,
    tiebreak: str,
    label_fn,
    label_col: str,
    target_rows: int = DEFAULT_TARGET_ROWS,
    partition_cols: list[str] | None = None,
    keys: DataFrame | None = None,
) -> DataFrame:
    """Add ``label_col = label_fn(rank, n)`` for a label that is monotone in
    the (key, tiebreak) rank (bucket numbers, split names by cut point).

    The key columns (of ``keys``, by default ``df``; pass a cheap projection
    when ``df`` is expensive to compute) are ranked alone, and only the first
    row of each label goes on.  ``df`` is then labelled in one map-side pass
    against those cuts: its rows are never shuffled or sorted.
    """
    pc = list(partition_cols or [])
    cuts = rank_cuts(keys if keys is not None else df, key, tiebreak, label_fn, pc, target_rows)
    return attach_cuts(df, cuts, pc).withColumn(label_col, label_at(F.col(key), F.col(tiebreak), F.col("__cuts"))).drop("__cuts")


def assign_buckets(
    df: DataFrame,
    buckets: int,
    length_col: str = "length",
    id_col: str = "id",
    bucket_col: str = "bucket",
    target_rows: int = DEFAULT_TARGET_ROWS,
    partition_cols: list[str] | None = None,
    keys: DataFrame | None = None,
) -> DataFrame:
    """Add ``bucket_col`` (0-based) to every row; no rows when ``buckets <= 0``.
    With ``partition_cols`` every partition (experiment) is bucketed on its own."""
    if buckets <= 0:
        return df.withColumn(bucket_col, F.lit(None).cast("int")).limit(0)

    def label(r, n):
        return bucket_of(r, n, F.least(F.lit(buckets).cast("long"), n))

    return label_by_rank(df, length_col, id_col, label, bucket_col, target_rows=target_rows,
                         partition_cols=partition_cols, keys=keys)


def length_buckets(
    stats: DataFrame,
    buckets: int = 4,
    length_col: str = "length",
    id_col: str = "id",
    f1_col: str | None = "f1",
    with_bleu: bool = True,
    target_rows: int = DEFAULT_TARGET_ROWS,
    group_cols: list[str] | None = None,
    keys: DataFrame | None = None,
    metrics: list[str | Metric] | None = None,
) -> DataFrame:
    """Per-bucket min/max/mean reference length, BLEU, token F1 and samples.

    ``stats`` holds one row per pair with ``id``, ``length``, optional ``f1``
    and (when ``with_bleu``) the BLEU statistics of :func:`bleu_row_stats`.
    ``group_cols`` buckets every group (experiment) separately.  ``keys``:
    a cheap projection with the id, length (and group) columns to rank, so
    ``stats`` itself is computed once.  ``metrics``: the metrics of a bucket in place of
    BLEU and token F1, each a name or the caller's own :class:`Metric`.
    """
    gc = list(group_cols or [])
    tagged = assign_buckets(stats, buckets, length_col, id_col, "bucket", target_rows, gc, keys)
    aggs = [
        F.min(length_col).cast("int").alias("min_tokens"),
        F.max(length_col).cast("int").alias("max_tokens"),
        F.avg(length_col).alias("avg_ref_tokens"),
        F.count(F.lit(1)).cast("int").alias("samples"),
    ]
    if metrics is not None:
        ms = resolve(metrics)
        out = tagged.groupBy(*gc, "bucket").agg(*aggs, *sums(ms))
        return out.select(*[c for c in out.columns if not c.startswith("__sum_")], *finished(ms))
    if f1_col:
        aggs.append(F.avg(f1_col).alias("token_f1"))
    if with_bleu:
        aggs.extend(bleu_sums())
    out = tagged.groupBy(*gc, "bucket").agg(*aggs)
    if with_bleu:
        out = out.withColumn("bleu", bleu_from_sums()).drop(*[f"S_{c}" for c in STAT_COLS])
    return out


def as_report_array(buckets_df: DataFrame, group_cols: list[str] | None = None) -> DataFrame:
    """Collapse per-bucket rows to the report shape ``length_buckets: array<struct>``
    (ordered by bucket), one row per group."""
    group_cols = group_cols or []
    fields = ["min_tokens", "max_tokens", "avg_ref_tokens", "bleu", "token_f1", "samples"]
    s = F.struct(F.col("bucket"), *[F.col(f) for f in fields])
    return buckets_df.groupBy(*group_cols).agg(F.array_sort(F.collect_list(s)).alias("__b")).select(
        *group_cols, F.transform("__b", lambda x: F.struct(*[x[f].alias(f) for f in fields])).alias("length_buckets")
    )
