"""PK1-PK5: chunking documents into several embeddings and picking budgets.

Chunks are computed inside each row with ``sequence``/``slice``; summaries
are small (one row per configuration), so the frontier windows run over a
handful of rows per group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def uniform_chunks(tokens: Column, m: int | Column) -> Column:
    """PK1: ``m`` contiguous segments of near-equal token count
    (segment i = tokens[floor(i*n/m) : floor((i+1)*n/m)])."""
    mm = F.lit(m) if isinstance(m, int) else m
    n = F.size(tokens)
    start = lambda i: F.floor(i * n / mm).cast("int")
    return F.transform(F.sequence(F.lit(0), mm - 1),
                       lambda i: F.slice(tokens, start(i) + 1, start(i + 1) - start(i)))


def overlapping_chunks(tokens: Column, size: int, overlap: int) -> Column:
    """PK2: windows of ``size`` tokens advancing by ``size - overlap``; the
    last window ends at the text's end (one window for short texts)."""
    if not 0 <= overlap < size:
        raise ValueError("need 0 <= overlap < size")
    step = size - overlap
    n = F.size(tokens)
    count = F.when(n <= size, F.lit(1)).otherwise(F.lit(1) + F.ceil((n - size) / F.lit(step)).cast("int"))
    return F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.slice(tokens, i * step + 1, size))


def packing_ratio(chunked: DataFrame, chunks_col: str, group_cols: list[str]) -> DataFrame:
    """PK3: tokens per embedding and embeddings per document, per configuration."""
    per_doc = chunked.select(*group_cols, F.size(chunks_col).alias("__m"),
                             F.aggregate(chunks_col, F.lit(0), lambda a, c: a + F.size(c)).alias("__t"))
    return packing_ratio_of_counts(per_doc, "__t", "__m", group_cols)


def packing_ratio_of_counts(counts: DataFrame, tokens_col: str, chunks_col: str, group_cols: list[str]) -> DataFrame:
    """PK3 from token and chunk counts per document, without the chunks themselves."""
    return counts.groupBy(*group_cols).agg(
        (F.sum(tokens_col) / F.sum(chunks_col)).alias("tokens_per_embedding"),
        F.avg(chunks_col).alias("embeddings_per_doc"),
        F.count(F.lit(1)).alias("docs"),
    )


def pareto_frontier(summary: DataFrame, cost_col: str, quality_col: str, group_cols: list[str] | None = None) -> DataFrame:
    """PK4: configurations not dominated on (lower cost, higher quality):
    a row is kept when its quality beats every row of lower cost (or equal
    cost listed before it in quality order)."""
    gc = list(group_cols or [])
    w = Window.partitionBy(*gc).orderBy(F.col(cost_col), F.col(quality_col).desc()).rowsBetween(
        Window.unboundedPreceding, -1)
    best_before = F.max(quality_col).over(w)
    return summary.withColumn("__best", best_before).filter(
        F.col("__best").isNull() | (F.col(quality_col) > F.col("__best"))).drop("__best")


def min_budget(summary: DataFrame, cost_col: str, quality_col: str, tau: float = 0.95,
               group_cols: list[str] | None = None, baseline: Column | None = None) -> DataFrame:
    """PK5: smallest cost reaching ``tau`` x the baseline quality (default
    baseline: the best quality in the group)."""
    gc = list(group_cols or [])
    w = Window.partitionBy(*gc)
    base = baseline if baseline is not None else F.max(quality_col).over(w)
    s = summary.withColumn("__base", base)
    return s.filter(F.col(quality_col) >= F.lit(tau) * F.col("__base")).groupBy(*gc).agg(
        F.min(cost_col).alias("min_budget"), F.first("__base").alias("baseline_quality"))
