"""Cross-experiment reporting over evaluation reports.

Input is the report shape ``experiment, length_buckets: array<struct>``
(one row per experiment, as read by SRC6 or built by A6); all outputs are
small grouped tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def bucket_table(reports: DataFrame) -> DataFrame:
    """A10: one row per (experiment, bucket); buckets without BLEU are skipped."""
    x = reports.select("experiment", F.posexplode("length_buckets").alias("bucket", "b"))
    return x.filter(F.col("b.bleu").isNotNull()).select(
        "experiment", "bucket", F.col("b.min_tokens").alias("min_tokens"), F.col("b.max_tokens").alias("max_tokens"),
        F.col("b.avg_ref_tokens").alias("avg_tokens"), F.col("b.bleu").alias("bleu"),
        F.col("b.token_f1").alias("token_f1"), F.col("b.samples").alias("samples"))


def experiment_summary(table: DataFrame) -> DataFrame:
    """Per experiment mean bucket length, BLEU and F1 and bucket count, sorted."""
    return table.groupBy("experiment").agg(
        F.avg("avg_tokens").alias("mean_ref_tokens"), F.avg("bleu").alias("mean_bleu"),
        F.avg("token_f1").alias("mean_token_f1"), F.count(F.lit(1)).alias("n_buckets"),
    ).orderBy("experiment")


def short_long_export(table: DataFrame, threshold: float = 50.0) -> DataFrame:
    """Buckets split at ``threshold`` mean tokens into short/long text,
    then per (label, experiment) the bucket-ordered series."""
    lab = F.when(F.col("avg_tokens") < threshold, "short_text").otherwise("long_text")
    pts = F.struct("bucket", "avg_tokens", "bleu", "token_f1")
    g = table.withColumn("label", lab).groupBy("label", "experiment").agg(F.array_sort(F.collect_list(pts)).alias("s"))
    return g.select("label", "experiment", F.transform("s", lambda p: F.struct(
        p["bucket"].alias("bucket"), p["avg_tokens"].alias("avg_tokens"), p["bleu"].alias("bleu"), p["token_f1"].alias("token_f1"))).alias("series"))


def bleu_trend(table: DataFrame) -> DataFrame:
    """Per experiment ``min-max`` token range and ``a -> b -> c`` BLEU trend (1 decimal)."""
    g = table.groupBy("experiment").agg(
        F.min("min_tokens").alias("lo"), F.max("max_tokens").alias("hi"),
        F.array_sort(F.collect_list(F.struct("bucket", "bleu"))).alias("s"))
    trend = F.array_join(F.transform("s", lambda p: F.replace(F.format_number(p["bleu"], 1), F.lit(","), F.lit(""))), " -> ")
    return g.select("experiment", F.concat_ws("-", F.col("lo").cast("string"), F.col("hi").cast("string")).alias("tokens_range"),
                    trend.alias("trend"))


def prefix_sweep(pairs: DataFrame, ks: list[int], words_per_k: int = 8, group_col: str = "adapter",
                 length_col: str = "length") -> DataFrame:
    """A14's input: per (adapter, K) the BLEU and token F1 of predictions cut to
    their first ``words_per_k * K`` words, and the compression (mean reference
    length / K).

    ``pairs``: id, prediction, reference, ``length_col`` and ``group_col``.  All
    budgets come out of one pass over the texts, as columns of one row per
    pair; they are summed side by side and become rows only as one row per
    (adapter, K)."""
    from textbench.operators.bleu import STAT_COLS, bleu_from_sums, bleu_prefix_stats
    from textbench.operators.metrics import prefix_token_f1

    budgets = {k: k * words_per_k for k in ks}
    f1 = [f"b{b}_f1" for b in budgets.values()]
    p = prefix_token_f1(pairs, list(budgets.values()))
    st = bleu_prefix_stats(p, list(budgets.values()), keep=[group_col, length_col, *f1])
    sums = [F.sum(f"b{b}_{c}").cast("double").alias(f"b{b}_{c}") for b in budgets.values() for c in STAT_COLS]
    g = st.groupBy(group_col).agg(*sums, *[F.avg(c).alias(c) for c in f1], F.avg(length_col).alias("__len"))
    rows = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"b{b}_f1").alias("token_f1"),
                                        *[F.col(f"b{b}_{c}").alias(f"S_{c}") for c in STAT_COLS]) for k, b in budgets.items()]))
    x = g.select(group_col, "__len", rows.alias("s")).select(group_col, "__len", "s.*")
    return x.select(group_col, "k", bleu_from_sums().alias("bleu"), "token_f1", (F.col("__len") / F.col("k")).alias("compression"))


def best_k(sweep: DataFrame, group_col: str = "adapter") -> DataFrame:
    """Per adapter type the K with the best BLEU, with its F1 and compression."""
    best = F.max_by(F.struct("k", "bleu", "token_f1", "compression"), "bleu")
    return sweep.groupBy(group_col).agg(best.alias("b")).select(
        group_col, "b.k", "b.bleu", "b.token_f1", "b.compression")


def length_quality_corr(points: DataFrame, x: str = "avg_tokens", y: str = "bleu",
                        group_col: str = "experiment") -> DataFrame:
    """Pearson r of bucket length vs. quality per experiment."""
    return points.groupBy(group_col).agg(F.corr(x, y).alias("pearson_r"), F.count(F.lit(1)).alias("points"))


def cross_domain(stats: DataFrame, train_col: str, eval_col: str, metrics=("bleu", "f1")) -> DataFrame:
    """A18 from per-row statistics: one row per (train, eval) pair with the metrics
    of its rows (any of the library's contract) and their number."""
    from textbench.operators.metric import metric_table

    return metric_table(stats, [*metrics, "samples"], [train_col, eval_col])


def cross_domain_cells(results: DataFrame, train_col: str, eval_col: str, value_col: str) -> DataFrame:
    """A18 in long form: one row per (train, eval) pair that occurs, whatever
    the number of domains."""
    return results.groupBy(train_col, eval_col).agg(F.max(value_col).alias(value_col))


def cross_domain_matrix(results: DataFrame, train_col: str, eval_col: str, value_col: str | list[str],
                        eval_values: list[str] | None = None) -> DataFrame:
    """Train domain x eval domain matrix of one metric, or of several with a
    list (columns ``<eval>_<metric>``).  Pass ``eval_values`` to skip the job
    that lists the distinct domains."""
    values = [value_col] if isinstance(value_col, str) else list(value_col)
    return results.groupBy(train_col).pivot(eval_col, eval_values).agg(*[F.first(v).alias(v) for v in values])
