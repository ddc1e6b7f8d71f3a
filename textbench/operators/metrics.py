"""Row-level text metrics and their aggregates.

A metric is (per-row statistics, aggregate columns, finish expression), so
the same metric can be computed overall, per group, per length bucket, per
bootstrap replicate or over a stream.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textbench.functions.text import normalize_ws, words


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def token_f1_col(pred, ref) -> Column:
    """A2 per row: F1 of the *sets* of whitespace tokens; 0 if either side is empty.

    Nothing that walks a text stands behind a condition: Spark shares equal parts of
    an expression only where they are always evaluated, so each text is split once."""
    p = F.array_distinct(words(_c(pred)))
    r = F.array_distinct(words(_c(ref)))
    common = F.size(F.array_intersect(p, r)).cast("double")
    precision = common / F.greatest(F.size(p), F.lit(1))
    recall = common / F.greatest(F.size(r), F.lit(1))
    f1 = 2 * precision * recall / F.greatest(precision + recall, F.lit(1e-300))  # without a common token 0 / 1e-300
    return F.coalesce(f1, F.when((F.size(p) == 0) | (F.size(r) == 0), F.lit(0.0)))  # a null text beside an empty one


def f1_of_counts(common: Column, pred: Column, ref: Column) -> Column:
    """F1 from the sizes of two sets and of what they share; 0 if any is 0."""
    precision, recall = common.cast("double") / pred, common.cast("double") / ref
    return F.when((pred == 0) | (ref == 0) | (common == 0), F.lit(0.0)).otherwise(2 * precision * recall / (precision + recall))


def prefix_token_f1(df: DataFrame, budgets: list[int], pred: str = "prediction", ref: str = "reference") -> DataFrame:
    """``df`` with ``b<b>_f1``: token F1 of the first ``b`` words of ``pred`` for
    every budget.  The two word sets meet once, for the largest budget; the
    smaller ones are compared with what that left."""
    out = df.withColumn("__w", F.slice(words(_c(pred)), 1, max(budgets))).withColumn("__r", F.array_distinct(words(_c(ref))))
    out = out.withColumn("__n", F.size("__r")).withColumn("__r", F.array_intersect("__w", "__r"))
    for b in budgets:
        own = F.array_distinct(F.slice("__w", 1, b))
        out = out.withColumn(f"b{b}_f1", f1_of_counts(F.size(F.array_intersect(own, "__r")), F.size(own), F.col("__n")))
    return out.drop("__w", "__r", "__n")


def exact_match_col(pred, ref) -> Column:
    """A1 per row: equality after whitespace normalisation."""
    return normalize_ws(_c(pred)) == normalize_ws(_c(ref))


def token_f1(df: DataFrame, pred: str = "prediction", ref: str = "reference",
             group_cols: list[str] | None = None) -> DataFrame:
    """A2: macro-mean token F1 (null for an empty group: the reference's NaN)."""
    group_cols = group_cols or []
    return df.groupBy(*group_cols).agg(
        F.avg(token_f1_col(pred, ref)).alias("token_f1"),
        F.count(F.lit(1)).alias("samples"),
    )


def exact_match(df: DataFrame, pred: str = "prediction", ref: str = "reference",
                refusal: str = "is_refusal", group_cols: list[str] | None = None) -> DataFrame:
    """A1: exact match overall, on positives and on refusals, with counts;
    an empty subset scores 0.0."""
    group_cols = group_cols or []
    em = F.when(exact_match_col(pred, ref), 1.0).otherwise(0.0)
    is_ref = F.col(refusal)
    return df.groupBy(*group_cols).agg(
        F.count(F.lit(1)).alias("samples"),
        F.sum(F.when(~is_ref, 1).otherwise(0)).cast("long").alias("positive_samples"),
        F.sum(F.when(is_ref, 1).otherwise(0)).cast("long").alias("refusal_samples"),
        F.coalesce(F.avg(em), F.lit(0.0)).alias("exact_match"),
        F.coalesce(F.avg(F.when(~is_ref, em)), F.lit(0.0)).alias("positive_exact_match"),
        F.coalesce(F.avg(F.when(is_ref, em)), F.lit(0.0)).alias("refusal_accuracy"),
    )


def selection_report(df: DataFrame, pred: str = "prediction", ref: str = "reference",
                     refusal: str = "is_refusal", group_cols: list[str] | None = None) -> DataFrame:
    """The selection evaluation record (A1 + A2 with counts) in one pass."""
    group_cols = group_cols or []
    em = F.when(exact_match_col(pred, ref), 1.0).otherwise(0.0)
    is_ref = F.col(refusal)
    return df.groupBy(*group_cols).agg(
        F.count(F.lit(1)).alias("samples"),
        F.sum(F.when(~is_ref, 1).otherwise(0)).cast("long").alias("positive_samples"),
        F.sum(F.when(is_ref, 1).otherwise(0)).cast("long").alias("refusal_samples"),
        F.coalesce(F.avg(em), F.lit(0.0)).alias("exact_match"),
        F.coalesce(F.avg(F.when(~is_ref, em)), F.lit(0.0)).alias("positive_exact_match"),
        F.coalesce(F.avg(F.when(is_ref, em)), F.lit(0.0)).alias("refusal_accuracy"),
        F.avg(token_f1_col(pred, ref)).alias("token_f1"),
    )


def length_bias(df: DataFrame, pred: str = "prediction", ref: str = "reference",
                group_cols: list[str] | None = None) -> DataFrame:
    """Mean output length vs. mean target length (whitespace words)."""
    group_cols = group_cols or []
    return df.groupBy(*group_cols).agg(
        F.avg(F.size(words(pred))).alias("mean_pred_words"),
        F.avg(F.size(words(ref))).alias("mean_ref_words"),
        (F.avg(F.size(words(pred))) / F.avg(F.size(words(ref)))).alias("length_ratio"),
        F.count(F.lit(1)).alias("samples"),
    )
