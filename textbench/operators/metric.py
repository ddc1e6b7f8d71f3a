"""One contract for metrics: additive per-row statistics, their sums, a finish.

A :class:`Metric` names columns of per-row statistics; whoever computes it sums
them (with weights or not, per bucket, per replicate, per group of a stream)
and hands the sums to ``finish``.  Sums can be merged, so the same metric runs
as an aggregate with map-side combine, over bootstrap replicates and as the
state of a streaming aggregation.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textbench.operators.bleu import STAT_COLS, bleu_from


@dataclass(frozen=True)
class Metric:
    """``finish`` gets ``{column: sum}`` for ``columns`` and the number of
    rows (with weights, the weighted number) under ``"n"``."""

    name: str
    columns: tuple[str, ...]
    finish: Callable[[dict[str, Column]], Column]


BUILT_IN = {m.name: m for m in (
    Metric("f1", ("f1",), lambda s: s["f1"] / s["n"]),
    Metric("length", ("length",), lambda s: s["length"] / s["n"]),
    Metric("samples", (), lambda s: s["n"]),
    Metric("bleu", tuple(STAT_COLS), lambda s: bleu_from(lambda c: s[c].cast("double"))),
)}

_N = "__sum_n"


def resolve(metrics: list[str | Metric] | str | Metric) -> list[Metric]:
    out = []
    for m in [metrics] if isinstance(metrics, (str, Metric)) else metrics:
        if isinstance(m, str) and m not in BUILT_IN:
            raise ValueError(f"unknown metric {m}")
        out.append(BUILT_IN[m] if isinstance(m, str) else m)
    return out


def statistics(metrics: list[Metric]) -> list[str]:
    """The columns that the metrics sum, each once."""
    return list(dict.fromkeys(c for m in metrics for c in m.columns))


def sums(metrics: list[Metric], weight: Column | None = None, rows: Column | None = None) -> list[Column]:
    """Aggregates for all metrics: the (weighted) sum of each statistic and of
    the rows (``rows``: how many a row stands for)."""
    one = F.lit(1).cast("long") if rows is None else rows
    w = (lambda c: c) if weight is None else (lambda c: weight * c)
    return [F.sum(w(F.col(c))).alias(f"__sum_{c}") for c in statistics(metrics)] + [F.sum(w(one)).alias(_N)]


def finished(metrics: list[Metric], prefix: str = "") -> list[Column]:
    """Each metric from the columns that :func:`sums` made."""
    have = {c: F.col(f"__sum_{c}") for c in statistics(metrics)}
    return [m.finish({**{c: have[c] for c in m.columns}, "n": F.col(_N)}).alias(prefix + m.name) for m in metrics]


def metric_table(stats: DataFrame, metrics: list[str | Metric] | str | Metric, group_cols: list[str] | None = None) -> DataFrame:
    """The metrics per group (of a table or of a stream)."""
    ms, gc = resolve(metrics), list(group_cols or [])
    return stats.groupBy(*gc).agg(*sums(ms)).select(*gc, *finished(ms))
