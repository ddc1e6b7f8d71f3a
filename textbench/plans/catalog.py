"""Registry of named queries: each is a Spark plan over the driver tables plus
(where the semantics are SQL-expressible) the DuckDB text of the same result.

Floating outputs are rounded to 6 places on both sides (sum order differs
between engines); arrays are rendered with ``array_join`` where compared.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return deco


def load_all() -> None:
    """Import every module that registers queries."""
    from textbench.plans import (  # noqa: F401
        q_metrics, q_splits, q_text, q_agent, q_selection, q_embed, q_reports, q_stream, q_collate,
    )
