"""SNK1-SNK4: result, report, JSON-lines and table sinks.

All writes go through Spark's commit protocol (a task retry or a lost
executor never leaves partial files visible), from the executors, in
parallel; nothing is gathered on the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame


def write_results(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """SNK1: prediction tables (prompt/query, prediction, reference, ...) as Parquet."""
    df.write.mode(mode).parquet(path)


def write_report(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """SNK2: metric records (nested bucket arrays included) as JSON."""
    df.write.mode(mode).json(path)


def write_jsonl(df: DataFrame, path: str) -> None:
    """SNK3: append records (trajectories, chat examples) as JSON lines;
    each call adds new files, as the reference appends lines."""
    df.write.mode("append").json(path)


def write_table(df: DataFrame, path: str, fmt: str = "csv", mode: str = "overwrite") -> None:
    """SNK4: a small report table as CSV (with header) or JSON."""
    w = df.write.mode(mode)
    if fmt == "csv":
        w.option("header", True).csv(path)
    elif fmt == "json":
        w.json(path)
    else:
        raise ValueError(f"unsupported table format {fmt}")


def write_layout(df: DataFrame, path: str, folders: list[str], sort: list[str], mode: str = "overwrite") -> None:
    """Parquet laid out for pruned scans: a folder per value of ``folders`` (a
    filter on them lists only its own) and files sorted by ``sort``, whose row
    groups have narrow ranges that a filter can skip.  A large folder is written
    by many tasks, each with a range of its own."""
    order = [*folders, *sort]
    (df.repartitionByRange(*order).sortWithinPartitions(*order)
     .write.mode(mode).partitionBy(*folders).parquet(path))
