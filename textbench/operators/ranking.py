"""Exact, dense, 0-based ranks without a one-partition window.

``Window.orderBy(...)`` with no ``partitionBy`` pulls every row into one
task.  Instead the rows are cut at sampled range bounds
(``repartitionByRange``), sorted inside each slice and written once to the
shared folder with their place in the slice.  A row's position is that place
plus the rows of all earlier slices; the offsets are one number per slice, so
what is broadcast is as small as the number of partitions.

The order is any list of orderable columns (numbers of any spread, doubles,
strings, dates, binary), ascending with nulls first.  The bounds are drawn from
the whole order, tiebreaks included, and rows equal in all of it are told
apart by their place in the stored input; so a key that a third of the rows
hold is cut like any other stretch, and a rank among its rows is as exact as
elsewhere.

Callers that only need to know which contiguous rank range a row falls in use
:func:`label_by_rank` in ``buckets``, which needs no shuffle of the rows at all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textbench.functions.hashing import with_scalars
from textbench.session import written

DEFAULT_TARGET_ROWS = 1_000_000
PLACE_BITS = 33  # of monotonically_increasing_id: the number of a row in its partition

_AT, _SLICE, _TIE = "__rk_at", "__rk_slice", "__rk_tie"


def range_sorted(df: DataFrame, order: list[str], target_rows: int = DEFAULT_TARGET_ROWS, stored: bool = False,
                 without: tuple[str, ...] = ()) -> DataFrame:
    """The rows of ``df`` in slices of ``order``, written to the shared folder,
    with ``__rk_slice`` (ascending with the order) and ``__rk_at`` (a row's
    place in its slice).  Slices hold about ``target_rows`` rows or fewer: there are
    at least as many as ``spark.sql.shuffle.partitions``.

    The input is written first, so that sampling does not compute it twice and
    the last tiebreak (a row's place in the input) is the same whenever a task
    is repeated; with ``stored`` it is such a table already.  Columns ``without``
    take part in the order and are then left out."""
    if not stored:
        df = written(df, "rank-rows")
    spark = df.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-df.count() // target_rows))
    rows = df.withColumn(_TIE, F.monotonically_increasing_id())
    cols = [F.col(f"`{c}`") for c in order] + [F.col(_TIE)]
    rows = rows.repartitionByRange(n, *cols).sortWithinPartitions(*cols).drop(_TIE, *without)
    rows = written(rows.withColumn(_AT, F.monotonically_increasing_id()), "rank-sorted")
    return rows.withColumn(_SLICE, F.shiftright(_AT, PLACE_BITS).cast("int")).withColumn(
        _AT, F.col(_AT).bitwiseAND(F.lit((1 << PLACE_BITS) - 1)))


def with_position(rows: DataFrame, rank_col: str, total_col: str | None = None) -> DataFrame:
    """``range_sorted`` rows with their position in the whole order (and the
    number of all rows) in place of the slice columns."""
    counts = rows.groupBy(_SLICE).agg(F.count(F.lit(1)).alias("__n"))
    # one row per slice: its size is the number of partitions
    w = Window.orderBy(_SLICE)
    offsets = counts.select(F.col(_SLICE), (F.sum("__n").over(w) - F.col("__n")).alias("__off"),
                            F.sum("__n").over(Window.partitionBy()).alias("__total"))
    out = rows.join(F.broadcast(offsets), _SLICE).withColumn(rank_col, F.col("__off") + F.col(_AT))
    if total_col:
        out = out.withColumn(total_col, F.col("__total"))
    return out.drop(_SLICE, _AT, "__off", "__total")


def range_rank(df: DataFrame, order: list[str], rank_col: str = "rank", total_col: str | None = None,
               partition_cols: list[str] | None = None, target_rows: int = DEFAULT_TARGET_ROWS,
               stored: bool = False, without: tuple[str, ...] = ()) -> DataFrame:
    """Add ``rank_col``: the exact 0-based position of each row in ``order``
    (within ``partition_cols``, where nulls are a partition), and optionally
    the number of rows as ``total_col``.  A partition's rows are consecutive in
    the whole order, so its ranks are positions less its first position: a hot
    partition is spread over slices as any other rows."""
    pc = list(partition_cols or [])
    rows = range_sorted(df, [*pc, *order], target_rows, stored, without)
    if not pc:
        return with_position(rows, rank_col, total_col)
    at = with_position(rows, "__pos")
    first = at.groupBy(*[F.col(f"`{c}`").alias(f"__p{i}") for i, c in enumerate(pc)]).agg(
        F.min("__pos").alias("__first"), F.count(F.lit(1)).alias("__count"))
    same = F.lit(True)
    for i, c in enumerate(pc):
        same = same & F.col(f"`{c}`").eqNullSafe(F.col(f"__p{i}"))
    out = at.join(first, same).withColumn(rank_col, F.col("__pos") - F.col("__first"))
    if total_col:
        out = out.withColumn(total_col, F.col("__count"))
    return out.drop("__pos", "__first", "__count", *[f"__p{i}" for i in range(len(pc))])


def two_level_rank(
    df: DataFrame,
    key: str,
    tiebreak: str,
    rank_col: str = "rank",
    target_rows: int = DEFAULT_TARGET_ROWS,
    total_col: str | None = None,
    partition_cols: list[str] | None = None,
) -> DataFrame:
    """Ranks by (key, tiebreak): slices first, places inside a slice second."""
    return range_rank(df, [key, tiebreak], rank_col, total_col, partition_cols, target_rows)


def dense_index(df: DataFrame, id_col: str, idx_col: str = "idx", target_rows: int = DEFAULT_TARGET_ROWS,
                total_col: str | None = None) -> DataFrame:
    """0-based dense position of each row in ``id_col`` order, for ids of any
    type and spread."""
    return range_rank(df, [id_col], idx_col, total_col, target_rows=target_rows)


def rank_cuts(keys: DataFrame, key: str, tiebreak: str, label_fn, partition_cols: list[str] | None = None,
              target_rows: int = DEFAULT_TARGET_ROWS) -> DataFrame:
    """Where a label that is monotone in the (key, tiebreak) rank begins: per
    partition one row with ``__cuts``, the ordered array of (k, t, lab) of the
    first row of each label.  ``label_fn(rank, total)`` gives the label; there
    are as many cuts as labels, however many rows."""
    pc = list(partition_cols or [])
    ranked = range_rank(keys.select(*dict.fromkeys([*pc, key, tiebreak])), [key, tiebreak], "__r", "__n", pc, target_rows)
    lab = label_fn(F.col("__r"), F.col("__n"))
    begins = (F.col("__r") == 0) | (lab != label_fn(F.col("__r") - 1, F.col("__n")))
    cut = F.struct(F.col(key).alias("k"), F.col(tiebreak).alias("t"), lab.alias("lab"))
    return ranked.where(begins).groupBy(*pc).agg(F.array_sort(F.collect_list(cut)).alias("__cuts"))


def label_at(key: Column, tiebreak: Column, cuts: Column) -> Column:
    """The label of the last cut that is not after (key, tiebreak)."""
    me = F.struct(key.alias("k"), tiebreak.alias("t"))
    upto = F.filter(cuts, lambda c: F.struct(c["k"].alias("k"), c["t"].alias("t")) <= me)
    return F.try_element_at(upto, F.lit(-1))["lab"]


def attach_cuts(df: DataFrame, cuts: DataFrame, partition_cols: list[str]) -> DataFrame:
    """``df`` with the ``__cuts`` of its partition (of all rows without one)."""
    if not partition_cols:
        return with_scalars(df, cuts)
    side = cuts.select("__cuts", *[F.col(f"`{c}`").alias(f"__p{i}") for i, c in enumerate(partition_cols)])
    same = F.lit(True)
    for i, c in enumerate(partition_cols):
        same = same & F.col(f"`{c}`").eqNullSafe(F.col(f"__p{i}"))
    return df.join(side, same).drop(*[f"__p{i}" for i in range(len(partition_cols))])
