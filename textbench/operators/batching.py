"""BAT1-3, TXT9, A19, A20: training batch plans, padding and logging windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textbench.functions.hashing import hash_bits
from textbench.operators.ranking import two_level_rank


def batch_plan(df: DataFrame, key: str, batch_size: int, epochs: int, seed: int = 42,
               resume_step: int = 0, save_every: int | None = None) -> DataFrame:
    """BAT1: per epoch a seeded permutation cut into batches.

    Adds ``epoch``, ``batch_index``, ``global_step`` (1-based,
    ``epoch * steps_per_epoch + batch_index + 1``, ``steps_per_epoch =
    ceil(n / batch_size)``) and, with ``save_every``, ``is_checkpoint``
    (A20).  Steps ``<= resume_step`` are dropped.  The permutation hashes
    (seed, epoch, key), so a resumed run continues with the same order.
    """
    ep = df.select("*", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))).alias("epoch"))
    # one global order over (epoch, hash): epoch in the high bits
    ep = ep.withColumn("__ok", F.col("epoch").cast("long") * F.lit(1 << 32) + hash_bits(seed, F.col("epoch"), F.col(key)))
    ranked = two_level_rank(ep, "__ok", key, "__r", total_col="__nn")
    n = F.col("__nn") / F.lit(epochs)
    pos = F.col("__r") - F.col("epoch") * n
    spe = F.ceil(n / F.lit(batch_size))
    out = (
        ranked.withColumn("batch_index", F.floor(pos / batch_size).cast("long"))
        .withColumn("global_step", (F.col("epoch") * spe + F.col("batch_index") + 1).cast("long"))
        .filter(F.col("global_step") > resume_step)
    )
    if save_every:
        out = out.withColumn("is_checkpoint", F.col("global_step") % save_every == 0)
    return out.drop("__ok", "__r", "__nn")


def pad_batches(df: DataFrame, batch_col: str, tokens_col: str, pad_id: int = 0, ignore_label: int = -100,
                label_col: str | None = None) -> DataFrame:
    """BAT2: pad every row to its batch's longest row: ``input_ids``,
    ``attention_mask`` (1/0) and ``labels`` (-100 on padding).  Batches are
    bounded by the batch size, so the per-batch window is small."""
    w = Window.partitionBy(batch_col)
    toks = F.col(tokens_col)
    labels = F.col(label_col) if label_col else toks
    out = df.withColumn("__max", F.max(F.size(toks)).over(w)).withColumn("__pad", F.col("__max") - F.size(toks))
    return out.select(
        "*",
        F.concat(toks, F.array_repeat(F.lit(pad_id), F.col("__pad").cast("int"))).alias("input_ids"),
        F.concat(F.array_repeat(F.lit(1), F.size(toks)), F.array_repeat(F.lit(0), F.col("__pad").cast("int"))).alias(
            "attention_mask"),
        F.concat(labels, F.array_repeat(F.lit(ignore_label), F.col("__pad").cast("int"))).alias("labels"),
    ).drop("__max", "__pad")


def length_bucketed_batches(df: DataFrame, key: str, length_col: str, batch_size: int) -> DataFrame:
    """BAT3: batches of rows with similar length (rank by length // size);
    adds ``batch_id`` and ``padding`` (tokens wasted by padding this row)."""
    ranked = two_level_rank(df, length_col, key, "__r")
    out = ranked.withColumn("batch_id", F.floor(F.col("__r") / batch_size).cast("long")).drop("__r")
    w = Window.partitionBy("batch_id")
    return out.withColumn("padding", (F.max(length_col).over(w) - F.col(length_col)).cast("long"))


def padding_report(batches: DataFrame, length_col: str) -> DataFrame:
    """Total real tokens, padding tokens and waste ratio of a batching."""
    return batches.groupBy().agg(
        F.count(F.lit(1)).alias("rows"),
        F.countDistinct("batch_id").alias("batches"),
        F.sum(length_col).cast("long").alias("tokens"),
        F.sum("padding").cast("long").alias("padding"),
        (F.sum("padding") / (F.sum("padding") + F.sum(length_col))).alias("waste"),
    )


def running_sum(df: DataFrame, group_col: str, order_col: str, value_col: str, out_col: str,
                block: int = 65536) -> DataFrame:
    """Inclusive running sum of ``value_col`` per group in ``order_col``
    order (numeric, e.g. a turn number), skew-safe: rows are cut into blocks
    of ``block`` consecutive order values; block totals are prefix-summed
    over the small (group, block) table and each block is summed on its own,
    so even a group holding a third of the table never lands in one task."""
    b = F.floor(F.col(order_col) / F.lit(block)).cast("long")
    d = df.withColumn("__blk", b)
    tot = d.groupBy(group_col, "__blk").agg(F.sum(value_col).alias("__bt"))
    wb = Window.partitionBy(group_col).orderBy("__blk").rowsBetween(Window.unboundedPreceding, -1)
    offs = tot.withColumn("__boff", F.coalesce(F.sum("__bt").over(wb), F.lit(0))).drop("__bt")
    w = Window.partitionBy(group_col, "__blk").orderBy(order_col).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (d.join(offs, [group_col, "__blk"], "inner")
            .withColumn(out_col, F.col("__boff") + F.sum(value_col).over(w)).drop("__blk", "__boff"))


def assistant_label_spans(msgs: DataFrame, conv_col: str, turn_col: str, role_col: str, length_col: str,
                          max_len: int = 2048) -> DataFrame:
    """TXT9: per message its token span ``[start, end)`` in the concatenated
    conversation (running sum of lengths), clipped at ``max_len``; only
    assistant spans are supervised."""
    out = running_sum(msgs, conv_col, turn_col, length_col, "__end").withColumn(
        "__start", F.col("__end") - F.col(length_col))
    return out.select(
        "*",
        F.least(F.col("__start"), F.lit(max_len)).cast("long").alias("start"),
        F.least(F.col("__end"), F.lit(max_len)).cast("long").alias("end"),
        (F.col(role_col) == "assistant").alias("supervised"),
    ).withColumn(
        "supervised_tokens", F.when(F.col("supervised"), F.col("end") - F.col("start")).otherwise(F.lit(0)).cast("long")
    ).drop("__end", "__start")


def windowed_loss(log: DataFrame, step_col: str, value_col: str, every: int, group_cols: list[str] | None = None) -> DataFrame:
    """Mean of a step-keyed metric per window of ``every`` steps
    (steps 1..N, N+1..2N, ...); only complete windows are emitted."""
    group_cols = group_cols or []
    win = F.floor((F.col(step_col) - 1) / every).cast("long")
    out = log.groupBy(*group_cols, win.alias("window")).agg(
        F.avg(value_col).alias("avg_loss"), F.count(F.lit(1)).alias("n"), F.max(step_col).alias("end_step"))
    return out.filter(F.col("n") == every).drop("n")


def checkpoint_steps(plan: DataFrame, save_every: int) -> Column:
    """Which global steps persist state."""
    return F.col("global_step") % save_every == 0
