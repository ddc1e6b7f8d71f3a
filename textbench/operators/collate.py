"""Collation (with BAT1, BAT2, SMP5, TXT6, JN2): batches as dense padded arrays.

One output row is one batch: token ids and attention mask padded to the
batch's longest row, prompt lengths, and the vectors and texts of its rows in
order.  A batch is planned from ids alone; texts and vectors move once, to
their batch, where at most ``batch_size`` rows meet.  Everything is a column
expression; the tokenizer is a column function from text to ``array<int>``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textbench.functions.text import MAX_TOKENS, message, regex_tokens, render_prompt
from textbench.operators.batching import batch_plan
from textbench.operators.splits import random_truncate

VOCABULARY = 32000


def hashed_token_ids(text, vocabulary: int = VOCABULARY) -> Column:
    """The default tokenizer's tokens as ids from 1 to ``vocabulary`` (0 pads),
    each by the first 24 bits of its md5."""
    return F.transform(regex_tokens(text), lambda t: (
        F.conv(F.substring(F.md5(t), 1, 6), 16, 10).cast("int") % vocabulary + 1))


def collate(rows: DataFrame, batch_cols: list[str], order_cols: list[str], tokens_col: str, carry: dict[str, str],
            pad_id: int = 0) -> DataFrame:
    """One row per batch: ``batch_cols``, ``rows``, ``width``, ``input_ids`` and
    ``attention_mask`` (``rows`` arrays of ``width`` values each) and, for every
    ``carry`` entry, an array with that column of each row.  Rows are ordered
    by ``order_cols``; a null token array is an empty one."""
    tokens = F.coalesce(F.col(tokens_col), F.array().cast("array<int>"))
    item = F.struct(F.struct(*order_cols).alias("o"), tokens.alias("t"), *[F.col(c).alias(f"c{i}") for i, c in enumerate(carry.values())])
    first = lambda a, b: F.when(a["o"] < b["o"], -1).when(a["o"] > b["o"], 1).otherwise(0)
    g = rows.groupBy(*batch_cols).agg(F.array_sort(F.collect_list(item), first).alias("__b"))
    g = g.withColumn("width", F.array_max(F.transform("__b", lambda x: F.size(x["t"]))))
    pad = lambda x: F.col("width") - F.size(x["t"])
    return g.select(
        *batch_cols, F.size("__b").alias("rows"), "width",
        F.transform("__b", lambda x: F.concat(x["t"], F.array_repeat(F.lit(pad_id), pad(x)))).alias("input_ids"),
        F.transform("__b", lambda x: F.concat(F.array_repeat(F.lit(1), F.size(x["t"])), F.array_repeat(F.lit(0), pad(x)))).alias("attention_mask"),
        *[F.col(f"__b.c{i}").alias(n) for i, n in enumerate(carry)])


def _prompts(user: Column, target: Column, system: str | None, bos: str, eos: str, generate: bool) -> tuple[Column, Column]:
    """(whole prompt, prompt without the target) of the fallback chat template."""
    head = ([message(F.lit("system"), F.lit(system))] if system else []) + [message(F.lit("user"), user)]
    alone = render_prompt(F.array(*head), bos, eos)
    whole = render_prompt(F.array(*head), bos, eos, True) if generate else render_prompt(
        F.array(*head, message(F.lit("assistant"), F.coalesce(target, F.lit("")))), bos, eos)
    return whole, alone


def training_batches(corpus: DataFrame, vectors: DataFrame, batch_size: int, epochs: int = 1, seed: int = 42,
                     user_prompt: str = "", system_prompt: str | None = None, min_tokens: int | None = None,
                     max_tokens: int = MAX_TOKENS, tokenizer=hashed_token_ids, include_text: bool = True,
                     resume_step: int = 0, id_col: str = "doc_id", bos: str = "", eos: str = "") -> DataFrame:
    """One row per training step: ``epoch, batch_index, global_step``, the arrays of
    :func:`collate`, ``prefix_lengths`` (prompt tokens before the text, not
    truncated), ``ids`` and ``embeddings`` (null for a row without a vector).

    Token rows are cut to ``max_tokens``, or with ``min_tokens`` to one random
    cap per step.  ``include_text=False`` gives generation prompts."""
    plan = batch_plan(corpus.select(id_col), id_col, batch_size, epochs, seed, resume_step)
    whole, alone = _prompts(F.lit(user_prompt), F.col("text"), system_prompt, bos, eos, not include_text)
    rows = plan.join(corpus.select(id_col, "text"), id_col).join(vectors.select(id_col, "embedding"), id_col, "left")
    rows = rows.withColumn("__t", random_truncate(tokenizer(whole), F.col("global_step"), seed, min_tokens, max_tokens))
    rows = rows.withColumn("__p", F.size(tokenizer(alone)).cast("long"))
    return collate(rows, ["epoch", "batch_index", "global_step"], [id_col], "__t",
                   {"prefix_lengths": "__p", "ids": id_col, "embeddings": "embedding"})


def selection_batches(examples: DataFrame, gathered: DataFrame, batch_size: int, max_tokens: int = MAX_TOKENS,
                      system_prompt: str | None = None, tokenizer=hashed_token_ids, include_text: bool = True,
                      sample_col: str = "sample_id", bos: str = "", eos: str = "") -> DataFrame:
    """One row per batch of ``batch_size`` consecutive sample ids: ``batch``, the
    arrays of :func:`collate`, ``prefix_lengths`` (cut to ``max_tokens``),
    ``embeddings`` and ``doc_mask`` (padded to the documents' slots), ``targets``,
    ``queries``, ``is_refusal`` and ``doc_counts``.

    ``examples`` as of SEL1, ``gathered`` as of JN2 (doc_embeddings, doc_mask
    per sample)."""
    whole, alone = _prompts(F.col("query"), F.col("target_text"), system_prompt, bos, eos, not include_text)
    rows = examples.join(gathered.select(sample_col, "doc_embeddings", "doc_mask"), sample_col)
    rows = rows.withColumn("batch", F.floor(F.col(sample_col) / batch_size).cast("long"))
    rows = rows.withColumn("__t", F.slice(tokenizer(whole), 1, max_tokens))
    rows = rows.withColumn("__p", F.least(F.size(tokenizer(alone)), F.lit(max_tokens)).cast("long"))
    return collate(rows, ["batch"], [sample_col], "__t", {
        "prefix_lengths": "__p", "embeddings": "doc_embeddings", "doc_mask": "doc_mask", "targets": "target_text",
        "queries": "query", "is_refusal": "is_refusal", "doc_counts": "doc_count"})
