"""Registered queries: collated training and selection batches."""

from __future__ import annotations

from pyspark.sql import functions as F

from textbench.functions.hashing import sql_hash_bits, sql_hash_uniform
from textbench.operators import collate as C
from textbench.operators import selection as SEL
from textbench.plans import sqlbits as S
from textbench.plans.catalog import register
from textbench.plans.fixtures import corpus, table, vectors
from textbench.plans.q_selection import CFG, SQL_SELECTION

PROMPT = "Reconstruct the document."


def _ids(text: str) -> str:
    return (f"list_transform({S.regex_tokens(text)}, lambda t: CAST('0x' || substr(md5(t), 1, 6) AS BIGINT) % {C.VOCABULARY} + 1)")


def _checksum(rows: str = "input_ids"):
    """Sum of id * place * row over a batch's padded ids, which depends on every position."""
    zero = F.lit(0).cast("long")
    row = F.transform(rows, lambda r, i: F.aggregate(F.transform(r, lambda x, j: x.cast("long") * (j + 1)), zero, lambda a, x: a + x) * (i + 1))
    return F.aggregate(row, zero, lambda a, x: a + x)


def _total(arrays: str):
    zero = F.lit(0).cast("long")
    return F.aggregate(F.transform(arrays, lambda r: F.aggregate(r, zero, lambda a, x: a + x)), zero, lambda a, x: a + x)


def _sum(array: str):
    return F.aggregate(array, F.lit(0).cast("long"), lambda a, x: a + x)


@register("bat2_training_batches", f"""
WITH e AS (SELECT doc_id, text, epoch, {sql_hash_bits(42, 'epoch', 'doc_id')} AS h FROM documents, range(0, 2) t(epoch)),
r AS (SELECT *, row_number() OVER (PARTITION BY epoch ORDER BY h, doc_id) - 1 AS r, count(*) OVER (PARTITION BY epoch) AS n FROM e),
p AS (SELECT *, CAST(floor(r / 16) AS BIGINT) AS batch_index, CAST(epoch * ceil(n / 16) + floor(r / 16) + 1 AS BIGINT) AS global_step FROM r),
t AS (SELECT *, {_ids(f"concat('user', chr(10), '{PROMPT}', chr(10), 'assistant', chr(10), text, chr(10))")} AS tok,
        CAST(24 + floor({sql_hash_uniform(42, "'trunc'", 'global_step')} * 73) AS BIGINT) AS cap,
        row_number() OVER (PARTITION BY global_step ORDER BY doc_id) AS pos FROM p),
c AS (SELECT epoch, batch_index, global_step, doc_id, pos, tok[1:cap] AS ids, len({S.regex_tokens(f"concat('user', chr(10), '{PROMPT}', chr(10))")}) AS pl FROM t),
v AS (SELECT vec_id, list_sum(embedding) AS s FROM embeddings)
SELECT epoch, batch_index, global_step, CAST(count(*) AS INTEGER) AS rows, CAST(max(len(ids)) AS INTEGER) AS width, CAST(sum(len(ids)) AS BIGINT) AS tokens,
       CAST(sum(pos * list_sum(list_transform(range(1, len(ids) + 1), lambda j: ids[j] * j))) AS BIGINT) AS checksum,
       CAST(sum(pl) AS BIGINT) AS prefix_tokens, CAST(sum(doc_id) AS BIGINT) AS id_sum, count(s) AS vectors, round(coalesce(sum(s), 0), 3) AS value_sum
FROM c LEFT JOIN v ON vec_id = doc_id GROUP BY epoch, batch_index, global_step
""")
def bat2_training_batches(spark, sf_dir):
    """2 epochs of batch 16, one random cap of 24 to 96 tokens per step, each row a whole collated batch."""
    b = C.training_batches(corpus(spark, sf_dir), vectors(spark, sf_dir), 16, 2, user_prompt=PROMPT, min_tokens=24, max_tokens=96)
    zero = F.lit(0.0).cast("double")
    values = F.aggregate(F.transform("embeddings", lambda e: F.coalesce(F.aggregate(e, zero, lambda a, x: a + x), zero)), zero, lambda a, x: a + x)
    return b.select("epoch", F.col("batch_index"), "global_step", "rows", "width", _total("attention_mask").alias("tokens"),
                    _checksum().alias("checksum"), _sum("prefix_lengths").alias("prefix_tokens"), _sum("ids").alias("id_sum"),
                    F.size(F.filter("embeddings", lambda e: e.isNotNull())).cast("long").alias("vectors"), F.round(values, 3).alias("value_sum"))


SQL_EMBEDDED = SQL_SELECTION.replace("FROM documents)", "FROM documents WHERE doc_id IN (SELECT vec_id FROM embeddings))")


@register("sel1_selection_batches", SQL_EMBEDDED + f""",
p AS (SELECT *, sample_id // 8 AS batch, row_number() OVER (PARTITION BY sample_id // 8 ORDER BY sample_id) AS pos,
        {_ids("concat('user', chr(10), query, chr(10), 'assistant', chr(10), target_text, chr(10))")}[1:128] AS ids,
        least(128, len({S.regex_tokens("concat('user', chr(10), query, chr(10))")})) AS pl FROM sel),
g AS (SELECT sample_id, sum(list_sum(embedding)) AS s FROM (SELECT sample_id, unnest(doc_indices) AS idx FROM sel) x
      JOIN d USING (idx) JOIN embeddings ON vec_id = doc_id GROUP BY sample_id)
SELECT batch, CAST(count(*) AS INTEGER) AS rows, CAST(max(len(ids)) AS INTEGER) AS width, CAST(sum(len(ids)) AS BIGINT) AS tokens,
       CAST(sum(pos * list_sum(list_transform(range(1, len(ids) + 1), lambda j: ids[j] * j))) AS BIGINT) AS checksum,
       CAST(sum(pl) AS BIGINT) AS prefix_tokens, CAST(sum(doc_count) AS BIGINT) AS documents, CAST(sum(doc_count) AS BIGINT) AS mask_sum,
       CAST(count(*) * 8 AS BIGINT) AS slots, count(*) FILTER (WHERE is_refusal) AS refusals,
       md5(string_agg(target_text, '|' ORDER BY sample_id)) AS targets_md5, round(sum(s), 3) AS value_sum
FROM p JOIN g USING (sample_id) GROUP BY batch
""")
def sel1_selection_batches(spark, sf_dir):
    """Selection examples over the documents that have vectors, collated in batches of 8 samples of up to 8 documents."""
    vec = vectors(spark, sf_dir)
    docs = corpus(spark, sf_dir).join(vec.select("doc_id"), "doc_id", "left_semi")
    ids = SEL.index_ids(docs)
    examples = SEL.selection_dataset(docs, cfg=CFG, seed=42)
    refs = SEL.selection_plan(ids, None, CFG, 42)
    gathered = SEL.gather_embeddings(refs, ids, vec, ["sample_id"], "doc_indices", max_docs=CFG.max_docs)
    b = C.selection_batches(examples, gathered, 8, max_tokens=128)
    zero = F.lit(0.0).cast("double")
    flat = F.flatten("embeddings")
    values = F.aggregate(F.transform(flat, lambda e: F.aggregate(e, zero, lambda a, x: a + x)), zero, lambda a, x: a + x)
    mask = F.flatten("doc_mask")
    return b.select("batch", "rows", "width", _total("attention_mask").alias("tokens"), _checksum().alias("checksum"),
                    _sum("prefix_lengths").alias("prefix_tokens"), _sum("doc_counts").alias("documents"),
                    F.size(F.filter(mask, lambda x: x)).cast("long").alias("mask_sum"), F.size(mask).cast("long").alias("slots"),
                    F.size(F.filter("is_refusal", lambda x: x)).cast("long").alias("refusals"),
                    F.md5(F.array_join("targets", "|")).alias("targets_md5"), F.round(values, 3).alias("value_sum"))
