"""Registered queries: splits, limits, sampling, batching (SPL, LIM, SMP, BAT, A19, A20)."""

from __future__ import annotations

from pyspark.sql import functions as F

from textbench.functions.hashing import hash_bits, hash_randint, sql_hash_bits, sql_hash_uniform, with_scalars
from textbench.functions.text import normalize_ws, words
from textbench.operators import batching as BT
from textbench.operators import splits as SP
from textbench.plans import sqlbits as S
from textbench.plans.catalog import register
from textbench.plans.fixtures import SQL_METRIC_LOG, corpus, metric_log, code_files, SQL_CODE_FILES, table

VAL, TEST = 0.1, 0.05
HOLD = VAL + TEST  # python float semantics, as in the reference (0.15000000000000002)


def _sql_split_labels() -> str:
    h = sql_hash_bits(42, "'shuffle'", "doc_id")
    return f"""
WITH h AS (SELECT doc_id, lang, {h} AS h FROM documents),
r AS (SELECT *, row_number() OVER (ORDER BY h, doc_id) - 1 AS r, count(*) OVER () AS n FROM h),
l AS (SELECT *, CASE WHEN r < ceil(ceil(n * CAST('{HOLD!r}' AS DOUBLE)) * CAST('{TEST / HOLD!r}' AS DOUBLE)) THEN 'test'
                     WHEN r < ceil(n * CAST('{HOLD!r}' AS DOUBLE)) THEN 'validation' ELSE 'train' END AS split FROM r)
"""


@register("spl1_auto_split", _sql_split_labels() + """
SELECT split, count(*) AS rows, CAST(sum(doc_id) AS BIGINT) AS id_sum FROM l GROUP BY split
""")
def spl1_auto_split(spark, sf_dir):
    out = SP.auto_split(corpus(spark, sf_dir).select("doc_id"), "doc_id", VAL, TEST, seed=42)
    return out.groupBy("split").agg(F.count(F.lit(1)).alias("rows"), F.sum("doc_id").cast("long").alias("id_sum"))


@register("spl2_named_split", _sql_split_labels() + """
SELECT doc_id, lang FROM l WHERE split = 'validation'
""")
def spl2_named_split(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang")
    return SP.named_split(SP.auto_split(docs, "doc_id", VAL, TEST, seed=42), "validation").select("doc_id", "lang")


@register("spl3_group_split", f"""
WITH g AS (SELECT doc_id, md5({S.normalize_ws('text')}) AS grp FROM documents),
s AS (SELECT *, CASE WHEN {sql_hash_uniform(42, "'group'", 'grp')} < 0.05 THEN 'test'
                     WHEN {sql_hash_uniform(42, "'group'", 'grp')} < 0.15000000000000002 THEN 'validation'
                     ELSE 'train' END AS split FROM g),
leak AS (SELECT grp FROM s GROUP BY grp HAVING count(DISTINCT split) > 1)
SELECT split, count(*) AS rows, count(DISTINCT grp) AS groups,
       (SELECT count(*) FROM leak) AS leaked_groups FROM s GROUP BY split
""")
def spl3_group_split(spark, sf_dir):
    """Duplicate-aware split: rows with the same normalised text share a split."""
    docs = corpus(spark, sf_dir).withColumn("grp", F.md5(normalize_ws("text")))
    s = SP.group_split(docs, F.col("grp"), VAL, TEST, seed=42)
    leaked = (s.groupBy("grp").agg(F.countDistinct("split").alias("k")).filter("k > 1")
              .groupBy().agg(F.count(F.lit(1)).alias("leaked_groups")))
    per = s.groupBy("split").agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("grp").alias("groups"))
    return with_scalars(per, leaked)


@register("lim1_limit_first", "SELECT doc_id, n_chars FROM documents ORDER BY doc_id LIMIT 100")
def lim1_limit_first(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    return SP.limit_first(docs, 100, "doc_id")


@register("lim1_limit_many", """
WITH e AS (SELECT event_id, value, count(*) OVER () AS n, row_number() OVER (ORDER BY event_id) AS rn FROM events)
SELECT event_id, value FROM e WHERE rn <= n // 2
""")
def lim1_limit_many(spark, sf_dir):
    """Half of the events in order of their id, a limit that grows with the table: by threshold, not in one task."""
    e = table(spark, sf_dir, "events").select("event_id", "value")
    return SP.limit_first(e, e.count() // 2, "event_id", few=0)


@register("lim1_limit_splits", """
WITH d AS (SELECT doc_id, CASE WHEN doc_id % 10 < 8 THEN 'train' WHEN doc_id % 10 = 8 THEN 'validation' ELSE 'test' END AS split FROM documents),
r AS (SELECT *, row_number() OVER (PARTITION BY split ORDER BY doc_id) AS rn FROM d)
SELECT split, doc_id FROM r WHERE split = 'test' OR rn <= CASE split WHEN 'train' THEN 50 ELSE 7 END
""")
def lim1_limit_splits(spark, sf_dir):
    """Each split with its own limit (train 50, validation 7, test all)."""
    m = F.col("doc_id") % 10
    docs = table(spark, sf_dir, "documents").select(
        F.when(m < 8, "train").when(m == 8, "validation").otherwise("test").alias("split"), "doc_id")
    return SP.limit_splits(docs, "split", {"train": 50, "validation": 7, "test": None}, "doc_id")


@register("lim2_cap_per_group", f"""
WITH c AS ({SQL_CODE_FILES}),
r AS (SELECT repo, doc_id, row_number() OVER (PARTITION BY repo ORDER BY {sql_hash_bits(42, "'files'", 'doc_id')}, doc_id) AS rn FROM c)
SELECT repo, count(*) AS files, CAST(sum(doc_id) AS BIGINT) AS id_sum FROM r WHERE rn <= 20 GROUP BY repo
""")
def lim2_cap_per_group(spark, sf_dir):
    files = code_files(spark, sf_dir)
    order = F.struct(hash_bits(42, F.lit("files"), F.col("doc_id")), F.col("doc_id"))
    capped = SP.cap_per_group(files, "repo", 20, order)
    return capped.groupBy("repo").agg(F.count(F.lit(1)).alias("files"), F.sum("doc_id").cast("long").alias("id_sum"))


@register("smp1_seeded_shuffle", f"""
SELECT doc_id, row_number() OVER (ORDER BY {sql_hash_bits(42, "'shuffle'", 'doc_id')}, doc_id) - 1 AS position FROM documents
""")
def smp1_seeded_shuffle(spark, sf_dir):
    return SP.seeded_shuffle(corpus(spark, sf_dir).select("doc_id"), "doc_id", seed=42)


@register("smp2_bernoulli", f"""
SELECT {sql_hash_uniform(42, "'refusal'", 'doc_id')} < 0.2 AS is_refusal,
       {sql_hash_uniform(42, "'content'", 'doc_id')} < 0.5 AS content_query, count(*) AS rows
FROM documents GROUP BY ALL
""")
def smp2_bernoulli(spark, sf_dir):
    d = corpus(spark, sf_dir).select("doc_id")
    return d.select(SP.bernoulli(0.2, 42, "refusal", F.col("doc_id")).alias("is_refusal"),
                    SP.bernoulli(0.5, 42, "content", F.col("doc_id")).alias("content_query")).groupBy(
        "is_refusal", "content_query").agg(F.count(F.lit(1)).alias("rows"))


def _sql_floyd() -> str:
    t = f"CAST(floor({sql_hash_uniform(42, 'doc_id', chr(39) + 'floyd' + chr(39), 'j')} * (j + 1)) AS BIGINT)"
    order_h = sql_hash_bits(42, "doc_id", "'order'", "v")
    return f"""
WITH s AS (SELECT doc_id, count(*) OVER () AS n,
             CAST(2 + floor({sql_hash_uniform(42, "'count'", 'doc_id')} * 7) AS BIGINT) AS k0 FROM documents),
k AS (SELECT *, greatest(1, least(k0, n)) AS k FROM s),
f AS (SELECT doc_id, n, k, list_reduce(range(n - k, n),
        lambda acc, j: CASE WHEN list_contains(acc, {t}) THEN list_append(acc, j) ELSE list_append(acc, {t}) END,
        []::BIGINT[]) AS chosen
      FROM k),
o AS (SELECT doc_id, n, k, list_transform(list_sort(list_transform(chosen, lambda v: {{'h': {order_h}, 'v': v}})), lambda x: x.v) AS idx FROM f)
"""


def _floyd(spark, sf_dir):
    d = corpus(spark, sf_dir).select("doc_id")
    n = d.groupBy().agg(F.count(F.lit(1)).alias("n"))
    s = with_scalars(d, n).withColumn("k", hash_randint(F.lit(2), F.lit(8), 42, F.lit("count"), F.col("doc_id")))
    s = s.withColumn("k", F.greatest(F.lit(1), F.least(F.col("k"), F.col("n"))))
    return s.withColumn("idx", SP.sample_k_of_n(F.col("k"), F.col("n"), 42, F.col("doc_id")))


@register("smp3_sample_k_of_n", _sql_floyd() + """
SELECT doc_id AS sample_id, k, array_to_string(idx, ',') AS indices, len(list_distinct(idx)) AS distinct_k FROM o
""")
def smp3_sample_k_of_n(spark, sf_dir):
    """Per sample (one per document): k in [2, 8] distinct document positions."""
    s = _floyd(spark, sf_dir)
    return s.select(F.col("doc_id").alias("sample_id"), "k", F.array_join("idx", ",").alias("indices"),
                    F.size(F.array_distinct("idx")).alias("distinct_k"))


@register("smp4_decoy_index", _sql_floyd() + f"""
SELECT doc_id AS sample_id,
  list_reduce(list_sort(idx), lambda acc, c: CASE WHEN acc >= c THEN acc + 1 ELSE acc END,
              CAST(floor({sql_hash_uniform(42, 'doc_id', "'decoy'")} * (n - len(idx))) AS BIGINT)) AS decoy
FROM o
""")
def smp4_decoy_index(spark, sf_dir):
    s = _floyd(spark, sf_dir)
    return s.select(F.col("doc_id").alias("sample_id"),
                    SP.decoy_index(F.col("n"), F.col("idx"), 42, F.col("doc_id")).alias("decoy"))


@register("smp5_random_truncate", f"""
SELECT conv_id, turn, len(w) AS n_tokens,
  len(w[1:CAST(8 + floor({sql_hash_uniform(42, "'trunc'", 'conv_id // 4')} * 57) AS BIGINT)]) AS kept_tokens
FROM (SELECT conv_id, turn, {S.words('text')} AS w FROM conversations)
""")
def smp5_random_truncate(spark, sf_dir):
    """Per batch of 4 conversations, one cap in [8, 64] tokens for all its rows."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", words("text").alias("w"))
    batch = F.floor(F.col("conv_id") / 4).cast("long")
    return c.select("conv_id", "turn", F.size("w").alias("n_tokens"),
                    F.size(SP.random_truncate(F.col("w"), batch, 42, 8, 64)).alias("kept_tokens"))


@register("bat1_batch_plan", f"""
WITH e AS (SELECT doc_id, epoch, {sql_hash_bits(42, 'epoch', 'doc_id')} AS h FROM documents, range(0, 2) t(epoch)),
r AS (SELECT *, row_number() OVER (PARTITION BY epoch ORDER BY h, doc_id) - 1 AS r,
             count(*) OVER (PARTITION BY epoch) AS n FROM e),
p AS (SELECT doc_id, epoch, CAST(floor(r / 32) AS BIGINT) AS batch_index,
             CAST(epoch * ceil(n / 32) + floor(r / 32) + 1 AS BIGINT) AS global_step FROM r)
SELECT doc_id, epoch, batch_index, global_step, global_step % 5 = 0 AS is_checkpoint FROM p WHERE global_step > 10
""")
def bat1_batch_plan(spark, sf_dir):
    """2 epochs of batch 32, resumed after step 10, checkpoint every 5 steps."""
    plan = BT.batch_plan(corpus(spark, sf_dir).select("doc_id"), "doc_id", 32, 2, seed=42, resume_step=10, save_every=5)
    return plan.select("doc_id", "epoch", "batch_index", "global_step", "is_checkpoint")


@register("a20_checkpoint_steps", f"""
WITH r AS (SELECT row_number() OVER (ORDER BY doc_id) - 1 AS r, count(*) OVER () AS n FROM documents),
s AS (SELECT DISTINCT CAST(epoch * ceil(n / 32) + floor(r / 32) + 1 AS BIGINT) AS global_step FROM r, range(0, 2) t(epoch))
SELECT global_step FROM s WHERE global_step > 10 AND global_step % 5 = 0
""")
def a20_checkpoint_steps(spark, sf_dir):
    """Steps that persist state (every 5) in the resumed 2-epoch plan."""
    plan = BT.batch_plan(corpus(spark, sf_dir).select("doc_id"), "doc_id", 32, 2, seed=42, resume_step=10, save_every=5)
    return plan.filter("is_checkpoint").select("global_step").distinct()


@register("bat2_pad_batches", f"""
WITH t AS (SELECT conv_id, turn, conv_id // 4 AS batch,
                  list_transform({S.words('text')}, lambda x: length(x)) AS tok FROM conversations),
m AS (SELECT *, max(len(tok)) OVER (PARTITION BY batch) AS mx FROM t)
SELECT conv_id, turn, CAST(mx AS INTEGER) AS padded_len, CAST(len(tok) AS INTEGER) AS mask_sum,
       CAST(mx - len(tok) AS INTEGER) AS ignored_labels,
       CAST(list_sum(tok) AS BIGINT) AS id_sum FROM m
""")
def bat2_pad_batches(spark, sf_dir):
    """Token ids = word lengths; batches of 4 conversations padded to their longest row."""
    c = table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", F.floor(F.col("conv_id") / 4).cast("long").alias("batch"),
        F.transform(words("text"), lambda x: F.length(x)).alias("tok"))
    p = BT.pad_batches(c, "batch", "tok")
    return p.select(
        "conv_id", "turn", F.size("input_ids").alias("padded_len"),
        F.aggregate("attention_mask", F.lit(0), lambda a, x: a + x).alias("mask_sum"),
        F.size(F.filter("labels", lambda x: x == -100)).alias("ignored_labels"),
        F.aggregate("input_ids", F.lit(0).cast("long"), lambda a, x: a + x).alias("id_sum"),
    )


@register("bat3_length_bucketed_batches", f"""
WITH t AS (SELECT doc_id, len({S.words('text')}) AS length FROM documents),
r AS (SELECT *, CAST(floor((row_number() OVER (ORDER BY length, doc_id) - 1) / 16) AS BIGINT) AS batch_id FROM t),
p AS (SELECT *, max(length) OVER (PARTITION BY batch_id) - length AS padding FROM r)
SELECT count(*) AS rows, count(DISTINCT batch_id) AS batches, CAST(sum(length) AS BIGINT) AS tokens,
       CAST(sum(padding) AS BIGINT) AS padding, round(sum(padding) / (sum(padding) + sum(length)), 6) AS waste FROM p
""")
def bat3_length_bucketed_batches(spark, sf_dir):
    d = corpus(spark, sf_dir).select("doc_id", F.size(words("text")).alias("length"))
    rep = BT.padding_report(BT.length_bucketed_batches(d, "doc_id", "length", 16), "length")
    return rep.withColumn("waste", F.round("waste", 6))


@register("a19_windowed_loss", f"""
WITH l AS ({SQL_METRIC_LOG})
SELECT CAST(floor((step - 1) / 100) AS BIGINT) AS window, round(avg(loss), 6) AS avg_loss, max(step) AS end_step
FROM l GROUP BY 1 HAVING count(*) = 100
""")
def a19_windowed_loss(spark, sf_dir):
    out = BT.windowed_loss(metric_log(spark, sf_dir), "step", "loss", 100)
    return out.select("window", F.round("avg_loss", 6).alias("avg_loss"), "end_step")
