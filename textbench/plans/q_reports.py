"""Registered queries: cross-experiment reports, packing, sources and sinks
(A10-A15, A18, PK1-PK5, SRC1, SRC8, SNK1-SNK4)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from textbench.functions.text import token_length, words
from textbench.operators import bleu as B
from textbench.operators import packing as PK
from textbench.operators import reports as RP
from textbench.operators.buckets import as_report_array, length_buckets
from textbench.plans import sqlbits as S
from textbench.plans.catalog import register
from textbench.plans.q_agent import SQL_TRAJ
from textbench.plans.fixtures import SQL_MANIFEST, SQL_PAIRS, manifest, pairs, table, trajectories
from textbench.session import checkpoint_dir, written
from textbench.sinks import writers as W
from textbench.sources import readers as RD

R6 = lambda c: F.round(F.col(c), 6).alias(c)


def exp_stats(spark, sf_dir):
    """Per-pair statistics tagged with ``experiment = lang-model``."""
    p = pairs(spark, sf_dir).withColumn("experiment", F.concat_ws("-", "lang", "model"))
    return B.pair_text_stats(p, keep=["experiment", "model", "lang"])


def sql_exp_stats(k_sweep: bool = False) -> str:
    src_pairs = f"SELECT *, concat_ws('-', lang, model) AS experiment FROM ({SQL_PAIRS})"
    keep = ["experiment", "model", "lang", "length", "f1"]
    if k_sweep:
        src_pairs = (f"SELECT id * 16 + k AS id, reference, experiment, model, lang, k, "
                     f"array_to_string({S.words('prediction')}[1:k * 8], ' ') AS prediction "
                     f"FROM ({src_pairs}), (SELECT unnest([1, 2, 4, 8]) AS k)")
        keep.append("k")
    src = (f"SELECT id, prediction, reference, {', '.join(c for c in keep if c not in ('length', 'f1'))}, "
           f"CAST(len({S.regex_tokens('reference')}) AS BIGINT) AS length, {S.token_f1('prediction', 'reference')} AS f1 "
           f"FROM ({src_pairs})")
    return B.sql_bleu_row_stats(src, keep=keep)


def experiment_buckets(spark, sf_dir):
    st = written(exp_stats(spark, sf_dir), "experiment-stats")  # narrow numbers: the texts are read once
    return length_buckets(st, 4, group_cols=["experiment"])


def reports(spark, sf_dir):
    """The ``experiments`` view: one eval-report-shaped row per experiment."""
    return as_report_array(experiment_buckets(spark, sf_dir), ["experiment"])


SQL_BUCKET_TABLE = f"""
WITH s AS ({sql_exp_stats()}),
r AS (SELECT *, row_number() OVER (PARTITION BY experiment ORDER BY length, id) - 1 AS rk,
             count(*) OVER (PARTITION BY experiment) AS n FROM s),
b AS (SELECT *, CAST(floor(((rk + 1) * least(4, n) - 1) / n) AS INTEGER) AS bucket FROM r),
g AS (SELECT experiment, bucket, CAST(min(length) AS INTEGER) AS min_tokens, CAST(max(length) AS INTEGER) AS max_tokens,
        avg(length) AS avg_tokens, avg(f1) AS token_f1, CAST(count(*) AS INTEGER) AS samples, {B.sql_bleu_sums()}
      FROM b GROUP BY experiment, bucket),
t AS (SELECT experiment, bucket, min_tokens, max_tokens, avg_tokens, {B.sql_bleu_from_sums()} AS bleu, token_f1, samples FROM g)
"""


@register("a10_bucket_table", SQL_BUCKET_TABLE + """
SELECT experiment, bucket, min_tokens, max_tokens, round(avg_tokens, 6) AS avg_tokens, round(bleu, 6) AS bleu,
       round(token_f1, 6) AS token_f1, samples FROM t WHERE bleu IS NOT NULL
""")
def a10_bucket_table(spark, sf_dir):
    """Experiments = language x model; 4 length buckets each; one row per bucket."""
    t = RP.bucket_table(reports(spark, sf_dir))
    return t.select("experiment", "bucket", "min_tokens", "max_tokens", R6("avg_tokens"), R6("bleu"), R6("token_f1"), "samples")


@register("a11_experiment_summary", SQL_BUCKET_TABLE + """
SELECT experiment, round(avg(avg_tokens), 6) AS mean_ref_tokens, round(avg(bleu), 6) AS mean_bleu,
       round(avg(token_f1), 6) AS mean_token_f1, count(*) AS n_buckets FROM t WHERE bleu IS NOT NULL GROUP BY experiment
""")
def a11_experiment_summary(spark, sf_dir):
    s = RP.experiment_summary(RP.bucket_table(reports(spark, sf_dir)))
    return s.select("experiment", R6("mean_ref_tokens"), R6("mean_bleu"), R6("mean_token_f1"), "n_buckets")


@register("a12_short_long_export", SQL_BUCKET_TABLE + """
SELECT CASE WHEN avg_tokens < 50 THEN 'short_text' ELSE 'long_text' END AS label, experiment,
       CAST(count(*) AS INTEGER) AS points, round(sum(bleu), 6) AS bleu_sum,
       string_agg(CAST(bucket AS VARCHAR), ',' ORDER BY bucket) AS buckets
FROM t WHERE bleu IS NOT NULL GROUP BY ALL
""")
def a12_short_long_export(spark, sf_dir):
    e = RP.short_long_export(RP.bucket_table(reports(spark, sf_dir)))
    return e.select(
        "label", "experiment", F.size("series").alias("points"),
        F.round(F.aggregate("series", F.lit(0.0), lambda a, p: a + p["bleu"]), 6).alias("bleu_sum"),
        F.array_join(F.transform("series", lambda p: p["bucket"].cast("string")), ",").alias("buckets"))


@register("a13_bleu_trend", SQL_BUCKET_TABLE + """
SELECT experiment, concat(CAST(min(min_tokens) AS VARCHAR), '-', CAST(max(max_tokens) AS VARCHAR)) AS tokens_range,
       string_agg(printf('%.1f', bleu), ' -> ' ORDER BY bucket) AS trend FROM t WHERE bleu IS NOT NULL GROUP BY experiment
""")
def a13_bleu_trend(spark, sf_dir):
    return RP.bleu_trend(RP.bucket_table(reports(spark, sf_dir)))


@register("a15_length_quality_corr", SQL_BUCKET_TABLE + """
SELECT experiment, round(corr(avg_tokens, bleu), 6) AS pearson_r, count(*) AS points FROM t WHERE bleu IS NOT NULL GROUP BY experiment
""")
def a15_length_quality_corr(spark, sf_dir):
    c = RP.length_quality_corr(RP.bucket_table(reports(spark, sf_dir)))
    return c.select("experiment", R6("pearson_r"), "points")


def _sweep(spark, sf_dir):
    """K in (1, 2, 4, 8), a budget of 8 words each, per adapter (= model)."""
    p = pairs(spark, sf_dir).select("id", F.col("model").alias("adapter"), "prediction", "reference", token_length("reference").alias("length"))
    return RP.prefix_sweep(p, [1, 2, 4, 8])


SQL_SWEEP = f"""
WITH s AS ({sql_exp_stats(True)}),
g AS (SELECT model AS adapter, k, {B.sql_bleu_sums()}, avg(f1) AS token_f1, avg(length) AS avg_len FROM s GROUP BY model, k),
sw AS (SELECT adapter, k, {B.sql_bleu_from_sums()} AS bleu, token_f1, avg_len / k AS compression FROM g)
"""


@register("a14_best_k", SQL_SWEEP + """
SELECT adapter, arg_max(k, bleu) AS k, round(max(bleu), 6) AS bleu, round(arg_max(token_f1, bleu), 6) AS token_f1,
       round(arg_max(compression, bleu), 6) AS compression FROM sw GROUP BY adapter
""")
def a14_best_k(spark, sf_dir):
    """K sweep (predictions cut to 8K words for K in 1, 2, 4, 8) and the best K per adapter."""
    b = RP.best_k(_sweep(spark, sf_dir))
    return b.select("adapter", "k", R6("bleu"), R6("token_f1"), R6("compression"))


SQL_CELLS = f"""
WITH s AS ({sql_exp_stats()}),
g AS (SELECT model, lang, avg(f1) AS f1, count(*) AS samples, {B.sql_bleu_sums()} FROM s GROUP BY model, lang),
cells AS (SELECT model AS train, lang AS eval, round({B.sql_bleu_from_sums()}, 6) AS bleu, round(f1, 6) AS f1, samples FROM g)
"""


def _cells(spark, sf_dir):
    c = RP.cross_domain(exp_stats(spark, sf_dir), "model", "lang")
    return c.select(F.col("model").alias("train"), F.col("lang").alias("eval"), R6("bleu"), R6("f1"), "samples")


@register("a18_cross_domain_cells", SQL_CELLS + "SELECT * FROM cells")
def a18_cross_domain_cells(spark, sf_dir):
    """BLEU and token F1 of each "train" model (m0, m1) on each "eval" language, one row per cell."""
    return _cells(spark, sf_dir)


_LANGS = ["de", "en", "es", "fr"]


@register("a18_cross_domain_matrix", SQL_CELLS + "SELECT train, " + ", ".join(
    f"max({v}) FILTER (WHERE eval = '{x}') AS {x}_{v}" for x in _LANGS for v in ("bleu", "f1")) + " FROM cells GROUP BY train")
def a18_cross_domain_matrix(spark, sf_dir):
    """The same as a matrix: a row per model, BLEU and token F1 per language as columns."""
    return RP.cross_domain_matrix(_cells(spark, sf_dir), "train", "eval", ["bleu", "f1"], _LANGS)


# -- packing ----------------------------------------------------------------

def _tokens(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", "lang", words("text").alias("tok"))


@register("pk1_uniform_chunks", f"""
WITH t AS (SELECT doc_id, len({S.words('text')}) AS n FROM documents),
c AS (SELECT doc_id, n, i, CAST(floor((i + 1) * n / 4) AS BIGINT) - CAST(floor(i * n / 4) AS BIGINT) AS len FROM t, range(0, 4) r(i))
SELECT doc_id, count(*) AS chunks, min(len) AS min_len, max(len) AS max_len, CAST(sum(len) AS BIGINT) AS total_len FROM c GROUP BY doc_id
""")
def pk1_uniform_chunks(spark, sf_dir):
    t = _tokens(spark, sf_dir).withColumn("c", PK.uniform_chunks(F.col("tok"), 4))
    x = t.select("doc_id", F.explode("c").alias("chunk")).withColumn("len", F.size("chunk"))
    return x.groupBy("doc_id").agg(F.count(F.lit(1)).alias("chunks"), F.min("len").cast("long").alias("min_len"),
                                   F.max("len").cast("long").alias("max_len"), F.sum("len").cast("long").alias("total_len"))


@register("pk2_overlapping_chunks", f"""
WITH t AS (SELECT doc_id, len({S.words('text')}) AS n FROM documents),
w AS (SELECT doc_id, n, CASE WHEN n <= 64 THEN 1 ELSE 1 + CAST(ceil((n - 64) / 48) AS BIGINT) END AS cnt FROM t),
c AS (SELECT doc_id, least(64, n - i * 48) AS len FROM w, range(0, cnt) r(i))
SELECT doc_id, count(*) AS windows, CAST(sum(len) AS BIGINT) AS covered FROM c GROUP BY doc_id
""")
def pk2_overlapping_chunks(spark, sf_dir):
    """Windows of 64 words overlapping by 16."""
    t = _tokens(spark, sf_dir).withColumn("c", PK.overlapping_chunks(F.col("tok"), 64, 16))
    return t.select("doc_id", F.size("c").alias("windows"),
                    F.aggregate("c", F.lit(0).cast("long"), lambda a, x: a + F.size(x)).alias("covered"))


MS = [1, 2, 4, 8, 16, 32]


@register("pk3_packing_ratio", f"""
WITH t AS (SELECT doc_id, lang, len({S.words('text')}) AS n FROM documents),
tm AS (SELECT * FROM t, (SELECT unnest({MS}) AS m))
SELECT lang, m, round(sum(n) / sum(m), 6) AS tokens_per_embedding, round(avg(m), 6) AS embeddings_per_doc, count(*) AS docs
FROM tm GROUP BY lang, m
""")
def pk3_packing_ratio(spark, sf_dir):
    """Tokens per embedding for m uniform chunks per document, from token counts."""
    t = _tokens(spark, sf_dir).select("lang", F.size("tok").alias("n"), F.explode(F.array(*[F.lit(m) for m in MS])).alias("m"))
    s = PK.packing_ratio_of_counts(t, "n", "m", ["lang", "m"])
    return s.select("lang", "m", R6("tokens_per_embedding"), R6("embeddings_per_doc"), "docs")


@register("pk4_pareto_frontier", SQL_SWEEP + """
SELECT adapter, k, round(bleu, 6) AS bleu FROM (
  SELECT *, max(bleu) OVER (PARTITION BY adapter ORDER BY k, bleu DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best FROM sw)
WHERE best IS NULL OR bleu > best
""")
def pk4_pareto_frontier(spark, sf_dir):
    """Budgets K not dominated on the BLEU that the K sweep measured, per adapter."""
    f = PK.pareto_frontier(_sweep(spark, sf_dir), "k", "bleu", ["adapter"])
    return f.select("adapter", "k", R6("bleu"))


@register("pk5_min_budget", SQL_SWEEP + """
SELECT adapter, min(k) AS min_budget, round(max(base), 6) AS baseline_quality FROM (
  SELECT *, max(bleu) OVER (PARTITION BY adapter) AS base FROM sw) WHERE bleu >= 0.95 * base GROUP BY adapter
""")
def pk5_min_budget(spark, sf_dir):
    """The smallest K that reaches 95 % of the best measured BLEU, per adapter."""
    b = PK.min_budget(_sweep(spark, sf_dir), "k", "bleu", 0.95, ["adapter"])
    return b.select("adapter", "min_budget", R6("baseline_quality"))


# -- sources ----------------------------------------------------------------

@register("src1_read_corpus", "SELECT count(*) AS rows, CAST(sum(length(text)) AS BIGINT) AS chars, CAST(sum(doc_id) AS BIGINT) AS id_sum FROM documents")
def src1_read_corpus(spark, sf_dir):
    c = RD.read_corpus(spark, f"{sf_dir.rstrip('/')}/documents.parquet", text_col="text", id_col="doc_id")
    return c.groupBy().agg(F.count(F.lit(1)).alias("rows"), F.sum(F.length("text")).cast("long").alias("chars"),
                           F.sum("doc_id").cast("long").alias("id_sum"))


@register("src8_latest_checkpoint", f"""
WITH m AS ({SQL_MANIFEST}), s AS (SELECT run, path, CAST(regexp_extract(path, 'adapter-step(\\d+)\\.pt$', 1) AS BIGINT) AS step FROM m)
SELECT run, max(step) AS step, arg_max(path, step) AS path FROM s GROUP BY run
""")
def src8_latest_checkpoint(spark, sf_dir):
    """Latest checkpoint per run from a manifest of checkpoint paths."""
    return RD.latest_checkpoint(manifest(spark, sf_dir))


# -- sinks (write, then read back) ------------------------------------------

def _scratch(spark, name: str) -> str:
    return f"{checkpoint_dir(spark).rstrip('/')}/sinks/{name}-{uuid.uuid4().hex}"


@register("snk1_write_results", f"""
SELECT count(*) AS rows, CAST(sum(length(prediction)) AS BIGINT) AS pred_chars, CAST(sum(length(reference)) AS BIGINT) AS ref_chars
FROM ({SQL_PAIRS})
""")
def snk1_write_results(spark, sf_dir):
    """Prediction table written as Parquet and read back."""
    path = _scratch(spark, "results")
    W.write_results(pairs(spark, sf_dir).select(F.col("id").alias("prompt_id"), "prediction", "reference"), path)
    back = spark.read.parquet(path)
    return back.groupBy().agg(F.count(F.lit(1)).alias("rows"), F.sum(F.length("prediction")).cast("long").alias("pred_chars"),
                              F.sum(F.length("reference")).cast("long").alias("ref_chars"))


@register("snk2_write_report", SQL_BUCKET_TABLE + """
SELECT experiment, CAST(count(*) AS INTEGER) AS buckets, CAST(sum(samples) AS BIGINT) AS samples FROM t GROUP BY experiment
""")
def snk2_write_report(spark, sf_dir):
    """Eval reports (with bucket arrays) written as JSON and read back with the report schema."""
    path = _scratch(spark, "reports")
    W.write_report(reports(spark, sf_dir), path)
    back = spark.read.schema(RD.extended(RD.EVAL_REPORT_SCHEMA, experiment="string")).json(path)
    return back.select("experiment", F.size("length_buckets").alias("buckets"),
                       F.aggregate("length_buckets", F.lit(0).cast("long"), lambda a, b: a + b["samples"]).alias("samples"))


@register("snk3_write_jsonl", """
SELECT count(*) * 2 AS lines, count(DISTINCT conv_id) AS conversations FROM conversations
""")
def snk3_write_jsonl(spark, sf_dir):
    """Chat conversations appended twice to a JSON-lines folder, then read with the conversation schema."""
    path = _scratch(spark, "jsonl")
    c = table(spark, sf_dir, "conversations")
    js = c.select("conv_id", F.array(F.struct(F.col("role"), F.col("text").alias("content"))).alias("messages"))
    W.write_jsonl(js, path)
    W.write_jsonl(js, path)
    back = spark.read.schema(RD.extended(RD.CONVERSATION_SCHEMA, conv_id="long")).json(path)
    return back.groupBy().agg(F.count(F.lit(1)).alias("lines"), F.countDistinct("conv_id").alias("conversations"))


@register("snk4_write_table", SQL_BUCKET_TABLE + """
SELECT count(*) AS rows, CAST(sum(samples) AS BIGINT) AS samples, round(sum(round(bleu, 6)), 4) AS bleu_sum FROM t WHERE bleu IS NOT NULL
""")
def snk4_write_table(spark, sf_dir):
    """Bucket table written as CSV (header) and read back."""
    path = _scratch(spark, "table")
    t = RP.bucket_table(reports(spark, sf_dir)).withColumn("bleu", F.round("bleu", 6))
    W.write_table(t, path, "csv")
    back = spark.read.option("header", True).schema(t.schema).csv(path)
    return back.groupBy().agg(F.count(F.lit(1)).alias("rows"), F.sum("samples").cast("long").alias("samples"),
                              F.round(F.sum("bleu"), 4).alias("bleu_sum"))


@register("src6_read_eval_reports", SQL_BUCKET_TABLE + """
SELECT experiment, bucket, min_tokens, max_tokens, round(avg_tokens, 6) AS avg_tokens, round(bleu, 6) AS bleu,
       round(token_f1, 6) AS token_f1, samples FROM t WHERE bleu IS NOT NULL
""")
def src6_read_eval_reports(spark, sf_dir):
    """Experiment reports written by Spark (one folder per experiment) and
    collected back with the report reader, then flattened (A10)."""
    root = _scratch(spark, "outputs")
    reports(spark, sf_dir).write.partitionBy("experiment").json(root)
    back = RD.read_eval_reports(spark, root, report_glob="part-*.json", multi_line=False, siblings=False)
    t = RP.bucket_table(back)
    return t.select("experiment", "bucket", "min_tokens", "max_tokens", R6("avg_tokens"), R6("bleu"), R6("token_f1"), "samples")


@register("prj1_predicates", """
SELECT lang, count(*) AS files, count(*) FILTER (WHERE length(text) > 20 AND length(text) < 5000) AS kept_by_size,
       count(*) FILTER (WHERE n_chars < 1000 AND lang <> 'en') AS short_non_en
FROM documents GROUP BY lang
""")
def prj1_predicates(spark, sf_dir):
    """How many rows the size, language and length predicates keep, side by side in one pass (conditional counts, not filters)."""
    d = table(spark, sf_dir, "documents").select("lang", "text", "n_chars")
    size_ok = (F.length("text") > 20) & (F.length("text") < 5000)
    return d.groupBy("lang").agg(F.count(F.lit(1)).alias("files"), F.count(F.when(size_ok, 1)).alias("kept_by_size"),
                                 F.count(F.when((F.col("n_chars") < 1000) & (F.col("lang") != "en"), 1)).alias("short_non_en"))


def pruned_scan(spark, sf_dir):
    """Documents laid out by language, then the predicates as filters on what is stored."""
    root = _scratch(spark, "by-lang")
    W.write_layout(table(spark, sf_dir, "documents"), root, ["lang"], ["n_chars", "doc_id"])
    d = spark.read.parquet(root)
    return d.where(F.col("lang").isin("de", "fr") & (F.col("n_chars") > 20) & (F.col("n_chars") < 5000)).select("doc_id", "lang", "n_chars")


@register("prj1_pruned_scan", """
SELECT doc_id, lang, n_chars FROM documents WHERE lang IN ('de', 'fr') AND n_chars > 20 AND n_chars < 5000
""")
def prj1_pruned_scan(spark, sf_dir):
    """Language and size predicates answered by the layout: other languages' folders are not listed, and row
    groups of other sizes are skipped by their statistics."""
    return pruned_scan(spark, sf_dir)


@register("prj1_success_filter", f"""
SELECT run, task_id, model FROM ({SQL_TRAJ}) WHERE success
""")
def prj1_success_filter(spark, sf_dir):
    """The success predicate on stored trajectories, as a filter that the scan gets."""
    root = _scratch(spark, "trajectories")
    trajectories(spark, sf_dir).write.parquet(root)
    return spark.read.parquet(root).where("success").select("run", "task_id", "model")
