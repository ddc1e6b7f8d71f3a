"""Registered queries: evaluation metrics over the ``pairs`` view (A1-A7, A17, TXT3)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textbench.functions.hashing import sql_hash_bits, sql_hash_uniform
from textbench.functions.text import token_length
from textbench.operators import bleu as B
from textbench.operators.bootstrap import bootstrap_ci, reconstruction_report, sql_poisson_weight, sql_replicate_uniform
from textbench.operators.buckets import length_buckets
from textbench.operators.metric import Metric
from textbench.operators.metrics import exact_match, length_bias, selection_report, token_f1, token_f1_col
from textbench.plans import sqlbits as S
from textbench.plans.catalog import register
from textbench.plans.fixtures import SQL_PAIRS, pairs
from textbench.session import written

R6 = lambda c: F.round(F.col(c), 6).alias(c)

#: a caller's metric: system by reference length; the same object runs in buckets (A4), bootstrap (A5) and streams (ST2)
BREVITY = Metric("brevity", ("sys_len", "ref_len"), lambda s: s["sys_len"] / s["ref_len"])


def pair_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs with their reference length (tokens) and token F1."""
    return pairs(spark, sf_dir).select(
        "id", "model", "is_refusal", "prediction", "reference",
        token_length("reference").alias("length"),
        token_f1_col("prediction", "reference").alias("f1"),
    )


def pair_stats(spark: SparkSession, sf_dir: str, with_bleu: bool = True) -> DataFrame:
    """One row per pair: id, model, is_refusal, length (reference tokens), f1
    and, with BLEU, the n-gram statistics."""
    if not with_bleu:
        return pair_rows(spark, sf_dir).drop("prediction", "reference")
    return B.pair_text_stats(pairs(spark, sf_dir), keep=["model", "is_refusal"])


SQL_PAIR_SRC = f"""
SELECT id, model, is_refusal, prediction, reference,
  CAST(len({S.regex_tokens('reference')}) AS BIGINT) AS length,
  {S.token_f1('prediction', 'reference')} AS f1
FROM ({SQL_PAIRS})
"""

SQL_PAIR_STATS = B.sql_bleu_row_stats(SQL_PAIR_SRC, keep=["model", "is_refusal", "length", "f1"])


# -- A2 ---------------------------------------------------------------------

@register("a2_token_f1", f"""
SELECT model, round(avg({S.token_f1('prediction', 'reference')}), 6) AS token_f1, count(*) AS samples
FROM ({SQL_PAIRS}) GROUP BY model
""")
def a2_token_f1(spark, sf_dir):
    return token_f1(pairs(spark, sf_dir), group_cols=["model"]).select("model", R6("token_f1"), "samples")


# -- A4 (flagship) ----------------------------------------------------------

def _sql_buckets(b: int, with_bleu: bool) -> str:
    src = SQL_PAIR_STATS if with_bleu else SQL_PAIR_SRC
    bleu_cols = f", {B.sql_bleu_sums()}" if with_bleu else ""
    bleu_out = f", round({B.sql_bleu_from_sums()}, 6) AS bleu" if with_bleu else ""
    return f"""
WITH s AS ({src}),
r AS (SELECT *, row_number() OVER (ORDER BY length, id) - 1 AS rk, count(*) OVER () AS n FROM s),
b AS (SELECT *, CAST(floor(((rk + 1) * least({b}, n) - 1) / n) AS INTEGER) AS bucket FROM r),
g AS (SELECT bucket, CAST(min(length) AS INTEGER) AS min_tokens, CAST(max(length) AS INTEGER) AS max_tokens,
        avg(length) AS avg_ref_tokens, CAST(count(*) AS INTEGER) AS samples, avg(f1) AS token_f1{bleu_cols}
      FROM b GROUP BY bucket)
SELECT bucket, min_tokens, max_tokens, round(avg_ref_tokens, 6) AS avg_ref_tokens, samples,
       round(token_f1, 6) AS token_f1{bleu_out}
FROM g
"""


@register("a4_length_buckets_f1", _sql_buckets(8, False))
def a4_length_buckets_f1(spark, sf_dir):
    """Token F1 by reference-length bucket (8 buckets), no BLEU."""
    st = pair_stats(spark, sf_dir, with_bleu=False)
    out = length_buckets(st, 8, with_bleu=False)
    return out.select("bucket", "min_tokens", "max_tokens", R6("avg_ref_tokens"), "samples", R6("token_f1"))


@register("a4_length_buckets", _sql_buckets(4, True))
def a4_length_buckets(spark, sf_dir):
    """BLEU and token F1 by reference-length bucket (4 buckets, the reference default)."""
    st = written(pair_stats(spark, sf_dir, with_bleu=True), "pair-stats")  # narrow numbers: the texts are read once
    out = length_buckets(st, 4, with_bleu=True)
    return out.select("bucket", "min_tokens", "max_tokens", R6("avg_ref_tokens"), "samples", R6("token_f1"), R6("bleu"))


@register("a4_length_buckets_metric", f"""
WITH s AS ({SQL_PAIR_STATS}),
r AS (SELECT *, row_number() OVER (ORDER BY length, id) - 1 AS rk, count(*) OVER () AS n FROM s),
b AS (SELECT *, CAST(floor(((rk + 1) * least(4, n) - 1) / n) AS INTEGER) AS bucket FROM r)
SELECT bucket, CAST(count(*) AS INTEGER) AS samples, round(CAST(sum(sys_len) AS DOUBLE) / sum(ref_len), 6) AS brevity,
       round(avg(f1), 6) AS f1 FROM b GROUP BY bucket
""")
def a4_length_buckets_metric(spark, sf_dir):
    """Length buckets of a metric that the caller defines, beside a built-in one."""
    st = written(pair_stats(spark, sf_dir), "pair-stats")
    out = length_buckets(st, 4, metrics=[BREVITY, "f1"])
    return out.select("bucket", "samples", R6("brevity"), R6("f1"))


# -- A3 ---------------------------------------------------------------------

@register("a3_corpus_bleu", f"""
WITH s AS ({SQL_PAIR_STATS})
SELECT model, round({B.sql_bleu_from_sums()}, 6) AS bleu, samples FROM (
  SELECT model, {B.sql_bleu_sums()}, count(*) AS samples FROM s GROUP BY model)
""")
def a3_corpus_bleu(spark, sf_dir):
    st = pair_stats(spark, sf_dir, with_bleu=True)
    out = st.groupBy("model").agg(*B.bleu_sums(), F.count(F.lit(1)).alias("samples"))
    return out.select("model", F.round(B.bleu_from_sums(), 6).alias("bleu"), "samples")


# -- A1 / A7 ----------------------------------------------------------------

def _sql_em(group: str, with_f1: bool) -> str:
    em = f"CASE WHEN {S.normalize_ws('prediction')} = {S.normalize_ws('reference')} THEN 1.0 ELSE 0.0 END"
    f1 = f", round(avg({S.token_f1('prediction', 'reference')}), 6) AS token_f1" if with_f1 else ""
    sel = f"{group}, " if group else ""
    gb = f"GROUP BY {group}" if group else ""
    return f"""
SELECT {sel}count(*) AS samples,
  CAST(sum(CASE WHEN NOT is_refusal THEN 1 ELSE 0 END) AS BIGINT) AS positive_samples,
  CAST(sum(CASE WHEN is_refusal THEN 1 ELSE 0 END) AS BIGINT) AS refusal_samples,
  round(coalesce(avg({em}), 0.0), 6) AS exact_match,
  round(coalesce(avg(CASE WHEN NOT is_refusal THEN {em} END), 0.0), 6) AS positive_exact_match,
  round(coalesce(avg(CASE WHEN is_refusal THEN {em} END), 0.0), 6) AS refusal_accuracy{f1}
FROM ({SQL_PAIRS}) {gb}
"""


_EM_COLS = ["samples", "positive_samples", "refusal_samples"]
_EM_FLT = ["exact_match", "positive_exact_match", "refusal_accuracy"]


@register("a1_exact_match", _sql_em("model", False))
def a1_exact_match(spark, sf_dir):
    out = exact_match(pairs(spark, sf_dir), group_cols=["model"])
    return out.select("model", *_EM_COLS, *[R6(c) for c in _EM_FLT])


@register("a7_selection_report", _sql_em("", True))
def a7_selection_report(spark, sf_dir):
    out = selection_report(pairs(spark, sf_dir))
    return out.select(*_EM_COLS, *[R6(c) for c in _EM_FLT], R6("token_f1"))


# -- A17 --------------------------------------------------------------------

@register("a17_length_bias", f"""
SELECT model, round(avg(len({S.words('prediction')})), 6) AS mean_pred_words,
  round(avg(len({S.words('reference')})), 6) AS mean_ref_words,
  round(avg(len({S.words('prediction')})) / avg(len({S.words('reference')})), 6) AS length_ratio,
  count(*) AS samples
FROM ({SQL_PAIRS}) GROUP BY model
""")
def a17_length_bias(spark, sf_dir):
    out = length_bias(pairs(spark, sf_dir), group_cols=["model"])
    return out.select("model", R6("mean_pred_words"), R6("mean_ref_words"), R6("length_ratio"), "samples")


# -- TXT3 -------------------------------------------------------------------

@register("txt3_token_length", f"""
SELECT model, round(avg(len({S.regex_tokens('reference')})), 6) AS avg_ref_tokens,
  round(avg(len({S.regex_tokens('reference')})) / 4.0, 6) AS compression_ratio,
  CAST(sum(len({S.regex_tokens('reference')})) AS BIGINT) AS total_tokens
FROM ({SQL_PAIRS}) GROUP BY model
""")
def txt3_token_length(spark, sf_dir):
    """Mean reference length in tokens and compression ratio for K=4 prefix tokens."""
    p = pairs(spark, sf_dir).select("model", token_length("reference").alias("n"))
    out = p.groupBy("model").agg(F.avg("n").alias("avg_ref_tokens"), F.sum("n").cast("long").alias("total_tokens"))
    k = 4
    return out.select("model", R6("avg_ref_tokens"),
                      F.round(F.col("avg_ref_tokens") / k if k else F.lit(0.0), 6).alias("compression_ratio"),
                      "total_tokens")


# -- A5 / A6 ----------------------------------------------------------------

def _sql_scores(weighted: str) -> str:
    """Scores per replicate from ``x`` rows (rep, w, rows, f1 and length sums, statistics)."""
    sums = ", ".join(f"CAST(sum(w * {c}) AS DOUBLE) AS S_{c}" for c in B.STAT_COLS)
    return f"""{weighted},
g AS (SELECT rep, sum(w * f1) / sum(w * rows) AS score_f1, sum(w * length) / sum(w * rows) AS score_len, sum(w * rows) AS score_n, {sums}
      FROM x WHERE w > 0 GROUP BY rep),
sc AS (SELECT rep, score_f1, score_len, score_n, {B.sql_bleu_from_sums()} AS score_bleu FROM g)
"""


def _sql_replicates(n_boot: int, seed: int = 42) -> str:
    u = sql_replicate_uniform(seed, "id", "rep")
    return _sql_scores(f"""
WITH s AS ({SQL_PAIR_STATS}),
x AS (SELECT s.*, 1 AS rows, rep, CASE WHEN rep < 0 THEN 1 ELSE {sql_poisson_weight(u)} END AS w
      FROM s, range(-1, {n_boot}) r(rep))""")


def _sql_block_replicates(n_boot: int, blocks: int, seed: int = 42) -> str:
    u = sql_replicate_uniform(seed, "blk", "rep")
    sums = ", ".join(f"sum({c}) AS {c}" for c in B.STAT_COLS)
    return _sql_scores(f"""
WITH s0 AS ({SQL_PAIR_STATS}),
s AS (SELECT {sql_hash_bits(seed, 'id', "'block'")} % {blocks} AS blk, count(*) AS rows, sum(f1) AS f1, sum(length) AS length, {sums}
      FROM s0 GROUP BY 1),
x AS (SELECT s.*, rep, CASE WHEN rep < 0 THEN 1 ELSE {sql_poisson_weight(u)} END AS w FROM s, range(-1, {n_boot}) r(rep))""")


def _sql_multinomial_replicates(n_boot: int, seed: int = 42) -> str:
    return _sql_scores(f"""
WITH s AS (SELECT *, row_number() OVER (ORDER BY id) - 1 AS idx, count(*) OVER () AS n FROM ({SQL_PAIR_STATS})),
d AS (SELECT rep, CAST(floor({sql_hash_uniform(seed, 'rep', 'idx')} * n) AS BIGINT) AS idx FROM s, range(0, {n_boot}) r(rep)),
x AS (SELECT s.*, 1 AS rows, rep, w FROM (SELECT rep, idx, count(*) AS w FROM d GROUP BY ALL
                                          UNION ALL SELECT -1, idx, 1 FROM s) c JOIN s USING (idx))""")


_SQL_CI = """
SELECT round(max(CASE WHEN rep < 0 THEN score_bleu END), 6) AS bleu,
  round(quantile_cont(score_bleu, 0.025) FILTER (WHERE rep >= 0), 6) AS bleu_ci_lower,
  round(quantile_cont(score_bleu, 0.975) FILTER (WHERE rep >= 0), 6) AS bleu_ci_upper,
  round(max(CASE WHEN rep < 0 THEN score_f1 END), 6) AS f1,
  round(quantile_cont(score_f1, 0.025) FILTER (WHERE rep >= 0), 6) AS f1_ci_lower,
  round(quantile_cont(score_f1, 0.975) FILTER (WHERE rep >= 0), 6) AS f1_ci_upper
FROM sc
"""


@register("a5_bootstrap_ci_blocks", _sql_block_replicates(1000, 4096) + _SQL_CI)
def a5_bootstrap_ci_blocks(spark, sf_dir):
    """95% intervals from 1000 replicates over 4096 blocks of additive statistics (the defaults, by name)."""
    out = bootstrap_ci(pair_stats(spark, sf_dir), ["bleu", "f1"], n_boot=1000, seed=42, method="blocks", blocks=4096)
    return out.select(*[R6(c) for c in out.columns])


@register("a5_bootstrap_ci_multinomial", _sql_multinomial_replicates(1000) + _SQL_CI)
def a5_bootstrap_ci_multinomial(spark, sf_dir):
    """95% intervals from 1000 resamples of exactly n rows with replacement, drawn by hash."""
    st = written(pair_stats(spark, sf_dir), "pair-stats")
    out = bootstrap_ci(st, ["bleu", "f1"], n_boot=1000, seed=42, method="multinomial")
    return out.select(*[R6(c) for c in out.columns])


@register("a5_bootstrap_ci_exact")
def a5_bootstrap_ci_exact(spark, sf_dir):
    """95% intervals from 1000 resamples of exactly n rows, the draws split down a tree of blocks (any size)."""
    out = bootstrap_ci(pair_stats(spark, sf_dir), ["bleu", "f1", "samples"], n_boot=1000, seed=42, method="exact")
    return out.select(*[R6(c) for c in out.columns])


@register("a5_bootstrap_ci_metric", _sql_block_replicates(1000, 4096) + """
SELECT round(max(CASE WHEN rep < 0 THEN score_len END), 6) AS brevity,
  round(quantile_cont(score_len, 0.025) FILTER (WHERE rep >= 0), 6) AS brevity_ci_lower,
  round(quantile_cont(score_len, 0.975) FILTER (WHERE rep >= 0), 6) AS brevity_ci_upper
FROM (SELECT rep, S_sys_len / S_ref_len AS score_len FROM g)
""")
def a5_bootstrap_ci_metric(spark, sf_dir):
    """95% interval of a metric that the caller defines: the ratio of system to reference length."""
    out = bootstrap_ci(pair_stats(spark, sf_dir), BREVITY)
    return out.select(*[R6(c) for c in out.columns])


@register("a5_bootstrap_ci_poisson", _sql_replicates(1000) + _SQL_CI)
def a5_bootstrap_ci_poisson(spark, sf_dir):
    """95% intervals from 1000 replicates with a Poisson weight of its own for every row."""
    out = bootstrap_ci(pair_stats(spark, sf_dir), ["bleu", "f1"], n_boot=1000, seed=42, method="poisson")
    return out.select(*[R6(c) for c in out.columns])


@register("a5_bootstrap_ci", _sql_replicates(1000) + _SQL_CI)
def a5_bootstrap_ci(spark, sf_dir):
    """95% bootstrap intervals of corpus BLEU and token F1: 1000 replicates, every row resampled by itself."""
    out = bootstrap_ci(pair_stats(spark, sf_dir), ["bleu", "f1"], n_boot=1000, ci=0.95, seed=42, method="poisson")
    return out.select(*[R6(c) for c in out.columns])


def _rendered(scaled) -> str:
    return " || ':' || ".join(f"CAST(CAST({x} AS BIGINT) AS VARCHAR)" for x in scaled)


@register("a6_reconstruction_report", _sql_replicates(1000) + f"""
SELECT round(max(CASE WHEN rep < 0 THEN score_bleu END), 6) AS bleu,
  round(quantile_cont(score_bleu, 0.025) FILTER (WHERE rep >= 0), 6) AS bleu_ci_lower,
  round(quantile_cont(score_bleu, 0.975) FILTER (WHERE rep >= 0), 6) AS bleu_ci_upper,
  round(max(CASE WHEN rep < 0 THEN score_f1 END), 6) AS token_f1,
  round(quantile_cont(score_f1, 0.025) FILTER (WHERE rep >= 0), 6) AS token_f1_ci_lower,
  round(quantile_cont(score_f1, 0.975) FILTER (WHERE rep >= 0), 6) AS token_f1_ci_upper,
  round(max(CASE WHEN rep < 0 THEN score_len END), 6) AS avg_ref_tokens,
  round(max(CASE WHEN rep < 0 THEN score_len END) / 4.0, 6) AS token_compression_ratio,
  CAST(max(CASE WHEN rep < 0 THEN score_n END) AS BIGINT) AS samples,
  (SELECT string_agg({_rendered(["min_tokens", "max_tokens", "samples", "round(bleu * 10000)", "round(token_f1 * 10000)"])}, ','
                     ORDER BY bucket) FROM ({_sql_buckets(4, True)})) AS length_buckets
FROM sc
""")
def a6_reconstruction_report(spark, sf_dir):
    """The evaluation record (K = 4 prefix tokens) with its 4 length buckets
    (rendered as min:max:samples:bleu:f1, the last two times 10000)."""
    st = written(pair_stats(spark, sf_dir, with_bleu=True), "pair-stats")
    out = reconstruction_report(st, prefix_tokens=4, n_boot=1000, seed=42, method="poisson", buckets=4)
    scaled = lambda b, c: F.round(F.round(b[c], 6) * 10000).cast("long")
    shown = F.array_join(F.transform("length_buckets", lambda b: F.concat_ws(
        ":", *[b[c].cast("string") for c in ("min_tokens", "max_tokens", "samples")],
        *[scaled(b, c).cast("string") for c in ("bleu", "token_f1")])), ",")
    return out.select(*[R6(c) if c != "samples" else c for c in out.columns if c != "length_buckets"],
                      shown.alias("length_buckets"))


# -- JN3, P1-P3 -------------------------------------------------------------

@register("jn3_join_predictions", f"""
WITH p AS (SELECT id, prediction FROM ({SQL_PAIRS})),
r AS (SELECT doc_id AS id, text AS reference FROM documents)
SELECT count(*) AS pairs, round(avg({S.token_f1('prediction', 'reference')}), 6) AS token_f1
FROM p JOIN r USING (id)
""")
def jn3_join_predictions(spark, sf_dir):
    """Predictions matched to their reference documents by id (inner join: unmatched rows drop, like zip strict=False)."""
    from textbench.plans.fixtures import corpus

    p = pairs(spark, sf_dir).select("id", "prediction")
    r = corpus(spark, sf_dir).select(F.col("doc_id").alias("id"), F.col("text").alias("reference"))
    j = p.join(r, "id", "inner")
    return j.groupBy().agg(F.count(F.lit(1)).alias("pairs"),
                           F.round(F.avg(token_f1_col("prediction", "reference")), 6).alias("token_f1"))


@register("p1_hash_uniform", f"""
SELECT lang, round(sum({sql_hash_uniform(42, 'doc_id')}), 6) AS u_sum,
       count(*) FILTER (WHERE {sql_hash_uniform(42, 'doc_id')} < 0.5) AS below_half
FROM documents GROUP BY lang
""")
def p1_hash_uniform(spark, sf_dir):
    """Per-row deterministic uniforms: their sum and the count below 0.5 per language."""
    from textbench.functions.hashing import hash_uniform
    from textbench.plans.fixtures import table

    d = table(spark, sf_dir, "documents").select("lang", hash_uniform(42, F.col("doc_id")).alias("u"))
    return d.groupBy("lang").agg(F.round(F.sum("u"), 6).alias("u_sum"),
                                 F.count(F.when(F.col("u") < 0.5, 1)).alias("below_half"))


@register("p2_two_level_rank", """
SELECT doc_id, row_number() OVER (ORDER BY n_chars, doc_id) - 1 AS rank FROM documents
""")
def p2_two_level_rank(spark, sf_dir):
    """Exact global rank of documents by length (ties by id) from range slices, not a one-task window."""
    from textbench.operators.ranking import two_level_rank
    from textbench.plans.fixtures import table

    d = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    return two_level_rank(d, "n_chars", "doc_id", "rank").select("doc_id", "rank")


@register("p2_rank_double", """
SELECT event_id, row_number() OVER (ORDER BY value NULLS FIRST, event_id) - 1 AS rank FROM events
""")
def p2_rank_double(spark, sf_dir):
    """Exact rank of events by a fractional value (ties by id)."""
    from textbench.operators.ranking import two_level_rank
    from textbench.plans.fixtures import table

    e = table(spark, sf_dir, "events").select("event_id", "value")
    return two_level_rank(e, "value", "event_id", "rank").select("event_id", "rank")


@register("p2_rank_string", """
SELECT doc_id, row_number() OVER (PARTITION BY lang ORDER BY text NULLS FIRST, doc_id) - 1 AS rank,
       count(*) OVER (PARTITION BY lang) AS docs FROM documents
""")
def p2_rank_string(spark, sf_dir):
    """Exact rank of documents by their text within each language."""
    from textbench.operators.ranking import two_level_rank
    from textbench.plans.fixtures import table

    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    return two_level_rank(d, "text", "doc_id", "rank", total_col="docs", partition_cols=["lang"]).select("doc_id", "rank", "docs")


@register("p2_dense_index", """
SELECT doc_id, hash_id, row_number() OVER (ORDER BY hash_id, doc_id) - 1 AS idx FROM (
  SELECT doc_id, CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 15) AS BIGINT) * 8 * (CASE WHEN doc_id % 2 = 0 THEN 1 ELSE -1 END) AS hash_id
  FROM documents)
""")
def p2_dense_index(spark, sf_dir):
    """Dense index over hash ids of both signs that span the 64-bit range."""
    from textbench.operators.ranking import range_rank
    from textbench.plans.fixtures import table

    half = F.conv(F.substring(F.md5(F.col("doc_id").cast("string")), 1, 15), 16, 10).cast("long") * 8
    d = table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("doc_id") % 2 == 0, half).otherwise(-half).alias("hash_id"))
    return range_rank(d, ["hash_id", "doc_id"], "idx")


@register("p3_ngram_stats", SQL_PAIR_STATS.replace("SELECT t.id, t.model, t.is_refusal, t.length, t.f1,", "SELECT t.id,"))
def p3_ngram_stats(spark, sf_dir):
    """Per-pair BLEU sufficient statistics (lengths, clipped matches and totals for n = 1..4)."""
    return B.bleu_row_stats(pair_rows(spark, sf_dir).select("id", "prediction", "reference"))
