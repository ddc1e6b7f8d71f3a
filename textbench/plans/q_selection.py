"""Registered queries: document-selection dataset and lookups (SEL1, JN1, JN2, TXT5, TXT7)."""

from __future__ import annotations

from pyspark.sql import functions as F

from textbench.functions import text as T
from textbench.functions.hashing import hash_randint, sql_hash_bits, sql_hash_uniform
from textbench.operators import selection as SEL
from textbench.plans import sqlbits as S
from textbench.plans.catalog import register
from textbench.plans.fixtures import corpus, table

CFG = SEL.SelectionConfig()
RT = CFG.refusal_text.replace("'", "''")


def _u(*parts: str) -> str:
    return sql_hash_uniform(42, *parts)


def _randint(lo: str, hi: str, *parts: str) -> str:
    return f"CAST(({lo}) + floor({_u(*parts)} * (({hi}) - ({lo}) + 1)) AS BIGINT)"


def _floyd(k: str, n: str, key: str) -> str:
    t = _randint("0", "j", key, "'floyd'", "j")
    order_h = sql_hash_bits(42, key, "'order'", "v")
    chosen = (f"list_reduce(range({n} - {k}, {n}), lambda acc, j: CASE WHEN list_contains(acc, {t}) "
              f"THEN list_append(acc, j) ELSE list_append(acc, {t}) END, []::BIGINT[])")
    return f"list_transform(list_sort(list_transform({chosen}, lambda v: {{'h': {order_h}, 'v': v}})), lambda x: x.v)"


def _phrase(text: str, *key: str) -> str:
    w = S.words(text)
    ln = _randint("3", f"least(6, len({w}))", *key, "'len'")
    st = _randint("0", f"len({w}) - {ln}", *key, "'start'")
    return (f"(CASE WHEN len({w}) = 0 THEN '' WHEN len({w}) <= 3 THEN array_to_string({w}, ' ') "
            f"ELSE array_to_string({w}[{st} + 1:{st} + {ln}], ' ') END)")


def _index_query(k: str, i: str) -> str:
    return (f"concat('There are ', CAST({k} AS VARCHAR), ' documents. Return document #', CAST({i} AS VARCHAR), "
            f"' exactly. If no document matches, reply with: \"{RT}\"')")


def _content_query(k: str, p: str) -> str:
    return (f"concat('There are ', CAST({k} AS VARCHAR), ' documents. Return the document that contains the phrase \"', "
            f"{p}, '\" exactly. If no document matches, reply with: \"{RT}\"')")


SQL_INDEXED = "SELECT doc_id, text, row_number() OVER (ORDER BY doc_id) - 1 AS idx FROM documents"

SQL_SELECTION = f"""
WITH d AS ({SQL_INDEXED}),
n AS (SELECT count(*) AS N FROM d),
s1 AS (SELECT idx AS sid, N, CAST(greatest(1, least({_randint('2', '8', 'idx', "'count'")}, N)) AS BIGINT) AS k FROM d, n),
s2 AS (SELECT *, {_floyd('k', 'N', 'sid')} AS doc_indices,
              {_u('sid', "'refusal'")} < 0.2 AS is_refusal, {_u('sid', "'content'")} < 0.5 AS content,
              {_u('sid', "'oob'")} < 0.5 AS oobf FROM s1),
s3 AS (SELECT *, is_refusal AND NOT (oobf OR N <= k) AS use_decoy FROM s2),
s4 AS (SELECT *, CASE WHEN use_decoy THEN list_reduce(list_sort(doc_indices),
              lambda acc, c: CASE WHEN acc >= c THEN acc + 1 ELSE acc END, {_randint('0', 'N - k - 1', 'sid', "'decoy'")}) END AS decoy FROM s3),
nd AS (SELECT sid, CASE WHEN use_decoy THEN list_append(doc_indices, decoy) ELSE doc_indices END AS need FROM s4),
ne AS (SELECT sid, unnest(need) AS idx, unnest(range(len(need))) AS pos FROM nd),
tx AS (SELECT sid, list(text ORDER BY pos) AS texts FROM ne JOIN d USING (idx) GROUP BY sid),
s5 AS (SELECT s4.*, texts, texts[1:k] AS docs, {_randint('0', 'k - 1', 'sid', "'target'")} AS tpos FROM s4 JOIN tx USING (sid)),
s6 AS (SELECT *, docs[tpos + 1] AS ttext FROM s5),
s7 AS (SELECT *, {_phrase('ttext', 'sid', "'tphrase'")} AS pt,
              CASE WHEN use_decoy THEN {_phrase('texts[k + 1]', 'sid', "'dphrase'")} END AS pd FROM s6),
s8 AS (SELECT *,
   pt <> '' AND NOT (len(list_filter(range(k), lambda i: i <> tpos AND strpos(docs[i + 1], pt) > 0)) > 0) AS t_ok,
   use_decoy AND pd <> '' AND NOT (len(list_filter(range(k), lambda i: strpos(docs[i + 1], pd) > 0)) > 0) AS d_ok,
   k + {_randint('1', 'greatest(2, k // 2)', 'sid', "'oobpos'")} AS oob FROM s7),
sel AS (SELECT sid AS sample_id, doc_indices, k AS doc_count, is_refusal,
   CASE WHEN NOT is_refusal AND content AND t_ok THEN 'content' WHEN NOT is_refusal THEN 'position'
        WHEN d_ok THEN 'refusal_content' ELSE 'refusal_position' END AS query_kind,
   CASE WHEN NOT is_refusal AND content AND t_ok THEN {_content_query('k', 'pt')}
        WHEN NOT is_refusal THEN {_index_query('k', 'tpos + 1')}
        WHEN d_ok THEN {_content_query('k', 'pd')} ELSE {_index_query('k', 'oob')} END AS query,
   CASE WHEN is_refusal THEN '{RT}' ELSE ttext END AS target_text, pt, tpos, docs FROM s8)
"""


def _selection(spark, sf_dir):
    return SEL.selection_dataset(corpus(spark, sf_dir), cfg=CFG, seed=42)


@register("sel1_selection_dataset", SQL_SELECTION + """
SELECT sample_id, CAST(doc_count AS INTEGER) AS doc_count, array_to_string(doc_indices, ',') AS doc_indices,
       is_refusal, query_kind, query, md5(target_text) AS target_md5 FROM sel
""")
def sel1_selection_dataset(spark, sf_dir):
    """One selection example per corpus document (sample id = dense index)."""
    s = _selection(spark, sf_dir)
    return s.select("sample_id", "doc_count", F.array_join("doc_indices", ",").alias("doc_indices"), "is_refusal",
                    "query_kind", "query", F.md5("target_text").alias("target_md5"))


SQL_SELECTION_EVAL = SQL_SELECTION.replace("'42'", "'43'").replace(
    " AS k FROM d, n)", " AS k FROM (SELECT unnest(range(2000)) AS idx) e, n)")


@register("sel1_selection_eval", SQL_SELECTION_EVAL + """
SELECT sample_id, CAST(doc_count AS INTEGER) AS doc_count, array_to_string(doc_indices, ',') AS doc_indices,
       is_refusal, query_kind, query, md5(target_text) AS target_md5 FROM sel
""")
def sel1_selection_eval(spark, sf_dir):
    """The evaluation split: its fixed number of samples over the whole corpus, with the seed after the training one."""
    samples, seed = SEL.split_samples(spark, CFG, "eval", 42)
    s = SEL.selection_dataset(corpus(spark, sf_dir), samples, CFG, seed)
    return s.select("sample_id", "doc_count", F.array_join("doc_indices", ",").alias("doc_indices"), "is_refusal",
                    "query_kind", "query", F.md5("target_text").alias("target_md5"))


PROMPT = {"system": "Answer from the documents.", "user_prefix": "Documents are attached."}


@register("txt6_selection_prompt", SQL_SELECTION + f"""
SELECT sample_id, md5(p) AS prompt_md5, md5(concat(p, '<s>assistant', chr(10), target_text, '</s>', chr(10))) AS full_md5
FROM (SELECT sample_id, target_text, concat('<s>system', chr(10), '{PROMPT['system']}', '</s>', chr(10), '<s>user', chr(10),
        '{PROMPT['user_prefix']}', chr(10), query, '</s>', chr(10)) AS p FROM sel)
""")
def txt6_selection_prompt(spark, sf_dir):
    """System message, user prefix and query of each selection example, without and with the answer."""
    s = _selection(spark, sf_dir)
    ask = [T.message(F.lit("system"), F.lit(PROMPT["system"])),
           T.message(F.lit("user"), T.selection_user_content(F.col("query"), PROMPT["user_prefix"]))]
    answer = T.message(F.lit("assistant"), F.col("target_text"))
    render = lambda m: F.md5(T.render_prompt(F.array(*m), bos="<s>", eos="</s>"))
    return s.select("sample_id", render(ask).alias("prompt_md5"), render([*ask, answer]).alias("full_md5"))


@register("txt7_render_queries", SQL_SELECTION + """
SELECT query_kind, count(*) AS samples, CAST(sum(length(query)) AS BIGINT) AS query_chars FROM sel GROUP BY query_kind
""")
def txt7_render_queries(spark, sf_dir):
    s = _selection(spark, sf_dir)
    return s.groupBy("query_kind").agg(F.count(F.lit(1)).alias("samples"),
                                       F.sum(F.length("query")).cast("long").alias("query_chars"))


@register("txt5_phrase_in_docs", SQL_SELECTION + """
SELECT sample_id, pt AS phrase, (pt = '' OR len(list_filter(range(doc_count), lambda i: i <> tpos AND strpos(docs[i + 1], pt) > 0)) > 0) AS found_elsewhere,
       (pt = '' OR len(list_filter(range(doc_count), lambda i: strpos(docs[i + 1], pt) > 0)) > 0) AS found_anywhere
FROM sel WHERE NOT is_refusal
""")
def txt5_phrase_in_docs(spark, sf_dir):
    """For each positive sample: is the target's phrase in another document of the group (and in any)?"""
    docs = corpus(spark, sf_dir)
    ids = SEL.index_ids(docs)
    s = SEL.selection_plan(ids, cfg=CFG, seed=42).filter(~F.col("is_refusal"))
    texts = SEL.lookup_docs(s, ids, docs, ["sample_id", "target_pos"], "doc_indices", "docs")
    sid = F.col("sample_id")
    j = texts.withColumnRenamed("target_pos", "tpos")
    j = j.withColumn("ttext", F.element_at("docs", (F.col("tpos") + 1).cast("int")))
    j = j.withColumn("phrase", T.sample_phrase(F.col("ttext"), 42, sid, F.lit("tphrase")))
    return j.select("sample_id", "phrase",
                    T.phrase_in_docs(F.col("phrase"), F.col("docs"), F.col("tpos")).alias("found_elsewhere"),
                    T.phrase_in_docs(F.col("phrase"), F.col("docs")).alias("found_anywhere"))


@register("jn1_lookup_docs", SQL_SELECTION + """
, ne2 AS (SELECT sample_id, unnest(doc_indices) AS idx, unnest(range(len(doc_indices))) AS pos FROM sel),
t2 AS (SELECT sample_id, list(text ORDER BY pos) AS texts FROM ne2 JOIN d USING (idx) GROUP BY sample_id)
SELECT sample_id, md5(array_to_string(texts, chr(1))) AS texts_md5, CAST(sum(length(t)) AS BIGINT) AS chars
FROM (SELECT sample_id, texts, unnest(texts) AS t FROM t2) GROUP BY sample_id, texts
""")
def jn1_lookup_docs(spark, sf_dir):
    """Each sample's document indices resolved to its ordered texts."""
    docs = corpus(spark, sf_dir)
    ids = SEL.index_ids(docs)
    t = SEL.lookup_docs(SEL.selection_plan(ids, cfg=CFG, seed=42), ids, docs, ["sample_id"], "doc_indices", "texts")
    return t.select("sample_id", F.md5(F.array_join("texts", "\u0001")).alias("texts_md5"),
                    F.aggregate("texts", F.lit(0).cast("long"), lambda a, x: a + F.length(x)).alias("chars"))


@register("jn2_gather_embeddings", f"""
WITH v AS (SELECT vec_id, embedding, row_number() OVER (ORDER BY vec_id) - 1 AS idx FROM embeddings),
n AS (SELECT count(*) AS N FROM v),
s AS (SELECT idx AS sid, N, CAST(greatest(1, least({_randint('2', '8', 'idx', "'count'")}, N)) AS BIGINT) AS k FROM v, n),
f AS (SELECT sid, k, {_floyd('k', 'N', 'sid')} AS ind FROM s),
e AS (SELECT sid, k, unnest(ind) AS idx, unnest(range(len(ind))) AS pos FROM f),
g AS (SELECT sid, k, list(embedding ORDER BY pos) AS embs FROM e JOIN v USING (idx) GROUP BY sid, k)
SELECT sid AS sample_id, CAST(k AS INTEGER) AS doc_count, CAST(8 * len(embs[1]) AS INTEGER) AS padded_values,
       round(list_sum(list_transform(embs, lambda x: list_sum(x))), 3) AS value_sum FROM g
""")
def jn2_gather_embeddings(spark, sf_dir):
    """Per sample (one per vector) k in [2, 8] vectors gathered and zero-padded to 8 slots."""
    from textbench.functions.hashing import with_scalars
    from textbench.operators.splits import sample_k_of_n

    vec = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    iv = SEL.index_ids(vec, "vec_id")
    n = iv.groupBy().agg(F.count(F.lit(1)).alias("N"))
    s = with_scalars(iv.select(F.col("idx").alias("sample_id")), n)
    k = F.greatest(F.lit(1), F.least(hash_randint(2, 8, 42, F.col("sample_id"), F.lit("count")), F.col("N")))
    s = s.withColumn("k", k).withColumn("ind", sample_k_of_n(F.col("k"), F.col("N"), 42, F.col("sample_id")))
    dim = F.size(F.element_at("doc_embeddings", 1))
    g = SEL.gather_embeddings(s, iv, vec, ["sample_id"], "ind", max_docs=8, id_col="vec_id")
    total = F.aggregate("doc_embeddings", F.lit(0.0).cast("double"),
                        lambda a, e: a + F.aggregate(e, F.lit(0.0).cast("double"), lambda b, x: b + x))
    return g.select("sample_id", "doc_count", (F.lit(8) * dim).cast("int").alias("padded_values"),
                    F.round(total, 3).alias("value_sum"))
