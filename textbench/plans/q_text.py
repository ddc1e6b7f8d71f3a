"""Registered queries: text scalars (TXT1, TXT2, TXT4, TXT6, TXT8, TXT9)."""

from __future__ import annotations

from pyspark.sql import functions as F

from textbench.functions import text as T
from textbench.functions.hashing import sql_hash_uniform
from textbench.operators.batching import assistant_label_spans
from textbench.plans import sqlbits as S
from textbench.plans.catalog import register
from textbench.plans.fixtures import corpus, table


@register("txt1_normalize_ws", f"""
SELECT doc_id, md5({S.normalize_ws('text')}) AS norm_md5, length({S.normalize_ws('text')}) AS norm_chars FROM documents
""")
def txt1_normalize_ws(spark, sf_dir):
    d = corpus(spark, sf_dir)
    n = T.normalize_ws("text")
    return d.select("doc_id", F.md5(n).alias("norm_md5"), F.length(n).alias("norm_chars"))


@register("txt2_words", f"""
SELECT lang, count(*) AS docs, CAST(sum(len({S.words('text')})) AS BIGINT) AS words,
       max(len({S.words('text')})) AS max_words FROM documents GROUP BY lang
""")
def txt2_words(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("lang", F.size(T.words("text")).alias("n"))
    return d.groupBy("lang").agg(F.count(F.lit(1)).alias("docs"), F.sum("n").cast("long").alias("words"),
                                 F.max("n").alias("max_words"))


def sql_sample_phrase(text: str, key: str, seed=42, lo=3, hi=6) -> str:
    w = S.words(text)
    ln = f"CAST({lo} + floor({sql_hash_uniform(seed, key, chr(39) + 'len' + chr(39))} * (least({hi}, len({w})) - {lo} + 1)) AS BIGINT)"
    st = f"CAST(floor({sql_hash_uniform(seed, key, chr(39) + 'start' + chr(39))} * (len({w}) - {ln} + 1)) AS BIGINT)"
    return (f"(CASE WHEN len({w}) = 0 THEN '' WHEN len({w}) <= {lo} THEN array_to_string({w}, ' ') "
            f"ELSE array_to_string({w}[{st} + 1:{st} + {ln}], ' ') END)")


@register("txt4_sample_phrase", f"""
SELECT doc_id, {sql_sample_phrase('text', 'doc_id')} AS phrase FROM documents
""")
def txt4_sample_phrase(spark, sf_dir):
    d = corpus(spark, sf_dir)
    return d.select("doc_id", T.sample_phrase(F.col("text"), 42, F.col("doc_id")).alias("phrase"))


@register("txt6_render_prompt", """
WITH m AS (SELECT conv_id, string_agg(concat('<s>', role, chr(10), text, '</s>', chr(10)), '' ORDER BY turn) AS body
           FROM conversations GROUP BY conv_id)
SELECT conv_id, md5(concat(body, '<s>assistant', chr(10))) AS prompt_md5,
       length(concat(body, '<s>assistant', chr(10))) AS prompt_chars FROM m
""")
def txt6_render_prompt(spark, sf_dir):
    """Fallback chat template over each conversation, with the generation header."""
    c = table(spark, sf_dir, "conversations")
    msgs = c.groupBy("conv_id").agg(
        F.array_sort(F.collect_list(F.struct("turn", T.message(F.col("role"), F.col("text")).alias("m")))).alias("ms"))
    prompt = T.render_prompt(F.transform("ms", lambda x: x["m"]), bos="<s>", eos="</s>", add_generation_prompt=True)
    return msgs.select("conv_id", F.md5(prompt).alias("prompt_md5"), F.length(prompt).alias("prompt_chars"))


@register("txt8_label_layout", f"""
WITH t AS (SELECT doc_id, 1 + doc_id % 8 AS docs, len({S.regex_tokens('text')}) AS tl FROM documents)
SELECT doc_id, CAST(4 * 8 + 16 + 512 AS INTEGER) AS seq_len,
       CAST(least(tl, 512) AS INTEGER) AS supervised, CAST(4 * docs AS INTEGER) AS prefix_attended FROM t
""")
def txt8_label_layout(spark, sf_dir):
    """K=4 prefix slots for up to 8 documents, 16 prompt tokens, target capped at and padded to the default length."""
    d = corpus(spark, sf_dir).select("doc_id", F.size(T.regex_tokens("text")).alias("tl"))
    mask = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: i < (F.col("doc_id") % 8 + 1))
    tl = F.least(F.col("tl"), F.lit(T.MAX_TOKENS))
    layout = T.label_layout(F.lit(4), mask, F.lit(16), tl, F.lit(T.MAX_TOKENS) - tl)
    att = T.prefix_attention(F.lit(4), mask)
    return d.select("doc_id", F.size(layout).alias("seq_len"),
                    F.aggregate(layout, F.lit(0), lambda a, x: a + x).alias("supervised"),
                    F.size(F.filter(att, lambda b: b)).alias("prefix_attended"))


@register("txt9_assistant_label_spans", f"""
WITH t AS (SELECT conv_id, turn, role, len({S.regex_tokens('text')}) AS n FROM conversations),
s AS (SELECT *, sum(n) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS e FROM t)
SELECT conv_id, CAST(sum(CASE WHEN role = 'assistant' THEN least(e, 2048) - least(e - n, 2048) ELSE 0 END) AS BIGINT) AS supervised_tokens,
       CAST(least(max(e), 2048) AS BIGINT) AS seq_len, count(*) FILTER (WHERE role = 'assistant') AS assistant_turns
FROM s GROUP BY conv_id
""")
def txt9_assistant_label_spans(spark, sf_dir):
    """Supervised (assistant) token spans per conversation, clipped at the default length."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.size(T.regex_tokens("text")).alias("n"))
    sp = assistant_label_spans(c, "conv_id", "turn", "role", "n")
    return sp.groupBy("conv_id").agg(
        F.sum("supervised_tokens").cast("long").alias("supervised_tokens"),
        F.max("end").cast("long").alias("seq_len"),
        F.sum(F.when(F.col("supervised"), 1).otherwise(0)).cast("long").alias("assistant_turns"))
