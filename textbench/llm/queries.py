"""Registered queries of the training-data operators and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from textbench.llm import merkle, prefixtrie, quality
from textbench.llm.common import table

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def _query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            ORACLE[name] = sql
        return fn

    return add


@_query("op1_cross_entropy_difference")
def op1(spark, sf_dir):
    from textbench.llm.lmscore import cross_entropy_difference

    return cross_entropy_difference(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), keep=["doc_id"])


@_query("op2_tool_call_links")
def op2(spark, sf_dir):
    from textbench.llm.toolcalls import SCHEMAS, derive_calls, link_tool_calls

    return link_tool_calls(*derive_calls(table(spark, sf_dir, "conversations")), SCHEMAS)


_OP3_SQL = """
WITH RECURSIVE link AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) >= 0.98),
reach AS (SELECT a, b FROM link UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a),
low AS (SELECT a, least(a, min(b)) AS component_id FROM reach GROUP BY a),
deg AS (SELECT a, count(*) AS n_links FROM link GROUP BY a)
SELECT vec_id, coalesce(n_links, 0)::BIGINT AS n_links, coalesce(component_id, vec_id) AS component_id,
       coalesce(component_id, vec_id) = vec_id AS kept
FROM embeddings LEFT JOIN low ON vec_id = low.a LEFT JOIN deg ON vec_id = deg.a
"""


@_query("op3_collision_near_vectors", _OP3_SQL)
def op3(spark, sf_dir):
    from textbench.llm.vectors import near_vectors

    return near_vectors(table(spark, sf_dir, "embeddings"))


_OP4_SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size,
         CAST('0x' || substr(md5(concat_ws(':', '11', doc_id, md5(text))), 1, 15) AS BIGINT) AS r
  FROM documents),
s0 AS (SELECT source, sum(size)::DOUBLE AS source_size FROM d GROUP BY source),
s1 AS (SELECT *, [3.0, 1.0, 2.0][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::DOUBLE AS w FROM s0),
s2 AS (SELECT *, 2.0::DOUBLE * source_size AS cap, (2.0::DOUBLE * source_size) / w AS full_at FROM s1),
s3 AS (SELECT *, coalesce(sum(cap) OVER (ORDER BY full_at, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used,
         sum(w) OVER (ORDER BY full_at, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS live,
         sum(source_size) OVER () * 1.5::DOUBLE AS goal FROM s2),
s4 AS (SELECT *, max(CASE WHEN (goal - used) / live <= full_at THEN (goal - used) / live END) OVER () AS level FROM s3),
s AS (SELECT source, source_size, CASE WHEN level IS NULL THEN cap ELSE least(cap, w * level) END AS target FROM s4),
run AS (
  SELECT d.*, s.source_size, s.target,
         sum(size) OVER (PARTITION BY d.source ORDER BY r, doc_id ROWS UNBOUNDED PRECEDING) AS upto
  FROM d JOIN s ON d.source IS NOT DISTINCT FROM s.source),
seq AS (
  SELECT run.*, turn, CASE WHEN target > 0 THEN (upto + turn * source_size) / target ELSE r / 1152921504606846976.0::DOUBLE END AS finish
  FROM run, (VALUES (0), (1)) AS t(turn)),
cut AS (
  SELECT *, sum(size) OVER (ORDER BY finish, r, doc_id, size, turn ROWS UNBOUNDED PRECEDING) AS total FROM seq WHERE finish < 2),
taken AS (SELECT doc_id, count(*) AS copies FROM cut WHERE total <= (SELECT sum(target) FROM s) GROUP BY doc_id)
SELECT run.doc_id, size::BIGINT AS size, source_size::BIGINT AS source_size, round(target, 6) AS target,
       (size * coalesce(copies, 0))::BIGINT AS taken
FROM run LEFT JOIN taken USING (doc_id)
"""


@_query("op4_weighted_fair_mix", _OP4_SQL)
def op4(spark, sf_dir):
    from textbench.llm.mixing import mix_sources

    out = mix_sources(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "source_size", F.round("target", 6).alias("target"), "taken")


@_query("op5_nb_char_toxicity")
def op5(spark, sf_dir):
    from textbench.llm.toxicity import score_toxicity

    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), keep=["doc_id"])


_OP7_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                             '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, least(10, len(w)) AS k,
               list_slice(w, i, i + least(10, len(w)) - 1) AS words
        FROM (SELECT item_id, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
spot AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d),
hit AS (SELECT spot.doc_id, spot.i, win.k, win.item_id
        FROM spot JOIN win ON spot.w[spot.i] = win.words[1] AND list_slice(spot.w, spot.i, spot.i + win.k - 1) = win.words),
pos AS (SELECT DISTINCT doc_id, unnest(range(i, i + k)) AS p FROM hit),
n AS (SELECT doc_id, count(*) AS n_hit FROM pos GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
       FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hit) GROUP BY doc_id)
SELECT d.doc_id, coalesce(len(w), 0)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit,
       coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN it USING (doc_id)
"""


_OP6_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
q AS (SELECT page_id, octet_length(encode(body)) AS payload_bytes, sha1(body) AS payload_digest FROM p),
k AS (SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS keeper FROM q)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes, payload_digest,
       CASE WHEN page_id = keeper THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> keeper THEN keeper END AS refers_to
FROM k
"""


@_query("op6_warc_zstd_archives", _OP6_SQL)
def op6(spark, sf_dir):
    from textbench.llm.warc import archive_round_trip

    return archive_round_trip(table(spark, sf_dir, "pages")).drop("url")


@_query("op7_benchmark_contamination", _OP7_SQL)
def op7(spark, sf_dir):
    from textbench.llm.contamination import contamination

    out = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), keep=["doc_id"])
    return out.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


@_query("op8_minhash_near_dedup")
def op8(spark, sf_dir):
    from textbench.llm.neardup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), k=2)


@_query("op9_license_scan")
def op9(spark, sf_dir):
    from textbench.llm.licenses import document_files, license_scan

    out = license_scan(document_files(table(spark, sf_dir, "documents")))
    return out.withColumnRenamed("file_id", "doc_id").withColumn("score", F.round("score", 6))


@_query("op10_fuzzy_line_dedup")
def op10(spark, sf_dir):
    from textbench.llm.lines import dedup_lines

    return dedup_lines(table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_kept", "removed")


@_query("op13_merkle_manifest", merkle.SQL)
def op13(spark, sf_dir):
    return merkle.tamper_check(table(spark, sf_dir, "documents"))


@_query("op11_conversation_trie", prefixtrie.SQL)
def op11(spark, sf_dir):
    return prefixtrie.conversation_trie(table(spark, sf_dir, "conversations"))


@_query("op12_random_index_quality")
def op12(spark, sf_dir):
    return quality.score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), keep=["doc_id"])
