"""Registered queries: embeddings (E1-E4, JN5, JN6, SRC7, A16)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from textbench.operators import embeddings as EM
from textbench.plans import sqlbits as S
from textbench.plans.catalog import register
from textbench.plans.fixtures import corpus, table, vectors
from textbench.session import checkpoint_dir, spread
from textbench.sources.readers import read_embeddings

K, MODEL_DIM = 4, 16
_LIN = EM.random_adapter(64, MODEL_DIM, K, layers=0, seed=7)
_ROWSUM = [float(x) for x in _LIN[0][0].sum(axis=1)]
_BSUM = float(_LIN[0][1].sum())


def _linear_factory(dim: int):
    return EM.random_adapter(dim, MODEL_DIM, K, layers=0, seed=7)


def _mlp_factory(dim: int):
    return EM.random_adapter(dim, MODEL_DIM, K, layers=2, hidden=32, seed=7)


def _vec_stats(col: str = "embedding"):
    e = F.col(col)
    return [
        F.round(F.aggregate(e, F.lit(0.0).cast("double"), lambda a, x: a + F.abs(x)), 6).alias("l1"),
        F.round(F.aggregate(e, F.lit(0.0).cast("double"), lambda a, x: a + x), 6).alias("total"),
        F.size(F.filter(e, lambda x: x != 0)).alias("nnz"),
    ]


SQL_BOW = f"""
WITH w AS (SELECT doc_id, unnest({S.words('text')}) AS w FROM documents),
b AS (SELECT doc_id, ('0x' || substr(md5(w), 1, 8))::BIGINT % 64 AS bucket,
             CASE WHEN ('0x' || substr(md5(w), 9, 2))::BIGINT % 2 = 0 THEN 1 ELSE -1 END AS sign FROM w),
e AS (SELECT doc_id, bucket, sum(sign) AS v FROM b GROUP BY 1, 2),
s AS (SELECT doc_id, CAST(sum(abs(v)) AS DOUBLE) AS l1, CAST(sum(v) AS DOUBLE) AS total,
             CAST(count(*) FILTER (WHERE v <> 0) AS INTEGER) AS nnz FROM e GROUP BY doc_id)
SELECT d.doc_id, coalesce(l1, 0.0) AS l1, coalesce(total, 0.0) AS total, coalesce(nnz, 0) AS nnz
FROM documents d LEFT JOIN s USING (doc_id)
"""


@register("e1_embed_texts", SQL_BOW)
def e1_embed_texts(spark, sf_dir):
    """Hashed bag-of-words vectors (64 dims) for every document."""
    v = EM.embed_texts(spread(corpus(spark, sf_dir)), dim=64)
    return v.select("doc_id", *_vec_stats())


@register("e2_precompute_embeddings", """
WITH n AS (SELECT count(*) AS a, count(*) FILTER (WHERE doc_id % 3 = 0) AS third FROM documents)
SELECT 'first' AS stage, third AS vectors, third AS ids, CAST(32 AS INTEGER) AS dim FROM n
UNION ALL SELECT 'resume', a, a, 32 FROM n UNION ALL SELECT 'again', a, a, 32 FROM n
UNION ALL SELECT 'part', a, a, 32 FROM n UNION ALL SELECT 'other_dim', a, a, 16 FROM n
""")
def e2_precompute_embeddings(spark, sf_dir):
    """A precompute's life in the shared folder: a third of the corpus, resumed
    on all of it, run again, run on a part, and run with another dimension."""
    docs = corpus(spark, sf_dir)
    part = docs.where("doc_id % 3 = 0")
    path = f"{checkpoint_dir(spark).rstrip('/')}/precompute/{uuid.uuid4().hex}"
    out = None
    for stage, rows, dim in (("first", part, 32), ("resume", docs, 32), ("again", docs, 32), ("part", part, 32),
                             ("other_dim", docs, 16)):
        v = EM.precompute_embeddings(spark, rows, path, dim=dim)
        # counted here: a later stage adds to the same folder
        n = v.agg(F.count(F.lit(1)).alias("vectors"), F.countDistinct("doc_id").alias("ids"),
                  F.max(F.size("embedding")).alias("dim")).first()
        row = spark.createDataFrame([(stage, n["vectors"], n["ids"], n["dim"])], "stage string, vectors long, ids long, dim int")
        out = row if out is None else out.unionAll(row)
    return out


_DOT = " + ".join(f"CAST(embedding[{i + 1}] AS DOUBLE) * CAST({r!r} AS DOUBLE)" for i, r in enumerate(_ROWSUM))


@register("e3_adapter_forward_linear", f"""
SELECT vec_id AS doc_id, CAST({K * MODEL_DIM} AS INTEGER) AS prefix_size, round({_DOT} + CAST({_BSUM!r} AS DOUBLE), 6) AS prefix_sum FROM embeddings
""")
def e3_adapter_forward_linear(spark, sf_dir):
    """Linear adapter (0 hidden layers) to a K=4 x 16 prefix; the checked value is the sum of the prefix."""
    p = EM.adapter_forward(vectors(spark, sf_dir), _linear_factory, out_type="double")
    return p.select("doc_id", F.size("prefix").alias("prefix_size"),
                    F.round(F.aggregate("prefix", F.lit(0.0).cast("double"), lambda a, x: a + x), 6).alias("prefix_sum"))


def _sql_mlp() -> str:
    """The two-layer adapter in SQL: weights as rows, a layer as join and sum,
    GELU with the same approximation of erf."""
    layers = _mlp_factory(64)
    ctes = ["x0 AS (SELECT vec_id AS doc_id, unnest(range(64)) AS i, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings)"]
    for n, (w, b) in enumerate(layers):
        rows = ", ".join(f"[{', '.join(repr(float(v)) for v in col)}]" for col in w.T)
        bias = ", ".join(repr(float(v)) for v in b)
        ctes.append(f"w{n} AS (SELECT j, unnest(range({w.shape[0]})) AS i, CAST(unnest(r) AS DOUBLE) AS w FROM "
                    f"(SELECT unnest(range({w.shape[1]})) AS j, unnest([{rows}]) AS r))")
        ctes.append(f"b{n} AS (SELECT unnest(range({w.shape[1]})) AS j, CAST(unnest([{bias}]) AS DOUBLE) AS b)")
        ctes.append(f"h{n} AS (SELECT doc_id, j AS i, sum(x * w) + any_value(b) AS z FROM x{n} JOIN w{n} USING (i) "
                    f"JOIN b{n} USING (j) GROUP BY doc_id, j)")
        if n < len(layers) - 1:
            t = f"(1 / (1 + {EM.ERF_P} * abs(z) / sqrt(2)))"
            a0, a1, a2, a3, a4 = EM.ERF_A
            poly = f"{t} * ({a0} + {t} * ({a1} + {t} * ({a2} + {t} * ({a3} + {t} * {a4}))))"
            ctes.append(f"x{n + 1} AS (SELECT doc_id, i, z * 0.5 * (1 + sign(z) * (1 - {poly} * exp(-z * z / 2))) AS x FROM h{n})")
    last = len(layers) - 1
    return (f"WITH {', '.join(ctes)} SELECT doc_id, CAST(count(*) AS INTEGER) AS prefix_size, "
            f"round(sum(z), 5) AS prefix_sum, round(max(z), 5) AS prefix_max FROM h{last} GROUP BY doc_id")


@register("e3_adapter_forward_mlp", _sql_mlp())
def e3_adapter_forward_mlp(spark, sf_dir):
    """Two-layer GELU adapter to a K=4 x 16 prefix."""
    p = EM.adapter_forward(vectors(spark, sf_dir), _mlp_factory, out_type="double")
    return p.select("doc_id", F.size("prefix").alias("prefix_size"),
                    F.round(F.aggregate("prefix", F.lit(0.0).cast("double"), lambda a, x: a + x), 5).alias("prefix_sum"),
                    F.round(F.array_max("prefix"), 5).alias("prefix_max"))


@register("e4_no_adapter_check", """
SELECT len(embedding) = 64 AS usable_at_64, len(embedding) = 2048 AS usable_at_2048, count(*) AS vectors FROM embeddings GROUP BY ALL
""")
def e4_no_adapter_check(spark, sf_dir):
    v = vectors(spark, sf_dir)
    a = EM.no_adapter_check(v, 64).withColumnRenamed("usable_without_adapter", "usable_at_64")
    b = EM.no_adapter_check(a, 2048).withColumnRenamed("usable_without_adapter", "usable_at_2048")
    return b.groupBy("usable_at_64", "usable_at_2048").agg(F.count(F.lit(1)).alias("vectors"))


@register("jn5_pending_embeddings", """
SELECT count(*) AS pending, CAST(sum(doc_id) AS BIGINT) AS id_sum FROM documents
WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)
""")
def jn5_pending_embeddings(spark, sf_dir):
    p = EM.pending_embeddings(corpus(spark, sf_dir), vectors(spark, sf_dir))
    return p.groupBy().agg(F.count(F.lit(1)).alias("pending"), F.sum("doc_id").cast("long").alias("id_sum"))


@register("jn6_embedding_coverage", """
WITH c AS (SELECT doc_id FROM documents),
v0 AS (SELECT vec_id AS doc_id, CASE WHEN vec_id % 77 = 5 THEN NULL ELSE embedding END AS e FROM embeddings),
v1 AS (SELECT * FROM v0 UNION ALL SELECT * FROM v0 WHERE doc_id % 50 = 0),
v AS (SELECT doc_id, count(e) AS n, count(*) FILTER (WHERE len(e) <> 64) AS bad, count(*) - count(e) AS z FROM v1 GROUP BY doc_id),
j AS (SELECT c.doc_id AS cd, coalesce(n, 0) AS n, coalesce(bad, 0) AS bad, coalesce(z, 0) AS z FROM c FULL OUTER JOIN v ON c.doc_id = v.doc_id),
a AS (SELECT count(cd) AS rows, CAST(sum(n) AS BIGINT) AS vectors, count(*) FILTER (WHERE cd IS NOT NULL AND n > bad) AS covered,
             count(*) FILTER (WHERE cd IS NOT NULL AND n <= bad) AS missing, count(*) FILTER (WHERE cd IS NULL AND n > 0) AS orphans,
             CAST(sum(greatest(n - 1, 0)) AS BIGINT) AS duplicates, CAST(sum(z) AS BIGINT) AS null_vectors, CAST(sum(bad) AS BIGINT) AS bad_dims FROM j)
SELECT *, CASE WHEN bad_dims > 0 THEN 'rebuild' WHEN missing > 0 THEN 'resume' WHEN duplicates > 0 THEN 'duplicates'
          ELSE 'complete' END AS verdict FROM a
""")
def jn6_embedding_coverage(spark, sf_dir):
    """Coverage by stored vectors of which some are null and some repeated."""
    v = vectors(spark, sf_dir)
    v = v.withColumn("embedding", F.when(F.col("doc_id") % 77 != 5, F.col("embedding")))
    return EM.embedding_coverage(corpus(spark, sf_dir), v.unionAll(v.where("doc_id % 50 = 0")), 64)


def _bucketed(spark, sf_dir):
    """Documents and vectors as tables of one bucketing."""
    tag = uuid.uuid4().hex
    root = f"{checkpoint_dir(spark).rstrip('/')}/bucketed/{tag}"
    docs = EM.write_bucketed(corpus(spark, sf_dir), f"corpus_{tag}", f"{root}/corpus", buckets=16)
    v = vectors(spark, sf_dir).withColumn("embedding", F.when(F.col("doc_id") % 77 != 5, F.col("embedding")))
    return docs, EM.write_bucketed(v, f"vectors_{tag}", f"{root}/vectors", buckets=16)


@register("jn5_pending_bucketed", """
SELECT count(*) AS pending, CAST(sum(doc_id) AS BIGINT) AS id_sum FROM documents
WHERE doc_id NOT IN (SELECT vec_id FROM embeddings WHERE vec_id % 77 <> 5)
""")
def jn5_pending_bucketed(spark, sf_dir):
    """The resume point of bucketed tables (vectors that are null are pending): no shuffle of either side."""
    p = EM.pending_embeddings(*_bucketed(spark, sf_dir))
    return p.groupBy().agg(F.count(F.lit(1)).alias("pending"), F.sum("doc_id").cast("long").alias("id_sum"))


@register("jn6_coverage_bucketed", """
WITH v AS (SELECT vec_id AS doc_id, CASE WHEN vec_id % 77 <> 5 THEN embedding END AS e FROM embeddings),
j AS (SELECT d.doc_id AS cd, v.doc_id AS vd, e FROM documents d FULL OUTER JOIN v ON d.doc_id = v.doc_id),
a AS (SELECT count(cd) AS rows, count(e) AS vectors, count(*) FILTER (WHERE cd IS NOT NULL AND e IS NOT NULL) AS covered,
             count(*) FILTER (WHERE cd IS NOT NULL AND e IS NULL) AS missing, count(*) FILTER (WHERE cd IS NULL AND e IS NOT NULL) AS orphans,
             CAST(0 AS BIGINT) AS duplicates, count(*) FILTER (WHERE vd IS NOT NULL AND e IS NULL) AS null_vectors, CAST(0 AS BIGINT) AS bad_dims FROM j)
SELECT *, CASE WHEN missing > 0 THEN 'resume' ELSE 'complete' END AS verdict FROM a
""")
def jn6_coverage_bucketed(spark, sf_dir):
    """Coverage of bucketed tables: counted and joined bucket by bucket."""
    return EM.embedding_coverage(*_bucketed(spark, sf_dir), 64)


@register("src7_read_embeddings", """
SELECT count(*) AS vectors, min(len(embedding)) AS dim, round(sum(list_sum(embedding)), 3) AS value_sum FROM embeddings
""")
def src7_read_embeddings(spark, sf_dir):
    v = read_embeddings(spark, f"{sf_dir.rstrip('/')}/embeddings.parquet", id_col="vec_id")
    tot = F.aggregate("embedding", F.lit(0.0).cast("double"), lambda a, x: a + x)
    return v.groupBy().agg(F.count(F.lit(1)).alias("vectors"), F.min(F.size("embedding")).alias("dim"),
                           F.round(F.sum(tot), 3).alias("value_sum"))


@register("a16_embedding_storage_estimate", """
SELECT count(*) AS num_rows, CAST(768 AS BIGINT) AS dims, CAST(3072 AS BIGINT) AS bytes_per_row,
       CAST(count(*) * 3072 AS BIGINT) AS total_bytes, round(count(*) * 3072 / 1073741824.0, 9) AS total_gb,
       count(*) * 3072 / 1073741824.0 <= 250 AS precompute
FROM documents
""")
def a16_embedding_storage_estimate(spark, sf_dir):
    """768-dim float32 storage for the corpus and the auto precompute decision (250 GB cap)."""
    e = EM.storage_estimate(corpus(spark, sf_dir), dims=768, mode="auto")
    return e.withColumn("total_gb", F.round("total_gb", 9))


@register("snk5_write_embeddings", """
SELECT count(*) AS vectors, count(DISTINCT vec_id) AS ids, round(sum(list_sum(embedding)), 3) AS value_sum FROM embeddings
""")
def snk5_write_embeddings(spark, sf_dir):
    """Vectors written as Parquet partitioned by id bucket, then read back."""
    path = f"{checkpoint_dir(spark).rstrip('/')}/sinks/vectors-{uuid.uuid4().hex}"
    EM.write_embeddings(vectors(spark, sf_dir), path, "overwrite", buckets=16)
    back = spark.read.parquet(path)
    tot = F.aggregate("embedding", F.lit(0.0).cast("double"), lambda a, x: a + x)
    return back.groupBy().agg(F.count(F.lit(1)).alias("vectors"), F.countDistinct("doc_id").alias("ids"),
                              F.round(F.sum(tot), 3).alias("value_sum"))
