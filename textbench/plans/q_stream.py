"""Registered queries: streaming (ST1, ST2).

Each query lands the driver tables in a scratch folder under
``spark.checkpoint.dir`` in two arrivals, runs the stream to completion
(``availableNow``) and returns what the sink committed.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from textbench.operators.bleu import bleu_row_stats
from textbench.operators.embeddings import HashedBagOfWords
from textbench.plans.catalog import register
from textbench.plans.fixtures import corpus, pairs, trajectories
from textbench.plans.q_agent import _sql_metrics
from textbench.plans.q_embed import SQL_BOW, _vec_stats
from textbench.plans.q_metrics import BREVITY, SQL_PAIR_STATS
from textbench.session import checkpoint_dir
from textbench.streaming.streams import Published, embed_stream, metric_stream, trajectory_metrics_stream


def _scratch(spark, name):
    return f"{checkpoint_dir(spark).rstrip('/')}/streams/{name}-{uuid.uuid4().hex}"


def _half(spark, folder: str) -> int:
    """Half of the files of a folder: two micro-batches, however large the table."""
    return max(1, len(spark.read.text(folder)._jdf.inputFiles()) // 2 + 1)


@register("st1_embed_stream", SQL_BOW)
def st1_embed_stream(spark, sf_dir):
    """Documents arriving in two lots are embedded by a checkpointed stream."""
    base = _scratch(spark, "embed")
    docs = corpus(spark, sf_dir)
    for part in (0, 1):
        docs.filter(F.col("doc_id") % 2 == part).write.mode("append").parquet(f"{base}/landing")
    q = embed_stream(spark, f"{base}/landing", docs.schema, f"{base}/vectors", f"{base}/_checkpoint",
                     encoder=HashedBagOfWords(64), max_files_per_trigger=_half(spark, f"{base}/landing"))
    q.awaitTermination()
    return spark.read.parquet(f"{base}/vectors").select("doc_id", *_vec_stats())


@register("st2_trajectory_metrics_stream", _sql_metrics())
def st2_trajectory_metrics_stream(spark, sf_dir):
    """Trajectories appended to a JSON-lines log in two arrivals; running A8 in complete mode."""
    base = _scratch(spark, "traj")
    t = trajectories(spark, sf_dir)
    for part in (0, 1):
        t.filter(F.col("run") % 2 == part).select("task_id", "success", "steps").write.mode("append").json(
            f"{base}/log")
    q = trajectory_metrics_stream(spark, f"{base}/log", f"{base}/metrics", f"{base}/_checkpoint",
                                  max_files_per_trigger=_half(spark, f"{base}/log"))
    q.awaitTermination()
    m = Published(spark, f"{base}/metrics").read()
    cols = ["pass_rate", "first_try_rate", "avg_steps", "avg_tool_calls", "death_spiral_rate"]
    return m.select("total", *[F.round(c, 6).alias(c) for c in cols])


@register("st2_metric_stream", f"""
WITH s AS ({SQL_PAIR_STATS})
SELECT model, round(CAST(sum(sys_len) AS DOUBLE) / sum(ref_len), 6) AS brevity FROM s GROUP BY model
""")
def st2_metric_stream(spark, sf_dir):
    """A metric that the caller defines (system by reference length), kept per model over pairs that arrive in two lots."""
    base = _scratch(spark, "brevity")
    p = pairs(spark, sf_dir).select("id", "model", "prediction", "reference")
    for part in (0, 1):
        p.filter(F.col("id") % 2 == part).write.mode("append").parquet(f"{base}/landing")
    src = spark.readStream.schema(p.schema).option("maxFilesPerTrigger", _half(spark, f"{base}/landing")).parquet(f"{base}/landing")
    q = metric_stream(bleu_row_stats(src, keep=["model"]), BREVITY, f"{base}/metrics", f"{base}/_checkpoint", ["model"])
    q.awaitTermination()
    return Published(spark, f"{base}/metrics").read().select("model", F.round("brevity", 6).alias("brevity"))
