"""Streams resume from their checkpoint: new arrivals only, nothing twice."""

import uuid

import pytest
from pyspark.sql import functions as F

from textbench.operators.embeddings import HashedBagOfWords, embed_texts
from textbench.session import checkpoint_dir
from textbench.streaming.streams import Published, embed_stream, metric_stream, trajectory_metrics_stream
from textbench.operators.trajectories import trajectory_metrics
from textbench.plans.fixtures import trajectories
from conftest import SF_SMALL


def test_embed_stream_resumes_after_restart(spark):
    base = f"{checkpoint_dir(spark).rstrip('/')}/t-embed-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text")
    docs.filter("doc_id % 2 = 0").coalesce(1).write.parquet(f"{base}/landing/a")
    q = embed_stream(spark, f"{base}/landing/*", docs.schema, f"{base}/out", f"{base}/ckpt", encoder=HashedBagOfWords(16))
    q.awaitTermination()
    first = spark.read.parquet(f"{base}/out").count()
    docs.filter("doc_id % 2 = 1").coalesce(1).write.parquet(f"{base}/landing/b")
    q = embed_stream(spark, f"{base}/landing/*", docs.schema, f"{base}/out", f"{base}/ckpt", encoder=HashedBagOfWords(16))
    q.awaitTermination()
    out = spark.read.parquet(f"{base}/out")
    assert first == docs.filter("doc_id % 2 = 0").count()
    assert out.count() == docs.count() == out.select("doc_id").distinct().count()
    batch = embed_texts(docs, encoder=HashedBagOfWords(16))
    diff = out.join(batch.withColumnRenamed("embedding", "e2"), "doc_id").filter(F.col("embedding") != F.col("e2")).count()
    assert diff == 0


def test_metrics_stream_equals_batch(spark):
    base = f"{checkpoint_dir(spark).rstrip('/')}/t-traj-{uuid.uuid4().hex}"
    t = trajectories(spark, SF_SMALL).select("task_id", "success", "steps", "model")
    for part in (0, 1, 2):
        t.filter(F.abs(F.hash("task_id")) % 3 == part).coalesce(1).write.mode("append").json(f"{base}/log")
    from textbench.sources.readers import TRAJECTORY_SCHEMA, extended

    schema = extended(TRAJECTORY_SCHEMA, model="string")
    q = trajectory_metrics_stream(spark, f"{base}/log", f"{base}/m", f"{base}/ckpt", group_cols=["model"], schema=schema)
    q.awaitTermination()
    got = {r["model"]: (r["total"], round(r["pass_rate"], 9)) for r in Published(spark, f"{base}/m").read().collect()}
    want = {r["model"]: (r["total"], round(r["pass_rate"], 9))
            for r in trajectory_metrics(t, group_cols=["model"]).collect()}
    assert got == want


def test_an_epoch_that_fails_between_writing_and_publishing_shows_nothing(spark, monkeypatch):
    """The log grows by a second lot; the first attempt at its epoch writes all data and dies before the commit."""
    base = f"{checkpoint_dir(spark).rstrip('/')}/t-publish-{uuid.uuid4().hex}"
    out = Published(spark, f"{base}/m")
    with pytest.raises(FileNotFoundError):
        out.read()

    def land(lo, hi):
        spark.range(lo, hi).select(F.col("id").cast("double").alias("f1")).coalesce(1).write.mode("append").parquet(f"{base}/log")

    def run():
        src = spark.readStream.schema("f1 double").parquet(f"{base}/log")
        q = metric_stream(src, ["f1", "samples"], f"{base}/m", f"{base}/ckpt")
        q.awaitTermination()

    land(0, 10)
    run()
    assert [tuple(r) for r in out.read().collect()] == [(4.5, 10)]

    real = Published.write

    def dies(self, df, epoch):
        path = real(self, df, epoch)  # the data is there; take the commit back and fail
        self._fs.delete(self._path(f"{path}/_SUCCESS"), False)
        raise RuntimeError("lost between writing and publishing")

    land(10, 20)
    monkeypatch.setattr(Published, "write", dies)
    with pytest.raises(Exception, match="lost between"):
        run()
    assert [tuple(r) for r in out.read().collect()] == [(4.5, 10)]  # the epoch before, whole
    monkeypatch.setattr(Published, "write", real)
    run()
    assert [tuple(r) for r in out.read().collect()] == [(9.5, 20)]  # the repeated epoch, once
    for n in range(3):
        land(20 + n, 21 + n)
        run()
    assert len(out.versions()) == Published.KEEP and out.read().first()["samples"] == 23
