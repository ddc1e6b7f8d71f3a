"""ST1, ST2: incremental versions of the precompute and the metrics.

* ST1: new corpus files are encoded as they land.  The stream checkpoint is
  the progress record (the reference's ``.progress.json``): a restarted
  query continues after the last committed micro-batch, and the file sink
  commits each batch atomically, so no vector is lost or written twice.
* ST2: an append-only trajectory log is summarised by A8 as a stateful
  aggregation in ``complete`` mode; every micro-batch publishes the (small,
  one row per group) result.  ``metric_stream`` does the same for any metrics
  of the library's contract (``operators/metric.py``) over a stream of statistics.

A result is published by :class:`Published`: each attempt at an epoch writes a
folder of its own, and becomes visible by the ``_SUCCESS`` file with which
Spark commits it.  Readers take the highest epoch that has one, so an attempt that
fails halfway shows nothing, and a repeated one replaces the first whole.

Both use ``trigger(availableNow=True)``: process everything present, in
micro-batches that ``max_files_per_trigger`` can bound, then stop.  Checkpoints live under the cluster's
shared ``spark.checkpoint.dir``.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from textbench.operators.embeddings import Encoder, embed_texts
from textbench.operators.metric import Metric, metric_table
from textbench.operators.trajectories import trajectory_metrics
from textbench.sources.readers import TRAJECTORY_SCHEMA


def _paced(reader, max_files: int | None):
    """Bound the files of a micro-batch where the caller asks for it; otherwise
    a batch takes all that has arrived, in parallel."""
    return reader if max_files is None else reader.option("maxFilesPerTrigger", max_files)


def embed_stream(spark: SparkSession, source_dir: str, schema: T.StructType, out_dir: str, checkpoint: str,
                 encoder: Encoder | None = None, id_col: str = "doc_id", text_col: str = "text",
                 max_files_per_trigger: int | None = None, fmt: str = "parquet"):
    """ST1: start (and return) the streaming query that embeds ``source_dir``."""
    src = _paced(spark.readStream.schema(schema), max_files_per_trigger).format(fmt).load(source_dir)
    vec = embed_texts(src.select(id_col, text_col), id_col, text_col, encoder)
    return (vec.writeStream.format("parquet").option("checkpointLocation", checkpoint)
            .outputMode("append").trigger(availableNow=True).start(out_dir))


class Published:
    """A result table below ``root``, of which one version is visible at a time."""

    KEEP = 2  # versions that stay, for readers that have begun

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def versions(self) -> list[str]:
        """Committed versions, the visible one last: by epoch, then by the time of the commit."""
        found = self._fs.globStatus(self._path(f"{self.root}/epoch-*/*/_SUCCESS")) or []
        known = [(int(re.search(r"/epoch-(\d+)/", s.getPath().toString())[1]), s.getModificationTime(), s.getPath().getParent().toString())
                 for s in found]
        return [path for _, _, path in sorted(known)]

    def write(self, df: DataFrame, epoch: int) -> str:
        """Write a version; it is visible when this returns.  Versions before the
        last ``KEEP`` are deleted afterwards."""
        path = f"{self.root}/epoch-{epoch}/{uuid.uuid4().hex}"
        df.write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "true").parquet(path)
        for old in self.versions()[:-self.KEEP]:
            self._fs.delete(self._path(old), True)
        return path

    def read(self) -> DataFrame:
        """The visible version."""
        versions = self.versions()
        if not versions:
            raise FileNotFoundError(f"nothing is published in {self.root}")
        return self.spark.read.parquet(versions[-1])


def _publish(agg: DataFrame, out_dir: str, checkpoint: str):
    """Run a complete-mode aggregation over all that is there, publishing each epoch."""
    out = Published(agg.sparkSession, out_dir)
    return (agg.writeStream.outputMode("complete").foreachBatch(lambda batch, epoch: out.write(batch, epoch) and None)
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


def metric_stream(stats: DataFrame, metrics: list[str | Metric] | str | Metric, out_dir: str, checkpoint: str,
                  group_cols: list[str] | None = None):
    """Running metrics over a stream of per-row statistics: their sums are the state."""
    return _publish(metric_table(stats, metrics, group_cols), out_dir, checkpoint)


def trajectory_metrics_stream(spark: SparkSession, log_dir: str, out_dir: str, checkpoint: str,
                              group_cols: list[str] | None = None, max_steps: int = 20,
                              schema: T.StructType = TRAJECTORY_SCHEMA, max_files_per_trigger: int | None = None):
    """ST2: running A8 metrics over a JSON-lines trajectory log (read with :class:`Published`)."""
    src = _paced(spark.readStream.schema(schema), max_files_per_trigger).json(log_dir)
    return _publish(trajectory_metrics(src, max_steps=max_steps, group_cols=group_cols), out_dir, checkpoint)
