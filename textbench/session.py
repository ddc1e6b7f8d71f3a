"""Session construction and cluster-aware settings."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import SparkSession


def get_session(
    master: str | None = None,
    shuffle_partitions: int | None = None,
    app_name: str = "textbench",
) -> SparkSession:
    """Return (or create) a SparkSession with the settings the operators assume.

    On a cluster, call with ``master=None`` so the launcher's master and
    resource settings win; only options left unset are filled here.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    builder = (
        builder.config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder named by the cluster (``spark.checkpoint.dir``)."""
    ensure_checkpoint_dir(spark)
    return spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the cluster's ``spark.checkpoint.dir``.  Where it is unset, a
    ``local`` master gets a scratch folder of its own; any other master is an
    error, because executors could not read the driver's disk."""
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not configured:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        configured = tempfile.mkdtemp(prefix="textbench-ckpt-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(configured)


def written(df, tag: str = "table"):
    """``df`` written once to the shared checkpoint folder and read back: what
    several passes need is computed once, and lineage ends there."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/written/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df):
    """``df``, dealt out anew if it is read in fewer splits than the session has
    cores (a small file of one row group would be one task's work).  Such an
    input is smaller than cores * ``spark.sql.files.maxPartitionBytes``, so this
    exchange has a bound; a larger one is left as it is read."""
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    files = len(df._jdf.inputFiles())
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    size = sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))
    most = spark.conf.get("spark.sql.files.maxPartitionBytes")
    most = int(spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(most))
    return df.repartition(2 * cores) if files and max(files, size // most) < cores else df
