"""Splits, sampling and batching invariants."""

import math

import pytest
from pyspark.sql import functions as F

from textbench.functions.hashing import hash_randint
from textbench.operators import batching as BT
from textbench.operators import splits as SP


def test_auto_split_exact_counts_disjoint_complete(spark):
    df = spark.range(1000).withColumnRenamed("id", "doc_id")
    out = SP.auto_split(df, "doc_id", 0.1, 0.05, seed=3)
    counts = {r["split"]: r["count"] for r in out.groupBy("split").count().collect()}
    hold = math.ceil(1000 * (0.1 + 0.05))
    test = math.ceil(hold * (0.05 / (0.1 + 0.05)))
    assert counts == {"test": test, "validation": hold - test, "train": 1000 - hold}
    assert out.select("doc_id").distinct().count() == 1000


def test_auto_split_test_ratio_zero_and_errors(spark):
    df = spark.range(100).withColumnRenamed("id", "doc_id")
    counts = {r["split"]: r["count"] for r in SP.auto_split(df, "doc_id", 0.2, 0.0).groupBy("split").count().collect()}
    assert counts == {"validation": 20, "train": 80}
    with pytest.raises(ValueError):
        SP.auto_split(df, "doc_id", 0.0, 0.0)
    with pytest.raises(ValueError):
        SP.auto_split(df, "doc_id", 0.5, 0.5)
    with pytest.raises(ValueError):
        SP.named_split(df.withColumn("split", F.lit("train")), "dev")


def test_floyd_samples_are_distinct_and_in_range(spark):
    df = spark.range(2000).withColumn("n", (F.col("id") % 9 + 1)).withColumn(
        "k", hash_randint(1, 12, 5, F.col("id")))
    out = df.select("n", "k", SP.sample_k_of_n(F.col("k"), F.col("n"), 5, F.col("id")).alias("s")).collect()
    for r in out:
        s = r["s"]
        assert len(s) == len(set(s)) == max(1, min(r["k"], r["n"]))
        assert all(0 <= v < r["n"] for v in s)


def test_decoy_never_chosen_and_uniformish(spark):
    df = spark.range(3000).withColumn("n", F.lit(10).cast("long")).withColumn("chosen", F.array(F.lit(2).cast("long"), F.lit(5).cast("long")))
    out = [r["d"] for r in df.select(SP.decoy_index(F.col("n"), F.col("chosen"), 1, F.col("id")).alias("d")).collect()]
    assert set(out) == {0, 1, 3, 4, 6, 7, 8, 9}


def test_batch_plan_resume_and_checkpoints(spark):
    df = spark.range(100).withColumnRenamed("id", "doc_id")
    plan = BT.batch_plan(df, "doc_id", 32, 2, seed=1, resume_step=3, save_every=2)
    rows = plan.collect()
    steps = sorted({r["global_step"] for r in rows})
    assert steps == list(range(4, 9))  # ceil(100/32)=4 steps per epoch, 8 total
    assert all(r["is_checkpoint"] == (r["global_step"] % 2 == 0) for r in rows)
    # every document once per epoch (before the resume filter)
    full = BT.batch_plan(df, "doc_id", 32, 2, seed=1)
    assert full.groupBy("epoch").count().orderBy("epoch").collect()[0]["count"] == 100


def test_pad_batches_equal_lengths(spark):
    df = spark.createDataFrame([(0, [1, 2, 3]), (0, [4]), (1, [5, 6])], "b long, tok array<int>")
    out = BT.pad_batches(df, "b", "tok").collect()
    for r in out:
        assert len(r["input_ids"]) == len(r["attention_mask"]) == len(r["labels"])
        assert r["labels"].count(-100) == r["attention_mask"].count(0)


def test_windowed_loss_complete_windows_only(spark):
    df = spark.createDataFrame([(i, float(i)) for i in range(1, 26)], "step long, loss double")
    out = BT.windowed_loss(df, "step", "loss", 10).orderBy("window").collect()
    assert [r["avg_loss"] for r in out] == [5.5, 15.5]


def test_random_truncate_same_cap_per_batch(spark):
    df = spark.createDataFrame([(b, list(range(100))) for b in (1, 1, 2)], "b long, tok array<int>")
    out = df.select("b", F.size(SP.random_truncate(F.col("tok"), F.col("b"), 0, 8, 64)).alias("n")).collect()
    caps = {}
    for r in out:
        caps.setdefault(r["b"], set()).add(r["n"])
    assert all(len(v) == 1 and 8 <= next(iter(v)) <= 64 for v in caps.values())
