"""Rank histogram, bucket cuts and per-group caps against brute force."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from textbench.operators.buckets import assign_buckets
from textbench.operators.ranking import dense_index, range_rank, range_sorted, two_level_rank
from textbench.operators.splits import cap_per_group


def ref_buckets(lengths, b):
    """The reference's cut: stable sort by length, part i = [i*n//b, (i+1)*n//b)."""
    n = len(lengths)
    if n == 0 or b <= 0:
        return {}
    b = min(b, n)
    order = sorted(range(n), key=lambda i: lengths[i])
    out = {}
    for i in range(b):
        for j in order[i * n // b:(i + 1) * n // b]:
            out[j] = i
    return out


def test_closed_form_matches_reference_cut():
    for n in range(1, 120):
        for b in range(1, 10):
            bb = min(b, n)
            want = ref_buckets(list(range(n)), b)
            for r in range(n):
                assert (r + 1) * bb - 1 >= 0
                assert ((r + 1) * bb - 1) // n == want[r]


@pytest.mark.parametrize("target", [3, 1000])
def test_assign_buckets_with_hot_length(spark, target):
    rnd = random.Random(1)
    lengths = [7] * 40 + [rnd.randint(1, 30) for _ in range(33)]
    df = spark.createDataFrame([(i, l) for i, l in enumerate(lengths)], "id long, length long")
    for b in (1, 3, 4, 8, 200):
        got = {r["id"]: r["bucket"] for r in assign_buckets(df, b, target_rows=target).collect()}
        assert got == ref_buckets(lengths, b)


def test_assign_buckets_zero_gives_no_rows(spark):
    df = spark.createDataFrame([(1, 2)], "id long, length long")
    assert assign_buckets(df, 0).count() == 0


@pytest.mark.parametrize("target", [2, 5, 1_000_000])
def test_two_level_rank_equals_row_number(spark, target):
    rnd = random.Random(7)
    rows = [(i * 3 + 11, rnd.choice([5, 5, 5, 5, 9, rnd.randint(0, 50)])) for i in range(90)]
    df = spark.createDataFrame(rows, "id long, k long")
    got = {r["id"]: r["rank"] for r in two_level_rank(df, "k", "id", target_rows=target).collect()}
    want = {i: r for r, (i, _) in enumerate(sorted(rows, key=lambda x: (x[1], x[0])))}
    assert got == want


def test_dense_index_sparse_ids(spark):
    ids = [1, 5, 10**12, 10**12 + 3, 7, 2**40]
    df = spark.createDataFrame([(i,) for i in ids], "doc_id long")
    got = {r["doc_id"]: r["idx"] for r in dense_index(df, "doc_id", target_rows=2).collect()}
    assert got == {v: i for i, v in enumerate(sorted(ids))}


def test_cap_per_group_is_exact_with_hot_group(spark):
    rows = [("hot", i) for i in range(500)] + [("cold", i) for i in range(7)]
    df = spark.createDataFrame(rows, "g string, o long")
    out = cap_per_group(df, "g", 30, F.col("o"), salts=16).collect()
    hot = sorted(r["o"] for r in out if r["g"] == "hot")
    cold = sorted(r["o"] for r in out if r["g"] == "cold")
    assert hot == list(range(30)) and cold == list(range(7))


def test_rank_plan_has_no_single_partition_window_on_rows(spark):
    df = spark.range(1000).withColumn("k", F.col("id") % 7)
    plan = two_level_rank(df, "k", "id")._jdf.queryExecution().executedPlan().toString()
    # the only Window without partition keys is over one row per slice, and what is broadcast is its result
    assert plan.count("SinglePartition") <= 2 and "functions=[partial_count(1)]" in plan and "rank-sorted" in plan


def test_hot_key_among_others_is_split(spark):
    """A third of the rows have one key."""
    n, target = 30_000, 500
    df = spark.range(n).select((F.col("id") * 7 + 3).alias("id"), F.when(F.col("id") % 3 == 0, 17).otherwise(
        F.pmod(F.xxhash64("id"), F.lit(500))).alias("k"))
    slices = range_sorted(df, ["k", "id"], target).groupBy("__rk_slice").count()
    assert slices.agg(F.max("count")).first()[0] <= 4 * target
    got = two_level_rank(df, "k", "id", target_rows=target)
    want = df.withColumn("w", F.row_number().over(Window.orderBy("k", "id")) - 1)
    assert got.join(want, ["id", "k"]).filter("rank <> w").count() == 0 and got.count() == n


def test_equal_rows_are_split_and_numbered_apart(spark):
    df = spark.range(4000).select(F.lit("same").alias("k"))
    slices = range_sorted(df, ["k"], 200).groupBy("__rk_slice").count()
    assert slices.agg(F.max("count")).first()[0] <= 1600
    assert sorted(r["rank"] for r in range_rank(df, ["k"], target_rows=200).collect()) == list(range(4000))


def test_fractional_keys_and_nulls(spark):
    rnd = random.Random(3)
    rows = [(i, rnd.random() / 1000 if i % 10 else None) for i in range(1000)]
    df = spark.createDataFrame(rows, "id long, k double")
    got = {r["id"]: r["rank"] for r in two_level_rank(df, "k", "id", target_rows=100).collect()}
    order = sorted(rows, key=lambda x: (x[1] is not None, x[1] or 0.0, x[0]))
    assert got == {i: n for n, (i, _) in enumerate(order)}


def test_ids_of_the_whole_64_bit_range(spark):
    ids = [-9 * 10**18, -5, 0, 3, 9 * 10**18]
    df = spark.createDataFrame([(i,) for i in ids], "doc_id long")
    assert [r["idx"] for r in dense_index(df, "doc_id").orderBy("doc_id").collect()] == [0, 1, 2, 3, 4]


def test_string_ranks_within_partitions_of_which_one_is_null(spark):
    rnd = random.Random(5)
    rows = [(rnd.choice(["a", "b", None]), "".join(rnd.choice("xyzé") for _ in range(3)), i) for i in range(300)]
    df = spark.createDataFrame(rows, "g string, k string, id long")
    got = {r["id"]: (r["r"], r["n"]) for r in range_rank(df, ["k", "id"], "r", "n", ["g"], target_rows=20).collect()}
    for g in ("a", "b", None):
        own = sorted((r for r in rows if r[0] == g), key=lambda r: (r[1].encode(), r[2]))
        assert [got[r[2]] for r in own] == [(i, len(own)) for i in range(len(own))]


def test_rank_of_no_rows(spark):
    df = spark.createDataFrame([], "id long, k string")
    assert two_level_rank(df, "k", "id").count() == 0 and assign_buckets(df.withColumn("length", F.col("id")), 3).count() == 0


def test_far_outlier_id_does_not_crowd_the_dense_index(spark):
    ids = spark.range(5000).union(spark.createDataFrame([(2 ** 55,)], "id long")).withColumnRenamed("id", "doc_id")
    got = dense_index(ids, "doc_id", target_rows=200)
    assert got.filter("doc_id < 5000 AND idx <> doc_id").count() == 0 and got.agg(F.max("idx")).first()[0] == 5000


def test_rows_are_read_once(spark):
    df = spark.range(50).withColumn("k", F.col("id") % 5)
    plan = two_level_rank(df, "k", "id")._jdf.queryExecution().executedPlan().toString()
    assert "Range (0, 50" not in plan and "rank-sorted" in plan
