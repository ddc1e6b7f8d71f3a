"""LIM1 by threshold, pruned scans, report tables."""

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from textbench.operators import reports as RP
from textbench.operators import splits as SP
from textbench.operators import trajectories as TR


@pytest.mark.parametrize("n", [11, 60, 100, 149, 150, 500])
def test_limit_by_threshold_takes_exactly_n_in_order(spark, n):
    rows = [(None if i < 20 else i // 30, i) for i in range(150)]  # ties and nulls at most cuts
    df = spark.createDataFrame(rows, "k long, id long")
    got = [r["k"] for r in SP.limit_first(df, n, "k", few=10).collect()]
    assert len(got) == min(n, 150)
    key = lambda k: (k is not None, k or 0)
    assert sorted(got, key=key) == sorted((k for k, _ in rows), key=key)[:n]


def test_large_limit_has_no_one_task_exchange(spark):
    df = spark.range(30_000).select((F.col("id") * 7 % 30_011).alias("k"), "id")
    out = SP.limit_first(df, 20_000, "k")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrdered" not in plan and "GlobalLimit" not in plan
    assert out.count() == 20_000
    assert SP.limit_first(df.limit(0), 20_000, "k").count() == 0 and SP.limit_first(df, 10, "k").count() == 10


def test_predicates_reach_the_scan(spark):
    from textbench.plans.q_reports import prj1_success_filter, pruned_scan

    plan = pruned_scan(spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [lang" in plan and "lang#" in plan.split("PartitionFilters: [")[1][:20]
    assert "GreaterThan(n_chars,20)" in plan and "LessThan(n_chars,5000)" in plan and "text" not in plan.split("ReadSchema:")[1][:80]
    plan = prj1_success_filter(spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(success), EqualTo(success,true)]" in plan


def test_numbers_of_report_lines_have_no_separators(spark):
    m = spark.createDataFrame([("m", 1, 0.5, 0.25, 1234.5, 12345.25, 1.0)],
                              "model string, total long, pass_rate double, first_try_rate double, avg_steps double, avg_tool_calls double, death_spiral_rate double")
    assert TR.compare_models(m).first()["line"].split() == ["m", "50.0%", "25.0%", "1234.5", "12345.2", "100.0%"]


def test_cross_domain_of_two_metrics(spark):
    st = spark.createDataFrame([("a", "x", 0.5), ("a", "x", 1.0), ("b", "y", 0.25)], "train string, eval string, f1 double")
    cells = RP.cross_domain(st, "train", "eval", ["f1"])
    assert {(r["train"], r["eval"]): (r["f1"], r["samples"]) for r in cells.collect()} == {("a", "x"): (0.75, 2), ("b", "y"): (0.25, 1)}
    m = {r["train"]: r.asDict() for r in RP.cross_domain_matrix(cells, "train", "eval", ["f1", "samples"], ["x", "y"]).collect()}
    assert m["a"] == {"train": "a", "x_f1": 0.75, "x_samples": 2, "y_f1": None, "y_samples": None}
