"""Every registered query against its DuckDB oracle at sf0.001, and plan checks."""

import hashlib
import math

import pytest

import __spark_entry__ as E
from conftest import SF_SMALL

QUERIES = E.queries()
ORACLE = E.oracle_sql()


def _norm(v):
    if v is None:
        return "∅"
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 6))
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(_norm(x) for x in v) + "]"
    return str(v)


def _digest(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted("|".join(_norm(r[i]) for i in order) for r in rows)


def test_every_oracle_has_a_query():
    assert set(ORACLE) <= set(QUERIES)
    assert len(QUERIES) >= 85


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_oracle(spark, duck, name):
    df = QUERIES[name](spark, SF_SMALL)
    rows = df.collect()
    cur = duck.execute(ORACLE[name])
    orows = cur.fetchall()
    ocols = [d[0] for d in cur.description]
    assert sorted(df.columns) == sorted(ocols)
    assert _digest(df.columns, rows) == _digest(ocols, orows)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_rows_only_queries_run(spark, name):
    assert QUERIES[name](spark, SF_SMALL).count() > 0


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() > 0 and "bleu" in df.columns


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_bleu_stats_and_sweep_shuffle_no_texts(spark):
    from textbench.plans.q_metrics import pair_stats
    from textbench.plans.q_reports import _sweep

    stats, sweep = _plan(pair_stats(spark, SF_SMALL)), _plan(_sweep(spark, SF_SMALL))
    for plan in (stats, sweep):
        # the one small file is dealt out by rows; nothing is shuffled by a key but the sums per adapter
        assert plan.count("Exchange RoundRobinPartitioning") == 1 and plan.count("MapInArrow") == 1
    assert "hashpartitioning" not in stats and sweep.count("hashpartitioning(adapter") == 1
    # pairs are not multiplied by the budgets: the only explode stands after the sums
    assert sweep.count("Generate explode") == 1 and sweep.index("Generate explode") < sweep.index("Exchange hashpartitioning")


def test_large_inputs_are_not_dealt_out_anew(spark, tmp_path):
    from textbench.session import spread

    spark.range(100).repartition(spark.sparkContext.defaultParallelism).write.parquet(str(tmp_path / "t"))
    assert "Exchange" not in _plan(spread(spark.read.parquet(str(tmp_path / "t"))))
    assert "Exchange" not in _plan(spread(spark.createDataFrame([(1,)], "a int")))


def test_no_python_udf_in_native_operators(spark):
    for name in ("a2_token_f1", "a4_length_buckets_f1", "sel1_selection_dataset", "sft4_sft_from_repos",
                 "txt10_parse_tool_call", "a8_trajectory_metrics", "bat1_batch_plan"):
        plan = _plan(QUERIES[name](spark, SF_SMALL))
        assert "PythonUDF" not in plan and "EvalPython" not in plan and "MapInPandas" not in plan, name


def test_filters_and_columns_reach_the_scan(spark):
    from pyspark.sql import functions as F
    from textbench.plans.fixtures import table

    df = table(spark, SF_SMALL, "documents").filter(F.col("lang") == "de").select("doc_id")
    plan = _plan(df)
    assert "PushedFilters: [IsNotNull(lang), EqualTo(lang,de)]" in plan
    assert "ReadSchema: struct<doc_id:bigint,lang:string>" in plan
