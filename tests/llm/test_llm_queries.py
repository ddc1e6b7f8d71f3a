"""Each operator query against its DuckDB SQL, and the rows of the others."""

import pytest

import __spark_entry__ as E
from test_oracle import _digest

PATH = "/root/testdata/sf0.001"
NAMES = sorted(n for n in E.queries() if n.startswith("op"))


def test_one_query_per_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in NAMES) == list(range(1, 14)) and "pipeline" in E.queries()


@pytest.mark.parametrize("name", [n for n in NAMES if n in E.oracle_sql()])
def test_query_matches_sql(spark, duck, name):
    df = E.queries()[name](spark, PATH)
    cur = duck.execute(E.oracle_sql()[name])
    cols = [d[0] for d in cur.description]
    assert sorted(cols) == sorted(df.columns)
    assert _digest(df.columns, df.collect()) == _digest(cols, cur.fetchall())


@pytest.mark.parametrize("name", [n for n in NAMES if n not in E.oracle_sql()])
def test_query_returns_all_rows(spark, name):
    n = E.queries()[name](spark, PATH).count()
    assert n == spark.read.parquet(f"{PATH}/documents.parquet").count() or name.startswith("op2_")
