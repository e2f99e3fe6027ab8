"""Every query with SQL against DuckDB on the smallest tables."""

import os

import pandas as pd
import pytest

import tickloom.rule_queries
import tickloom.window_queries  # noqa: F401  (both register their queries)
from tickloom.queries import ORACLE_SQL, QUERIES

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    import duckdb

    c = duckdb.connect()
    for f in os.listdir(DATA):
        c.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{DATA}/{f}'")
    return c


def rows(table):
    frame = table.to_pandas(integer_object_nulls=True)
    frame = frame[sorted(frame.columns)].astype(object)
    clean = lambda x: None if not isinstance(x, (list, dict)) and getattr(x, "ndim", 0) == 0 and pd.isna(x) else float(x) if isinstance(x, float) else x
    return sorted(str(tuple(clean(x) for x in r)) for r in frame.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_against_duckdb(spark, duck, name):
    got, want = QUERIES[name](spark, DATA).toArrow(), duck.sql(ORACLE_SQL[name]).to_arrow_table()
    assert sorted(got.column_names) == sorted(want.column_names)
    assert rows(got) == rows(want)


def test_entry_and_registry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(QUERIES) <= set(e.queries()) and set(ORACLE_SQL) <= set(e.oracle_sql())


def test_no_pairs_and_no_python_in_hot_plans(spark):
    for name in ("q_asof_last", "q_walk_book", "q_equity", "q_prune", "q_throttle", "q_ledger_fold", "q_interval_fanout"):
        plan = QUERIES[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan, name
