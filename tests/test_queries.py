"""Every registered query against its oracle on the smallest tables."""

import os
import sys

import duckdb
import pytest

import __spark_entry__ as entry
from catalog import all_queries, all_sql

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(__file__)), "tools"))
from compare_oracle import TABLES, rows_of  # noqa: E402

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
# Pair-wise joins and row-wise Python have no place in any plan.
FORBIDDEN = ("CartesianProduct", "BroadcastNestedLoopJoin", "EvalPython", "MapInPandas")
QUERIES, SQL = all_queries(), all_sql()  # those of the training-data part are tested beside it


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF_DIR}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, con, name):
    frame = QUERIES[name](spark, SF_DIR)
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert not [node for node in FORBIDDEN if node in plan]
    got = frame.collect()
    if name not in SQL:
        assert got
        return
    cursor = con.execute(SQL[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(frame.columns) == sorted(columns)
    assert rows_of(frame.columns, got) == rows_of(columns, cursor.fetchall())


def test_every_oracle_has_a_query():
    assert set(SQL) <= set(QUERIES)
    assert set(entry.oracle_sql()) <= set(entry.queries()) >= set(QUERIES)
    assert entry.entry
