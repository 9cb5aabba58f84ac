"""Every named query against its SQL, and what no plan may contain."""

from __future__ import annotations

import sys
from pathlib import Path

import duckdb
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent / "scripts"))

import __spark_entry__ as entry
from check import TABLES, rows_of

from backdate.plans.queries import NAMED

SMALL = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not SMALL.exists(), reason="needs the generated tables")


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(NAMED))
def test_query_equals_its_sql(spark, con, name):
    df = entry.queries()[name](spark, str(SMALL))
    plan = df._jdf.queryExecution().executedPlan().toString()
    for node in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython", "MapInPandas"):
        assert node not in plan
    cur = con.execute(entry.oracle_sql()[name])
    columns = [c[0] for c in cur.description]
    assert sorted(columns) == sorted(df.columns)
    want = rows_of(columns, cur.fetchall())
    assert want and rows_of(df.columns, [tuple(r) for r in df.collect()]) == want


def test_entry(spark):
    assert entry.entry(spark).count() == 30


def test_hot_news_are_cut_before_the_shuffle(spark):
    plan = entry.queries()["news_top_k"](spark, str(SMALL))._jdf.queryExecution().executedPlan().toString()
    lines = [line for line in plan.splitlines() if "WindowGroupLimit" in line or "Exchange hashpartitioning(ticker" in line]
    partial = next(i for i, line in enumerate(lines) if "Partial" in line)
    assert "Exchange" in lines[partial - 1]


@pytest.mark.parametrize("name", ["indicators_panel", "facts_as_of", "lookahead_leaks", "news_top_k", "compare_runs"])
def test_same_rows_when_nothing_is_broadcast(spark, con, name):
    limits = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    for key in limits:
        spark.conf.set(key, "-1")
    try:
        df = entry.queries()[name](spark, str(SMALL))
        got = rows_of(df.columns, [tuple(r) for r in df.collect()])
        plan = df._jdf.queryExecution().executedPlan().toString()
    finally:
        for key in limits:
            spark.conf.unset(key)
    assert "BroadcastHashJoin" not in plan and "SortMergeJoin" in plan
    cur = con.execute(entry.oracle_sql()[name])
    assert got == rows_of([c[0] for c in cur.description], cur.fetchall())


def test_message_totals_are_shuffled_once(spark):
    df = entry.queries()["compare_runs"](spark, str(SMALL))
    df.collect()
    final = df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert sum("FileScan" in line and "text" in line for line in final.splitlines()) == 1
