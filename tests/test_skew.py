"""One ticker holds a third of all rows, one of its keys half of those: same results."""

from __future__ import annotations

import sys
from pathlib import Path

import duckdb
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent / "scripts"))

import __spark_entry__ as entry
from pyspark.sql import functions as F

from backdate.operators import versions
from backdate.schemas import PRICE_KEYS
from backdate.sources import derived
from check import TABLES, rows_of

SMALL = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not SMALL.exists(), reason="needs the generated tables")

SKEWED = {
    "lineitem": """* REPLACE (
        CASE WHEN l_orderkey % 3 = 0 THEN 7 ELSE l_suppkey END AS l_suppkey,
        CASE WHEN l_orderkey % 6 = 0 THEN TIMESTAMP '1999-02-20' ELSE l_shipdate END AS l_shipdate,
        CAST(CASE WHEN l_orderkey % 6 = 0 THEN 1 ELSE l_linenumber END AS INTEGER) AS l_linenumber)""",
    # All of these fall on one ticker and one publication day.
    "documents": "* REPLACE (CASE WHEN doc_id % 3 = 0 THEN doc_id * 3650 ELSE doc_id END AS doc_id)",
    "conversations": """* REPLACE (
        CASE WHEN conv_id % 3 = 0 THEN 1 ELSE conv_id END AS conv_id,
        CASE WHEN conv_id % 3 = 0 THEN conv_id * 100 + turn ELSE turn END AS turn)""",
}
QUERIES = [
    "indicators_panel", "price_snapshot", "build_versions", "facts_as_of", "lookahead_leaks", "news_top_k",
    "stored_rows", "version_invariants", "apply_batch_prices", "ingest_news_dedup", "run_metrics",
    "comparison_summary", "final_attempts",
]


@pytest.fixture(scope="module")
def skewed(tmp_path_factory):
    folder = tmp_path_factory.mktemp("skewed")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"COPY (SELECT {SKEWED.get(t, '*')} FROM '{SMALL}/{t}.parquet') TO '{folder}/{t}.parquet'")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return str(folder), con


@pytest.mark.parametrize("name", QUERIES)
def test_hot_keys_change_no_result(spark, skewed, name):
    folder, con = skewed
    df = entry.queries()[name](spark, folder)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(entry.oracle_sql()[name])
    assert got == rows_of([c[0] for c in cur.description], cur.fetchall())


def test_versions_take_one_shuffle(spark, skewed):
    folder, _ = skewed
    df = entry.queries()["build_versions"](spark, folder)
    df.collect()
    final = df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert final.count("Exchange hashpartitioning") == 1 and "SortAggregate" not in final


def test_repeats_can_be_reduced_before_the_shuffle(spark, skewed):
    """What a task sends is one row per key and day, not one per line; the versions are the same."""
    folder, _ = skewed
    log = derived.price_observations(spark, folder, ["close"], carry=derived.LINE_ORDER)
    built = [versions.build_versions(log, PRICE_KEYS, ["adj_close"], derived.LINE_ORDER, F.col("trade_date"), reduce_first=r)
             for r in (True, False)]
    plan = built[0]._jdf.queryExecution().executedPlan().toString()
    assert "Partial" in plan[plan.index("WindowGroupLimit"):]
    assert sorted(built[0].collect()) == sorted(built[1].collect())


@pytest.fixture(scope="module", params=["CAST(l_shipdate AS TIMESTAMP) + INTERVAL 3 YEAR",
                                        "CAST(l_shipdate AS TIMESTAMP) + INTERVAL (l_orderkey * 7919 % 86400) SECOND"])
def shifted(tmp_path_factory, request):
    folder = tmp_path_factory.mktemp("shifted")
    con = duckdb.connect()
    for t in TABLES:
        columns = f"* REPLACE ({request.param} AS l_shipdate)" if t == "lineitem" else "*"
        con.execute(f"COPY (SELECT {columns} FROM '{SMALL}/{t}.parquet') TO '{folder}/{t}.parquet'")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return str(folder), con


@pytest.mark.parametrize("name", ["ingest_facts_clean", "ingest_all_counts", "build_versions", "build_fact_versions",
                                  "apply_batch_prices", "facts_as_of", "price_history", "ingest_prices_clean"])
def test_later_years_and_times_of_day_lose_nothing(spark, shifted, name):
    folder, con = shifted
    df = entry.queries()[name](spark, folder)
    cur = con.execute(entry.oracle_sql()[name])
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of([c[0] for c in cur.description], cur.fetchall())
