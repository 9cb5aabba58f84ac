"""Leaks, bounds, coverage, constraints, run hygiene."""

from __future__ import annotations

import random

import seed

from backdate.operators import maintenance, news, quality
from backdate.operators.pointintime import price_history
from backdate.schemas import FACT_KEYS


def test_restatement_leak_report(spark):
    rows = [
        ("AAPL", "net_income_demo", "2023-10-01", "2023-12-31", 33916000000, "2024-02-01", "2024-06-15"),
        ("AAPL", "net_income_demo", "2023-10-01", "2023-12-31", 30100000000, "2024-06-15", seed.OPEN),
    ]
    asked = seed.requests(spark, ("AAPL", "2024-03-01"), ("AAPL", "2024-06-15"), ("AAPL", "2024-01-15"))
    got = {str(r.as_of): r for r in quality.lookahead_leaks(seed.facts(spark, rows), asked, FACT_KEYS).collect()}
    leak = got["2024-03-01"]
    assert (float(leak.naive_value), float(leak.asof_value)) == (30100000000.0, 33916000000.0)
    assert leak.leaked and leak.days_ahead == 106 and str(leak.naive_known_from) == "2024-06-15"
    assert not got["2024-06-15"].leaked and got["2024-06-15"].days_ahead == 0
    assert got["2024-01-15"].leaked and got["2024-01-15"].asof_value is None
    summary = {str(r.as_of): (r.n_keys, r.n_leaked, r.max_days_ahead) for r in quality.leak_summary(
        quality.lookahead_leaks(seed.facts(spark, rows), asked, FACT_KEYS)).collect()}
    assert summary["2024-03-01"] == (1, 1, 106) and summary["2024-06-15"] == (1, 0, None)


def test_bounds_hold_for_reads_and_fail_for_planted_rows(spark):
    asked = seed.requests(spark, ("AAPL", "2024-03-01"), ("NONE", "2024-03-01"))
    history, items = price_history(asked, seed.bars(spark)), news.news_top_k(asked, seed.news(spark))
    rows = {r.ticker: r for r in quality.asof_bound_check(asked, history, items).collect()}
    assert rows["AAPL"].holds and (rows["AAPL"].n_bars, rows["AAPL"].n_news) == (39, 5)
    assert rows["NONE"].holds and rows["NONE"].n_bars == 0
    planted = history.selectExpr("ticker", "as_of", "date_add(as_of, 1) AS trade_date")
    bad = {r.ticker: r for r in quality.asof_bound_check(asked, planted, items, cap=4).collect()}
    assert not bad["AAPL"].holds and bad["AAPL"].n_late_bars == 39


def test_coverage_counts_all_versions(spark):
    asked = seed.requests(spark, ("AAPL", "2024-01-12"), ("AAPL", "2024-01-16"), ("AAPL", "2024-03-01"), ("NONE", "2024-03-01"))
    counted = {(r.ticker, str(r.as_of)): r.n_rows for r in quality.stored_rows(asked, seed.bars(spark)).collect()}
    assert counted == {("AAPL", "2024-01-12"): 9, ("AAPL", "2024-01-16"): 10, ("AAPL", "2024-03-01"): 43, ("NONE", "2024-03-01"): 0}
    gaps = {(r.ticker, str(r.as_of)) for r in quality.coverage_gaps(asked, seed.bars(spark)).collect()}
    assert gaps == {("AAPL", "2024-01-12"), ("NONE", "2024-03-01")}


def test_constraints_are_counted(spark):
    parent = spark.createDataFrame([("a",), ("b",), ("b",)], "k string")
    child = spark.createDataFrame([("a", "x", 1), ("z", "y", None), ("z", "q", 2), (None, None, 3)], "k string, e string, n int")
    report = quality.constraint_violations(
        {"parent": parent, "child": child}, {"parent": ["k"], "child": ["n"]}, [("child", "k", "parent", "k")],
        {"child": ["k", "n"]}, {("child", "e"): ("x", "y")},
    )
    found = {(r.table_name, r.rule): r.violations for r in report.collect()}
    assert found == {
        ("parent", "primary key (k)"): 1, ("child", "primary key (n)"): 0, ("child", "k references parent"): 2,
        ("child", "k not null"): 1, ("child", "n not null"): 1, ("child", "e in (x, y)"): 1,
    }


def test_late_rows(spark):
    asked = seed.requests(spark, ("AAPL", "2024-03-01"))
    (row,) = quality.late_rows(price_history(asked, seed.bars(spark)), "trade_date").collect()
    assert (row.n_rows, row.n_late, str(row.newest)) == (39, 0, "2024-02-29")


def test_run_status_purge_and_orphans(spark):
    run, verdict, message = seed.experiments(spark)
    started = run.selectExpr("id", "ticker", "as_of_date", "mode", "'running' AS status", "cast(null as timestamp) AS completed_at")
    events = spark.sql("""SELECT * FROM VALUES
        ('run-bl', 'failed', timestamp'2024-03-15 09:00:00'), ('run-bl', 'completed', timestamp'2024-03-15 09:00:38'),
        ('run-bl-failed', 'failed', timestamp'2024-03-15 08:59:00') AS e(run_id, status, at)""")
    status = {r.id: r for r in maintenance.latest_status(started, events).collect()}
    assert {k: v.status for k, v in status.items()} == {"run-bl": "completed", "run-ma": "running", "run-bl-failed": "failed"}
    assert str(status["run-bl"].completed_at) == "2024-03-15 09:00:38" and status["run-bl-failed"].completed_at is None
    problems = {(r.id, r.problem) for r in quality.unfinished_runs(
        maintenance.latest_status(started, events), verdict.where("run_id <> 'run-bl'")).collect()}
    assert problems == {("run-ma", "left running"), ("run-bl", "completed without verdict")}
    left = maintenance.purge_runs(run, verdict, message, run.where("id = 'run-ma'"))
    assert [df.count() for df in left] == [2, 1, 1]


def test_reseed_replaces_the_rows_of_its_keys(spark):
    facts = seed.facts(spark)
    fresh = seed.facts(spark, [("AAPL", "net_income", "2023-10-01", "2023-12-31", 1.0, "2024-02-01", seed.OPEN)])
    after = maintenance.reseed(facts, fresh, FACT_KEYS)
    assert after.count() == 8
    assert [float(r.value) for r in after.where("metric = 'net_income' and period_end = '2023-12-31' and ticker = 'AAPL'").collect()] == [1.0]


def test_running_counts_equal_brute_force(spark):
    rng = random.Random(5)
    rows = [(f"T{rng.randrange(3)}", seed.day(f"2024-01-{rng.randrange(1, 29):02d}")) for _ in range(200)]
    asked = [(f"T{t}", seed.day(f"2024-01-{d:02d}")) for t in range(4) for d in (1, 7, 15, 28)]
    bars = spark.createDataFrame(rows, "ticker string, trade_date date")
    req = spark.createDataFrame(asked, "ticker string, as_of date")
    got = {(r.ticker, r.as_of): r.n_rows for r in quality.stored_rows(req, bars).collect()}
    assert got == {(t, d): sum(1 for x, y in rows if x == t and y <= d) for t, d in asked}
