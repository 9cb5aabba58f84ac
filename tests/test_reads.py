"""Point-in-time reads on the known-answer tables."""

from __future__ import annotations

import datetime as dt

import pytest
import seed
from pyspark.sql import functions as F

from backdate.operators import pointintime as pit
from backdate.operators.indicators import indicators, price_snapshot

# as_of, bars, last close, 1, 5, 21 bars %, RSI, MACD, signal, histogram, RSI with first-change seed
GOLDEN = [
    ("2024-01-05", 4, 181.18, -0.40, None, None, None, None, None, None, None),
    ("2024-01-22", 14, 191.83, 0.14, 3.13, None, None, None, None, None, None),
    ("2024-01-23", 15, 192.35, 0.27, 4.75, None, 64.17, 1.3819, 0.4810, 0.9009, 54.01),
    ("2024-03-01", 39, 180.75, -0.37, -0.45, -7.73, 39.70, -1.5537, -1.2202, -0.3335, 36.79),
    ("2024-03-04", 39, 180.75, -0.37, -0.45, -7.73, 39.70, -1.5537, -1.2202, -0.3335, 36.79),
    ("2024-03-05", 41, 180.75, -0.37, -1.96, -7.73, 40.38, -1.4398, -1.2138, -0.2260, 37.95),
]


def by_date(df):
    return {str(r.as_of): r for r in df.collect()}


def test_snapshot_and_indicators_match_known_answers(spark):
    asked = seed.requests(spark, *[("AAPL", g[0]) for g in GOLDEN])
    shot = by_date(price_snapshot(asked, seed.bars(spark), lookback_days=365))
    ind = by_date(indicators(asked, seed.bars(spark)))
    alt = by_date(indicators(asked, seed.bars(spark), seed="first"))
    for as_of, n, last, d1, d5, d21, rsi, macd, signal, hist, rsi_first in GOLDEN:
        s, i = shot[as_of], ind[as_of]
        assert (s.n_bars, s.last_close, s.pct_change_1d, s.pct_change_5d, s.pct_change_21d) == (n, last, d1, d5, d21)
        assert (i.n_bars, i.rsi_14, i.macd, i.macd_signal, i.macd_histogram) == (n, rsi, macd, signal, hist)
        assert alt[as_of].rsi_14 == rsi_first


def test_request_without_bars_keeps_its_row(spark):
    asked = seed.requests(spark, ("AAPL", "2023-01-01"), ("NONE", "2024-03-01"))
    for r in price_snapshot(asked, seed.bars(spark)).collect():
        assert r.n_bars == 0 and r.last_close is None and r.pct_change_1d is None
    for r in indicators(asked, seed.bars(spark)).collect():
        assert r.n_bars == 0 and r.rsi_14 is None and r.macd is None


def test_repeated_requests_give_one_row(spark):
    asked = seed.requests(spark, ("AAPL", "2024-03-01"), ("AAPL", "2024-03-01"))
    (row,) = indicators(asked, seed.bars(spark)).collect()
    assert (row.n_bars, row.rsi_14) == (39, 39.70)


def test_transaction_time_predicate_removes_second_versions(spark):
    bars = seed.bars(spark)
    assert bars.count() == 43 and bars.select("trade_date").distinct().count() == 41
    assert pit.known_as_of(bars, "2024-03-04").count() == 39
    assert pit.known_as_of(bars, "2024-03-05").count() == 41


def test_lookback_start_is_excluded_and_end_included(spark):
    asked = seed.requests(spark, ("AAPL", "2024-01-12"))
    days = [str(r.trade_date) for r in pit.price_history(asked, seed.bars(spark), 4).orderBy("trade_date").collect()]
    assert days == ["2024-01-09", "2024-01-10", "2024-01-11", "2024-01-12"]


@pytest.mark.parametrize("lookback", [1, 2, 3, 7, 30, 365, 4000])
def test_calendar_buckets_do_not_change_the_window(spark, lookback):
    asked = seed.requests(spark, *[("AAPL", d) for d in ("2024-01-02", "2024-02-20", "2024-03-05", "2025-01-01")])
    bars = seed.bars(spark)
    got = {(r.as_of, r.trade_date) for r in pit.price_history(asked, bars, lookback).collect()}
    want = set()
    for as_of in (r.as_of for r in asked.collect()):
        for b in bars.collect():
            if (as_of - dt.timedelta(lookback) < b.trade_date <= as_of) and b.known_from <= as_of < b.known_until:
                want.add((as_of, b.trade_date))
    assert got == want


def test_price_column_can_be_the_adjusted_close(spark):
    asked = seed.requests(spark, ("AAPL", "2024-03-05"))
    plain = indicators(asked, seed.bars(spark)).first()
    adjusted = indicators(asked, seed.bars(spark), price_col="adj_close").first()
    assert plain.macd != adjusted.macd


def test_flat_falling_and_missing_closes(spark):
    asked = seed.requests(spark, ("T", "2024-01-20"))

    def read(closes, **options):
        return indicators(asked, seed.close_series(spark, closes), **options).first()

    assert read([5.0] * 20).rsi_14 == 100.0
    assert read(range(40, 20, -1)).rsi_14 == 0.0
    gap = read([10, 11, 12, None, 13, 12, 14, 15, 13, 12, 11, 12, 14, 15, 16, 17])
    assert gap.n_bars == 16 and gap.rsi_14 is not None
    assert gap.macd is None and gap.macd_signal is None
    assert read([5.0] * 20, seed="first").rsi_14 != read([5.0] * 20, seed="first").rsi_14  # NaN


def python_rsi(closes, period=14):
    moves = [0.0 if a is None or b is None else b - a for a, b in zip(closes, closes[1:])]
    gain = sum(max(m, 0) for m in moves[:period]) / period
    loss = sum(max(-m, 0) for m in moves[:period]) / period
    for m in moves[period:]:
        gain, loss = gain + (max(m, 0) - gain) / period, loss + (max(-m, 0) - loss) / period
    return 100.0 if loss == 0 else 0.0 if gain == 0 else 100 - 100 / (1 + gain / loss)


def test_folds_equal_a_step_by_step_loop(spark):
    import random

    rng = random.Random(7)
    closes = [round(100 + rng.uniform(-9, 9), 2) for _ in range(200)]
    days = [15, 16, 26, 27, 60, 200]
    asked = seed.requests(spark, *[("T", str(dt.date(2024, 1, 1) + dt.timedelta(n - 1))) for n in days])
    rows = {r.n_bars: r for r in indicators(asked, seed.close_series(spark, closes)).collect()}
    for n in days:
        fast = slow = closes[0]
        signal = 0.0
        for c in closes[1:n]:
            fast += (c - fast) * 2 / 13
            slow += (c - slow) * 2 / 27
            signal += (fast - slow - signal) * 2 / 10
        assert rows[n].rsi_14 == pytest.approx(python_rsi(closes[:n]), abs=0.00501)
        assert rows[n].macd == pytest.approx(fast - slow, abs=0.0000501)
        assert rows[n].macd_histogram == pytest.approx(fast - slow - signal, abs=0.0000501)


def test_first_seed_variant_carries_averages_over_gaps(spark):
    closes = [10, 11, 12, None, 13, 12, 14, 15, 13, 12, 11, 12, 14, 15, 16, 17, None, None, 15, 18, 17, 16,
              19, 20, 18, 17, 21, 22, 20, 19, 23]

    def faded(values, keep):
        """Weighted mean from the first value on; a gap fades what is held, and the next value weighs against that."""
        held, old = None, 1.0
        for v in values:
            if held is None:
                held = v
                continue
            old *= keep
            if v is not None:
                held, old = (held * old + v * (1 - keep)) / (old + 1 - keep), 1.0
            yield held

    moves = [None if a is None or b is None else b - a for a, b in zip(closes, closes[1:])]
    *_, gain = faded([m if m is None else max(m, 0) for m in moves], 13 / 14)
    *_, loss = faded([m if m is None else max(-m, 0) for m in moves], 13 / 14)
    lines = [f - s for f, s in zip(faded(closes, 11 / 13), faded(closes, 25 / 27))]
    *_, signal = faded([0.0, *lines], 0.8)
    line = lines[-1]
    asked = seed.requests(spark, ("T", "2024-06-30"))
    row = indicators(asked, seed.close_series(spark, closes), seed="first", digits=2, min_bars_macd=27).first()
    assert row.rsi_14 == round(100 * gain / (gain + loss), 2)
    assert row.macd == round(line, 2) and row.macd_signal == round(signal, 2)
    short = indicators(seed.requests(spark, ("T", "2024-01-26")), seed.close_series(spark, closes),
                       seed="first", digits=2, min_bars_macd=27).first()
    assert short.n_bars == 26 and short.macd is None


def test_daily_changes_number_the_bars(spark):
    asked = seed.requests(spark, ("AAPL", "2024-01-05"))
    rows = pit.daily_changes(asked, seed.bars(spark)).orderBy("rn").collect()
    assert [r.rn for r in rows] == [1, 2, 3, 4]
    assert rows[0].change is None and rows[1].change == pytest.approx(184.25 - 185.20)


def test_facts_by_exact_period_and_by_all_periods(spark):
    facts = seed.facts(spark)
    asked = seed.requests(spark, ("AAPL", "2024-02-13"), ("AAPL", "2024-03-01"), ("AAPL", "2024-06-14"), ("AAPL", "2024-06-15"))

    def values(**options):
        out = {}
        for r in pit.facts_as_of(facts, asked, metrics=["net_income"], **options).collect():
            out.setdefault(str(r.as_of), set()).add(float(r.value))
        return out

    assert values(period_end="2023-12-31") == {
        "2024-03-01": {33916.0}, "2024-06-14": {33916.0}, "2024-06-15": {33800.0},
    }
    assert values()["2024-03-01"] == {33916.0, 22956.0}
    assert values()["2024-02-13"] == {22956.0}
    naive = facts.where("ticker = 'AAPL' and metric = 'net_income' and period_end <= '2024-03-01'")
    assert naive.count() == 3
    latest = pit.facts_latest(facts).where("metric = 'net_income' and period_end = '2023-12-31' and ticker = 'AAPL'")
    assert [float(r.value) for r in latest.collect()] == [33800.0]


def test_bounds_reach_the_file_scan(spark, tmp_path):
    path = str(tmp_path / "bars")
    seed.bars(spark).write.parquet(path)
    stored = spark.read.parquet(path)
    df = pit.price_history(seed.requests(spark, ("AAPL", "2024-03-01")), stored, 30)
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    (scan,) = {line[line.index("PushedFilters"):] for line in plan.splitlines() if "FileScan" in line and "close" in line}
    assert "LessThanOrEqual(trade_date,ScalarSubquery" in scan
    assert "adj_close" not in scan
    assert df.where(F.col("trade_date") > "2024-03-01").count() == 0
