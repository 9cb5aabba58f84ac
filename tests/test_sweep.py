"""Dense requests in one sweep, and indicators from maps of buckets."""

from __future__ import annotations

import datetime as dt
import random

import pytest
import seed
from pyspark.sql import functions as F

from backdate.functions import maps, series
from backdate.operators import pointintime as pit
from backdate.operators import sweep
from backdate.operators.indicators import indicators, indicators_by_maps

BARS = "ticker string, trade_date date, open double, high double, low double, close double, volume long, known_from date, known_until date"
DAY0 = dt.date(2024, 1, 1)
OPEN = dt.date(9999, 12, 31)


def day(n):
    return DAY0 + dt.timedelta(n)


def random_bars(spark, seed_, tickers=3, days=420):
    """Bars with gaps, corrections at any later day, some withdrawn, missing closes."""
    rng, rows = random.Random(seed_), []
    for t in range(tickers):
        for d in range(days):
            if rng.random() < 0.3:
                continue
            known = day(d + rng.choice([0, 0, 0, 2]))
            for _ in range(rng.choice([1, 1, 1, 2, 3])):
                last = rng.random() < 0.7
                until = OPEN if last else known + dt.timedelta(rng.choice([0, 1, 5, 40, 200]))
                close = None if t == 2 and rng.random() < 0.02 else round(rng.uniform(90, 110), 2)
                rows.append((f"T{t}", day(d), 1.0, 2.0, 0.5, close, rng.randrange(100), known, until))
                known = until
                if last:
                    break
    return spark.createDataFrame(rows, BARS)


def daily(spark, tickers=("T0", "T1", "T2", "NONE"), first=-5, last=460, step=1):
    rows = [(t, day(n)) for t in tickers for n in range(first, last, step)]
    return spark.createDataFrame(rows, "ticker string, as_of date")


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("lookback", [1, 7, 30, 180])
def test_sweep_equals_price_history_for_daily_requests(spark, lookback):
    bars, asked = random_bars(spark, 61), daily(spark)
    got = rows_of(sweep.price_history(asked.union(asked.limit(50)), bars, lookback))
    want = rows_of(pit.price_history(asked, bars, lookback).select("ticker", "as_of", "trade_date", "open", "high", "low", "close", "volume"))
    assert got == want and len(got) > 400


def exchanges(df):
    df.collect()
    final = df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    return [line for line in final.splitlines() if "Exchange" in line and "AQEShuffleRead" not in line]


def test_sweep_takes_one_exchange_and_no_join(spark):
    bars, asked = random_bars(spark, 62, days=60), daily(spark)
    for df in (sweep.price_history(asked, bars, 30), sweep.trailing(asked, bars, 30)):
        assert len(exchanges(df)) == 1 and "Join" not in df._jdf.queryExecution().executedPlan().toString()


def test_trailing_by_hand(spark):
    bars, asked = random_bars(spark, 63, days=100), daily(spark, last=140)
    by_request = {}
    for b in bars.collect():
        for n in range(-5, 140):
            d = day(n)
            if d - dt.timedelta(30) < b.trade_date <= d and b.known_from <= d < b.known_until:
                by_request.setdefault((b.ticker, d), []).append(b.close)
    got = {(r.ticker, r.as_of): r for r in sweep.trailing(asked, bars, 30).collect()}
    assert len(got) == 4 * 145
    for key, r in got.items():
        seen = by_request.get(key, [])
        closes = [c for c in seen if c is not None]
        assert r.n_bars == len(seen)
        assert (r.lowest, r.highest) == ((min(closes), max(closes)) if closes else (None, None))
        assert r.mean is None if not closes else r.mean == pytest.approx(sum(closes) / len(closes))


def test_versions_without_days_or_dates_are_never_seen(spark):
    rows = [("T", None, 1.0, 1.0, 1.0, 1.0, 1, DAY0, OPEN), ("T", DAY0, 1.0, 1.0, 1.0, 1.0, 1, None, OPEN),
            ("T", DAY0, 1.0, 1.0, 1.0, 1.0, 1, DAY0, None), ("T", DAY0, 1.0, 1.0, 1.0, 1.0, 1, day(2), day(2))]
    bars, asked = spark.createDataFrame(rows, BARS), daily(spark, ("T",), 0, 20)
    assert sweep.price_history(asked, bars, 10).count() == 0
    assert {r.n_bars for r in sweep.trailing(asked, bars, 10).collect()} == {0}
    assert sweep.trailing(asked.limit(0), bars, 10).count() == 0
    assert sweep.trailing(asked.union(spark.createDataFrame([("T", None)], asked.schema)), bars.limit(0), 10).count() == 20


def close_to(got, want):
    assert set(got) == set(want)
    for key, r in want.items():
        g = got[key]
        assert g.n_bars == r.n_bars, key
        for c, digits in (("rsi_14", 2), ("macd", 4), ("macd_signal", 4), ("macd_histogram", 4)):
            if r[c] is None or g[c] is None:
                assert g[c] is None and r[c] is None, (key, c)
            else:
                assert abs(g[c] - r[c]) < 1.01 * 10**-digits, (key, c)


@pytest.mark.parametrize("lookback", [20, 90, 365])
def test_maps_give_the_indicators(spark, lookback):
    """With corrections that arrive after a bucket has ended, with missing closes, and with few bars."""
    bars, asked = random_bars(spark, 64), daily(spark, step=9)
    got, want = ({(r.ticker, r.as_of): r for r in f(asked, bars, lookback).collect()} for f in (indicators_by_maps, indicators))
    close_to(got, want)
    equal = sum(got[k] == want[k] for k in want)
    assert equal >= 0.99 * len(want) and any(r.rsi_14 is not None for r in want.values())


def test_maps_match_known_answers(spark):
    asked = seed.requests(spark, *[("AAPL", d) for d in ("2024-01-22", "2024-01-23", "2024-03-01", "2024-03-05")], ("NONE", "2024-03-01"))
    assert rows_of(indicators_by_maps(asked, seed.bars(spark))) == rows_of(indicators(asked, seed.bars(spark)))
    flat = seed.close_series(spark, [5.0] * 30)
    rising = seed.close_series(spark, [float(n) for n in range(30)], "U")
    asked = spark.createDataFrame([("T", dt.date(2024, 12, 1)), ("U", dt.date(2024, 12, 1))], "ticker string, as_of date")
    assert {r.ticker: r.rsi_14 for r in indicators_by_maps(asked, flat.union(rising)).collect()} == {"T": 100.0, "U": 100.0}


def test_product_is_associative_and_cuts_anywhere(spark):
    rng = random.Random(65)
    closes = [rng.uniform(50, 60) for _ in range(120)]
    options = (14, 12, 26, 9)

    def mapped(parts):
        df = spark.createDataFrame([(i, p) for i, p in enumerate(parts)], "i int, c array<double>").withColumn("d", series.changes("c"))
        return df.select("i", maps.run_map("c", "d", *options).alias("m"))

    def answer(parts, groups=None):
        runs = mapped(parts)
        if groups:
            inner = runs.groupBy(F.expr(groups).alias("i")).agg(F.array_sort(F.collect_list(F.struct("i", "m"))).alias("g"))
            runs = inner.select("i", F.expr("transform(g, x -> x.m)").alias("g")).select("i", maps.product("g", 14).alias("m"))
        all_runs = runs.where("m IS NOT NULL").agg(F.array_sort(F.collect_list(F.struct("i", "m"))).alias("g"))
        whole = all_runs.select(F.expr("transform(g, x -> x.m)").alias("g")).select(maps.product("g", 14).alias("m"))
        row = whole.select("m.n", maps.rsi_of("m", 14).alias("r"), maps.macd_of("m").alias("macd")).first()
        return [row.n, row.r, *row.macd]

    one = answer([closes])
    for cuts in ([3, 9, 50], [1, 2, 3, 4, 5, 119], [14, 15, 16], [60]):
        parts = [closes[a:b] for a, b in zip([0, *cuts], [*cuts, None])]
        assert answer(parts) == pytest.approx(one, rel=1e-9) and answer([[], *parts, []]) == pytest.approx(one, rel=1e-9)
    parts = [closes[a : a + 20] for a in range(0, 120, 20)]
    assert answer(parts, "i DIV 2") == pytest.approx(one, rel=1e-9) and answer(parts, "IF(i = 0, 0, 1)") == pytest.approx(one, rel=1e-9)


def test_only_maps_are_shuffled_to_requests(spark):
    bars, asked = random_bars(spark, 66, days=200), daily(spark, last=200, step=20)
    df = indicators_by_maps(asked, bars)
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    last = [line for line in plan.toString().split("Initial Plan")[0].splitlines() if "hashpartitioning(ticker" in line and "as_of" in line]
    assert last and "_held" not in plan.schema().catalogString()
    # Between the meeting of buckets and requests and the last grouping there is no array but the first closes.
    optimized = df._jdf.queryExecution().optimizedPlan().toString()
    grouping = next(line for line in optimized.splitlines() if "Aggregate" in line and "as_of" in line and "collect_list(_part" in line)
    assert "_held" not in grouping and "_seen" not in grouping
