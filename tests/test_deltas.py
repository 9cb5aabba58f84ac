"""Windows from new observations only, and batches that touch only their years."""

from __future__ import annotations

import datetime as dt
import random
from collections import Counter
from pathlib import Path

import pytest
import seed
from pyspark.sql import functions as F

from backdate.operators import deltas, ingest, versions
from backdate.schemas import PRICE_KEYS
from backdate.sources import tables

LOG = "k int, d date, v int, w string, observed_on date, seq int"
DAY0 = dt.date(2024, 1, 1)
KEYS = ["k", "d"]


def random_log(rng, n, keys=40):
    return [
        (rng.randrange(keys), DAY0, rng.choice([None, 1, 2, 3]), rng.choice([None, "a"]), DAY0 + dt.timedelta(rng.randrange(-3, 9)), rng.randrange(3))
        for _ in range(n)
    ]


def build(df):
    return versions.build_versions(df, KEYS, ["v"], ["seq"], F.date_add("d", 2))


def delta_of(log, new):
    return deltas.window_delta(log, new, KEYS, ["v"], ["seq"], F.date_add("d", 2))


def bag(df):
    return Counter(tuple(r) for r in df.collect())


@pytest.mark.parametrize("seed_", range(4))
def test_delta_applied_equals_the_whole_log(spark, seed_):
    """New observations anywhere in time, on the days of old ones, and of keys that are new."""
    rng = random.Random(seed_)
    old, new = random_log(rng, 150), random_log(rng, 25, 60)
    log, late = (spark.createDataFrame(rows, LOG) for rows in (old, new))
    delta = delta_of(log, late)
    applied = deltas.apply_delta(build(log), delta)
    whole = build(log.union(late))
    assert bag(applied) == bag(whole.select(*applied.columns))
    rows = delta.collect()
    touched = {(r[0], r[1]) for r in new}
    assert {(r.k, r.d) for r in rows} <= touched and {r.change for r in rows} == {"withdrawn", "added"}
    # Nothing is taken and brought back as it was.
    plain = {c: Counter(tuple(r)[:-1] for r in rows if r.change == c) for c in ("withdrawn", "added")}
    assert all(plain["added"][x] != n or n > 1 for x, n in plain["withdrawn"].items())


def test_suppressed_repeat_becomes_a_version_again(spark):
    def row(v, day):
        return (1, DAY0, v, None, DAY0 + dt.timedelta(day), 0)

    log = spark.createDataFrame([row(5, 0), row(5, 8)], LOG)
    late = spark.createDataFrame([row(6, 4)], LOG)
    got = {(r.change, r.v, (r.known_from - DAY0).days, str(r.known_until)) for r in delta_of(log, late).collect()}
    assert got == {("withdrawn", 5, 2, "9999-12-31"), ("added", 5, 2, "2024-01-05"), ("added", 6, 4, "2024-01-09"), ("added", 5, 8, "9999-12-31")}
    again = spark.createDataFrame([row(5, 3)], LOG)
    assert delta_of(log, again).count() == 0 and delta_of(log, again.limit(0)).count() == 0
    assert {r.change for r in delta_of(log.limit(0), late).collect()} == {"added"}


def test_only_touched_keys_are_shuffled(spark, tmp_path):
    rng = random.Random(9)
    spark.createDataFrame(random_log(rng, 3000, 1000), LOG).write.parquet(str(tmp_path / "log"))
    spark.createDataFrame(random_log(rng, 5, 3), LOG).write.parquet(str(tmp_path / "new"))
    log, new = (spark.read.schema(LOG).parquet(str(tmp_path / n)) for n in ("log", "new"))
    delta = delta_of(log, new)
    delta.collect()
    final = delta._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert "BroadcastHashJoin" in final and "SortMergeJoin" not in final
    # The batch's keys are made distinct by one exchange, everything else takes one.
    assert sum("Exchange hashpartitioning" in line for line in final.splitlines()) == 2
    windows = build(log)
    windows.write.parquet(str(tmp_path / "windows"))
    applied = deltas.apply_delta(spark.read.schema(windows.schema).parquet(str(tmp_path / "windows")), delta)
    applied.collect()
    plan = applied._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert "LeftAnti, BuildRight" in plan and bag(applied) == bag(build(log.union(new)).select(*applied.columns))


def years_of_bars(spark):
    bars = seed.bars(spark)
    return [bars.withColumn("trade_date", F.add_months("trade_date", -12 * n)).withColumn("known_from", F.add_months("known_from", -12 * n))
            for n in range(4)]


def files(path):
    return {p: p.stat().st_mtime_ns for p in Path(path).rglob("*.parquet")}


def test_batch_reads_and_rewrites_only_its_years(spark, tmp_path):
    path = str(tmp_path / "bars")
    all_years = years_of_bars(spark)
    for year in all_years:
        tables.write_versions(year, path, "trade_date", PRICE_KEYS, 4)
    before, rows = files(path), spark.read.parquet(path).count()
    assert len(before) == 16
    batch = all_years[1].where("known_until = DATE'9999-12-31'").orderBy("trade_date").limit(3)
    batch = batch.drop("known_from", "known_until").withColumn("adj_close", F.col("adj_close") + 1)
    seen = []

    def apply(current, change):
        seen.append(current)
        return versions.next_state(ingest.apply_prices(current, change, "2025-06-01"))

    assert tables.update_years(batch, path, "price_bar", "trade_date", PRICE_KEYS, 4, apply) == [2023]
    after = files(path)
    assert {p for p in before if "valid_year=2023" not in str(p)} == {p for p in after if "valid_year=2023" not in str(p)}
    assert all(after[p] == before[p] for p in after if p in before) and len(after) == 16
    assert not {p for p in before if "valid_year=2023" in str(p)} & set(after)
    # The read met the year's files alone.
    plan = seen[0]._jdf.queryExecution().executedPlan()
    stored = spark.read.parquet(path)
    assert "PartitionFilters: [valid_year" in plan.toString() or "PartitionFilters: [isnotnull(valid_year" in plan.toString()
    assert stored.count() == rows + 3 and stored.where("valid_year = 2023 AND known_from = DATE'2025-06-01'").count() == 3
    assert tables.update_years(batch.limit(0), path, "price_bar", "trade_date", PRICE_KEYS, 4, apply) == []
    with pytest.raises(ValueError, match="no year"):
        tables.update_years(batch.withColumn("trade_date", F.lit(None).cast("date")), path, "price_bar", "trade_date", PRICE_KEYS, 4, apply)


def test_files_read_are_counted(spark, tmp_path):
    path = str(tmp_path / "bars")
    for year in years_of_bars(spark):
        tables.write_versions(year, path, "trade_date", PRICE_KEYS, 4)
    some = tables.read_years(spark, path, "price_bar", [2022, 2023])
    read = some.select(F.input_file_name().alias("f")).distinct().collect()
    assert len(read) == 8 and some.count() == 86 and "valid_year" not in some.columns
    plan = some._jdf.queryExecution().executedPlan()
    some.count()
    assert "PartitionFilters: [valid_year" in plan.toString() or "valid_year#" in plan.toString()


def test_late_observations_reach_the_stored_table(spark, tmp_path):
    """Delta of the log, applied to the years it touches, equals the windows of the whole log."""
    path = str(tmp_path / "bars")
    bars = seed.bars(spark).drop("known_from", "known_until").dropDuplicates(["ticker", "trade_date"])
    log = bars.withColumn("trade_date", F.expr("add_months(trade_date, -12 * CAST(day(trade_date) % 3 AS INT))")).dropDuplicates(["ticker", "trade_date"])
    log = log.withColumn("observed_on", F.col("trade_date"))
    late = log.where("year(trade_date) = 2023").limit(4).withColumn("adj_close", F.col("adj_close") + 1).withColumn(
        "observed_on", F.date_add("trade_date", 3))
    log.write.parquet(str(tmp_path / "log"))
    late.write.parquet(str(tmp_path / "late"))
    log, late = (spark.read.parquet(str(tmp_path / n)) for n in ("log", "late"))

    def windows(df):
        return versions.build_versions(df, PRICE_KEYS, ["adj_close"], [], F.col("trade_date"))

    tables.write_versions(tables.conform(windows(log), "price_bar"), path, "trade_date", PRICE_KEYS, 2)
    delta = deltas.window_delta(log, late, PRICE_KEYS, ["adj_close"], [], F.col("trade_date"))

    def apply(current, rows):
        own = [c for c in current.columns if c in rows.columns]
        return tables.conform(deltas.apply_delta(current.select(*own), rows), "price_bar")

    assert tables.update_years(delta, path, "price_bar", "trade_date", PRICE_KEYS, 2, apply) == [2023]
    want = tables.conform(windows(log.union(late)), "price_bar")
    assert bag(spark.read.parquet(path).select(*want.columns)) == bag(want)
