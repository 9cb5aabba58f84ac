"""Keyed state: any cut of a stream into batches gives the windows of the whole log."""

from __future__ import annotations

import datetime as dt
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from backdate.operators import versions
from backdate.streaming import state

LOG = "k int, d date, v double, w string, seq int, observed_on date"
DAY0 = dt.date(2024, 1, 1)
PROVIDER = "spark.sql.streaming.stateStore.providerClass"


@pytest.fixture
def rocksdb(spark):
    spark.conf.set(PROVIDER, state.ROCKSDB)
    yield
    spark.conf.unset(PROVIDER)


def bag(df):
    return Counter(repr(tuple(r)) for r in df.collect())


def run(spark, tmp_path, parts, name):
    landing, out = str(tmp_path / f"{name}-in"), str(tmp_path / f"{name}-out")
    for part in parts:
        spark.createDataFrame(part, LOG).coalesce(1).write.mode("append").parquet(landing)
        stream = spark.readStream.schema(LOG).parquet(landing)
        changes = state.version_changes(stream, ["k", "d"], ["v"], ["seq"], F.date_add("d", 2))
        query = (
            changes.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / f"{name}-check"))
            .outputMode("append").trigger(availableNow=True).start()
        )
        assert query.awaitTermination(120)
    return spark.read.parquet(out)


def test_any_cut_gives_the_batch_result(spark, tmp_path, rocksdb):
    rng = random.Random(71)
    rows = [
        (rng.randrange(12), DAY0, rng.choice([None, 1.0, 2.0, float("nan")]), rng.choice([None, "a", "b"]), rng.randrange(3),
         DAY0 + dt.timedelta(rng.randrange(-2, 8)))
        for _ in range(90)
    ]
    whole = versions.build_versions(spark.createDataFrame(rows, LOG), ["k", "d"], ["v"], ["seq"], F.date_add("d", 2))
    in_time = sorted(rows, key=lambda r: r[5])
    shuffled = rng.sample(rows, len(rows))
    cuts = {"one": [rows], "days": [in_time[:30], in_time[30:31], in_time[31:]], "late": [shuffled[:45], shuffled[45:]]}
    for name, parts in cuts.items():
        changes = run(spark, tmp_path, parts, name)
        assert bag(state.net_versions(changes).select(*whole.columns)) == bag(whole), name
        if name == "one":
            assert {r.change for r in changes.select("change").distinct().collect()} == {"added"}


def test_only_changed_windows_go_out(spark, tmp_path, rocksdb):
    def row(v, day):
        return (1, DAY0, v, None, 0, DAY0 + dt.timedelta(day))

    first = run(spark, tmp_path, [[row(5.0, 0), row(5.0, 8)]], "x")
    assert first.count() == 1
    changes = run(spark, tmp_path, [[row(5.0, 3)], [row(6.0, 4)]], "x")  # the same checkpoint goes on
    got = Counter((r.change, r.v, (r.known_from - DAY0).days, str(r.known_until)) for r in changes.collect())
    assert got == Counter([
        ("added", 5.0, 2, "9999-12-31"), ("withdrawn", 5.0, 2, "9999-12-31"), ("added", 5.0, 2, "2024-01-05"),
        ("added", 6.0, 4, "2024-01-09"), ("added", 5.0, 8, "9999-12-31"),
    ])
