"""Writers, publishing, lineage and continuous ingest."""

from __future__ import annotations

import datetime as dt

import pytest
import seed
from pyspark.sql import functions as F

from backdate.operators import ingest, versions
from backdate.schemas import FACT_KEYS, PRICE_KEYS
from backdate.session import cut_lineage
from backdate.sources import tables
from backdate.streaming import ingest as streaming


def test_append_conform_and_dump(spark, tmp_path):
    run, verdict, message = seed.experiments(spark)
    for name, df in (("run", run), ("verdict", verdict), ("agent_message", message)):
        path = str(tmp_path / name)
        tables.append_rows(df, path, name)
        tables.append_rows(df.where("false"), path, name)
        assert tables.read_table(spark, path, name).count() == df.count()
    stored = tables.read_table(spark, str(tmp_path / "run"), "run")
    assert stored.columns[:4] == ["id", "ticker", "as_of_date", "mode"] and stored.first().analyst_model is None
    tables.dump(seed.bars(spark), str(tmp_path / "dump"), ["trade_date", "known_from"])
    days = [r.trade_date for r in spark.read.json(str(tmp_path / "dump")).collect()]
    assert days == sorted(days) and len(days) == 43


def test_versions_are_replaced_by_year(spark, tmp_path):
    path = str(tmp_path / "bars")
    bars = seed.bars(spark)
    old = bars.withColumn("trade_date", F.add_months("trade_date", -12))
    tables.write_versions(old.unionByName(bars), path, "trade_date", PRICE_KEYS, 4)
    tables.write_versions(bars.where("trade_date < '2024-02-01'"), path, "trade_date", PRICE_KEYS, 4)
    stored = spark.read.parquet(path)
    assert len(stored.where("valid_year = 2023").inputFiles()) == 8  # four of either year, one ticker in all
    assert stored.where("valid_year = 2023").count() == 43 and stored.where("valid_year = 2024").count() == 21


@pytest.mark.parametrize("files", [4, 16, 64])
def test_every_year_has_as_many_files_as_asked_for(spark, tmp_path, files):
    path = str(tmp_path / "bars")
    # One ticker in all: its years are spread all the same.
    bars = spark.range(9_000).selectExpr(
        "'HOT' AS ticker", "date_add(DATE'2021-01-01', CAST(id % 1095 AS INT)) AS trade_date", "id AS close", "id DIV 1095 AS part",
    )
    tables.write_versions(bars, path, "trade_date", ["ticker", "trade_date", "part"], files)
    stored = spark.read.parquet(path)
    per_year = {r.valid_year: r.n for r in stored.select("valid_year", F.input_file_name().alias("f")).distinct()
                .groupBy("valid_year").agg(F.count("f").alias("n")).collect()}
    assert per_year == {2021: files, 2022: files, 2023: files} and stored.count() == 9_000


def shuffles(df):
    df.collect()
    final = df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    return [line for line in final.splitlines() if "Exchange hashpartitioning" in line]


def executed(df):
    """Lines of the plan that ran."""
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0].splitlines()


def indent(line):
    """How deep in the plan's tree a line stands: where its node's name begins."""
    return len(line) - len(line.lstrip(" :+-*")) - line[: len(line) - len(line.lstrip(" :+-*"))].count("*")


def test_small_batch_does_not_shuffle_the_table(spark, tmp_path):
    path = str(tmp_path / "bars")
    seed.bars(spark).write.parquet(path)
    current = spark.read.parquet(path)
    seed.bars(spark, seed.BARS[-2:]).drop("known_from", "known_until").write.parquet(str(tmp_path / "batch"))
    batch = spark.read.parquet(str(tmp_path / "batch")).withColumn("adj_close", F.col("adj_close") + 1)
    applied = ingest.apply_prices(current, batch, "2024-06-01")
    # What is shuffled comes from the batch's files alone, whose columns have numbers of their own.
    lines = [line for line in executed(applied) if "ReusedExchange" not in line]
    for n, line in enumerate(lines):
        if "Exchange hashpartitioning" in line:
            depth = indent(line)
            below = [other for other in lines[n + 1 :][: next((k for k, o in enumerate(lines[n + 1 :]) if indent(o) <= depth), None)]]
            scans = [other for other in below if "FileScan" in other]
            assert scans and all(str(tmp_path / "batch") in scan for scan in scans)
    assert {r.action: r.n_rows for r in versions.action_counts(applied).collect()} == {"untouched": 41, "closed": 2, "opened": 2}


def test_bucketed_table_is_read_without_a_shuffle(spark, tmp_path):
    spark.sql(f"CREATE DATABASE bucketed LOCATION '{tmp_path / 'db'}'")
    try:
        tables.save_bucketed(seed.bars(spark), "bucketed.bars", PRICE_KEYS, 4, str(tmp_path / "bars"))
        stored = spark.table("bucketed.bars")
        assert shuffles(versions.latest_version(stored, PRICE_KEYS)) == []
        assert versions.latest_version(stored, PRICE_KEYS).count() == 41
    finally:
        spark.sql("DROP DATABASE bucketed CASCADE")


def test_publish_is_all_or_nothing_and_repeatable(spark, tmp_path):
    root = str(tmp_path / "pub")
    assert tables.published_version(spark, root) is None
    one = {"a": spark.range(3), "b": spark.range(5)}
    tables.publish(one, root, 1)
    # Data of a version that no manifest names is not visible.
    spark.range(9).write.parquet(f"{root}/a/version=2")
    assert tables.read_published(spark, root, "a").count() == 3
    tables.publish({"a": spark.range(7), "b": spark.range(8)}, root, 2)
    assert [tables.read_published(spark, root, t).count() for t in "ab"] == [7, 8]
    with pytest.raises(ValueError, match="not above the published 2"):
        tables.publish({"a": spark.range(1)}, root, 2)
    assert tables.read_published(spark, root, "a").count() == 7
    assert tables.publish({"a": spark.range(4)}, root, batch=("q", 0)) == 3
    assert tables.publish({"a": spark.range(9)}, root, batch=("q", 0)) == 3
    assert tables.publish({"a": spark.range(9)}, root, batch=("r", 0)) == 4
    assert [tables.read_published(spark, root, t).count() for t in "ab"] == [9, 8]


def test_run_rows_have_defaults_and_no_null_keys(spark, tmp_path):
    asked = seed.requests(spark, ("AAPL", "2024-03-01"), ("MSFT", "2024-03-01"))
    runs = tables.begin_runs(asked, "baseline", "2024-03-02 10:00:00", analyst_model="m")
    again = tables.begin_runs(asked, "baseline", "2024-03-02 10:00:00", analyst_model="m")
    rows = runs.collect()
    assert {r.status for r in rows} == {"running"} and {r.debate_rounds for r in rows} == {1}
    assert {r.analyst_model for r in rows} == {"m"} and len({r.id for r in rows}) == 2 and set(rows) == set(again.collect())
    with pytest.raises(ValueError, match="run needs id"):
        tables.conform(asked.withColumnRenamed("as_of", "as_of_date").withColumn("mode", F.lit("baseline")), "run")
    with pytest.raises(Exception, match="NULL in run.mode"):
        tables.append_rows(runs.withColumn("mode", F.lit(None).cast("string")), str(tmp_path / "run"), "run")


def test_lineage_is_cut_in_the_shared_folder(spark):
    df = cut_lineage(spark.range(10).withColumn("x", F.col("id") * 2))
    assert df.agg(F.sum("x")).first()[0] == 90
    assert "Range" not in df._jdf.queryExecution().executedPlan().toString()


FACT_LOG = "ticker string, metric string, period_start date, period_end date, value double, currency string, source string, observed_on date"


def log_rows(*rows):
    return [(t, "eps", dt.date(2023, 10, 2), dt.date(2023, 12, 31), v, "USD", "s", seed.day(o)) for t, v, o in rows]


def test_stream_applies_each_file_once(spark, tmp_path):
    landing, root, check = (str(tmp_path / n) for n in ("landing", "root", "check"))
    initial = seed.facts(spark).where("false")

    def apply(current, batch):
        day = batch.agg(F.max("observed_on")).first()[0]
        return versions.next_state(ingest.apply_facts(current, batch.drop("observed_on"), day))

    def run(check=check):
        stream = spark.readStream.schema(FACT_LOG).parquet(landing)
        query = streaming.apply_stream(stream, root, "fundamental_fact", initial, apply, check)
        assert query.awaitTermination(120)

    spark.createDataFrame(log_rows(("A", 1.0, "2024-03-01"), ("B", 2.0, "2024-03-01")), FACT_LOG).write.mode("append").parquet(landing)
    run()
    spark.createDataFrame(log_rows(("A", 1.5, "2024-03-05")), FACT_LOG).write.mode("append").parquet(landing)
    run()
    run()
    assert tables.published_version(spark, root) == 2

    def rows():
        stored = tables.read_published(spark, root, "fundamental_fact").collect()
        return {(r.ticker, float(r.value), str(r.known_until)) for r in stored}

    assert rows() == {("A", 1.0, "2024-03-05"), ("A", 1.5, "9999-12-31"), ("B", 2.0, "9999-12-31")}
    # A new checkpoint counts its batches from 0 again; what it reads is applied all the same.
    landing = str(tmp_path / "other")
    spark.createDataFrame(log_rows(("C", 7.0, "2024-03-06")), FACT_LOG).write.parquet(landing)
    run(str(tmp_path / "check2"))
    assert tables.published_version(spark, root) == 3 and ("C", 7.0, "9999-12-31") in rows() and len(rows()) == 4


def test_streamed_log_gives_the_same_versions(spark, tmp_path):
    landing, log, check = (str(tmp_path / n) for n in ("landing", "log", "check"))
    rows = log_rows(("A", 1.0, "2024-03-01"), ("A", 1.5, "2024-03-05"), ("B", 2.0, "2024-03-01"))
    for row in rows:
        spark.createDataFrame([row], FACT_LOG).write.mode("append").parquet(landing)
        stream = spark.readStream.schema(FACT_LOG).parquet(landing)
        assert streaming.append_observations(stream, log, check, "period_end").awaitTermination(120)
    stored = spark.read.parquet(log).drop("valid_year")
    assert stored.count() == 3
    built = versions.build_versions(stored, FACT_KEYS, ["value"], ["value"], F.date_add("period_end", 45))
    assert {(r.ticker, str(r.known_from)) for r in built.collect()} == {("A", "2024-02-14"), ("A", "2024-03-05"), ("B", "2024-02-14")}
    assert PRICE_KEYS == ["ticker", "trade_date"]


def test_stream_drops_repeated_news(spark, tmp_path):
    landing = str(tmp_path / "news")
    schema = "ticker string, headline string, published_ts timestamp"
    t = dt.datetime(2024, 3, 1, 10)
    rows = [("A", "h", t), ("A", "h", t), ("A", "g", t), ("B", "h", t)]
    spark.createDataFrame(rows, schema).write.parquet(landing)
    stream = spark.readStream.schema(schema).parquet(landing)
    query = (
        streaming.without_repeats(stream, ["ticker", "headline", "published_ts"], "published_ts", "7 days")
        .writeStream.format("parquet").option("path", str(tmp_path / "out"))
        .option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
    )
    assert query.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 3
