"""Feeds with lines that cannot be read, stored years read for requests, counts while writing, VARIANT payloads."""

from __future__ import annotations

import json

import pytest
import seed
from pyspark.sql import functions as F

from backdate.operators import pointintime, quality, responses
from backdate.schemas import COMPANY_FEED, FACT_KEYS, NEWS_FEED, PRICE_FEED, PRICE_KEYS
from backdate.sources import landing, tables


def write_lines(path, lines):
    path.mkdir()
    (path / "part-0").write_text("\n".join(lines) + "\n", encoding="utf-8")
    return str(path)


def test_bad_lines_of_csv_prices_are_set_aside(spark, tmp_path):
    good = ["AAA,2024-03-01,1.0,2.0,0.5,1.5,100", "AAA,2024-03-04,1.0,2.0,0.5,,100", "B,2024-03-01,1,2,0.5,1.5,7"]
    bad = ["AAA,2024-03-05,x,2.0,0.5,1.5,100", "AAA,2024-03-06,1.0", "AAA,no day,1,2,0.5,1.5,7"]
    keyless = ["C,,1,2,0.5,1.5,7"]
    feed = write_lines(tmp_path / "prices", ["ticker,trade_date,open,high,low,close,volume", *good, *bad, *keyless])
    clean = write_lines(tmp_path / "clean", ["ticker,trade_date,open,high,low,close,volume", *good])
    out = str(tmp_path / "landed")
    counts = landing.land(spark, feed, out, PRICE_FEED, "csv", ["ticker", "trade_date"])
    assert {k: n for k, n in counts.items() if n} == {"rows": 7, "unreadable": 3, "missing trade_date": 1}
    # The sound rows are those of a feed that never had the others.
    expected = spark.read.schema(PRICE_FEED).option("header", True).csv(clean)
    assert landing.sound(spark, out, PRICE_FEED).schema == expected.schema
    assert sorted(landing.sound(spark, out, PRICE_FEED).collect(), key=str) == sorted(expected.collect(), key=str)
    held = landing.quarantined(spark, out, PRICE_FEED)
    assert sorted(r._line for r in held.where("_reason = 'unreadable'").collect()) == sorted(bad)
    assert all(r._file.endswith("part-0") for r in held.collect())
    # Whatever columns are asked for, the same lines are sound.
    assert landing.sound(spark, out, PRICE_FEED).select("ticker").count() == 3


def test_bad_lines_of_json_feeds_are_set_aside(spark, tmp_path):
    entry = {"ticker": "AAA", "feed_pos": 1, "content": {"pubDate": "2024-03-01T00:00:00Z", "title": "T"}}
    lines = [json.dumps(entry), json.dumps(entry)[:-3], "[1, 2", '{"ticker": "A", "feed_pos": "first"}', '{"feed_pos": 4}', "", "{}"]
    out = str(tmp_path / "landed")
    counts = landing.land(spark, write_lines(tmp_path / "news", lines), out, NEWS_FEED)
    assert {k: n for k, n in counts.items() if n} == {"rows": 6, "unreadable": 3, "missing ticker": 2}
    (row,) = landing.sound(spark, out, NEWS_FEED).collect()
    assert (row.ticker, row.feed_pos, row.content.title) == ("AAA", 1, "T")
    assert landing.quarantined(spark, out, NEWS_FEED).where("_reason = 'missing ticker'").count() == 2
    # A feed without faults has no rejected lines, an empty one no lines at all; landing again replaces.
    fine = write_lines(tmp_path / "companies", ['{"ticker": "A", "longName": "Ä"}'])
    landing.land(spark, fine, out + "2", COMPANY_FEED)
    landing.land(spark, fine, out + "2", COMPANY_FEED)
    assert [r.longName for r in landing.sound(spark, out + "2", COMPANY_FEED).collect()] == ["Ä"]
    assert landing.quarantined(spark, out + "2", COMPANY_FEED).count() == 0
    none = write_lines(tmp_path / "none", [""])
    assert landing.land(spark, none, out + "3", COMPANY_FEED)["rows"] == 0


def files_of(df):
    """Files that the run plan's scan of the stored table opened."""
    df.collect()
    stack, found = [df._jdf.queryExecution().executedPlan()], []
    while stack:
        node = stack.pop()
        if node.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
            stack.append(node.executedPlan())
        elif node.getClass().getSimpleName().endswith("QueryStageExec"):
            stack.append(node.plan())
        elif node.getClass().getSimpleName() == "FileSourceScanExec" and "valid_year" in node.simpleString(9999):
            found.append(node.metrics().apply("numFiles").value())
        children = node.children()
        stack.extend(children.apply(i) for i in range(children.size()))
    return found


@pytest.mark.parametrize("broadcast", ["10m", "-1"])
def test_only_years_that_requests_see_are_opened(spark, tmp_path, broadcast):
    bars = spark.range(40 * 360).selectExpr(
        "concat('T', id % 3) AS ticker", "date_add(DATE'1980-01-01', CAST(id AS INT)) AS trade_date",
        *[f"CAST(id AS DECIMAL(18,4)) AS {c}" for c in ("open", "high", "low", "close", "adj_close")], "id AS volume",
        "date_add(DATE'1980-01-01', CAST(id AS INT)) AS known_from", "DATE'9999-12-31' AS known_until",
    )
    path = str(tmp_path / "bars")
    tables.write_versions(bars, path, "trade_date", PRICE_KEYS, 2)
    # Two requests decades apart, one of them with a view over new year, and one without a date.
    requests = spark.createDataFrame(
        [("T1", "1984-12-30"), ("T2", "2011-02-01"), ("T2", None)], "ticker string, as_of string"
    ).withColumn("as_of", F.col("as_of").cast("date"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
    try:
        asked = tables.read_asked(spark, path, "price_bar", requests, 180)
        read = pointintime.price_history(requests, asked, 180)
        assert files_of(asked) == [6]  # of 2 × 40: 1984, 2010, 2011
        assert "dynamicpruning" in asked._jdf.queryExecution().executedPlan().toString()
        assert sorted(read.collect()) == sorted(pointintime.price_history(requests, bars, 180).collect())
        early = tables.read_asked(spark, path, "price_bar", requests.where("ticker = 'T1'"))
        assert files_of(early) == [10]  # 1980 to 1984
        assert tables.read_asked(spark, path, "price_bar", requests.where("false"), 180).count() == 0
        assert tables.read_asked(spark, path, "price_bar", requests.where("false")).count() == 0
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_counts_on_the_write_are_those_of_a_second_pass(spark, tmp_path):
    bars = seed.bars(spark).withColumns({
        "ticker": F.when(F.dayofmonth("trade_date") % 7 != 0, F.col("ticker")),
        "known_until": F.when(F.dayofmonth("trade_date") % 5 == 0, F.date_sub("known_from", 1)).otherwise(F.col("known_until")),
    })
    rules = {**quality.row_rules(["ticker", "close"], {"ticker": ("NVDA", "OTHER")}), **quality.version_rules()}
    path = str(tmp_path / "bars")
    counts = tables.write_observed(bars, rules, lambda df: df.write.parquet(path))
    stored = spark.read.parquet(path)
    assert counts == {"rows": stored.count(), **{rule: stored.where(broken).count() for rule, broken in rules.items()}}
    declared = {r.rule: r.violations for r in quality.constraint_violations(
        {"bars": stored}, {}, not_null={"bars": ["ticker", "close"]}, allowed={("bars", "ticker"): ("NVDA", "OTHER")},
    ).collect()}
    assert declared and all(counts[rule] == n for rule, n in declared.items())
    assert counts["ticker not null"] > 0 and counts["known_from up to known_until"] > 0
    # Nothing to write: nothing broken.
    none = tables.write_observed(bars.where("false"), rules, lambda df: df.write.parquet(path + "0"))
    assert set(none.values()) == {0}


def test_variant_payloads_keep_every_field(spark, tmp_path):
    whole = {"recommendation": "buy", "reasoning": "r", "strongest_counterpoint": "c", "confidence": "low"}
    payloads = {
        "plain": whole, "more": {**whole, "tokens": {"in": 3, "out": [1, 2]}, "ünit": None}, "number": {**whole, "reasoning": 5},
        "null": {**whole, "confidence": None}, "other": {**whole, "recommendation": "wait"}, "list": [whole], "empty": {},
    }
    rows = [(k, json.dumps(v, ensure_ascii=False)) for k, v in payloads.items()] + [("cut", '{"recommendation"'), ("none", None), ("", "")]
    messages = spark.createDataFrame(rows, "run_id string, payload string")
    path = str(tmp_path / "messages")
    responses.payloads_as_variant(messages).write.parquet(path)
    stored = spark.read.parquet(path)
    assert stored.schema["payload"].dataType.simpleString() == "variant"
    got = {r.run_id: r for r in responses.verdicts_of_variants(stored).collect()}
    texts = {r.run_id: r for r in responses.parse_verdicts(messages).collect()}
    for name, row in texts.items():
        if name not in ("list", ""):
            assert got[name][:6] == row[:6], name
    assert got["list"].problem == got[""].problem == "not valid JSON for the schema"
    assert json.loads(got["more"].extra) == {"tokens": {"in": 3, "out": [1, 2]}, "ünit": None}
    assert [n for n, r in got.items() if r.extra is not None] == ["more"]


def test_facts_have_no_lookback(spark, tmp_path):
    facts, path = seed.facts(spark), str(tmp_path / "facts")
    tables.write_versions(facts, path, "period_end", FACT_KEYS, 1)
    ticker = facts.first().ticker
    requests = spark.createDataFrame([(ticker, "2024-06-30")], "ticker string, as_of string").withColumn("as_of", F.col("as_of").cast("date"))
    read = pointintime.facts_as_of(tables.read_asked(spark, path, "fundamental_fact", requests), requests)
    assert sorted(read.collect(), key=str) == sorted(pointintime.facts_as_of(facts, requests).collect(), key=str)
