"""Feeds to tables: news, figures, companies, and a whole ingest."""

from __future__ import annotations

import datetime as dt
import json
from decimal import Decimal

import pytest
import seed
from pyspark.sql import functions as F

from backdate.functions.dates import published_date
from backdate.functions.text import first_sentences
from backdate.operators import ingest, news
from backdate.sources import landing


def entry(ticker, pos, **content):
    return json.dumps({"ticker": ticker, "feed_pos": pos, "content": content})


@pytest.fixture(scope="module")
def feed(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("news")
    lines = [
        entry("A", 1, pubDate="2024-03-01T10:00:00Z", title="one", provider={"displayName": "P"},
              canonicalUrl={"url": "u1"}, summary="First. Second! Third?"),
        entry("A", 2, pubDate="2024-03-01T09:00:00Z", title="one", summary="again"),
        entry("A", 3, pubDate="2024-02-28T23:30:00-05:00", title="two", summary="", description="Said  so. Yes."),
        entry("A", 4, pubDate="2024-03-02T00:00:00Z", title="late"),
        entry("A", 5, title="undated"),
        entry("A", 6, pubDate="", title="empty date"),
        entry("A", 7, pubDate="yesterday", title="bad date"),
        entry("A", 8, pubDate="2024-01-01T00:00:00Z"),
        entry("B", 1, pubDate="2024-02-01T00:00:00Z", title="known", provider={"displayName": ""}),
        entry("B", 2, pubDate="2024-02-02T00:00:00Z", title="fresh", canonicalUrl={"url": ""}),
    ]
    (path / "feed.json").write_text("\n".join(lines))
    return landing.read_news(spark, str(path))


def stored(spark, *rows):
    return spark.createDataFrame(
        [(t, h, seed.day(p)) for t, h, p in rows] or [], "ticker string, headline string, published_at date"
    )


def test_news_are_cleaned_deduplicated_and_bounded(spark, feed):
    rows = {(r.ticker, r.headline): r for r in news.ingest_news(
        stored(spark, ("B", "known", "2024-02-01")), feed, "2024-03-01").collect()}
    assert set(rows) == {("A", "one"), ("A", "two"), ("A", ""), ("B", "fresh")}
    one = rows["A", "one"]
    assert (one.source, one.url, one.summary, one.feed_pos) == ("P", "u1", "First. Second!", 1)
    two = rows["A", "two"]
    assert (two.source, str(two.published_at), two.summary) == ("Yahoo Finance", "2024-02-28", "Said  so. Yes.")
    assert rows["B", "fresh"].url == "" and rows["A", ""].summary == ""


def test_cap_counts_new_items_in_feed_order(spark, feed):
    existing = stored(spark, ("A", "one", "2024-03-01"))
    rows = news.ingest_news(existing, feed, "2024-03-01", max_items=1).collect()
    assert {(r.ticker, r.headline) for r in rows} == {("A", "two"), ("B", "known")}


def test_ingesting_the_feed_again_adds_nothing(spark, feed):
    added = news.ingest_news(stored(spark), feed, "2024-03-01")
    assert news.ingest_news(added, feed, "2024-03-01").count() == 0


def test_bad_dates_are_quarantined(spark, feed):
    assert [r.feed_pos for r in news.undated_news(feed).collect()] == [7]


def test_news_top_k_order_ties_and_defaults(spark):
    rows = [(f"h{i:02d}", "s", f"2024-01-{1 + i // 4:02d}", f"u{i}", "t") for i in range(24)]
    rows.append(("zz", "", "2024-01-06", "u", None))
    table = seed.news(spark, rows)
    asked = seed.requests(spark, ("AAPL", "2024-01-06"), ("AAPL", "2024-01-02"), ("AAPL", "2023-12-31"), ("B", "2024-01-06"))
    got = {}
    for r in news.news_top_k(asked, table, 8).orderBy("as_of", "position").collect():
        got.setdefault(str(r.as_of), []).append(r)
    assert set(got) == {"2024-01-06", "2024-01-02"}
    for as_of, picked in got.items():
        want = sorted((r for r in rows if r[2] <= as_of), key=lambda r: r[0])
        want = sorted(want, key=lambda r: r[2], reverse=True)[:8]
        assert [(p.headline, str(p.published)) for p in picked] == [(w[0], w[2]) for w in want]
        assert [p.position for p in picked] == list(range(1, 9))
    last = next(p for p in got["2024-01-06"] if p.headline == "zz")
    assert last.source == "Unknown" and last.summary == ""


def test_one_day_with_more_items_than_the_cap(spark):
    rows = [(f"h{i:03d}", "s", "2024-01-05", f"u{i}", "t") for i in range(300)]
    asked = seed.requests(spark, ("AAPL", "2024-01-05"), ("AAPL", "2025-01-05"))
    got = news.news_top_k(asked, seed.news(spark, rows), 8).collect()
    assert {(r.as_of.year, r.headline) for r in got} == {(y, f"h{i:03d}") for y in (2024, 2025) for i in range(8)}


@pytest.mark.parametrize("text, want", [
    ("  One. Two! Three?", "One. Two!"),
    ("One.Two. Three. Four", "One.Two. Three."),
    ("No stop at all", "No stop at all"),
    ("A.\n\tB? C.", "A. B?"),
    ("  spaced \x1f", "spaced"),
    ("Wait... what? Yes.", "Wait... what?"),
    ("", ""),
])
def test_first_sentences(spark, text, want):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(first_sentences(F.col("t"), 2)).first()[0] == want


def test_published_date_keeps_its_own_offset(spark):
    texts = ["2024-03-01T23:30:00-05:00", "2024-03-01", "", "x", None, "2024-02-30T00:00:00Z"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r[0] for r in df.select(published_date(F.col("t"))).collect()]
    assert got == [dt.date(2024, 3, 1), dt.date(2024, 3, 1), None, None, None, None]


def test_quarterly_table_is_unpivoted_and_cleaned(spark, tmp_path):
    (tmp_path / "q.csv").write_text(
        "ticker,line_item,2023-12-31,2023-09-30\n"
        "A,Total Revenue,100.5,NaN\nA,Net Income,n/a,20\nA,Gross Profit,1,2\nB,Basic EPS,,1.25\nB,Diluted EPS,1.2,\n"
    )
    got = {(r.ticker, r.metric, str(r.period_end)): r
           for r in ingest.clean_facts(landing.read_quarterly(spark, str(tmp_path))).collect()}
    assert set(got) == {
        ("A", "revenue", "2023-12-31"), ("A", "net_income", "2023-09-30"),
        ("B", "eps", "2023-09-30"), ("B", "eps_diluted", "2023-12-31"),
    }
    revenue = got["A", "revenue", "2023-12-31"]
    assert (revenue.value, str(revenue.period_start), revenue.currency) == (Decimal("100.5000"), "2023-10-02", "USD")


def test_quarterly_table_without_periods_gives_no_facts(spark):
    empty = spark.createDataFrame([("A", "Net Income")], "ticker string, line_item string")
    assert ingest.clean_facts(empty).count() == 0


def test_company_name_falls_back(spark):
    rows = [("A", "Long", "Short", "S", "X"), ("B", "", "Short", None, None), ("C", None, "", None, None)]
    feed = spark.createDataFrame(rows, "ticker string, longName string, shortName string, sector string, exchange string")
    assert {r.ticker: r.name for r in ingest.clean_companies(feed).collect()} == {"A": "Long", "B": "Short", "C": "C"}


def test_price_window_keeps_both_ends(spark):
    days = ["2023-09-02", "2023-09-03", "2024-02-29", "2024-03-01"]
    feed = spark.createDataFrame(
        [("A", seed.day(d), 1.0, 1.0, 1.0, 1.23456, 10) for d in days],
        "ticker string, trade_date date, open double, high double, low double, close double, volume bigint",
    )
    got = ingest.clean_prices(feed, "2024-02-29", 180).orderBy("trade_date").collect()
    assert [str(r.trade_date) for r in got] == ["2023-09-02", "2023-09-03", "2024-02-29"]
    assert got[0].adj_close == got[0].close == Decimal("1.2346")


def test_whole_ingest_twice(spark, feed):
    prices = spark.createDataFrame(
        [("A", seed.day("2024-02-28"), 1.0, 1.0, 1.0, 1.5, 10), ("A", seed.day("2024-02-29"), 1.0, 1.0, 1.0, 1.6, 10)],
        "ticker string, trade_date date, open double, high double, low double, close double, volume bigint",
    )
    quarterly = spark.createDataFrame([("A", "Net Income", 20.0)], "ticker string, line_item string, `2023-12-31` double")
    companies = spark.createDataFrame([("A", "Long", None, "S", "X")],
                                      "ticker string, longName string, shortName string, sector string, exchange string")
    feeds = {"company": companies, "prices": prices, "news": feed, "quarterly": quarterly}
    state = {
        "company": spark.createDataFrame([], "ticker string, name string, sector string, exchange string"),
        "price_bar": seed.bars(spark, []), "fundamental_fact": seed.facts(spark, []),
        "news_item": stored(spark),
    }
    first = ingest.ingest_batch(feeds, state, "2024-03-01", "2024-03-01")
    assert {r.action for r in first["price_bar"].collect()} == {"opened"}
    assert first["fundamental_fact"].count() == 1 and first["company"].count() == 1
    again = ingest.ingest_batch(
        {k: v for k, v in feeds.items() if k != "company"},
        {"price_bar": first["price_bar"].drop("action"), "fundamental_fact": first["fundamental_fact"].drop("action"),
         "news_item": first["news_item"]}, "2024-03-01", "2024-03-02",
    )
    assert {r.action for r in again["price_bar"].collect()} == {"unchanged"}
    assert {r.action for r in again["fundamental_fact"].collect()} == {"unchanged"}
    assert again["news_item"].count() == 0 and "company" not in again
