"""Every operator as a named query over the tables of ``backdate.sources.derived``.

Results are flat: dates and times as text, decimals as doubles.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from backdate.functions.dates import open_end
from backdate.functions.text import first_sentences
from backdate.operators import deltas, evaluate, ingest, maintenance, news, panel, pointintime, quality, responses, sweep, versions
from backdate.operators.indicators import indicators, indicators_by_maps, price_snapshot
from backdate.schemas import (
    CONFIDENCES,
    FACT_KEYS,
    HISTORY_LOOKBACK_DAYS,
    INDICATOR_LOOKBACK_DAYS,
    MACD_SLOW,
    MODES,
    NEWS_FEED,
    PRICE_KEYS,
    RECOMMENDATIONS,
    STANCES,
    STATUSES,
)
from backdate.session import new_folder
from backdate.sources import derived, landing, tables

Query = Callable[[SparkSession, str], DataFrame]

KNOWN_ON = "1999-03-01"
EARLY = ("1995-01-20", "1995-03-10")
PERIOD_END = "1998-12-31"
TRAILING_DAYS = 30
INGESTED_ON = "2002-06-30"
CLOCK = "2002-06-30 12:00:00"
FILES_PER_YEAR = 4


def plain(df: DataFrame) -> DataFrame:
    """Types every engine and client agrees on; timestamps read in UTC."""

    def flat(field: T.StructField) -> Column:
        c = F.col(field.name)
        if isinstance(field.dataType, T.TimestampType):
            c = F.to_utc_timestamp(c, F.current_timezone())
        if isinstance(field.dataType, (T.DateType, T.TimestampType, T.TimestampNTZType)):
            c = c.cast("string")
        elif isinstance(field.dataType, T.DecimalType):
            c = c.cast("double")
        elif isinstance(field.dataType, (T.IntegerType, T.ShortType)):
            c = c.cast("long")
        return c.alias(field.name)

    return df.select(*[flat(f) for f in df.schema])


def _content(df: DataFrame) -> Column:
    """A row as text: its columns in the order of their names."""
    return F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in sorted(df.columns) if c != "action"])


# -- point-in-time reads ------------------------------------------------------

def _bars_for(
    spark: SparkSession, d: str, requests: DataFrame, lookback_days: int, measures: Sequence[str] = ("close",)
) -> DataFrame:
    """The bars that the requests can see, with their bounds in the scan."""
    return derived.price_bar(spark, d, measures, asked=requests, lookback_days=lookback_days)


def indicators_panel(spark: SparkSession, d: str) -> DataFrame:
    requests = derived.requests(spark, d)
    return indicators(requests, _bars_for(spark, d, requests, INDICATOR_LOOKBACK_DAYS))


def indicators_mapped(spark: SparkSession, d: str) -> DataFrame:
    """The panel by maps of buckets instead of arrays of bars."""
    requests = derived.requests(spark, d)
    return indicators_by_maps(requests, _bars_for(spark, d, requests, INDICATOR_LOOKBACK_DAYS))


def trailing_closes(spark: SparkSession, d: str) -> DataFrame:
    """Dense requests: every ticker on every day it was traded, and the closes of 30 days as believed on that day."""
    traded = derived.price_observations(spark, d, ()).select("ticker", F.col("trade_date").alias("as_of"))
    return sweep.trailing(traded, derived.price_bar(spark, d, ("close",)), TRAILING_DAYS)


def indicators_early(spark: SparkSession, d: str) -> DataFrame:
    """So early in the data that some series are too short."""
    requests = derived.requests(spark, d, EARLY)
    return indicators(requests, _bars_for(spark, d, requests, INDICATOR_LOOKBACK_DAYS))


def price_history(spark: SparkSession, d: str) -> DataFrame:
    requests = derived.requests(spark, d)
    bars = _bars_for(spark, d, requests, HISTORY_LOOKBACK_DAYS, derived.PRICE_MEASURES)
    return pointintime.price_history(requests, bars)


def stored_price_history(spark: SparkSession, d: str) -> DataFrame:
    """From a stored table, of which the scan opens only the years the requests can see."""
    requests, path = derived.requests(spark, d), new_folder(spark, "price_bar")
    tables.write_versions(derived.price_bar(spark, d), path, "trade_date", PRICE_KEYS, FILES_PER_YEAR)
    bars = tables.read_asked(spark, path, "price_bar", requests, HISTORY_LOOKBACK_DAYS)
    return pointintime.price_history(requests, bars)


def stored_facts_as_of(spark: SparkSession, d: str) -> DataFrame:
    """The same for figures, which have no look-back."""
    requests, path = derived.requests(spark, d), new_folder(spark, "fundamental_fact")
    tables.write_versions(derived.fundamental_fact(spark, d), path, "period_end", FACT_KEYS, FILES_PER_YEAR)
    return pointintime.facts_as_of(tables.read_asked(spark, path, "fundamental_fact", requests), requests)


def price_snapshots(spark: SparkSession, d: str) -> DataFrame:
    requests = derived.requests(spark, d)
    return price_snapshot(requests, _bars_for(spark, d, requests, HISTORY_LOOKBACK_DAYS))


def daily_changes(spark: SparkSession, d: str) -> DataFrame:
    requests = derived.requests(spark, d)
    return pointintime.daily_changes(requests, _bars_for(spark, d, requests, HISTORY_LOOKBACK_DAYS))


def prices_known_on(spark: SparkSession, d: str) -> DataFrame:
    return pointintime.known_as_of(derived.price_bar(spark, d), KNOWN_ON)


def facts_as_of(spark: SparkSession, d: str) -> DataFrame:
    requests = derived.requests(spark, d)
    return pointintime.facts_as_of(derived.fundamental_fact(spark, d, asked=requests), requests)


def facts_of_metric(spark: SparkSession, d: str) -> DataFrame:
    requests = derived.requests(spark, d)
    facts = derived.fundamental_fact(spark, d, asked=requests)
    return pointintime.facts_as_of(facts, requests, metrics=["net_income"])


def facts_exact_period(spark: SparkSession, d: str) -> DataFrame:
    requests = derived.requests(spark, d)
    facts = derived.fundamental_fact(spark, d, asked=requests)
    return pointintime.facts_as_of(facts, requests, period_end=PERIOD_END)


def facts_naive_latest(spark: SparkSession, d: str) -> DataFrame:
    return pointintime.facts_latest(derived.fundamental_fact(spark, d))


def news_top_k(spark: SparkSession, d: str) -> DataFrame:
    return news.news_top_k(derived.requests(spark, d), derived.news_item(spark, d))


def news_visible(spark: SparkSession, d: str) -> DataFrame:
    return news.visible_news(derived.news_item(spark, d), KNOWN_ON)


# -- versioned writes ---------------------------------------------------------

def price_versions(spark: SparkSession, d: str) -> DataFrame:
    return derived.price_bar(spark, d)


def fact_versions(spark: SparkSession, d: str) -> DataFrame:
    return derived.fundamental_fact(spark, d)


def _late_prices(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """The price log without the returned lines, and those, which are observed before and after others."""
    on_time, late = (
        derived.price_observations(spark, d, ("close",), where, derived.LINE_ORDER)
        for where in ("l_returnflag <> 'R'", "l_returnflag = 'R'")
    )
    return on_time, late


def _price_delta(on_time: DataFrame, late: DataFrame) -> DataFrame:
    return deltas.window_delta(on_time, late, PRICE_KEYS, ["adj_close"], derived.LINE_ORDER, F.col("trade_date"))


def late_price_delta(spark: SparkSession, d: str) -> DataFrame:
    """What late observations take from and add to the windows."""
    return _price_delta(*_late_prices(spark, d))


def late_price_versions(spark: SparkSession, d: str) -> DataFrame:
    """Windows kept up by the delta of late observations."""
    on_time, late = _late_prices(spark, d)
    windows = versions.build_versions(on_time, PRICE_KEYS, ["adj_close"], derived.LINE_ORDER, F.col("trade_date"))
    return deltas.apply_delta(windows, _price_delta(on_time, late))


def open_versions(spark: SparkSession, d: str) -> DataFrame:
    return versions.open_versions(derived.price_bar(spark, d))


# Every line is either in the stored state or in the batch that follows it. The
# batch is nearly as large as the state, hence small_batch=False below.
STORED, ARRIVING = "l_linenumber <= 4", "l_linenumber > 4"


def apply_batch_prices(spark: SparkSession, d: str) -> DataFrame:
    batch = derived.price_observations(spark, d, where=ARRIVING, carry=derived.LINE_ORDER)
    return ingest.apply_prices(derived.price_bar(spark, d, where=STORED), batch, INGESTED_ON, derived.LINE_ORDER, small_batch=False)


def apply_batch_facts(spark: SparkSession, d: str) -> DataFrame:
    batch = derived.fact_observations(spark, d, where=ARRIVING, carry=derived.LINE_ORDER)
    return ingest.apply_facts(derived.fundamental_fact(spark, d, where=STORED), batch, INGESTED_ON, derived.LINE_ORDER, small_batch=False)


def batch_action_counts(spark: SparkSession, d: str) -> DataFrame:
    """With a batch that repeats the stored lines, so that some versions stay unchanged."""
    batch = derived.price_observations(spark, d, carry=derived.LINE_ORDER)
    stored = derived.price_bar(spark, d, where=STORED)
    return versions.action_counts(ingest.apply_prices(stored, batch, INGESTED_ON, derived.LINE_ORDER, small_batch=False))


def _broken_bars(spark: SparkSession, d: str) -> DataFrame:
    """Bars of which some windows end before they start, and some never end."""
    day, until = F.dayofmonth("trade_date"), F.col("known_until")
    ends = F.when(day == 17, open_end()).when((day == 13) & (until != open_end()), F.date_sub("known_from", 1)).otherwise(until)
    return derived.price_bar(spark, d, []).withColumn("known_until", ends)


def version_invariants(spark: SparkSession, d: str) -> DataFrame:
    """For prices with planted faults and for facts as they are."""
    prices = versions.version_invariants(_broken_bars(spark, d), PRICE_KEYS, reduce_first=False)
    facts = versions.version_invariants(derived.fundamental_fact(spark, d), FACT_KEYS, reduce_first=False)
    return prices.withColumn("table_name", F.lit("price_bar")).unionByName(
        facts.withColumn("table_name", F.lit("fundamental_fact"))
    )


def reseed_facts(spark: SparkSession, d: str) -> DataFrame:
    """Replace every period of one metric by its newest version, kept from the start."""
    facts = derived.fundamental_fact(spark, d)
    newest = pointintime.facts_latest(facts.where("metric = 'eps'"))
    return maintenance.reseed(facts, newest, FACT_KEYS)


# -- ingest -------------------------------------------------------------------

def _price_feed(spark: SparkSession, d: str) -> DataFrame:
    price = F.col("l_extendedprice")
    return derived.source(spark, d, "lineitem").select(
        F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("ticker"),
        F.to_date("l_shipdate").alias("trade_date"),
        price.alias("open"), price.alias("high"), price.alias("low"), price.alias("close"),
        F.col("l_quantity").alias("volume"),
    )


def ingest_prices_clean(spark: SparkSession, d: str) -> DataFrame:
    return ingest.clean_prices(_price_feed(spark, d), KNOWN_ON)


def _quarterly_by_metric(spark: SparkSession, d: str) -> DataFrame:
    """Wide figures per supplier and quarter; a quarter without some flag has a NULL there."""
    flag, price = F.col("l_returnflag"), F.col("l_extendedprice").cast("decimal(18,2)")
    end = F.date_sub(F.add_months(F.to_date(F.trunc(F.to_date("l_shipdate"), "quarter")), 3), 1)
    return derived.source(spark, d, "lineitem").groupBy(
        F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("ticker"), end.alias("period_end")
    ).agg(
        F.sum(F.when(flag == "A", price)).alias("revenue"),
        F.sum(F.when(flag == "N", price)).alias("net_income"),
        F.sum(F.when(flag == "R", price)).alias("eps"),
    )


def ingest_facts_unpivot(spark: SparkSession, d: str) -> DataFrame:
    wide = _quarterly_by_metric(spark, d)
    return ingest.unpivot_figures(wide, ["ticker", "period_end"], ["revenue", "net_income", "eps"], "metric")


def _quarterly_feed(spark: SparkSession, d: str) -> DataFrame:
    """One row per ticker, line item and period end, whatever the periods are."""
    items = F.array(
        F.struct(F.lit("Total Revenue").alias("line_item"), F.col("revenue").alias("figure")),
        F.struct(F.lit("Net Income").alias("line_item"), F.col("net_income").alias("figure")),
        F.struct(F.lit("Basic EPS").alias("line_item"), F.col("eps").alias("figure")),
        F.struct(F.lit("Gross Profit").alias("line_item"), F.col("revenue").alias("figure")),
    )
    return _quarterly_by_metric(spark, d).select("ticker", "period_end", F.inline(items))


def ingest_facts_clean(spark: SparkSession, d: str) -> DataFrame:
    return ingest.clean_fact_rows(_quarterly_feed(spark, d))


# Date texts of every fiftieth entry; a date can be read from those that begin with one in full.
ODD_DATES = ("soon", "1999-02-30T10:00:00Z", "", None, "1999/03/01", "1999-03-01", "31.12.1998", "1999-04-05 noon")


def _news_feed(spark: SparkSession, d: str) -> DataFrame:
    """Documents as nested feed entries; some lack provider, summary or a readable date."""
    doc, suppliers = F.col("doc_id"), derived.source(spark, d, "supplier").agg(F.count(F.lit(1))).scalar()
    day = F.date_add(F.lit("1999-01-01").cast("date"), ((doc * 7) % 365).cast("int"))
    odd = F.element_at(F.array(*[F.lit(t) for t in ODD_DATES]), (F.floor(doc / 50) % len(ODD_DATES) + 1).cast("int"))
    stamp = F.when(doc % 50 == 49, odd).otherwise(
        F.concat(day.cast("string"), F.lit("T23:30:00-05:00"))
    )
    return derived.source(spark, d, "documents").select(
        F.concat(F.lit("S"), (doc % suppliers).cast("string")).alias("ticker"),
        doc.alias("feed_pos"),
        F.struct(
            stamp.alias("pubDate"),
            F.element_at(F.split("text", "\n"), 1).alias("title"),
            F.when(doc % 3 != 0, F.struct(F.col("source").alias("displayName"))).alias("provider"),
            F.when(doc % 4 != 0, F.struct(F.concat(F.lit("doc:"), doc.cast("string")).alias("url"))).alias("canonicalUrl"),
            F.when(doc % 5 != 0, F.col("text")).otherwise("").alias("summary"),
            F.col("text").alias("description"),
        ).alias("content"),
        "lang",
    )


def ingest_news_dedup(spark: SparkSession, d: str) -> DataFrame:
    """The whole feed meets a table that already holds its English items."""
    feed = _news_feed(spark, d)
    stored = news.clean_news(feed.where("lang = 'en'")).where("published_at is not null")
    return news.ingest_news(stored, feed, "1999-09-30", max_items=8, ingested_at=CLOCK)


def landed_news(spark: SparkSession, d: str) -> DataFrame:
    """The feed as JSON lines of which some are broken off, hold a word for a number, or have no ticker."""
    entry = _news_feed(spark, d).select("ticker", "feed_pos", "content")
    kind = F.col("feed_pos") % 10
    text = F.to_json(F.struct("feed_pos", F.when(kind != 3, F.col("ticker")).alias("ticker"), "content"))
    line = F.when(kind == 7, F.expr("substring(_text, 1, length(_text) - 2)")).when(
        kind == 5, F.expr("concat('{\"feed_pos\":\"', feed_pos, ' or so\"', substring(_text, instr(_text, ',')))")
    ).otherwise(F.col("_text"))
    feed, landed = new_folder(spark, "news_feed"), new_folder(spark, "news_landed")
    entry.withColumn("_text", text).select(line.alias("value")).write.option("compression", "gzip").text(feed)
    landing.land(spark, feed, landed, NEWS_FEED)
    good = landing.sound(spark, landed, NEWS_FEED).select(
        "feed_pos", "ticker", F.col("content.title").alias("title"), F.lit("accepted").alias("outcome")
    )
    number = F.regexp_extract(landing.LINE, r'^\{"feed_pos":"?(\d+)', 1).cast("long")
    return good.unionByName(landing.quarantined(spark, landed, NEWS_FEED).select(
        F.coalesce(number, "feed_pos").alias("feed_pos"), F.lit(None).cast("string").alias("ticker"),
        F.lit(None).cast("string").alias("title"), F.col(landing.REASON).alias("outcome"),
    ))


def news_undated(spark: SparkSession, d: str) -> DataFrame:
    return news.undated_news(_news_feed(spark, d)).select("ticker", "feed_pos", F.col("content.pubDate").alias("pub_date"))


def truncate_sentences(spark: SparkSession, d: str) -> DataFrame:
    return derived.source(spark, d, "documents").select("doc_id", first_sentences(F.col("text"), 2).alias("summary"))


def company_upsert(spark: SparkSession, d: str) -> DataFrame:
    """A feed for the suppliers with a balance; names fall back, a missing sector overwrites."""
    feed = derived.source(spark, d, "supplier").where("s_acctbal > 0").select(
        F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("ticker"),
        F.when(F.col("s_suppkey") % 3 == 0, F.concat(F.col("s_name"), F.lit(" Holding"))).otherwise("").alias("longName"),
        F.when(F.col("s_suppkey") % 3 == 1, F.col("s_name")).alias("shortName"),
        F.when(F.col("s_nationkey") % 2 == 0, F.lit("RENAMED")).alias("sector"),
        F.lit("NEW").alias("exchange"),
    )
    return versions.upsert(derived.company(spark, d), ingest.clean_companies(feed), ["ticker"])


def _ingest_all(spark: SparkSession, d: str, as_of: str | DataFrame, prices: DataFrame, small_batch: bool) -> dict[str, DataFrame]:
    feed = _news_feed(spark, d)
    state = {
        "company": derived.company(spark, d),
        "price_bar": derived.price_bar(spark, d, where=STORED),
        "news_item": news.clean_news(feed.where("lang = 'en'")).where("published_at is not null"),
        "fundamental_fact": derived.fundamental_fact(spark, d, where=STORED),
    }
    companies = derived.company(spark, d).select(
        "ticker", F.col("name").alias("longName"), F.lit("").alias("shortName"), "sector", "exchange"
    )
    landing = {"company": companies, "prices": prices, "news": feed, "quarterly": _quarterly_feed(spark, d)}
    done = ingest.ingest_batch(landing, state, as_of, INGESTED_ON, small_batch=small_batch, ingested_at=CLOCK)
    return {t: df if "action" in df.columns else df.withColumn("action", F.lit("written")) for t, df in done.items()}


def ingest_all_counts(spark: SparkSession, d: str) -> DataFrame:
    """One full ingest of all tickers, as rows per table and action."""
    done = _ingest_all(spark, d, "1999-09-30", derived.price_observations(spark, d, where=ARRIVING), True)
    return reduce(DataFrame.unionByName, [
        versions.action_counts(df).withColumn("table_name", F.lit(name)) for name, df in done.items()
    ])


def ingest_all_rows(spark: SparkSession, d: str) -> DataFrame:
    """An ingest for a table of requests, every row of the next state as text.

    Half of the tickers ask as of one date and a quarter as of an earlier one.
    The price feed repeats what is stored, so many versions stay as they are.
    """
    number = F.substring("ticker", 2, 20).cast("long")
    last = F.when(number % 2 == 0, "1999-09-30").when(number % 4 == 1, "1998-06-30").cast("date")
    asked = derived.company(spark, d).select("ticker", last.alias("as_of")).where("as_of is not null")
    done = _ingest_all(spark, d, asked, derived.price_observations(spark, d), False)

    return reduce(DataFrame.unionByName, [
        plain(df).select(F.lit(name).alias("table_name"), "action", _content(plain(df)).alias("content")) if name == "news_item"
        else df.select(F.lit(name).alias("table_name"), "action", _content(df).alias("content")) for name, df in done.items()
    ])


# -- quality --------------------------------------------------------------------

def lookahead_leaks(spark: SparkSession, d: str) -> DataFrame:
    requests = derived.requests(spark, d)
    return quality.lookahead_leaks(derived.fundamental_fact(spark, d, asked=requests), requests, FACT_KEYS)


def leak_summary(spark: SparkSession, d: str) -> DataFrame:
    return quality.leak_summary(lookahead_leaks(spark, d))


def asof_bound_check(spark: SparkSession, d: str) -> DataFrame:
    requests = derived.requests(spark, d)
    bars = _bars_for(spark, d, requests, HISTORY_LOOKBACK_DAYS, derived.PRICE_MEASURES)
    history = pointintime.price_history(requests, bars)
    return quality.asof_bound_check(requests, history, news.news_top_k(requests, derived.news_item(spark, d)))


def constraint_violations(spark: SparkSession, d: str) -> DataFrame:
    tables = {
        "company": derived.company(spark, d),
        "price_bar": derived.price_bar(spark, d),
        "fundamental_fact": derived.fundamental_fact(spark, d),
        "news_item": derived.news_item(spark, d),
        "run": derived.run(spark, d),
        "agent_message": derived.agent_message(spark, d),
        "verdict": derived.verdict(spark, d),
        "lineitem": derived.source(spark, d, "lineitem"),
    }
    return quality.constraint_violations(
        tables,
        primary_keys={
            "company": ["ticker"], "run": ["id"], "verdict": ["run_id"],
            "price_bar": [*PRICE_KEYS, "known_from"],
            "fundamental_fact": [*FACT_KEYS, "known_from"],
            "news_item": ["ticker", "headline", "published_at"],
            # Declared nowhere, and indeed not a key: shows that the rule counts.
            "lineitem": ["l_orderkey", "l_linenumber"],
        },
        foreign_keys=[
            ("price_bar", "ticker", "company", "ticker"),
            ("fundamental_fact", "ticker", "company", "ticker"),
            ("news_item", "ticker", "company", "ticker"),
            ("run", "ticker", "company", "ticker"),
            ("agent_message", "run_id", "run", "id"),
            ("verdict", "run_id", "run", "id"),
            ("agent_message", "run_id", "verdict", "run_id"),
        ],
        not_null={
            "company": ["name"],
            "price_bar": ["ticker", "trade_date", "known_from", "known_until"],
            "fundamental_fact": ["ticker", "metric", "period_start", "period_end", "known_from", "known_until"],
            "news_item": ["ticker", "headline", "published_at"],
            "agent_message": ["agent_name", "model", "attempt", "prompt_tokens", "payload", "success"],
            "verdict": ["recommendation", "reasoning", "strongest_counterpoint", "confidence"],
        },
        allowed={
            ("run", "mode"): MODES, ("run", "status"): STATUSES,
            ("verdict", "recommendation"): RECOMMENDATIONS, ("verdict", "confidence"): CONFIDENCES,
            ("agent_message", "agent_name"): ("user", "assistant"),
        },
    )


def violations_while_writing(spark: SparkSession, d: str) -> DataFrame:
    """The rules a row decides on its own, counted by the tasks that write the tables.

    Besides declared constraints: no bar read for a request is dated after it, and
    no belief ends before it begins, of bars with planted faults.
    """
    requests = derived.requests(spark, d)
    written = {
        "price_bar": (_broken_bars(spark, d), {**quality.row_rules(["ticker", "trade_date", "known_from"]), **quality.version_rules()}),
        "price_history": (price_history(spark, d), quality.bound_rules("trade_date")),
        "news_top_k": (news.news_top_k(requests, derived.news_item(spark, d)), quality.bound_rules("published")),
        "run": (derived.run(spark, d), quality.row_rules(allowed={"mode": MODES, "status": STATUSES})),
        "agent_message": (derived.agent_message(spark, d), quality.row_rules(
            ["agent_name", "prompt_tokens", "payload"], {"agent_name": ("user", "assistant")},
        )),
        "verdict": (derived.verdict(spark, d), quality.row_rules(
            ["reasoning"], {"recommendation": RECOMMENDATIONS, "confidence": CONFIDENCES},
        )),
    }
    found = [
        (table, rule, n)
        for table, (df, rules) in written.items()
        for rule, n in tables.write_observed(df, rules, lambda rows, t=table: rows.write.parquet(new_folder(spark, t))).items()
    ]
    return spark.createDataFrame(found, "table_name string, rule string, violations long")


def coverage_gaps(spark: SparkSession, d: str) -> DataFrame:
    """With a gate of 300 rows, so that the generated data has gaps to report."""
    return quality.coverage_gaps(derived.requests(spark, d), derived.price_bar(spark, d, []), min_rows=300)


def stored_rows(spark: SparkSession, d: str) -> DataFrame:
    return quality.stored_rows(derived.requests(spark, d), derived.price_bar(spark, d, []))


def _status_events(spark: SparkSession, d: str) -> DataFrame:
    """A run reports its end after its last turn if that is an answer."""
    last = derived.source(spark, d, "conversations").groupBy("conv_id").agg(
        F.max(F.struct("turn", "role")).alias("end")
    )
    return last.where("end.role = 'assistant'").select(
        F.col("conv_id").cast("string").alias("run_id"),
        F.when(F.col("conv_id") % 11 == 10, "failed").otherwise("completed").alias("status"),
        F.timestamp_seconds(F.lit(1_700_000_000) + F.col("conv_id") * 60_000 + F.col("end.turn") * 60).alias("at"),
    )


def run_status(spark: SparkSession, d: str) -> DataFrame:
    started = derived.run(spark, d).withColumns({
        "status": F.lit("running"), "completed_at": F.lit(None).cast("timestamp"),
    })
    return maintenance.latest_status(started, _status_events(spark, d))


def orphan_runs(spark: SparkSession, d: str) -> DataFrame:
    return quality.unfinished_runs(run_status(spark, d), derived.verdict(spark, d))


# -- evaluation -------------------------------------------------------------------

def _experiments(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return derived.run(spark, d), derived.verdict(spark, d), derived.agent_message(spark, d)


def run_metrics(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.run_metrics(*_experiments(spark, d))


def compare_runs(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.in_report_order(evaluate.compare_runs(*_experiments(spark, d)))


def comparison_report(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.comparison_report(evaluate.compare_runs(*_experiments(spark, d)))


def comparison_summary(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.comparison_summary(run_metrics(spark, d))


def confidence_shift(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.confidence_shift(run_metrics(spark, d))


def verdict_distribution(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.verdict_distribution(derived.run(spark, d), derived.verdict(spark, d))


def attempt_counts(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.attempt_counts(derived.agent_message(spark, d))


def agent_messages(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.messages_of(derived.agent_message(spark, d), "assistant")


def confident_verdicts(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.verdicts_with(derived.verdict(spark, d), "high")


def experiment_grid(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.experiment_grid(derived.requests(spark, d))


def purge_runs(spark: SparkSession, d: str) -> DataFrame:
    """The rows left of each table, as text, after the failed runs are deleted with their children."""
    run, verdict, message = _experiments(spark, d)
    doomed = run.where("status = 'failed'").select("id")
    left = maintenance.purge_runs(run, verdict, message, doomed)
    return reduce(DataFrame.unionByName, [
        plain(df).select(F.lit(name).alias("table_name"), _content(plain(df)).alias("content"))
        for df, name in zip(left, ("run", "verdict", "agent_message"))
    ])


# -- panel and text -----------------------------------------------------------------

def _panel(spark: SparkSession, d: str) -> DataFrame:
    requests = derived.requests(spark, d)
    return panel.research_panel(
        requests, _bars_for(spark, d, requests, INDICATOR_LOOKBACK_DAYS), derived.news_item(spark, d)
    )


def research_panel(spark: SparkSession, d: str) -> DataFrame:
    headlines = F.array_join(F.transform("news", lambda n: F.concat(n["published"].cast("string"), F.lit(" "), n["headline"])), " | ")
    return _panel(spark, d).withColumns({"n_news": F.size("news"), "headlines": headlines}).drop("news")


def baseline_prompts(spark: SparkSession, d: str) -> DataFrame:
    return panel.baseline_prompts(_panel(spark, d))


def analyst_inputs(spark: SparkSession, d: str) -> DataFrame:
    return panel.analyst_inputs(_panel(spark, d))


def _arguments(spark: SparkSession, d: str) -> DataFrame:
    """Turns as debate arguments: each line a claim, the last one also a rebuttal after the opening.

    A system turn instructs the speakers and is no argument of either side.
    """
    lines = F.split("text", "\n")
    stance = F.when(F.col("role") == "user", STANCES[0]).otherwise(STANCES[1])
    none = F.array().cast("array<string>")
    return derived.source(spark, d, "conversations").where("role <> 'system'").select(
        F.col("conv_id").cast("string").alias("run_id"),
        (F.floor(F.col("turn") / 2) + 1).cast("int").alias("round"),
        stance.alias("stance"),
        lines.alias("claims"),
        F.when(F.col("turn") > 0, F.array(F.element_at(lines, -1))).otherwise(none).alias("rebuttal_to"),
    )


def debate_lines(spark: SparkSession, d: str) -> DataFrame:
    return panel.debate_lines(_arguments(spark, d))


def debate_transcripts(spark: SparkSession, d: str) -> DataFrame:
    return panel.debate_transcripts(_arguments(spark, d))


def _reports(spark: SparkSession, d: str) -> DataFrame:
    """The opening turn of most conversations as an analyst report, written as JSON and read back."""
    size, lines = F.length("text").cast("double"), F.split("text", "\n")
    number = F.col("conv_id").cast("double")
    written = derived.source(spark, d, "conversations").where("turn = 0").select(
        F.col("conv_id").cast("string").alias("run_id"),
        F.to_json(F.struct(
            F.create_map(F.lit("last_close"), size / 4, F.lit("pct_change_1d"), -number / 8).alias("price_snapshot"),
            F.create_map(F.lit("rsi_14"), number + 0.25).alias("indicators"),
            F.transform(lines, lambda line: F.struct(line.alias("headline"))).alias("news"),
            lines.alias("key_points"),
        )).alias("payload"),
    )
    cut = F.expr("substring(payload, 1, length(payload) - 1)")
    # Every ninth run's report is broken off, every tenth's is missing.
    written = written.where(F.col("run_id").cast("long") % 10 != 9).withColumn(
        "payload", F.when(F.col("run_id").cast("long") % 9 == 8, cut).otherwise(F.col("payload"))
    )
    return responses.parse_reports(written)


def debater_inputs(spark: SparkSession, d: str) -> DataFrame:
    return panel.debater_inputs(_reports(spark, d), _arguments(spark, d))


def judge_inputs(spark: SparkSession, d: str) -> DataFrame:
    return panel.judge_inputs(_reports(spark, d), _arguments(spark, d))


def _verdict_payloads(spark: SparkSession, d: str) -> DataFrame:
    """Turns as verdict payloads; some break the schema, the enums or the JSON itself."""
    kind = (F.col("conv_id") + F.col("turn")) % 6
    payload = F.to_json(F.struct(
        F.when(kind == 1, "strong buy").when(kind != 5, "buy").alias("recommendation"),
        F.when(kind != 5, F.col("text")).alias("reasoning"),
        F.when(kind != 5, F.col("role")).alias("strongest_counterpoint"),
        F.when(~kind.isin(2, 5), "high").alias("confidence"),
        F.when(kind == 5, "no reply").alias("error"),
    ))
    cut = F.expr("substring(_payload, 1, length(_payload) - 1)")
    return derived.source(spark, d, "conversations").withColumn("_payload", payload).select(
        F.concat_ws("-", "conv_id", "turn").alias("run_id"),
        F.when(kind == 3, cut).otherwise(F.col("_payload")).alias("payload"),
    )


def parse_verdicts(spark: SparkSession, d: str) -> DataFrame:
    return responses.parse_verdicts(_verdict_payloads(spark, d))


def verdicts_as_variant(spark: SparkSession, d: str) -> DataFrame:
    """Verdict payloads stored as VARIANT and read by field; some carry a field that no verdict has."""
    turn = F.substring_index("run_id", "-", -1)
    numbered = F.expr("concat(substring(payload, 1, length(payload) - 1), ',\"turn_no\":', substring_index(run_id, '-', -1), '}')")
    made = _verdict_payloads(spark, d).withColumn(
        "payload", F.when((turn.cast("long") % 4 == 1) & F.endswith("payload", F.lit("}")), numbered).otherwise(F.col("payload"))
    )
    path = new_folder(spark, "message_variant")
    responses.payloads_as_variant(made).write.parquet(path)
    return responses.verdicts_of_variants(spark.read.schema("run_id string, payload variant").parquet(path))


def parse_arguments(spark: SparkSession, d: str) -> DataFrame:
    """Arguments written as JSON and read back; some are broken off, of no side, or without claims."""
    kind = F.pmod(F.col("run_id").cast("long") + F.col("round"), F.lit(7))
    made = _arguments(spark, d).withColumns({
        "stance": F.when(kind == 1, "neutral").otherwise(F.col("stance")),
        "claims": F.when(kind != 2, F.col("claims")),
    })
    payload = F.to_json(F.struct("stance", "round", "claims", "rebuttal_to"))
    written = made.select("run_id", F.when(kind == 3, F.substring(payload, 1, 20)).otherwise(payload).alias("payload"))
    parsed = responses.parse_arguments(written)
    return parsed.select(
        "run_id", "stance", "round", "problem",
        F.size("claims").alias("n_claims"), F.array_join("claims", "\n").alias("claims"),
        F.size("rebuttal_to").alias("n_rebuttals"),
    )


def final_attempts(spark: SparkSession, d: str) -> DataFrame:
    return responses.final_attempts(derived.agent_message(spark, d))


def normalise_messages(spark: SparkSession, d: str) -> DataFrame:
    """Turns as call log rows with structured payloads."""
    calls = derived.source(spark, d, "conversations").select(
        "conv_id",
        F.col("role").alias("agent"), F.lit("derived").alias("model"), F.lit(1).alias("attempt"),
        F.length("text").alias("prompt_tokens"), F.lit(None).cast("int").alias("completion_tokens"),
        (F.length("text") / 7.0).alias("latency_s"),
        F.struct(F.col("turn").alias("turn"), F.col("text").alias("text")).alias("payload"),
        F.concat(F.lit("2024-03-15T09:00:0"), (F.col("turn") % 10).cast("string"), F.lit("+00:00")).alias("timestamp"),
        F.lit(True).alias("success"),
    )
    rows = responses.normalise_messages(calls, F.col("conv_id").cast("string"))
    return rows.withColumn("text", F.get_json_object("payload", "$.text")).drop("payload")


# -- alternate indicators --------------------------------------------------------------

def rsi_first_seed(spark: SparkSession, d: str) -> DataFrame:
    requests = derived.requests(spark, d)
    result = indicators(requests, _bars_for(spark, d, requests, INDICATOR_LOOKBACK_DAYS), seed="first")
    return result.select("ticker", "as_of", "rsi_14")


def macd_short(spark: SparkSession, d: str) -> DataFrame:
    """Two decimals, more than 26 bars."""
    requests = derived.requests(spark, d)
    result = indicators(
        requests, _bars_for(spark, d, requests, INDICATOR_LOOKBACK_DAYS),
        seed="first", digits=2, min_bars_macd=MACD_SLOW + 1,
    )
    return result.select("ticker", "as_of", "macd", "macd_signal", "macd_histogram")


NAMED: dict[str, Query] = {
    "indicators_panel": indicators_panel,
    "indicators_mapped": indicators_mapped,
    "trailing_closes": trailing_closes,
    "indicators_early": indicators_early,
    "price_history": price_history,
    "stored_price_history": stored_price_history,
    "stored_facts_as_of": stored_facts_as_of,
    "price_snapshot": price_snapshots,
    "daily_changes": daily_changes,
    "prices_known_on": prices_known_on,
    "facts_as_of": facts_as_of,
    "facts_of_metric": facts_of_metric,
    "facts_exact_period": facts_exact_period,
    "facts_naive_latest": facts_naive_latest,
    "news_top_k": news_top_k,
    "news_visible": news_visible,
    "build_versions": price_versions,
    "build_fact_versions": fact_versions,
    "late_price_delta": late_price_delta,
    "late_price_versions": late_price_versions,
    "open_versions": open_versions,
    "apply_batch_prices": apply_batch_prices,
    "apply_batch_facts": apply_batch_facts,
    "batch_action_counts": batch_action_counts,
    "version_invariants": version_invariants,
    "reseed_facts": reseed_facts,
    "ingest_prices_clean": ingest_prices_clean,
    "ingest_facts_unpivot": ingest_facts_unpivot,
    "ingest_facts_clean": ingest_facts_clean,
    "ingest_news_dedup": ingest_news_dedup,
    "landed_news": landed_news,
    "news_undated": news_undated,
    "truncate_sentences": truncate_sentences,
    "company_upsert": company_upsert,
    "ingest_all_counts": ingest_all_counts,
    "ingest_all_rows": ingest_all_rows,
    "lookahead_leaks": lookahead_leaks,
    "leak_summary": leak_summary,
    "asof_bound_check": asof_bound_check,
    "constraint_violations": constraint_violations,
    "violations_while_writing": violations_while_writing,
    "coverage_gaps": coverage_gaps,
    "stored_rows": stored_rows,
    "run_status": run_status,
    "orphan_runs": orphan_runs,
    "run_metrics": run_metrics,
    "compare_runs": compare_runs,
    "comparison_report": comparison_report,
    "comparison_summary": comparison_summary,
    "confidence_shift": confidence_shift,
    "verdict_distribution": verdict_distribution,
    "attempt_counts": attempt_counts,
    "agent_messages": agent_messages,
    "confident_verdicts": confident_verdicts,
    "experiment_grid": experiment_grid,
    "purge_runs": purge_runs,
    "research_panel": research_panel,
    "baseline_prompts": baseline_prompts,
    "analyst_inputs": analyst_inputs,
    "debate_lines": debate_lines,
    "debate_transcripts": debate_transcripts,
    "debater_inputs": debater_inputs,
    "judge_inputs": judge_inputs,
    "parse_verdicts": parse_verdicts,
    "verdicts_as_variant": verdicts_as_variant,
    "parse_arguments": parse_arguments,
    "final_attempts": final_attempts,
    "normalise_messages": normalise_messages,
    "rsi_first_seed": rsi_first_seed,
    "macd_short": macd_short,
}


def named_queries() -> dict[str, Query]:
    def flat(query: Query) -> Query:
        return lambda spark, sf_dir: plain(query(spark, sf_dir))

    return {name: flat(query) for name, query in NAMED.items()}
