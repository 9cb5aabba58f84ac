"""From landing feeds to the next state of the engine's tables."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from backdate.functions.text import first_filled
from backdate.operators.news import ingest_news
from backdate.operators.versions import apply_batch, next_state, upsert
from backdate.schemas import (
    FACT_CURRENCY,
    FACT_KEYS,
    FACT_LAG_DAYS,
    FACT_PERIOD_DAYS,
    FACT_SOURCE,
    FACT_VALUE,
    INGEST_LOOKBACK_DAYS,
    METRIC_OF_LINE_ITEM,
    NEWS_CAP,
    PRICE,
    PRICE_KEYS,
)
from backdate.session import cut_lineage
from backdate.sources.landing import in_ingest_window


def clean_companies(feed: DataFrame) -> DataFrame:
    """Name falls back from long to short name to the ticker."""
    name = first_filled(F.col("longName"), F.col("shortName"), F.col("ticker"))
    return feed.select("ticker", name.alias("name"), "sector", "exchange")


def clean_prices(
    feed: DataFrame, as_of: dt.date | str | DataFrame, lookback_days: int = INGEST_LOOKBACK_DAYS
) -> DataFrame:
    """Feed rows in the ingest window, in stored types; the feed's close is already adjusted."""
    return in_ingest_window(feed, as_of, lookback_days).select(
        "ticker", "trade_date",
        *[F.col(c).cast(PRICE).alias(c) for c in ("open", "high", "low", "close")],
        F.col("volume").cast("long").alias("volume"),
        F.col("close").cast(PRICE).alias("adj_close"),
    )


def _figures(rows: DataFrame, value_col: str) -> DataFrame:
    """Rows whose value is a number, as a double; text is read as one."""
    number = F.col(value_col)
    number = number.try_cast("double") if rows.schema[value_col].dataType.simpleString() == "string" else number.cast("double")
    return rows.withColumn(value_col, number).where(number.isNotNull() & ~F.isnan(number))


def unpivot_figures(
    wide: DataFrame, ids: Sequence[str], value_cols: Sequence[str], name_col: str, value_col: str = "value"
) -> DataFrame:
    """Wide to long; cells that are empty, NaN or no number are dropped."""
    texts = {f.name for f in wide.schema if f.dataType.simpleString() == "string"}
    numbers = wide.select(*ids, *[
        F.col(f"`{c}`").try_cast("double").alias(c) if c in texts else F.col(f"`{c}`").cast("double").alias(c) for c in value_cols
    ])
    return _figures(numbers.unpivot(list(ids), [f"`{c}`" for c in value_cols], name_col, value_col), value_col)


def clean_fact_rows(feed: DataFrame) -> DataFrame:
    """A long feed ``ticker, line_item, period_end, figure`` as facts: whitelisted metrics, approximate period start, stored types."""
    metric = F.create_map(*[F.lit(x) for pair in METRIC_OF_LINE_ITEM.items() for x in pair])
    period_end = F.col("period_end").try_cast("date")
    return _figures(feed.select("ticker", "line_item", period_end.alias("period_end"), "figure"), "figure").select(
        "ticker",
        F.try_element_at(metric, F.col("line_item")).alias("metric"),
        F.date_sub("period_end", FACT_PERIOD_DAYS).alias("period_start"),
        "period_end",
        F.col("figure").cast(FACT_VALUE).alias("value"),
        F.lit(FACT_CURRENCY).alias("currency"),
        F.lit(FACT_SOURCE).alias("source"),
    ).where(F.col("metric").isNotNull() & F.col("period_end").isNotNull())


def _is_date(name: str) -> bool:
    try:
        dt.date.fromisoformat(name[:10])
    except ValueError:
        return False
    return True


def undated_columns(wide: DataFrame) -> list[str]:
    """Columns of a wide feed whose name is no date; :func:`clean_facts` sets them aside."""
    return [c for c in wide.columns if c not in ("ticker", "line_item") and not _is_date(c)]


def clean_facts(wide: DataFrame) -> DataFrame:
    """A wide feed as facts: ``ticker, line_item`` and one column per period end, named by its date."""
    periods = [c for c in wide.columns if c not in ("ticker", "line_item") and _is_date(c)]
    if not periods:
        ids = wide.select("ticker", "line_item", F.lit(None).cast("string").alias("period_end"), F.lit(None).cast("double").alias("figure"))
        return clean_fact_rows(ids.limit(0))
    return clean_fact_rows(unpivot_figures(wide, ["ticker", "line_item"], periods, "period_end", "figure"))


def apply_prices(
    current: DataFrame, batch: DataFrame, ingestion_date: dt.date | str | Column,
    order_cols: Sequence[str] = (), small_batch: bool = True,
) -> DataFrame:
    """Only a changed adjusted close makes a version; a first bar is known on its own day."""
    return apply_batch(
        current, batch, PRICE_KEYS, ["adj_close"], ingestion_date, F.col("trade_date"), order_cols, small_batch
    )


def apply_facts(
    current: DataFrame, batch: DataFrame, ingestion_date: dt.date | str | Column,
    order_cols: Sequence[str] = (), small_batch: bool = True,
) -> DataFrame:
    """A changed value is a restatement; a first figure is known 45 days after its period."""
    return apply_batch(
        current, batch, FACT_KEYS, ["value"], ingestion_date,
        F.date_add("period_end", FACT_LAG_DAYS), order_cols, small_batch,
    )


def replay_batches(
    current: DataFrame,
    batches: Sequence[tuple[dt.date | str, DataFrame]],
    apply: Callable[..., DataFrame],
    cut_every: int = 8,
    **options,
) -> DataFrame:
    """The state after several batches in ingestion order, e.g. a backfill of daily files.

    ``apply`` is :func:`apply_prices` or :func:`apply_facts` and gets the
    ``options``, such as ``small_batch=False`` for a backfill. Each batch builds
    on the state before it, so the lineage is cut to the shared checkpoint
    folder every few batches.
    """
    state = current
    for done, (day, batch) in enumerate(sorted(batches, key=lambda b: str(b[0])), start=1):
        state = next_state(apply(state, batch, day, **options))
        if done % cut_every == 0:
            state = cut_lineage(state)
    return state


def ingest_batch(
    landing: Mapping[str, DataFrame],
    state: Mapping[str, DataFrame],
    as_of: dt.date | str | DataFrame,
    ingestion_date: dt.date | str,
    max_news: int = NEWS_CAP,
    small_batch: bool = True,
    ingested_at: dt.datetime | str | None = None,
) -> dict[str, DataFrame]:
    """One ingest: companies, prices, news, facts.

    ``as_of`` is one date for all tickers, or a table of requests ``(ticker,
    as_of)`` such as :func:`~backdate.operators.quality.coverage_gaps` gives, and
    then only their tickers and windows are taken in. ``landing`` holds the feeds
    ``company, prices, news, quarterly`` (wide or long); feeds that are absent
    leave their table as it is. Versioned tables come back with an ``action`` per
    row, ``news_item`` as the rows to append.
    """

    def asked(feed: DataFrame) -> DataFrame:
        if not isinstance(as_of, DataFrame):
            return feed
        return feed.join(as_of.select("ticker").distinct(), "ticker", "left_semi")

    result: dict[str, DataFrame] = {}
    if "company" in landing:
        result["company"] = upsert(state["company"], clean_companies(asked(landing["company"])), ["ticker"])
    if "prices" in landing:
        batch = clean_prices(landing["prices"], as_of)
        result["price_bar"] = apply_prices(state["price_bar"], batch, ingestion_date, small_batch=small_batch)
    if "news" in landing:
        fresh = ingest_news(state["news_item"], landing["news"], as_of, max_news, ingested_at)
        result["news_item"] = fresh.drop("feed_pos")
    if "quarterly" in landing:
        feed = asked(landing["quarterly"])
        batch = clean_fact_rows(feed) if "period_end" in feed.columns else clean_facts(feed)
        result["fundamental_fact"] = apply_facts(state["fundamental_fact"], batch, ingestion_date, small_batch=small_batch)
    return result
