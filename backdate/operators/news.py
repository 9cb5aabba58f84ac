"""News: newest-first top-k per request, and insert-if-absent ingest."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from backdate.functions.dates import as_date, day_bucket, open_end, published_date
from backdate.functions.text import first_filled, first_sentences
from backdate.operators.pointintime import distinct_requests, within_envelope
from backdate.schemas import (
    NEWS_CAP,
    NEWS_KEYS,
    NEWS_SOURCE_WHEN_ABSENT,
    NEWS_SOURCE_WHEN_EMPTY,
    SUMMARY_SENTENCES,
)

# Newest first; ties by text so that the answer does not depend on file order.
_TIE_BREAK = ["headline", "source", "url", "summary"]


def visible_news(news: DataFrame, day: dt.date | str | Column) -> DataFrame:
    return news.where(F.col("published_at") <= as_date(day))


def in_top_k_until(news: DataFrame, k: int) -> DataFrame:
    """Add ``leaves_on``: the day ``k`` newer items have pushed this one out of the top k.

    An item is among the newest k on every day of ``[published_at, leaves_on)``.
    First each day of a ticker is cut to its own top k, which the planner also
    does before the shuffle, so a hot ticker arrives as at most k rows per day
    and task; the second window then sees at most k rows per calendar day.
    """
    within_day = Window.partitionBy("ticker", "published_at").orderBy(*_TIE_BREAK)
    oldest_first = Window.partitionBy("ticker").orderBy(
        "published_at", *[F.desc_nulls_last(c) for c in _TIE_BREAK]
    )
    per_day = news.withColumn("_rn", F.row_number().over(within_day)).where(F.col("_rn") <= k)
    return per_day.drop("_rn").withColumn(
        "leaves_on", F.coalesce(F.lead("published_at", k).over(oldest_first), open_end())
    )


def _of_asked_tickers(news: DataFrame, requests: DataFrame, salts: int) -> DataFrame:
    """The news of tickers that have a request; a hot one is split by day where the requests are too many to broadcast."""
    wanted = requests.select("ticker").distinct().withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    salt = F.pmod(F.unix_date("published_at"), F.lit(salts))
    return news.withColumn("_salt", salt).join(wanted, ["ticker", "_salt"], "left_semi").drop("_salt")


def news_top_k(
    requests: DataFrame, news: DataFrame, k: int = NEWS_CAP, bucket_days: int = 32, salts: int = 16
) -> DataFrame:
    """The ``k`` newest items published by each request's date, ``position`` 1 = newest.

    Only items of asked tickers are ranked.

    An item is offered in the calendar buckets in which it belongs to the top k
    and dates are asked for, and joined there on ticker and bucket. Outside the
    bucket it is published in, an item is one of k, so a hot ticker is spread
    over its buckets at little more than one row per item.
    """
    columns = ["headline", "source", "published_at", "url", "summary"]
    offered = within_envelope(news.select("ticker", *columns), requests, "published_at", None)
    ranked = in_top_k_until(_of_asked_tickers(offered, requests, salts), k)
    oldest, newest = (requests.agg(f("as_of")).scalar() for f in (F.min, F.max))
    low = day_bucket(F.greatest(F.col("published_at"), oldest), bucket_days)
    high = day_bucket(F.least(F.date_sub("leaves_on", 1), newest), bucket_days)
    spread = ranked.where(F.col("leaves_on") > F.col("published_at")).select(
        "*", low.alias("_low"), high.alias("_high")
    ).where(F.col("_low") <= F.col("_high")).select(
        "ticker", *columns, "leaves_on", F.explode(F.sequence("_low", "_high")).alias("_bucket")
    )
    asked = distinct_requests(requests).withColumn("_bucket", day_bucket(F.col("as_of"), bucket_days))
    seen = spread.join(asked, ["ticker", "_bucket"]).where(
        (F.col("published_at") <= F.col("as_of")) & (F.col("leaves_on") > F.col("as_of"))
    )
    newest_first = Window.partitionBy("ticker", "as_of").orderBy(F.desc("published_at"), *_TIE_BREAK)
    return seen.select(
        "ticker", "as_of",
        F.row_number().over(newest_first).alias("position"),
        "headline",
        first_filled(F.col("source"), F.lit(NEWS_SOURCE_WHEN_EMPTY)).alias("source"),
        F.col("published_at").alias("published"),
        F.coalesce("summary", F.lit("")).alias("summary"),
    )


def clean_news(feed: DataFrame, max_sentences: int = SUMMARY_SENTENCES) -> DataFrame:
    """Nested feed entries as flat rows; ``published_at`` is NULL when it has no usable date."""
    part = F.col("content").getField
    return feed.select(
        "ticker", "feed_pos",
        F.coalesce(part("title"), F.lit("")).alias("headline"),
        F.coalesce(F.col("content.provider.displayName"), F.lit(NEWS_SOURCE_WHEN_ABSENT)).alias("source"),
        published_date(part("pubDate")).alias("published_at"),
        first_filled(F.col("content.canonicalUrl.url"), F.lit("")).alias("url"),
        first_sentences(
            first_filled(part("summary"), part("description"), F.lit("")), max_sentences
        ).alias("summary"),
    )


def undated_news(feed: DataFrame) -> DataFrame:
    """Quarantine: entries that carry a date text no date can be read from."""
    text = F.col("content.pubDate")
    return feed.where((text != "") & published_date(text).isNull())


def new_items(
    existing: DataFrame,
    cleaned: DataFrame,
    as_of: dt.date | str | Column | DataFrame,
    max_items: int = NEWS_CAP,
) -> DataFrame:
    """Cleaned entries to insert: published by ``as_of``, unseen, capped per ticker.

    ``as_of`` is one date, or a table of requests, of which each ticker's latest
    counts and tickers without one get nothing.

    The cap counts new items only, in feed order. Duplicates inside the feed
    are reduced to their first entry, with a map-side combine. The stored table
    is only probed with the feed's keys, so a feed that can be broadcast leaves
    it unshuffled.
    """
    if isinstance(as_of, DataFrame):
        last = as_of.groupBy("ticker").agg(F.max("as_of").alias("_last"))
        dated = cleaned.join(last, "ticker").where(F.col("published_at") <= F.col("_last")).drop("_last")
    else:
        dated = cleaned.where(F.col("published_at") <= as_date(as_of))
    values = [c for c in cleaned.columns if c not in NEWS_KEYS and c != "feed_pos"]
    first_seen = dated.groupBy(*NEWS_KEYS).agg(F.min(F.struct("feed_pos", *values)).alias("_first"))
    known = existing.select(*NEWS_KEYS).join(dated.select(*NEWS_KEYS).distinct(), NEWS_KEYS, "left_semi")
    unseen = first_seen.select(*NEWS_KEYS, "_first.*").join(known, NEWS_KEYS, "left_anti")
    feed_order = Window.partitionBy("ticker").orderBy("feed_pos", "headline", "published_at")
    capped = unseen.withColumn("_rn", F.row_number().over(feed_order)).where(F.col("_rn") <= max_items)
    return capped.select("ticker", "headline", "source", "published_at", "url", "summary", "feed_pos")


def ingest_news(
    existing: DataFrame, feed: DataFrame, as_of: dt.date | str | Column | DataFrame, max_items: int = NEWS_CAP,
    ingested_at: dt.datetime | str | None = None,
) -> DataFrame:
    """Rows to append to the news table after one feed, stamped with the caller's clock."""
    stamp = F.lit(None if ingested_at is None else str(ingested_at)).cast("timestamp")
    return new_items(existing, clean_news(feed), as_of, max_items).withColumn("ingested_at", stamp)
