"""Reading versioned tables as they were believed on each request's date.

Scale: requests are small next to the tables. Spark broadcasts them while they
are under ``spark.sql.autoBroadcastJoinThreshold``; beyond it both sides are
shuffled, on a key that also splits one hot ticker: calendar buckets for bars,
a salt from the rest of the key for facts.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from backdate.functions.dates import as_date, day_bucket
from backdate.operators.versions import latest_version
from backdate.schemas import FACT_KEYS, HISTORY_LOOKBACK_DAYS


def believed_on(day: Column, known_from: str = "known_from", known_until: str = "known_until") -> Column:
    """The point-in-time predicate; a version is gone on its ``known_until``."""
    return (F.col(known_from) <= day) & (F.col(known_until) > day)


def known_as_of(df: DataFrame, day: dt.date | str | Column) -> DataFrame:
    """The table as believed on one date."""
    return df.where(believed_on(as_date(day)))


def distinct_requests(requests: DataFrame) -> DataFrame:
    return requests.select("ticker", "as_of").distinct()


def within_envelope(
    df: DataFrame, requests: DataFrame, date_col: str, lookback_days: int | None, versioned: bool = False
) -> DataFrame:
    """Keep only dates some request can see, as bounds that reach the file scan.

    With ``versioned`` also only versions some request could have known.

    The bounds are scalar subqueries over the requests: no action here, and
    the scan skips row groups once they are known. The lower bound keeps a
    filter of its own, because Spark pushes two such bounds down only while it
    does not merge their subqueries into one.
    """
    newest = requests.agg(F.max("as_of")).scalar()
    df = df.where(F.col(date_col) <= newest)
    if versioned:
        df = df.where(F.col("known_from") <= newest)
    if lookback_days is not None:
        first = requests.agg(F.min("as_of").alias("first")).where(F.col("first").isNotNull())
        df = df.where(F.col(date_col) > first.select(F.date_sub("first", lookback_days)).scalar())
    return df


def buckets_asked(requests: DataFrame, lookback_days: int, width: int) -> DataFrame:
    oldest = F.date_sub("as_of", lookback_days - 1)
    return distinct_requests(requests).select(
        "ticker", "as_of",
        F.explode(F.sequence(day_bucket(oldest, width), day_bucket(F.col("as_of"), width))).alias("_bucket"),
    )


def _bars_offered(requests: DataFrame, bars: DataFrame, lookback_days: int, columns: Sequence[str], width: int) -> DataFrame:
    return within_envelope(bars, requests, "trade_date", lookback_days, versioned=True).select(
        "ticker", "trade_date", *columns, "known_from", "known_until",
        day_bucket(F.col("trade_date"), width).alias("_bucket"),
    )


def bars_in_view(requests: DataFrame, bars: DataFrame, lookback_days: int, columns: Sequence[str]) -> DataFrame:
    """Every bar each request can see: ``(as_of - lookback, as_of]``, as then believed.

    Joined on ticker and calendar bucket. A request covers at most five buckets
    and a bar lies in one, so candidates stay close to the result and one hot
    ticker is spread over its buckets.
    """
    width = max(1, lookback_days // 4)
    offered = _bars_offered(requests, bars, lookback_days, columns, width)
    return (
        offered.join(buckets_asked(requests, lookback_days, width), ["ticker", "_bucket"])
        .where(
            (F.col("trade_date") >= F.date_sub("as_of", lookback_days - 1))
            & (F.col("trade_date") <= F.col("as_of"))
            & believed_on(F.col("as_of"))
        )
        .select("ticker", "as_of", "trade_date", *columns)
    )


def held_bars(requests: DataFrame, bars: DataFrame, lookback_days: int, price: Column) -> DataFrame:
    """``_held``, the versions of a ticker and calendar bucket as one array, made once however many requests read it.

    Only buckets that some request asks for are shuffled and made.
    """
    width = max(1, lookback_days // 4)
    names = sorted(c for c in bars.columns if c not in ("ticker", "trade_date", "known_from", "known_until"))
    wanted = buckets_asked(requests, lookback_days, width).select("ticker", "_bucket").distinct()
    offered = _bars_offered(requests, bars, lookback_days, names, width).join(wanted, ["ticker", "_bucket"], "left_semi")
    return offered.groupBy("ticker", "_bucket").agg(
        F.collect_list(F.struct("trade_date", price.alias("price"), "known_from", "known_until")).alias("_held")
    )


def bar_arrays(requests: DataFrame, bars: DataFrame, lookback_days: int, price: Column) -> DataFrame:
    """Per request the array ``bars`` of (trade_date, price) in date order; empty if none.

    The versions of a ticker and bucket become one array, made once however many
    requests read it, so a request meets at most five rows and picks its bars
    inside them. The requests join the last grouping as rows without a bar, so
    those that see nothing keep their row without a second join.
    """
    width = max(1, lookback_days // 4)
    held = held_bars(requests, bars, lookback_days, price)
    day = F.col("as_of")
    seen = F.filter("_held", lambda v: (
        (v["trade_date"] >= F.date_sub(day, lookback_days - 1)) & (v["trade_date"] <= day)
        & (v["known_from"] <= day) & (v["known_until"] > day)
    ))
    picked = F.transform(seen, lambda v: F.struct(v["trade_date"].alias("trade_date"), v["price"].alias("price")))
    met = held.join(buckets_asked(requests, lookback_days, width), ["ticker", "_bucket"]).select(
        "ticker", "as_of", picked.alias("_bars")
    )
    none = F.array().cast("array<struct<trade_date: date, price: double>>")
    marker = distinct_requests(requests).select("ticker", "as_of", none.alias("_bars"))
    return met.union(marker).groupBy("ticker", "as_of").agg(
        F.array_sort(F.flatten(F.collect_list("_bars"))).alias("bars")
    )


def price_history(
    requests: DataFrame, bars: DataFrame, lookback_days: int = HISTORY_LOOKBACK_DAYS
) -> DataFrame:
    """Daily bars per request, as doubles."""
    measures = ["open", "high", "low", "close", "volume"]
    seen = bars_in_view(requests, bars, lookback_days, measures)
    return seen.select("ticker", "as_of", "trade_date", *[F.col(m).cast("double").alias(m) for m in measures])


def daily_changes(
    requests: DataFrame, bars: DataFrame, lookback_days: int = HISTORY_LOOKBACK_DAYS, price_col: str = "close"
) -> DataFrame:
    """Row number and change to the previous bar for each bar of a request's window."""
    seen = bars_in_view(requests, bars, lookback_days, [price_col])
    in_order = Window.partitionBy("ticker", "as_of").orderBy("trade_date")
    price = F.col(price_col).cast("double")
    return seen.select(
        "ticker", "as_of", "trade_date",
        F.row_number().over(in_order).alias("rn"),
        price.alias(price_col),
        (price - F.lag(price).over(in_order)).alias("change"),
    )


def facts_as_of(
    facts: DataFrame,
    requests: DataFrame,
    metrics: Sequence[str] | None = None,
    period_end: dt.date | str | Column | None = None,
    salts: int = 16,
) -> DataFrame:
    """All facts a request's date had been told: period over, version believed then.

    ``metrics`` and ``period_end`` narrow the read to some metrics or one exact
    period. A ticker's facts are split by a salt taken from metric and period,
    and the (narrow) requests are repeated once per salt.
    """
    offered = facts
    if metrics is not None:
        offered = offered.where(F.col("metric").isin(*metrics))
    if period_end is not None:
        offered = offered.where(F.col("period_end") == as_date(period_end))
    offered = within_envelope(offered, requests, "period_end", None, versioned=True).withColumn(
        "_salt", F.pmod(F.xxhash64("metric", "period_end"), F.lit(salts)).cast("int")
    )
    wanted = distinct_requests(requests).withColumn(
        "_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))
    )
    return (
        offered.join(wanted, ["ticker", "_salt"])
        .where((F.col("period_end") <= F.col("as_of")) & believed_on(F.col("as_of")))
        .select("ticker", "as_of", *[c for c in facts.columns if c != "ticker"])
    )


def facts_latest(facts: DataFrame, keys: Sequence[str] = FACT_KEYS) -> DataFrame:
    """The contrast: newest value per key without regard to when it became known."""
    return latest_version(facts, keys)
