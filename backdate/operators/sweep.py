"""Bars and requests of a time range in one pass: for requests about as dense as the bars, say one per ticker and day.

A version of a bar is seen by the requests of a span of days: from when it is known
and over, until it is superseded or leaves the look-back. So a request meets a bar
where its day lies in the bar's span. Days are cut into ranges as long as the
look-back; a span, which is no longer than that, lies in one range or is handed on to
the next, while every request lies in one. Bars and requests are put into one table,
shuffled once by (ticker, range) and swept there: the days asked in a range, at most
as many as it has, stand beside every version, which picks those in its span.

No request is repeated, no join is planned, and a hot ticker is spread over its
ranges. Where requests are few, :func:`pointintime.price_history` ships less.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from backdate.functions.dates import day_bucket
from backdate.schemas import HISTORY_LOOKBACK_DAYS

RANGE = ["ticker", "_range"]


def visible_spans(bars: DataFrame, lookback_days: int) -> DataFrame:
    """``_from`` and ``_to``: the first and last day on which a request sees the version; versions never seen are left out."""
    first = F.greatest("known_from", "trade_date")
    last = F.least(F.date_sub("known_until", 1), F.date_add("trade_date", lookback_days - 1))
    sound = F.col("trade_date").isNotNull() & F.col("known_from").isNotNull() & F.col("known_until").isNotNull()
    return bars.where(sound).select("*", first.alias("_from"), last.alias("_to")).where(F.col("_from") <= F.col("_to"))


def swept(requests: DataFrame, bars: DataFrame, lookback_days: int, columns: Sequence[str]) -> DataFrame:
    """``ticker, _range, as_of, bar``: every version each request sees, and a row without a bar for each request.

    ``bar`` is a struct of trade_date and ``columns``. Repeated requests have their
    marker row each; the rows with a bar come once. Partitioned by (ticker, _range),
    so groupings that hold both columns need no further shuffle.
    """
    spans = visible_spans(bars, lookback_days)
    held = spans.select(
        "ticker",
        F.explode(F.sequence(day_bucket(F.col("_from"), lookback_days), day_bucket(F.col("_to"), lookback_days))).alias("_range"),
        F.lit(None).cast("date").alias("as_of"), "_from", "_to", F.struct("trade_date", *columns).alias("bar"),
    )
    none = {f.name: F.lit(None).cast(f.dataType).alias(f.name) for f in held.schema}
    asked = requests.where(F.col("as_of").isNotNull()).select(
        "ticker", day_bucket(F.col("as_of"), lookback_days).alias("_range"), "as_of", *[none[c] for c in ("_from", "_to", "bar")]
    )
    in_range = Window.partitionBy(*RANGE)
    met = held.unionByName(asked).withColumn("_days", F.collect_set("as_of").over(in_range))
    own: Column = F.when(F.col("bar").isNull(), F.array("as_of")).otherwise(
        F.filter("_days", lambda d: (d >= F.col("_from")) & (d <= F.col("_to")))
    )
    return met.select(*RANGE, F.explode(own).alias("as_of"), "bar")


def price_history(requests: DataFrame, bars: DataFrame, lookback_days: int = HISTORY_LOOKBACK_DAYS) -> DataFrame:
    """The rows of :func:`pointintime.price_history`."""
    measures = ["open", "high", "low", "close", "volume"]
    seen = swept(requests, bars, lookback_days, measures).where(F.col("bar").isNotNull())
    return seen.select(
        "ticker", "as_of", "bar.trade_date", *[F.col(f"bar.{m}").cast("double").alias(m) for m in measures]
    )


def trailing(requests: DataFrame, bars: DataFrame, lookback_days: int, price_col: str = "close") -> DataFrame:
    """Number, lowest, highest and mean price of the bars each request sees; one row per request, also without bars."""
    price = F.col(f"bar.`{price_col}`")
    return (
        swept(requests, bars, lookback_days, [price_col])
        .groupBy(*RANGE, "as_of")
        .agg(
            F.count("bar").alias("n_bars"),
            F.min(price).cast("double").alias("lowest"),
            F.max(price).cast("double").alias("highest"),
            (F.sum(price).cast("double") / F.count(price)).alias("mean"),
        )
        .drop("_range")
    )
