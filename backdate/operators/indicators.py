"""RSI, MACD and percentage changes, one row per request.

All bars of a request meet in one array. It is bounded by the look-back: belief
windows do not overlap, so there is at most one bar per day.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from backdate.functions import maps, series
from backdate.functions.dates import open_end
from backdate.operators.pointintime import buckets_asked, bar_arrays, distinct_requests, held_bars
from backdate.schemas import (
    HISTORY_LOOKBACK_DAYS,
    INDICATOR_LOOKBACK_DAYS,
    MACD_FAST,
    MACD_SIGNAL,
    MACD_SLOW,
    PCT_CHANGE_BARS,
    RSI_PERIOD,
)


def close_arrays(
    requests: DataFrame, bars: DataFrame, lookback_days: int, price_col: str = "close"
) -> DataFrame:
    """Per request the array ``bars`` of (trade_date, price) in date order; empty if none."""
    own = bars.select("ticker", "trade_date", price_col, "known_from", "known_until")
    return bar_arrays(requests, own, lookback_days, F.col(price_col).cast("double"))


def prices_of(bars: str) -> Column:
    return F.expr(f"transform({bars}, bar -> bar.price)")


def indicator_columns(
    df: DataFrame,
    closes: str,
    seed: str = "mean",
    period: int = RSI_PERIOD,
    fast: int = MACD_FAST,
    slow: int = MACD_SLOW,
    signal: int = MACD_SIGNAL,
    min_bars_macd: int | None = None,
    digits: int = 4,
) -> DataFrame:
    """``rsi_14, macd, macd_signal, macd_histogram`` in place of the array column ``closes``."""
    if seed not in ("mean", "first"):
        raise ValueError(f"unknown seed {seed!r}")
    gate_rsi = F.size(closes) >= period + 1
    gate_macd = F.size(closes) >= (period + 1 if min_bars_macd is None else min_bars_macd)
    rsi = (series.rsi_mean_seed if seed == "mean" else series.rsi_first_seed)("_diffs", period)
    fold = (series.macd if seed == "mean" else series.macd_over_gaps)(closes, fast, slow, signal)
    kept = [c for c in df.columns if c != closes]
    return (
        df.select("*", series.changes(closes).alias("_diffs"))
        .select(
            *kept,
            F.when(gate_rsi, F.round(rsi, 2)).alias("rsi_14"),
            F.when(gate_macd, fold).alias("_macd"),
        )
        .select(
            *kept, "rsi_14",
            *[F.round(f"_macd.{c}", digits).alias(c) for c in ("macd", "macd_signal", "macd_histogram")],
        )
    )


def indicators(
    requests: DataFrame,
    bars: DataFrame,
    lookback_days: int = INDICATOR_LOOKBACK_DAYS,
    price_col: str = "close",
    **options,
) -> DataFrame:
    """RSI-14 and MACD 12/26/9 as known on each request's date.

    Fewer than 15 bars give NULLs. ``seed="mean"`` starts RSI at the mean of the
    first 14 changes; ``seed="first"`` at the first change, with averages that
    are carried over missing closes. Further ``options``: see
    :func:`indicator_columns`.
    """
    arrays = close_arrays(requests, bars, lookback_days, price_col)
    with_closes = arrays.select(
        "ticker", "as_of", F.size("bars").cast("long").alias("n_bars"), prices_of("bars").alias("_closes")
    )
    return indicator_columns(with_closes, "_closes", **options)


def indicators_by_maps(
    requests: DataFrame,
    bars: DataFrame,
    lookback_days: int = INDICATOR_LOOKBACK_DAYS,
    price_col: str = "close",
    period: int = RSI_PERIOD,
    fast: int = MACD_FAST,
    slow: int = MACD_SLOW,
    signal: int = MACD_SIGNAL,
    digits: int = 4,
) -> DataFrame:
    """The rows of :func:`indicators` (mean seed), with a map per bucket in place of its bars.

    Where a request meets a calendar bucket, the bars it sees there become one map of
    fixed size, and only maps are shuffled to the request, which combines at most five.
    A bucket that the window covers and in which nothing changed after the request's
    day has its map made once, however many requests read it; this is most of them
    when requests are dense and corrections prompt.
    """
    options = (period, fast, slow, signal)
    width = max(1, lookback_days // 4)
    own = bars.select("ticker", "trade_date", price_col, "known_from", "known_until")
    held = held_bars(requests, own, lookback_days, F.col(price_col).cast("double"))

    def mapped(df: DataFrame, seen: Column, name: str) -> DataFrame:
        """The map of the held bars that ``seen`` picks, in date order."""
        kept = df.columns
        return (
            df.withColumn("_seen", F.array_sort(seen))
            .withColumn("_closes", F.expr("transform(_seen, bar -> bar.price)"))
            .withColumn("_diffs", series.changes("_closes"))
            .select(*kept, maps.run_map("_closes", "_diffs", *options).alias(name))
        )

    pair = F.transform("_held", lambda v: F.struct(v["trade_date"].alias("trade_date"), v["price"].alias("price"),
                                                   v["known_from"].alias("known_from"), v["known_until"].alias("known_until")))
    last_change = F.array_max(F.transform("_held", lambda v: F.greatest(
        v["known_from"], F.when(v["known_until"] != open_end(), v["known_until"])
    )))
    held = held.select("ticker", "_bucket", pair.alias("_held"), last_change.alias("_settled_on"))
    settled = mapped(held, F.filter("_held", lambda v: v["known_until"] == open_end()), "_settled")

    day, first_day = F.col("as_of"), F.date_sub("as_of", lookback_days - 1)
    starts, ends = (F.date_from_unix_date(F.col("_bucket") * width + n) for n in (0, width - 1))
    whole = (starts >= first_day) & (ends <= day) & (F.col("_settled_on") <= day)
    met = settled.join(buckets_asked(requests, lookback_days, width), ["ticker", "_bucket"])
    # A bucket read as settled has no bars to fold.
    seen = F.when(~whole, F.filter("_held", lambda v: (
        (v["trade_date"] >= first_day) & (v["trade_date"] <= day) & (v["known_from"] <= day) & (v["known_until"] > day)
    )))
    runs = mapped(met, seen, "_own").select("ticker", "as_of", F.struct(
        "_bucket", F.when(whole, F.col("_settled")).otherwise(F.col("_own")).alias("run")
    ).alias("_part"))
    marker = distinct_requests(requests).select("ticker", "as_of", F.lit(None).cast(runs.schema["_part"].dataType).alias("_part"))
    # NULL parts are not collected, and those without a bar are left out.
    parts = runs.union(marker).groupBy("ticker", "as_of").agg(F.collect_list("_part").alias("_parts"))
    in_order = F.expr("transform(filter(array_sort(_parts, (p, q) -> p._bucket - q._bucket), p -> p.run IS NOT NULL), p -> p.run)")
    whole_run = parts.withColumn("_runs", in_order).select("ticker", "as_of", maps.product("_runs", period).alias("_run"))
    gate = F.col("n_bars") >= period + 1
    return (
        whole_run.select("ticker", "as_of", F.coalesce(F.col("_run.n"), F.lit(0)).cast("long").alias("n_bars"), "_run")
        .select(
            "ticker", "as_of", "n_bars", F.when(gate, F.round(maps.rsi_of("_run", period), 2)).alias("rsi_14"),
            F.when(gate, maps.macd_of("_run")).alias("_macd"),
        )
        .select(
            "ticker", "as_of", "n_bars", "rsi_14",
            *[F.round(f"_macd.{c}", digits).alias(c) for c in ("macd", "macd_signal", "macd_histogram")],
        )
    )


def snapshot_columns(closes: str, windows: Sequence[int] = PCT_CHANGE_BARS) -> list[Column]:
    """Last close and its percentage change over some numbers of bars."""
    last = F.round(F.try_element_at(closes, F.lit(-1)), 2).alias("last_close")
    return [last, *[series.pct_change(closes, n).alias(f"pct_change_{n}d") for n in windows]]


def price_snapshot(
    requests: DataFrame,
    bars: DataFrame,
    windows: Sequence[int] = PCT_CHANGE_BARS,
    lookback_days: int = HISTORY_LOOKBACK_DAYS,
) -> DataFrame:
    """One row per request; NULL metrics and ``n_bars = 0`` when it sees no bar."""
    arrays = close_arrays(requests, bars, lookback_days)
    closes = arrays.select("ticker", "as_of", prices_of("bars").alias("_closes"))
    return closes.select(
        "ticker", "as_of",
        F.size("_closes").cast("long").alias("n_bars"),
        *snapshot_columns("_closes", windows),
    )
