"""Versioned tables: deriving belief windows, applying batches, checking windows.

A version is believed from ``known_from`` (inclusive) to ``known_until``
(exclusive). Windows come from an append-only observation log, so they cannot
overlap and nothing is updated in place.

Windows need one shuffle, on the key; where one key repeats very often on one
day, ``reduce_first`` spends a second one to cut those repeats down before they
meet in a task.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from backdate.functions.dates import as_date, open_end

WINDOW_COLUMNS = ["known_from", "known_until"]


def _others(df: DataFrame, taken: Sequence[str]) -> list[str]:
    return [c for c in df.columns if c not in set(taken)]


def last_per_key(df: DataFrame, keys: Sequence[str], order_cols: Sequence[str]) -> DataFrame:
    """The last row of each key by ``order_cols``; each task sends at most one row per key.

    Rows equal in ``order_cols`` are decided by their other values, so the
    result does not depend on the order of arrival.
    """
    values = _others(df, keys)
    ranked = [c for c in order_cols if c in values]
    ranked += [c for c in values if c not in ranked]
    if not ranked:
        return df.distinct()
    last_first = Window.partitionBy(*keys).orderBy(*[F.desc_nulls_last(c) for c in ranked])
    return df.withColumn("_rn", F.row_number().over(last_first)).where(F.col("_rn") == 1).drop("_rn")


def build_versions(
    observations: DataFrame,
    keys: Sequence[str],
    compare_cols: Sequence[str],
    order_cols: Sequence[str] = (),
    default_known_from: Column | None = None,
    observed_on: str = "observed_on",
    reduce_first: bool = False,
) -> DataFrame:
    """Belief windows from an observation log.

    Of several observations of a key on one day the last by ``order_cols``
    counts, then by its other values. An observation equal to the one before it
    in all ``compare_cols`` adds nothing. The first version of a key starts at
    ``default_known_from`` (else at its own day), every later one on the day it
    was observed, but never before the first. A version superseded before it
    could be known keeps an empty window.

    All steps read one sort of one shuffle on the key. With ``reduce_first`` the
    repeats of a key and day are reduced in a shuffle of their own.
    """
    if reduce_first:
        observations = last_per_key(observations, [*keys, observed_on], order_cols)
    values = _others(observations, [*keys, observed_on])
    ranked = [c for c in order_cols if c in values]
    ranked += [c for c in values if c not in ranked]
    in_order = Window.partitionBy(*keys).orderBy(observed_on, *ranked)
    by_day = Window.partitionBy(*keys).orderBy(observed_on)
    daily = observations.withColumn("_next_day", F.lead(observed_on).over(in_order)).where(
        F.col("_next_day").isNull() | (F.col("_next_day") != F.col(observed_on))
    ).drop("_next_day")

    unchanged = reduce(
        lambda a, b: a & b, (F.col(c).eqNullSafe(F.lag(c).over(by_day)) for c in compare_cols)
    )
    first_seen = F.lag(observed_on).over(by_day).isNull()
    start = F.col(observed_on) if default_known_from is None else default_known_from
    marked = daily.select(
        "*",
        first_seen.alias("_first"),
        F.first(start).over(by_day).alias("_start"),
        unchanged.alias("_unchanged"),
    ).where(F.col("_first") | ~F.col("_unchanged"))

    known_from = F.when(F.col("_first"), F.col("_start")).otherwise(
        F.greatest(F.col(observed_on), F.col("_start"))
    )
    carried = [c for c in _others(observations, [*keys, observed_on, *WINDOW_COLUMNS])
               if c not in order_cols or c in compare_cols]
    return (
        marked.withColumn("known_from", known_from)
        .withColumn("known_until", F.coalesce(F.lead("known_from").over(by_day), open_end()))
        .select(*keys, *carried, *WINDOW_COLUMNS)
    )


def open_versions(df: DataFrame) -> DataFrame:
    """Versions still believed."""
    return df.where(F.col("known_until") == open_end())


def apply_batch(
    current: DataFrame,
    batch: DataFrame,
    keys: Sequence[str],
    compare_cols: Sequence[str],
    ingestion_date: dt.date | str | Column,
    default_known_from: Column | None = None,
    order_cols: Sequence[str] = (),
    small_batch: bool = True,
) -> DataFrame:
    """The next state of a versioned table after one batch, with an ``action`` per row.

    ``untouched``: key not in the batch, or an already closed version.
    ``unchanged``: same value again. ``closed`` and ``opened``: a correction,
    or a first version when only ``opened``.

    ``batch`` has the table's columns without the window; of several rows for a
    key the last by ``order_cols`` counts. Every key with a history must have an
    open row, which this operator and :func:`build_versions` both guarantee.

    The table is read once: closed versions pass through the same join, which
    they can never meet. With ``small_batch`` the table is only ever the probed
    side, so while Spark can broadcast the batch nothing of the table is
    shuffled, and which keys are new is found from the key columns alone. Without
    it (a batch as large as the table, say a backfill) one full outer join does
    both. The result is the same.
    """
    day = as_date(ingestion_date)
    columns, types = current.columns, {f.name: f.dataType for f in current.schema}
    values = _others(current, [*keys, *WINDOW_COLUMNS])
    ordering = [c for c in order_cols if c not in values]
    incoming = last_per_key(batch.select(*keys, *values, *ordering), keys, order_cols)
    # Compare what would be stored, not what arrived.
    incoming = incoming.select(*[F.col(c).cast(types[c]).alias(c) for c in [*keys, *values]])

    def version(source: str, known_from: Column, known_until: Column, action: str) -> Column:
        return F.struct(
            *[F.col(f"{source}{v}").alias(v) for v in values],
            known_from.alias("known_from"),
            known_until.alias("known_until"),
            F.lit(action).alias("action"),
        )

    was_from, was_until = F.col("known_from"), F.col("known_until")
    restart = F.greatest(day, was_from)
    same = reduce(lambda x, y: x & y, (F.col(c).eqNullSafe(F.col(f"_new.{c}")) for c in compare_cols))
    first_day = day if default_known_from is None else default_known_from
    rows = (
        F.when(F.col("known_until").isNull(), F.array(version("_new.", first_day, open_end(), "opened")))
        .when(F.col("_new").isNull(), F.array(version("", was_from, was_until, "untouched")))
        .when(same, F.array(version("", was_from, was_until, "unchanged")))
        .otherwise(F.array(
            version("", was_from, restart, "closed"), version("_new.", restart, open_end(), "opened"),
        ))
    )
    arrived = incoming.select(*keys, F.lit(True).alias("_open"), F.struct(*values).alias("_new"))
    marked = current.withColumn("_open", F.col("known_until") == open_end())
    met = marked.join(arrived, [*keys, "_open"], "left_outer" if small_batch else "full_outer")
    result = met.select(*keys, F.inline(rows)).select(*columns, "action")
    if not small_batch:
        return result
    known = open_versions(current).select(*keys).join(incoming.select(*keys), list(keys), "left_semi")
    begun = incoming.join(known, list(keys), "left_anti").select(
        *keys, *values, first_day.alias("known_from"), open_end().alias("known_until"),
        F.lit("opened").alias("action"),
    )
    return result.unionByName(begun)


def action_counts(applied: DataFrame) -> DataFrame:
    """Rows per action; ``opened`` is the number of inserted rows."""
    return applied.groupBy("action").agg(F.count(F.lit(1)).alias("n_rows"))


def next_state(applied: DataFrame) -> DataFrame:
    return applied.drop("action")


def upsert(existing: DataFrame, batch: DataFrame, keys: Sequence[str], order_cols: Sequence[str] = ()) -> DataFrame:
    """Last write wins, whole rows: a NULL in the batch replaces a value."""
    incoming = last_per_key(batch, keys, order_cols).select(*existing.columns)
    kept = existing.join(incoming.select(*keys), list(keys), "left_anti")
    return kept.unionByName(incoming)


def latest_version(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The newest version per key, whatever the question's date (the naive read)."""
    return last_per_key(df, keys, WINDOW_COLUMNS)


def version_invariants(df: DataFrame, keys: Sequence[str], reduce_first: bool = True) -> DataFrame:
    """Violations per rule; all counts are 0 for a sound table.

    ``reversed_window``: ends before it starts. ``overlap``: believed together
    with the next version of the key. ``many_open``: surplus open versions.
    Without ``reduce_first`` every row is sorted by its key as it is.
    """
    # One row per key and start day first, so no key is larger than its number of days. Of versions that
    # build_versions has just made there are no more than that, and they lie by key: tables of them by day only take memory.
    filled, until = F.col("known_until") > F.col("known_from"), F.col("known_until")
    flags = {"_filled": filled, "_reversed": until < F.col("known_from"), "_open": until == open_end()}
    if reduce_first:
        starts = df.groupBy(*keys, "known_from").agg(
            F.max("known_until").alias("_until"), *[F.count_if(c).alias(n) for n, c in flags.items()]
        )
    else:
        starts = df.select(*keys, "known_from", until.alias("_until"), *[F.when(c, 1).otherwise(0).alias(n) for n, c in flags.items()])
    by_day = Window.partitionBy(*keys).orderBy("known_from", "_until")
    earlier = by_day.rowsBetween(Window.unboundedPreceding, -1)
    # The furthest end of any earlier version; it must not pass this start.
    reach = F.max("_until").over(earlier)
    clash = F.when(F.col("_filled") > 0, F.col("_filled") - 1 + F.when(reach > F.col("known_from"), 1).otherwise(0))
    # A key's first open version is no surplus. Counted on the way, so that no task keeps sums by key.
    has_open = F.coalesce(F.max(F.col("_open") > 0).over(earlier), F.lit(False))
    surplus = F.col("_open") - F.when((F.col("_open") > 0) & ~has_open, 1).otherwise(0)
    counted = starts.select(F.col("_reversed").alias("reversed_window"), clash.alias("overlap"), surplus.alias("many_open"))
    totals = counted.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c)
                           for c in ("reversed_window", "overlap", "many_open")])
    return totals.unpivot([], ["reversed_window", "overlap", "many_open"], "rule", "violations")
