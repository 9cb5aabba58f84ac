"""Keeping belief windows up to date from new observations alone, however late they come.

A new observation changes the windows of its own key only: the version before it may
close earlier, one may be opened, and one after it may become a change or cease to be
one. So the log is read for the touched keys (by a semi-join that Spark can broadcast),
their windows are derived with and without the new observations in one shuffle, and
what differs is the delta. The windows table itself is not needed for that, and takes
the delta by an anti-join, again on broadcast rows while the delta is small.

Reading the log rather than the windows matters for late observations: an observation
that repeated its predecessor's value left no version, but is one once a different
value comes between.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from backdate.operators.versions import build_versions

WITHDRAWN, ADDED = "withdrawn", "added"


def window_delta(
    log: DataFrame,
    new: DataFrame,
    keys: Sequence[str],
    compare_cols: Sequence[str],
    order_cols: Sequence[str] = (),
    default_known_from: Column | None = None,
    observed_on: str = "observed_on",
) -> DataFrame:
    """Versions that ``new`` takes from and adds to the windows of ``log``, with a ``change``.

    ``new`` has the log's columns and is not in it yet. Of a version that the new
    windows hold another number of times, ``withdrawn`` takes all copies and ``added``
    brings them anew. Keys are not NULL. See :func:`versions.build_versions` for the
    other arguments.
    """
    touched = log.join(new.select(*keys).distinct(), list(keys), "left_semi")
    before = touched.withColumn("_state", F.explode(F.array(F.lit(0), F.lit(1))))
    after = new.select(*log.columns, F.lit(1).alias("_state"))
    # All that follows is per key: one exchange serves the windows of both states and the comparison.
    states = before.unionByName(after).repartition(*keys)
    built = build_versions(states, [*keys, "_state"], compare_cols, order_cols, default_known_from, observed_on)
    columns = [c for c in built.columns if c != "_state"]
    counted = built.groupBy(*columns).agg(
        F.count_if(F.col("_state") == 0).alias("_before"), F.count_if(F.col("_state") == 1).alias("_after")
    )
    changes = F.concat(
        F.array_repeat(F.lit(WITHDRAWN), F.when(F.col("_before") > 0, 1).otherwise(0)),
        F.array_repeat(F.lit(ADDED), F.col("_after").cast("int")),
    )
    return counted.where(F.col("_before") != F.col("_after")).select(*columns, F.explode(changes).alias("change"))


def apply_delta(windows: DataFrame, delta: DataFrame) -> DataFrame:
    """The windows after a delta; rows are the same if all their columns are."""
    columns = windows.columns
    gone = delta.where(F.col("change") == WITHDRAWN).select(*[F.col(c).alias(f"_gone_{c}") for c in columns])
    same = [F.col(c).eqNullSafe(F.col(f"_gone_{c}")) for c in columns]
    kept = windows.join(gone, same, "left_anti")
    return kept.unionByName(delta.where(F.col("change") == ADDED).select(*columns))
