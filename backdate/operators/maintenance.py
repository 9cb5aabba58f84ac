"""Run status, deletion with children, delete-and-reseed."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def latest_status(run: DataFrame, events: DataFrame) -> DataFrame:
    """Runs with the last of their status events ``(run_id, status, at)`` applied.

    ``completed_at`` is set by a completion and kept otherwise.
    """
    last = events.groupBy(F.col("run_id").alias("id")).agg(F.max(F.struct("at", "status")).alias("_last"))
    finished = F.when(F.col("_last.status") == "completed", F.col("_last.at"))
    return run.join(last, "id", "left").withColumns({
        "status": F.coalesce("_last.status", "status"),
        "completed_at": F.coalesce(finished, "completed_at"),
    }).select(*run.columns)


def without_keys(df: DataFrame, keys: DataFrame, on: Sequence[str]) -> DataFrame:
    """Rows whose key is not listed."""
    return df.join(keys.select(*on), list(on), "left_anti")


def purge_runs(
    run: DataFrame, verdict: DataFrame, message: DataFrame, doomed: DataFrame
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Delete the runs in ``doomed(id)`` together with their verdicts and messages."""
    children = doomed.select(F.col("id").alias("run_id"))
    return (
        without_keys(run, doomed, ["id"]),
        without_keys(verdict, children, ["run_id"]),
        without_keys(message, children, ["run_id"]),
    )


def reseed(df: DataFrame, rows: DataFrame, on: Sequence[str]) -> DataFrame:
    """Delete every row of the keys in ``rows`` and put ``rows`` in their place."""
    return without_keys(df, rows, on).unionByName(rows)
