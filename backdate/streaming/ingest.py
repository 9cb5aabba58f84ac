"""Continuous ingest: the observation log, versioned tables, news without repeats."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from backdate.sources.tables import manifest, publish, read_published


def append_observations(stream: DataFrame, path: str, checkpoint: str, valid_date: str) -> StreamingQuery:
    """Append to the observation log, each row once; the form for large tables.

    Nothing stored is rewritten: windows are derived from the log by
    ``build_versions``, for the years a query needs.
    """
    return (
        stream.withColumn("valid_year", F.year(valid_date))
        .writeStream.format("parquet")
        .partitionBy("valid_year")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )


def apply_stream(
    stream: DataFrame,
    root: str,
    table: str,
    initial: DataFrame,
    apply: Callable[[DataFrame, DataFrame], DataFrame],
    checkpoint: str,
) -> StreamingQuery:
    """Apply each micro-batch to a published versioned table.

    ``apply(current, batch)`` returns the next state. The manifest holds which
    query (by the id in its checkpoint) and batch made each version, so a batch
    that is run again after a failure changes nothing twice, while a query with
    a new checkpoint goes on from the newest version. Each batch rewrites the
    table: meant for daily files, while :func:`append_observations` is the form
    for frequent small batches.
    """

    def one_batch(batch: DataFrame, batch_id: int) -> None:
        spark: SparkSession = batch.sparkSession
        query = spark.read.json(f"{checkpoint}/metadata").first()["id"]
        known = manifest(spark, root).where(F.array_contains("tables", table)).limit(1).count()
        current = read_published(spark, root, table) if known else initial
        publish({table: apply(current, batch)}, root, batch=(query, batch_id))

    return (
        stream.writeStream.foreachBatch(one_batch)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def without_repeats(news: DataFrame, keys: Sequence[str], event_time: str, delay: str) -> DataFrame:
    """Drop news seen before within the watermark; state is kept only that long."""
    return news.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(list(keys))
