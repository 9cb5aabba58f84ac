"""Readers for the landing feeds; the fetch that fills the folders is outside."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from backdate.functions.dates import as_date, day_bucket
from backdate.operators.pointintime import buckets_asked
from backdate.schemas import COMPANY_FEED, INGEST_LOOKBACK_DAYS, NEWS_FEED, PRICE_FEED
from backdate.sources.tables import write_observed


def _read(spark: SparkSession, path: str, fmt: str, schema) -> DataFrame:
    reader = spark.read.schema(schema)
    if fmt == "csv":
        reader = reader.option("header", True)
    return reader.format(fmt).load(path)


def in_ingest_window(prices: DataFrame, as_of: dt.date | str | DataFrame, lookback_days: int) -> DataFrame:
    """Days ``[as_of - lookback, as_of]``: both ends belong to the feed window.

    With a table of requests for ``as_of``, days in a window of the row's own ticker;
    rows and requests meet on ticker and calendar bucket, of which a window has at most six.
    """
    if isinstance(as_of, DataFrame):
        days = lookback_days + 1
        width = max(1, days // 4)
        wanted = buckets_asked(as_of, days, width).withColumnsRenamed({"ticker": "_t", "_bucket": "_b"})
        inside = (F.col("trade_date") >= F.date_sub("as_of", lookback_days)) & (F.col("trade_date") <= F.col("as_of"))
        met = (F.col("ticker") == F.col("_t")) & (day_bucket(F.col("trade_date"), width) == F.col("_b"))
        return prices.join(wanted, met & inside, "left_semi")
    last = as_date(as_of)
    return prices.where((F.col("trade_date") >= F.date_sub(last, lookback_days)) & (F.col("trade_date") <= last))


def read_prices(
    spark: SparkSession, path: str, as_of: dt.date | str,
    lookback_days: int = INGEST_LOOKBACK_DAYS, fmt: str = "parquet",
) -> DataFrame:
    return in_ingest_window(_read(spark, path, fmt, PRICE_FEED), as_of, lookback_days)


# What a landed line has besides the feed's columns: its text if unreadable, its file, why it is rejected.
LINE, FILE, REASON = "_line", "_file", "_reason"


def land(
    spark: SparkSession, path: str, out: str, feed: str, fmt: str = "json", required: Sequence[str] = ("ticker",)
) -> dict[str, int]:
    """Store a feed's lines, sound ones and rejected ones apart, and count them by reason; no line is lost.

    A line is ``unreadable`` when it is broken off, of another shape, or holds a
    value that its column's type cannot, else ``missing COLUMN`` for the first of
    ``required`` that is NULL. Empty JSON lines are no lines; a CSV file begins
    with its header.

    One parse and one write: ``out`` is partitioned by ``rejected`` and replaced as
    a whole, the counts are observed on the write. Whether a line is sound is told
    only when all columns are read, so columns are picked from what is stored.
    """
    schema = T.StructType.fromDDL(feed).add(LINE, "string")
    reader = spark.read.schema(schema).option("columnNameOfCorruptRecord", LINE).option("mode", "PERMISSIVE")
    if fmt == "csv":
        reader = reader.option("header", True)
    reason = F.when(F.col(LINE).isNotNull(), "unreadable")
    for column in required:
        reason = reason.when(F.col(column).isNull(), f"missing {column}")
    lines = reader.format(fmt).load(path).select("*", F.col("_metadata.file_path").alias(FILE), reason.alias(REASON))
    return write_observed(
        lines.withColumn("rejected", F.col(REASON).isNotNull()),
        {r: F.col(REASON) == r for r in ("unreadable", *[f"missing {c}" for c in required])},
        lambda df: df.write.mode("overwrite").options(partitionOverwriteMode="static", compression="zstd").partitionBy("rejected").parquet(out),
    )


def _landed(spark: SparkSession, path: str, feed: str) -> DataFrame:
    schema = f"{feed}, {LINE} string, {FILE} string, {REASON} string, rejected boolean"
    return spark.read.schema(schema).parquet(path)


def sound(spark: SparkSession, path: str, feed: str) -> DataFrame:
    """The feed's rows that :func:`land` accepted, in the feed's own columns."""
    return _landed(spark, path, feed).where("NOT rejected").drop(LINE, FILE, REASON, "rejected")


def quarantined(spark: SparkSession, path: str, feed: str) -> DataFrame:
    """Rejected lines: ``_reason, _file, _line`` and what could be read of the feed's columns."""
    return _landed(spark, path, feed).where("rejected").drop("rejected")


def read_news(spark: SparkSession, path: str) -> DataFrame:
    """Nested JSON entries; a missing part of an entry reads as NULL."""
    return _read(spark, path, "json", NEWS_FEED)


def read_companies(spark: SparkSession, path: str, fmt: str = "json") -> DataFrame:
    return _read(spark, path, fmt, COMPANY_FEED)


def read_quarterly(spark: SparkSession, path: str, fmt: str = "csv") -> DataFrame:
    """Wide table: ``ticker, line_item`` and one column per period end (kept as text)."""
    reader = spark.read.format(fmt)
    if fmt == "csv":
        reader = reader.option("header", True)
    return reader.load(path)
