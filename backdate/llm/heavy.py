"""Keys that hold more rows than a task should: found exactly, and few by construction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FLOOR = 1_000  # a key of at most this many rows is never heavy
MOST = 32_768  # at most so many keys are heavy, whatever the data
BUCKETS = 262_144


def text_key(text: Column) -> list[Column]:
    """Two independent 64-bit hashes of a text; NULL is the empty text."""
    whole = F.coalesce(text, F.lit(""))
    return [F.xxhash64(whole), F.xxhash64(F.lit(1_000_003), whole)]


def heavy_keys(rows: DataFrame, keys: list[str], floor: int = FLOOR, most: int = MOST) -> tuple[DataFrame, int]:
    """The keys with more than ``limit`` rows, and that limit: ``floor``, or a ``most``-th of all rows if that is more.

    So there are at most ``most`` of them (their table can be broadcast) and any
    other key has at most ``limit`` rows. Counts by hash bucket come first; only
    the keys of buckets beyond the limit are counted one by one. ``rows`` is read
    several times and should be a stored table; the first key is a hash.
    """
    limit = max(floor, rows.count() // most)
    bucket = F.pmod(F.col(keys[0]), F.lit(BUCKETS))
    full = rows.groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > limit).select("bucket")
    within = rows.select(*keys, bucket.alias("bucket")).join(F.broadcast(full), "bucket", "left_semi")
    found = within.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > limit)
    return found.select(*keys), limit
