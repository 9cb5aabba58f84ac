"""Mixing sources to target weights by hash thresholds.

Every document has a fixed 60-bit key. A source that must give only part of its
words gives the documents whose key is below a threshold. The threshold is
found without sorting: words are summed by source and bucket of the key, the
bucket in which the budget ends is found by a running sum over at most 4096
buckets, and only that bucket is divided again, until no bucket holds two keys.
A larger budget of the same source always takes a superset of the documents.

Defined results: a NULL text has size 0 and is never taken; NULL is a source of
its own, last in order; rows equal in id, source and text share a key and go
together; a source without words has target 0; an empty table stays empty.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from backdate.llm.common import stored, word_count

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST_REPEATS = 2
LEVEL_BITS, LEVELS = 12, 5


def _key(doc_id: Column, source: Column, text: Column) -> Column:
    """15 hexadecimal digits of a digest, as a number."""
    part = lambda c: F.coalesce(c, F.lit(""))
    whole = F.concat_ws("|", part(doc_id.cast("string")), part(source), F.md5(part(text)))
    return F.conv(F.substring(F.md5(whole), 1, 15), 16, 10).cast("long")


def _rank_sources(sources: DataFrame) -> DataFrame:
    """Position of each source in code point order, NULL last: places within range partitions, then their offsets."""
    order = [F.col("source").isNull(), F.col("source")]
    placed = stored(sources.orderBy(*order).withColumn("part", F.spark_partition_id()))
    counts = placed.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    # One row per partition, however many sources there are.
    before = counts.withColumn("before", F.sum("n").over(Window.orderBy("part")) - F.col("n")).drop("n")
    within = F.row_number().over(Window.partitionBy("part").orderBy(*order))
    return placed.withColumn("within", within).join(before, "part").select(
        "source", "source_size", (F.col("before") + F.col("within") - 1).alias("rank")
    )


def source_targets(
    sources: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: float = MOST_REPEATS
) -> DataFrame:
    """``target`` words of each source of ``sources (source, source_size)``.

    ``share`` of all words is dealt by weight; no source gets more than ``most``
    times its own, and what is left over is dealt again among the others.
    """
    ranked = _rank_sources(sources)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    ranked = stored(ranked.select("source", "source_size", weight.alias("weight"), (F.col("source_size") * float(most)).alias("top")))
    total = ranked.agg(F.sum("source_size")).first()[0] or 0
    budget, level = float(total) * share, 0.0
    while True:
        full = F.col("top") < F.col("weight") * level if level else F.lit(False)
        used, open_weight, n_full = ranked.agg(
            F.sum(F.when(full, F.col("top"))), F.sum(F.when(~full, F.col("weight"))), F.count_if(full)
        ).first()
        if not open_weight:
            break
        raised = max(0.0, budget - (used or 0.0)) / open_weight
        if raised == level:
            break
        level = raised
        # Full at the last level stays full: the level only rises.
    return ranked.select("source", "source_size", F.least(F.col("top"), F.col("weight") * level).alias("target"))


def _thresholds(sizes: DataFrame, budgets: DataFrame) -> DataFrame:
    """``(source, below)``: documents of the source with a key under ``below`` meet its budget as nearly as possible."""
    span = 1 << LEVEL_BITS * LEVELS
    found = budgets.select("source", F.col("extra").alias("left"), F.lit(0).cast("long").alias("low"))
    for _ in range(LEVELS):
        span >>= LEVEL_BITS
        # Only documents in the open bucket of their source.
        place = F.floor((F.col("key") - F.col("low")) / span).cast("long")
        inside = sizes.join(found, sizes["source"].eqNullSafe(found["source"])).where(
            (F.col("key") >= F.col("low")) & (F.col("key") < F.col("low") + F.lit(span << LEVEL_BITS))
        ).select(found["source"], "left", "low", place.alias("bucket"), "size")
        sums = inside.groupBy("source", "left", "low", "bucket").agg(F.sum("size").alias("words"))
        upto = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
        sums = sums.withColumn("before", F.sum("words").over(upto) - F.col("words"))
        # The bucket in which the budget ends.
        ends = sums.where((F.col("before") <= F.col("left")) & (F.col("before") + F.col("words") > F.col("left")))
        found = stored(ends.select(
            "source", (F.col("left") - F.col("before")).alias("left"), (F.col("low") + F.col("bucket") * span).alias("low"), "words"
        ))
    # One key is left: take it if that comes nearer to the budget.
    nearer = F.col("words") - F.col("left") < F.col("left")
    return found.select("source", F.when(nearer, F.col("low") + 1).otherwise(F.col("low")).alias("below"))


def _plan(
    docs: DataFrame, weights: Sequence[float], share: float, most: int
) -> tuple[DataFrame, DataFrame]:
    """The size and key of every row, and of each source its size, target, whole passes and threshold."""
    sizes = stored(docs.select(
        "doc_id", "source", word_count(F.col("text")).alias("size"),
        _key(F.col("doc_id"), F.col("source"), F.col("text")).alias("key"),
    ))
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = stored(source_targets(sources, weights, share, most).select(
        "*", F.when(F.col("source_size") > 0, F.least(F.lit(most), F.floor(F.col("target") / F.col("source_size"))))
        .otherwise(0).cast("int").alias("passes"),
    ))
    left = F.col("target") - F.col("passes") * F.col("source_size")
    budgets = targets.select("source", left.alias("extra")).where("extra > 0")
    below = _thresholds(sizes, budgets).withColumnRenamed("source", "s")
    plan = targets.join(below, targets["source"].eqNullSafe(below["s"]), "left").select(
        F.col("source").alias("p_source"), "source_size", "target", "passes", F.coalesce("below", F.lit(0)).alias("below")
    )
    return sizes, stored(plan)


def _copies(most: int) -> Column:
    return F.least(F.lit(most), F.col("passes") + (F.col("key") < F.col("below")).cast("int"))


def mix_sources(
    docs: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: int = MOST_REPEATS
) -> DataFrame:
    """``doc_id, size, source_size, target, taken`` and ``copies`` for every row of ``docs (doc_id, source, text)``.

    ``taken`` is ``size`` times ``copies``: as many whole passes over the source
    as its target holds, and one more for documents under the threshold.
    """
    sizes, plan = _plan(docs, weights, share, most)
    copies = _copies(most)
    return (
        sizes.join(plan, sizes["source"].eqNullSafe(plan["p_source"]))
        .select("doc_id", "size", "source_size", "target", (F.col("size") * copies).cast("long").alias("taken"),
                "source", copies.alias("copies"), "key")
    )


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` as often as the mix takes them, with their own columns.

    How often follows from a row's key and its source's plan. The plan has a row per
    source, so Spark broadcasts it while it is small, and the texts stay where they are.
    """
    _, plan = _plan(docs, WEIGHTS, SHARE, MOST_REPEATS)
    rows = docs.select(
        F.struct(*docs.columns).alias("row"), F.col("source").alias("r_source"),
        _key(F.col("doc_id"), F.col("source"), F.col("text")).alias("key"),
    )
    met = rows.join(plan, rows["r_source"].eqNullSafe(plan["p_source"])).select("row", _copies(MOST_REPEATS).alias("copies"))
    return met.where("copies > 0").select("row", F.explode(F.sequence(F.lit(1), "copies"))).select("row.*")
