"""Exact top-k search by integer inner product, on norm-sorted blocks with rotated partial sums.

Vectors are turned so that the directions in which they vary most come first
(the singular vectors of the whole table, from its d x d sum of products). For a
query, a candidate is scored on the first few rotated coordinates; what the rest
can add is at most the product of the two residual lengths (Cauchy-Schwarz), so
most candidates are dropped early. The survivors' scores are exact integers.

The longest vectors, a bounded number, are searched by all queries first and
give each a floor under its k-th score. All candidates lie in blocks of bounded
size by descending length; a query goes to the blocks whose longest vector, by
the product of lengths, could still reach its floor, and streams past the block.

Defined results: vectors that are NULL, empty, hold NULL or non-finite
components, or have a NULL id take no part; a shorter vector counts as zero
beyond its end; rows with the query's own id are not its candidates; repeated
rows of one id are one candidate each time; ties go to the smaller id.
Vectors whose sums doubles can't hold exactly are searched in whole numbers of
any size, block against block; their scores rank by their exact values, and one
beyond a long is given as the nearest long.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from backdate.llm.common import stored

SCALE = 256
TOP = 5
SEED_ROWS = 4096  # longest vectors that every query meets first
BLOCK_ROWS = 4096
MET = "query_id long, q_key long, vec_id long, side int, digits string, score long"
EXACT = 1 << 52  # squared length up to which sums of products are exact in doubles
LARGE_QUERIES = 1024  # queries that meet a block of candidates in one task where either side is large
HEAD = 0.25  # share of the coordinates scored before pruning


def integer_vectors(rows: DataFrame, scale: int = SCALE) -> DataFrame:
    """``vec_id, v, norm2, large``: components as floor(scale * x), and the squared length.

    Vectors too long for sums that are exact in doubles have no ``v`` and ``norm2``
    but their components as they are in ``large``.
    """
    longest = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + F.pow(F.abs(x.cast("double")) * float(scale) + 1, F.lit(2.0)))
    whole = F.transform("embedding", lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("long"))
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    sound = rows.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).where((F.size("embedding") > 0) & finite)
    made = sound.withColumn("_fits", longest < float(EXACT)).select(
        "vec_id", F.when(F.col("_fits"), whole).alias("v"),
        F.when(~F.col("_fits"), F.transform("embedding", lambda x: x.cast("double"))).alias("large"),
    )
    return made.withColumn("norm2", F.aggregate("v", F.lit(0).cast("long"), lambda s, x: s + x * x))


def _matrix(column: pa.ListArray, width: int) -> np.ndarray:
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    out = np.zeros((len(column), width))
    row = np.repeat(np.arange(len(column)), sizes)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def _rotation(vectors: DataFrame, width: int) -> np.ndarray:
    """Orthonormal directions in descending order of the vectors' spread along them."""

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for batch in batches:
            m = _matrix(batch.column("v"), width)
            total += m.T @ m
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(width), width)), pa.array(np.tile(np.arange(width), width)),
                                          pa.array(total.ravel())], ["i", "j", "x"])

    sums = vectors.select("v").mapInArrow(products, "i long, j long, x double").groupBy("i", "j").agg(F.sum("x").alias("x"))
    gram = np.zeros((width, width))
    for r in sums.collect():  # width * width numbers
        gram[r["i"], r["j"]] = r["x"]
    _, directions = np.linalg.eigh(gram)
    return directions[:, ::-1]


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    return np.lexsort((ids, -scores))[:k]


def _search(width: int, rotation: np.ndarray, k: int):
    head = max(1, int(width * HEAD))

    def turned(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        r = v @ rotation
        return r[:, :head], np.linalg.norm(r[:, head:], axis=1)

    def search(q_ids, q, floors, c_ids, c):
        """Per query, ids and scores of its best k among the candidates that may pass its floor."""
        q_norm, c_norm = np.linalg.norm(q, axis=1), np.linalg.norm(c, axis=1)
        q_head, q_rest = turned(q)
        c_head, c_rest = turned(c)
        # Sums of rounded products may be off by so much.
        slack = 1e-9 * (1 + q_norm * c_norm.max(initial=0))
        for i in range(len(q)):
            floor = floors[i]
            reach = np.searchsorted(-c_norm, -(floor - slack[i]) / q_norm[i], "right") if q_norm[i] > 0 and floor > 0 else len(c)
            bound = c_head[:reach] @ q_head[i] + c_rest[:reach] * q_rest[i]
            left = np.flatnonzero((bound >= floor - slack[i]) & (c_ids[:reach] != q_ids[i]))
            if not len(left):
                continue
            if len(left) > 4 * k:
                # The best bounds first raise the floor for the others.
                few = left[np.argpartition(-bound[left], 2 * k)[: 2 * k]]
                tried = np.rint(c[few] @ q[i])
                floor = max(floor, np.partition(tried, -k)[-k])
                left = left[bound[left] >= floor - slack[i]]
            scores = np.rint(c[left] @ q[i]).astype(np.int64)
            order = _best(c_ids[left], scores, k)
            yield i, c_ids[left][order], scores[order]

    return search


def _longest_first(ids: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((ids, -np.linalg.norm(v, axis=1)))
    return ids[order], v[order]


def _whole_numbers(row: np.ndarray, scale: int) -> list[int]:
    """floor(scale * x) of each component, whatever its size."""
    return [int(x) * scale if abs(x) >= EXACT else math.floor(x * scale) for x in row.tolist()]


def _scaled(rows: list[np.ndarray], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows with components below 1, and the exponents taken out of them."""
    out = np.zeros((len(rows), width))
    for i, row in enumerate(rows):
        out[i, : len(row)] = row
    exponent = np.frexp(np.abs(out).max(axis=1, initial=0))[1]
    return np.ldexp(out, -exponent[:, None]), exponent.astype(np.int64)


def _ordered(score: int) -> tuple[int, str, int]:
    """``side, digits, score`` that sort as the score does, with the nearest long for one beyond a long."""
    if -(1 << 63) <= score < 1 << 63:
        return 0, "", score
    digits = str(abs(score))
    if score > 0:
        return 1, f"{len(digits):05d}{digits}", (1 << 63) - 1
    return -1, f"{99999 - len(digits):05d}" + "".join(str(9 - int(d)) for d in digits), -(1 << 63)


def _large_block(k: int, scale: int):
    """The best k candidates of each query of one block by exact whole numbers, for components of any size.

    Doubles bound each score from both sides; only candidates whose upper bound
    reaches the k-th best lower bound are summed up exactly.
    """

    def best(rows: pd.DataFrame) -> pd.DataFrame:
        asked, held = rows[rows["kind"] == 1], rows[rows["kind"] == 0]
        out: list[tuple] = []
        width = max(len(x) for x in rows["x"])
        c, c_exp = _scaled(list(held["x"]), width)
        q, q_exp = _scaled(list(asked["x"]), width)
        ids, vectors, numbers = held["vec_id"].to_numpy(np.int64), list(held["x"]), {}
        shift = np.clip(c_exp - c_exp.max(initial=-2000), -1000, 0).astype(np.int32)
        c_floor = np.ldexp(1.0, np.clip(-c_exp, -1000, 1000).astype(np.int32))
        for i, (q_id, q_key, x) in enumerate(zip(asked["vec_id"], asked["q_key"], asked["x"], strict=True)):
            # Off by rounding, and by the floors of either side: each below 1 / scale of a component.
            off = width * (2.0**-40 + 2 * (c_floor + np.ldexp(1.0, int(np.clip(-q_exp[i], -1000, 1000)))))
            near = c @ q[i]
            low, high = np.ldexp(near - off, shift), np.ldexp(near + off, shift)
            others = np.flatnonzero(ids != q_id)
            if len(others) > k:
                # Exponents more than 1000 apart are taken as 1000 apart, which moves no bound by 1e-290.
                others = others[high[others] >= np.partition(low[others], -k)[-k] - 1e-290]
            whole, scores = _whole_numbers(x, scale), []
            for j in others.tolist():
                if j not in numbers:
                    numbers[j] = _whole_numbers(vectors[j], scale)
                scores.append((-sum(a * b for a, b in zip(whole, numbers[j], strict=False)), int(ids[j])))
            out.extend((q_id, q_key, vec_id, *_ordered(-score)) for score, vec_id in heapq.nsmallest(k, scores))
        return pd.DataFrame(out, columns=["query_id", "q_key", "vec_id", "side", "digits", "score"])

    return best


def _large_met(queries: DataFrame, n_queries: int, candidates: DataFrame, n_candidates: int, k: int, scale: int) -> DataFrame:
    """Every query against every candidate, in blocks of both; each task holds one block of either."""
    slices, blocks = -(-n_queries // LARGE_QUERIES), -(-n_candidates // BLOCK_ROWS)
    asked = stored(queries.repartition(slices).withColumn("slice", F.spark_partition_id())).withColumn(
        "block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    )
    held = stored(candidates.repartition(blocks).withColumn("block", F.spark_partition_id())).withColumn(
        "slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1)))
    )
    both = asked.withColumn("kind", F.lit(1)).unionByName(held.withColumn("kind", F.lit(0)))
    return both.groupBy("slice", "block").applyInPandas(_large_block(k, scale), MET)


def top_inner(
    rows: DataFrame, is_query: Callable[[Column], Column], k: int = TOP, scale: int = SCALE
) -> DataFrame:
    """``query_id, rank, vec_id, score`` of the k best candidates of each row of ``rows (vec_id, embedding)`` that ``is_query``."""
    every = stored(integer_vectors(rows, scale))
    n, width, n_large = every.agg(F.count("v"), F.max(F.size("v")), F.count("large")).first()
    met = _met(every.where("v IS NOT NULL").drop("large"), n, width, is_query, k) if n else rows.sparkSession.createDataFrame([], MET)
    if n_large:
        # Where a side is large, scores are whole numbers of any size: large queries meet all rows, the others the large ones.
        numbers = every.select(
            "vec_id", F.coalesce("large", F.transform("v", lambda x: x / float(scale))).alias("x"),
            F.when(F.col("large").isNull(), F.xxhash64("v")).otherwise(F.xxhash64("large")).alias("q_key"),
            F.col("large").isNotNull().alias("is_large"),
        )
        asked = numbers.where(is_query(F.col("vec_id"))).dropDuplicates(["vec_id", "x"])
        n_asked = {r["is_large"]: r["count"] for r in asked.groupBy("is_large").count().collect()}
        for large, candidates, n_candidates in ((True, numbers, n + n_large), (False, numbers.where("is_large"), n_large)):
            if large in n_asked:
                queries = asked.where(F.col("is_large") == large).drop("is_large")
                met = met.unionByName(_large_met(queries, n_asked[large], candidates.drop("is_large"), n_candidates, k, scale))
    # At most k rows per query and block, cut again before the shuffle.
    best = Window.partitionBy("query_id", "q_key").orderBy(F.desc("side"), F.desc("digits"), F.desc("score"), "vec_id")
    return met.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _met(vectors: DataFrame, n: int, width: int, is_query: Callable[[Column], Column], k: int) -> DataFrame:
    """Each query's best k of every block that may hold some of its best, among ``n`` vectors of exact sums."""
    spark = vectors.sparkSession
    rotation = _rotation(vectors, width)
    search = _search(width, rotation, k)

    seed = vectors.orderBy(F.desc("norm2"), "vec_id").limit(SEED_ROWS).toPandas()
    first = _longest_first(
        seed["vec_id"].to_numpy(np.int64), np.array([np.pad(v, (0, width - len(v))) for v in seed["v"]], np.float64)
    )
    first = spark.sparkContext.broadcast(first)

    def floors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c_ids, c = first.value
        for batch in batches:
            ids, q = batch.column("vec_id").to_numpy(), _matrix(batch.column("v"), width)
            floor = np.full(len(ids), -np.inf)
            for i, _, scores in search(ids, q, floor.copy(), c_ids, c):
                if len(scores) == k:
                    floor[i] = scores[-1]
            yield pa.RecordBatch.from_arrays([*(batch.column(x) for x in ("vec_id", "v", "norm2")), pa.array(floor)], ["vec_id", "v", "norm2", "floor"])

    # One row per query; its repeats would only give the same answer again.
    asked = vectors.where(is_query(F.col("vec_id"))).dropDuplicates(["vec_id", "v"])
    asked = stored(asked.mapInArrow(floors, "vec_id long, v array<long>, norm2 long, floor double"))
    # Equal lengths are parted by a hash, so every block is of bounded size.
    ranged = vectors.repartitionByRange(max(1, -(-n // BLOCK_ROWS)), F.desc("norm2"), F.xxhash64("vec_id"))
    blocks = stored(ranged.withColumn("block", F.spark_partition_id()))
    tops = blocks.groupBy("block").agg(F.sqrt(F.max("norm2")).alias("top"))
    tops = tops.agg(F.collect_list(F.struct("block", "top")).alias("tops"))  # one entry per BLOCK_ROWS vectors
    meets = F.filter("tops", lambda b: b["top"] * F.sqrt("norm2") * (1 + 1e-9) >= F.col("floor"))
    queries = asked.join(F.broadcast(tops)).select(
        F.explode(F.transform(meets, lambda b: b["block"])).alias("block"), F.lit(1).alias("kind"), "vec_id", "v", "floor"
    )
    candidates = blocks.select("block", F.lit(0).alias("kind"), "vec_id", "v", F.lit(0.0).alias("floor"))
    dealt = candidates.unionByName(queries).repartition("block").sortWithinPartitions("block", "kind")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, block = None, [], None
        for batch in batches:
            kind, of = batch.column("kind").to_numpy(), batch.column("block").to_numpy()
            edges = np.flatnonzero((np.diff(kind) != 0) | (np.diff(of) != 0)) + 1
            for a, b in zip([0, *edges], [*edges, len(kind)], strict=True):
                ids, v = batch.column("vec_id").to_numpy()[a:b], _matrix(batch.column("v").slice(a, b - a), width)
                if kind[a] == 0:
                    if of[a] != at:
                        at, held = of[a], []
                    held.append((ids, v))
                    block = None
                    continue
                if block is None:
                    block = _longest_first(*(np.concatenate([h[i] for h in held]) for i in (0, 1)))
                floor = batch.column("floor").to_numpy()[a:b]
                found = list(search(ids, v, floor, *block))
                if found:
                    row = np.repeat([f[0] for f in found], [len(f[1]) for f in found])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(ids[row]), batch.column("v").slice(a, b - a).take(pa.array(row)),
                         pa.array(np.concatenate([f[1] for f in found])), pa.array(np.concatenate([f[2] for f in found]))],
                        ["query_id", "q", "vec_id", "score"],
                    )

    met = dealt.mapInArrow(scan, "query_id long, q array<long>, vec_id long, score long")
    return met.select(
        "query_id", F.xxhash64("q").alias("q_key"), "vec_id", F.lit(0).alias("side"), F.lit("").alias("digits"), "score"
    )
