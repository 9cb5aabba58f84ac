"""How five filters interact: survivors of every subset of them, from one word per document.

A document fails some of the five conditions. Of the 32 subsets of filters it
survives those that hold none of its failures, which is one 32-bit truth-table
word. The survivors of all subsets at once are the positional popcounts of these
words, counted by carry-save adders: three words of one weight become a sum of
that weight and a carry of twice the weight, until a few words per weight are left.
Words are counted per batch, part and label; Spark adds the counts.

Any order of filters can be read off the subset counts, since what is left after
some filters does not depend on their order; so the 120 orders cost nothing more.

Documents are compared for equal texts by 128-bit hashes, taken as free of
collisions. Texts with very many copies (at most ``heavy.MOST`` of them) meet their
least id by broadcast; the groups that are shuffled are of bounded size.

Defined results: a NULL text is the empty one; a NULL source is the part ''; a row
with a NULL id is never later than another and has no labels; rows of one id are
judged each, none a copy of the other; a document is good or toxic if any of its
label rows says so. An empty table has no parts.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, permutations
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from backdate.llm.common import stored
from backdate.llm.fingerprints import chunks, words_of
from backdate.llm.heavy import FLOOR, MOST, text_key

FILTERS = "ABCDE"
SUBSETS = 1 << len(FILTERS)
LEAST_WORDS = 50
SYMBOLS = b"#$%&*|"
COPY = 1 << FILTERS.index("E")
KINDS = ("all", "good", "toxic")
ID_SALTS = 64

# Bit s of word f: a document failing f survives the filters s.
SURVIVAL = np.array([sum(1 << s for s in range(SUBSETS) if not f & s) for f in range(SUBSETS)], np.uint32)

_IS_SYMBOL = np.zeros(256, bool)
_IS_SYMBOL[list(SYMBOLS)] = True


def text_failures(raw: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Failures of the conditions A to D for texts as bytes."""
    words, n = words_of(raw, places), len(places) - 1
    order = np.lexsort((words.hashes, words.text))
    hashes, text = words.hashes[order], words.text[order]
    fresh = np.ones(len(hashes), bool)
    fresh[1:] = (hashes[1:] != hashes[:-1]) | (text[1:] != text[:-1])
    distinct = np.bincount(text[fresh], minlength=n)

    def inside(mark: np.ndarray) -> np.ndarray:
        total = np.zeros(len(raw) + 1, np.int64)
        np.cumsum(mark, out=total[1:])
        return total[places[1:]] - total[places[:-1]]

    points, capitals = inside((raw & 0xC0) != 0x80), inside((raw >= 65) & (raw <= 90))
    return (
        (words.counts < LEAST_WORDS)
        | (100 * distinct < 65 * words.counts) << 1
        | (100 * capitals > 5 * points) << 2
        | (inside(_IS_SYMBOL[raw]) > 0) << 3
    ).astype(np.int32)


def _judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, raw, places in chunks(batch, "text"):
            salt = np.arange(part.num_rows, dtype=np.int32) % ID_SALTS
            yield pa.RecordBatch.from_arrays(
                [*[part.column(c) for c in ("doc_id", "part", "h1", "h2")], pa.array(text_failures(raw, places), pa.int32()), pa.array(salt)],
                ["doc_id", "part", "h1", "h2", "failed", "salt"],
            )


def with_copies(judged: DataFrame) -> DataFrame:
    """``failed`` with the bit of E: a smaller id has the same text. ``judged`` is stored and read several times."""
    limit = max(FLOOR, judged.count() // MOST)
    least = judged.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("least")).where(F.col("n") > 1)
    least = stored(least)
    often, seldom = least.where(F.col("n") > limit), least.where(F.col("n") <= limit)  # often: at most MOST rows
    keys = ["h1", "h2"]
    met = judged.join(F.broadcast(often), keys).select(*judged.columns, "least")
    rest = judged.join(F.broadcast(often.select(*keys)), keys, "left_anti").join(seldom, keys, "left_outer")
    copied = F.coalesce(F.col("doc_id") > F.col("least"), F.lit(False))
    return met.unionByName(rest.select(*judged.columns, "least")).select(
        "doc_id", "salt", "part", (F.col("failed") + F.when(copied, COPY).otherwise(0)).alias("failed")
    )


def with_labels(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """``good`` and ``toxic`` of each row. NULL ids, which have no labels, are spread instead of meeting in one task."""
    own = labels.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(
        *[F.coalesce(F.max(F.col(c) == 1), F.lit(False)).alias(name) for c, name in (("quality", "good"), ("toxic", "toxic"))]
    ).withColumn("salt", F.lit(0))
    spread = F.when(F.col("doc_id").isNull(), F.col("salt")).otherwise(0)
    met = rows.withColumn("salt", spread).join(own, ["doc_id", "salt"], "left_outer")
    return met.select("part", "failed", *[F.coalesce(c, F.lit(False)).alias(c) for c in ("good", "toxic")])


def positional_popcount(words: np.ndarray) -> np.ndarray:
    """How many of the 32-bit words have each bit, by carry-save addition."""
    counts, weight, level = np.zeros(32, np.int64), 1, words.astype(np.uint32)
    while len(level):
        carries = []
        while len(level) > 2:
            third = len(level) // 3
            a, b, c = level[:third], level[third : 2 * third], level[2 * third : 3 * third]
            half = a ^ b
            carries.append((a & b) | (c & half))
            level = np.concatenate([half ^ c, level[3 * third :]])
        for word in level:
            counts += weight * ((int(word) >> np.arange(32)) & 1)
        level, weight = np.concatenate(carries) if carries else level[:0], 2 * weight
    return counts


COUNTS = [f"{kind}_{s}" for kind in KINDS for s in range(SUBSETS)]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        words = SURVIVAL[batch.column("failed").to_numpy()]
        labelled = [np.ones(len(words), bool)] + [
            batch.column(c).to_numpy(zero_copy_only=False).astype(bool) for c in ("good", "toxic")
        ]
        parts = batch.column("part").dictionary_encode()
        code = parts.indices.to_numpy()
        order = np.argsort(code, kind="stable")
        at = np.searchsorted(code[order], np.arange(len(parts.dictionary) + 1))
        out = np.zeros((len(parts.dictionary), len(COUNTS)), np.int64)
        for p in range(len(parts.dictionary)):
            rows = order[at[p] : at[p + 1]]
            out[p] = np.concatenate([positional_popcount(words[rows[own[rows]]]) for own in labelled])
        yield pa.RecordBatch.from_arrays(
            [parts.dictionary.cast(pa.string()), *[pa.array(c, pa.int64()) for c in out.T]], ["part", *COUNTS]
        )


def subset_survivors(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per ``part`` the arrays ``all``, ``good`` and ``toxic``: how many documents survive each of the 32 subsets."""
    h1, h2 = text_key(F.col("text"))
    rows = docs.select("doc_id", F.coalesce("source", F.lit("")).alias("part"), h1.alias("h1"), h2.alias("h2"), "text")
    judged = stored(rows.mapInArrow(_judge, "doc_id long, part string, h1 long, h2 long, failed int, salt int"))
    words = with_labels(with_copies(judged), labels)
    counted = words.mapInArrow(_count, "part string, " + ", ".join(f"{c} long" for c in COUNTS))
    sums = counted.groupBy("part").agg(*[F.sum(c).alias(c) for c in COUNTS])
    return sums.select("part", *[F.array(*[F.col(f"{kind}_{s}") for s in range(SUBSETS)]).alias(kind) for kind in KINDS])


def _at(kind: str, subset: Column | int) -> Column:
    return F.get(kind, subset if isinstance(subset, Column) else F.lit(subset))


def _shapley(f: int) -> Column:
    """What filter f removes, over all orders: the sets before it, by the number of orders that have them there."""
    n, bit = len(FILTERS), 1 << f
    others = [1 << i for i in range(n) if i != f]
    return sum(
        (factorial(k) * factorial(n - 1 - k) * (_at("all", sum(s)) - _at("all", sum(s) + bit))
         for k in range(n) for s in combinations(others, k)),
        F.lit(0),
    )


def filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per part, order of the filters and step, with what the step's filter does there."""
    n, whole = len(FILTERS), SUBSETS - 1
    orders = F.array(*[F.lit("".join(p)) for p in permutations(FILTERS)])
    by_part = subset_survivors(docs, labels).withColumn("shapley", F.array(*[_shapley(f) for f in range(n)]))
    steps = by_part.withColumn("filter_order", F.explode(orders)).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(n))))
    place = [F.locate(c, F.col("filter_order")) for c in FILTERS]
    before = sum((F.when(p < F.col("step"), 1 << i).otherwise(0) for i, p in enumerate(place)), F.lit(0))
    steps = steps.select(
        "*", before.alias("before"), F.expr(f"locate(substr(filter_order, step, 1), '{FILTERS}') - 1").alias("f")
    ).withColumn("bit", F.expr("CAST(shiftleft(1, f) AS INT)"))
    after = F.col("before") + F.col("bit")
    removed = _at("all", F.col("before")) - _at("all", after)
    long = {
        "kept": _at("all", after),
        "removed": removed,
        "redundant": _at("all", 0) - _at("all", F.col("bit")) - removed,
        "unique_fails": _at("all", F.lit(whole) - F.col("bit")) - _at("all", whole),
        "good_lost": _at("good", F.col("before")) - _at("good", after),
        "toxic_lost": _at("toxic", F.col("before")) - _at("toxic", after),
        "shapley": F.get("shapley", F.col("f")),
    }
    return steps.select("part", "filter_order", "step", *[c.cast("long").alias(name) for name, c in long.items()])
