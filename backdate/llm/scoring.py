"""Language-model scores from a log-frequency Bloom filter of n-gram counts.

A count c is kept as its level, 1 + floor(log_b c): the filter holds the n-gram
together with each level up to its own, and a reader probes level after level
until one is missing. Levels are cut off below, so a count read back is at most
the true one and above it divided by b, but for false positives.

The filter is cut by hash into blocks that tasks fill and into shards of bounded
size. Texts go in chunks; a chunk's distinct n-grams are dealt by shard to tasks that hold one shard
at a time, and their levels come back to the chunk. So no task and no broadcast grows with the
filter, and the driver sees none of it. The most frequent words, a bounded
table, are broadcast with their exact counts.

The score interpolates bigrams with single words: a word after another has
probability ``(c(v, w) + m * p(w)) / (c(v) + m)``, ``p(w)`` being the base
probability. With counts cut off below and ``c(v)`` read from above, a
distribution's sum stays at most 1 but for false positives.

Exact base scores count every word: frequent words locally, the others joined to
the stored counts by hash and summed per text.

Defined results: a NULL or empty text is its end token alone; a NULL id is not
held out; rows are scored one by one, whatever their ids; words are told apart
by 64-bit hashes, bigrams within a block by 32 more bits.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from backdate.llm.common import stored
from backdate.llm.fingerprints import Words, chunks, mix, signed, utf8, words_of

FOLDS, HELD_OUT = 10, 0
PRIOR = 0.1
LEVEL_BASE = 1.5
BITS_PER_ENTRY, PROBES = 10, 6  # about 1 false positive in 120 probes
BLOCK_TOKENS = 1 << 18  # bigrams of training text to a block, about
SHARD_BYTES = 16 << 20  # of the filter, to a shard
PASS_BYTES = 128 << 20  # of the filter, held by a worker at a time
ASKED_BYTES = 64 << 20  # of text whose n-grams a copy of a shard is read for, at least and about, to a shard of SHARD_BYTES
HOT_WORDS = 1 << 17
STRENGTH = 200.0  # m
END = np.uint64(0x5851F42D4C957F2D)  # the end token's hash; it is also what stands before a text
PAIR, LEVEL, PROBE = (np.uint64(x) for x in (0xA24BAED4963EE407, 0x9FB21C651E98DF25, 0xD6E8FEB86659FD93))
FLUSH_TOKENS = 1 << 20


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(FOLDS)) == HELD_OUT, F.lit(False))


def tokens_of(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes of texts in a row, each with its end token, and where each text begins."""
    hashes = np.insert(words.hashes, words.first[1:], END)
    return hashes, words.first + np.arange(len(words.first))


def pairs_of(tokens: np.ndarray) -> np.ndarray:
    """The hash of each token with the one before; before a text stands an end token."""
    before = np.concatenate([[END], tokens[:-1]]) if len(tokens) else tokens
    return mix(before * PAIR + tokens)


def _block(hashes: np.ndarray, bits: int) -> np.ndarray:
    return ((hashes >> np.uint64(1)) >> np.uint64(63 - bits)).astype(np.int64)


def _pair_key(hashes: np.ndarray) -> np.ndarray:
    return hashes & np.uint64(0xFFFFFFFF)


def levels_of(counts: np.ndarray) -> np.ndarray:
    return 1 + np.floor(np.log(counts) / math.log(LEVEL_BASE) + 1e-9).astype(np.int64)


# The least and the largest count of each level; level 0 is a count of 0.
AT_LEAST = np.r_[0, np.ceil(LEVEL_BASE ** np.arange(100) - 1e-6)]
AT_MOST = np.r_[0, np.ceil(LEVEL_BASE ** np.arange(1, 101) - 1e-6) - 1]


def _places(keys: np.ndarray, level, size) -> Iterator[np.ndarray]:
    """The bits of each key at a level, within its block of ``size`` bits."""
    first = mix(keys + np.uint64(level * int(LEVEL) % (1 << 64)))
    step = mix(first ^ PROBE) | np.uint64(1)
    for _ in range(PROBES):
        yield first % size
        first = first + step


def fill(keys: np.ndarray, levels: np.ndarray) -> bytes:
    """A block's bits holding each key with all levels up to its own."""
    size = max(64, -(-int(levels.sum()) * BITS_PER_ENTRY // 8) * 8)
    bits = np.zeros(size, bool)
    level = 1
    while len(keys):
        for at in _places(keys, level, np.uint64(size)):
            bits[at] = True
        level += 1
        more = levels >= level
        keys, levels = keys[more], levels[more]
    return np.packbits(bits, bitorder="little").tobytes()


class Shard:
    """Some of the filter's blocks, and reading levels from them."""

    def __init__(self, low: int, blocks: list[bytes]):
        self.low = low
        sizes = np.array([len(b) for b in blocks], np.int64)
        self.start = np.r_[0, np.cumsum(sizes)]
        self.bits = np.frombuffer(b"".join(blocks), np.uint8)

    def probe(self, keys: np.ndarray, block: np.ndarray, levels: np.ndarray) -> None:
        """Write the levels of the keys whose block is here."""
        own = np.flatnonzero((block >= self.low) & (block < self.low + len(self.start) - 1))
        keys, block = keys[own], block[own] - self.low
        start, size = self.start[block], ((self.start[block + 1] - self.start[block]) * 8).astype(np.uint64)
        level = 1
        while len(own) and level < len(AT_MOST):
            there = np.ones(len(own), bool)
            for at in _places(keys, level, size):
                left = np.flatnonzero(there)
                place = at[left].astype(np.int64)
                there[left] = self.bits[start[left] + (place >> 3)] >> (place & 7).astype(np.uint8) & 1
            own, keys, start, size = own[there], keys[there], start[there], size[there]
            levels[own] = level
            level += 1


def _gather(bits: int):
    """Counted words and pairs of each block, from texts of a few million tokens at a time."""

    def rows(tokens: list[np.ndarray], pairs: list[np.ndarray]) -> pa.RecordBatch:
        out = []
        edges = np.arange(1 << bits)
        for parts, to_key, kind in ((tokens, lambda h: h, "<u8"), (pairs, _pair_key, "<u4")):
            own, counts = np.unique(np.concatenate(parts), return_counts=True)
            at = np.r_[np.searchsorted(_block(own, bits), edges), len(own)]
            keys, counts = to_key(own).astype(kind), counts.astype("<u4")
            for x in (keys, counts):
                out.append(pa.array([x[a:b].tobytes() for a, b in zip(at[:-1], at[1:], strict=True)], pa.binary()))
        return pa.RecordBatch.from_arrays([pa.array(edges), *out], ["block", "words", "word_counts", "pairs", "pair_counts"])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, pairs, n = [], [], 0
        for batch in batches:
            for _, raw, places in chunks(batch, "text"):
                own, _ = tokens_of(words_of(raw, places, lower=True))
                tokens.append(own)
                pairs.append(pairs_of(own))
                n += len(own)
                if n >= FLUSH_TOKENS:
                    yield rows(tokens, pairs)
                    tokens, pairs, n = [], [], 0
        if n:
            yield rows(tokens, pairs)

    return gather


def _added(keys: pa.ChunkedArray, counts: pa.ChunkedArray, kind: str) -> tuple[np.ndarray, np.ndarray]:
    own = np.frombuffer(b"".join(keys.to_pylist()), kind)
    count = np.frombuffer(b"".join(counts.to_pylist()), "<u4")
    own, which = np.unique(own, return_inverse=True)
    total = np.zeros(len(own), np.int64)
    np.add.at(total, which, count)
    return own, total


def _reduce(group: pa.Table) -> pa.Table:
    words, word_counts = _added(group["words"], group["word_counts"], "<u8")
    pairs, pair_counts = _added(group["pairs"], group["pair_counts"], "<u4")
    keys = np.concatenate([words, pairs.astype(np.uint64)])
    bits = fill(keys, levels_of(np.concatenate([word_counts, pair_counts])))
    return pa.table({
        "block": group["block"][:1], "bits": pa.array([bits], pa.binary()), "n_bytes": pa.array([len(bits)], pa.int64()),
        "words": pa.array([signed(words).tolist()], pa.list_(pa.int64())), "counts": pa.array([word_counts.tolist()], pa.list_(pa.int64())),
    })


def train(docs: DataFrame) -> tuple[DataFrame, int]:
    """Stored blocks of the filter with their words' exact counts, and the number of bits of a block's number."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = max(0, math.ceil(math.log2(max(1, size / 6 / BLOCK_TOKENS))))
    gathered = docs.select("text").mapInArrow(
        _gather(bits), "block long, words binary, word_counts binary, pairs binary, pair_counts binary"
    )
    reduced = gathered.groupBy("block").applyInArrow(
        _reduce, "block long, bits binary, n_bytes long, words array<long>, counts array<long>"
    )
    return stored(reduced), bits


def shard_count(blocks: DataFrame, bits: int, most: int = SHARD_BYTES) -> tuple[int, int]:
    """Into how many shards of at most ``most`` bytes the filter goes, and how often each is sent."""
    total = blocks.agg(F.sum("n_bytes")).first()[0] or 0
    n = max(1, min(1 << bits, -(-total // most)))
    while True:
        largest = blocks.groupBy(_shard(F.col("block"), n, bits)).agg(F.sum("n_bytes").alias("n")).agg(F.max("n")).first()[0] or 0
        if largest <= most or n >= 1 << bits:
            break
        n = min(1 << bits, n * 2)
    copies = (6 * BLOCK_TOKENS << bits) // n // max(ASKED_BYTES, 4 * largest)
    return n, max(1, copies)


def _shard(block: Column, n: int, bits: int) -> Column:
    return F.floor(block * n / (1 << bits)).cast("int")


def frequent_words(counts: DataFrame, most: int = HOT_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Hashes, ascending, and counts of all words at least so frequent that at most ``most`` are."""
    steps = counts.groupBy(F.floor(F.log2("n") * 16).alias("step")).agg(F.count(F.lit(1)).alias("words")).orderBy(F.desc("step")).collect()
    seen, least = 0, None
    for r in steps:
        seen += r["words"]
        if seen > most:
            break
        least = r["step"]
    if least is None:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    rows = counts.where(F.floor(F.log2("n") * 16) >= least).collect()
    word = np.array([r["word"] for r in rows], np.int64).view(np.uint64)
    order = np.argsort(word)
    return word[order], np.array([r["n"] for r in rows], np.int64)[order]


def _chunked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each chunk of texts, named by its first text."""
    for batch in batches:
        for part, _, _ in chunks(batch, "text"):
            rows = pa.StructArray.from_arrays(part.columns, part.schema.names)
            yield pa.RecordBatch.from_arrays([part.column("row_no").slice(0, 1), pa.ListArray.from_arrays(pa.array([0, part.num_rows], pa.int32()), rows)], ["chunk", "rows"])


class _Chunk:
    """A chunk's tokens and their distinct pairs and words, ascending and so in the order of shards; frequent words have exact counts."""

    def __init__(self, rows: pa.StructArray, hot: np.ndarray):
        self.tokens, self.first = tokens_of(words_of(*utf8(rows.field("text")), lower=True))
        self.words, self.which = np.unique(self.tokens, return_inverse=True)
        self.pairs, self.back = np.unique(pairs_of(self.tokens), return_inverse=True)
        self.place = np.minimum(np.searchsorted(hot, self.words), max(0, len(hot) - 1))
        self.is_hot = hot[self.place] == self.words if len(hot) else np.zeros(len(self.words), bool)


def _rows_of(batch: pa.RecordBatch) -> Iterator[pa.StructArray]:
    column = batch.column("rows")
    at = column.offsets.to_numpy()
    for low, high in zip(at[:-1], at[1:], strict=True):
        yield column.values.slice(low, high - low)


def _asked(n: int, bits: int, hot_words: Broadcast):
    """The distinct words that are not frequent, and pairs, that each chunk asks of each shard."""
    edges = np.array([-(-(i << bits) // n) for i in range(n + 1)])

    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, rows in zip(batch.column("chunk").to_pylist(), _rows_of(batch), strict=True):
                own = _Chunk(rows, hot_words.value[0])
                own_words = own.words[~own.is_hot]
                at = [np.searchsorted(_block(k, bits), edges) for k in (own_words, own.pairs)]
                some = np.flatnonzero((np.diff(at[0]) > 0) | (np.diff(at[1]) > 0))
                # A pair is told by its block and 32 bits, and pairs are sent with how many are of each block.
                counts = np.bincount(_block(own.pairs, bits), minlength=1 << bits)
                sides = ((own_words, at[0], "<u8"), (_pair_key(own.pairs), at[1], "<u4"), (counts, edges, "<u4"))
                out = [pa.array([k[a[i] : a[i + 1]].astype(kind).tobytes() for i in some], pa.binary()) for k, a, kind in sides]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(some.astype(np.int32)), pa.array([chunk] * len(some), pa.int64()), *out], ["shard", "chunk", "words", "pairs", "n_pairs"]
                )

    return asked


def _probe(n: int, bits: int):
    """The levels of what is asked. Rows are sorted by shard, and a shard's blocks come first."""

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, blocks, shard = None, {}, None
        for batch in batches:
            out = []
            for r in (r for i in range(0, batch.num_rows, 64) for r in batch.slice(i, 64).to_pylist()):
                if (r["shard"], r["copy"]) != at:
                    at, blocks, shard = (r["shard"], r["copy"]), {}, None
                if r["bits"] is not None:
                    blocks[r["block"]] = r["bits"]
                    continue
                if shard is None:
                    low, high = (-(-(i << bits) // n) for i in (r["shard"], r["shard"] + 1))
                    shard, blocks = Shard(low, [blocks.get(b, bytes(8)) for b in range(low, high)]), {}
                words, pairs = np.frombuffer(r["words"], "<u8"), np.frombuffer(r["pairs"], "<u4").astype(np.uint64)
                levels = [np.zeros(len(keys), np.uint8) for keys in (words, pairs)]
                shard.probe(words, _block(words, bits), levels[0])
                shard.probe(pairs, np.repeat(np.arange(low, high), np.frombuffer(r["n_pairs"], "<u4")), levels[1])
                out.append((r["chunk"], r["shard"], *(x.tobytes() for x in levels)))
            cols = list(zip(*out, strict=True)) if out else [()] * 4
            kinds = (pa.int64(), pa.int32(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["chunk", "shard", "words", "pairs"])

    return probe


def _score(hot_words: Broadcast, last: dict):
    """Scores of the texts of each chunk, from the levels that came back."""

    def levels_in(batch: pa.RecordBatch) -> Iterator[tuple]:
        hot, hot_counts = hot_words.value
        for i, rows in enumerate(_rows_of(batch)):
            own = _Chunk(rows, hot)
            exact = np.where(own.is_hot, hot_counts[own.place], 0) if len(hot) else np.zeros(len(own.words), np.int64)
            found = batch.column("found")[i].as_py()
            of_words = np.zeros(len(own.words), np.uint8)
            of_words[~own.is_hot] = np.frombuffer(b"".join(x["words"] for x in found), np.uint8)
            of_pairs = np.frombuffer(b"".join(x["pairs"] for x in found), np.uint8)
            levels = np.array([of_words[own.which], of_pairs[own.back]])
            yield rows, own.tokens, own.first, levels, own.is_hot[own.which], exact[own.which]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = last["tokens"] + PRIOR * (last["distinct"] + 1)
        for batch in batches:
            for part, tokens, first, levels, is_hot, exact in levels_in(batch):
                low = np.where(is_hot, exact, AT_LEAST[levels[0]])
                high = np.where(is_hot, exact, AT_MOST[levels[0]])
                before = np.concatenate([[last["texts"]], high[:-1]])
                before[first[:-1]] = last["texts"]
                single = (low + PRIOR) / rest
                chance = (AT_LEAST[levels[1]] + STRENGTH * single) / (before + STRENGTH)
                total = np.add.reduceat(np.log10(np.minimum(chance, 1.0)), first[:-1])
                base = np.where(is_hot, np.log10((exact + PRIOR) / rest), 0.0)
                rare = np.flatnonzero(~is_hot)
                rare_at = np.searchsorted(rare, first)
                words, often = [], []
                for a, b in zip(rare_at[:-1], rare_at[1:], strict=True):
                    own, n = np.unique(tokens[rare[a:b]], return_counts=True)
                    words.append(signed(own))
                    often.append(n)
                n_tokens = np.diff(first)
                yield pa.RecordBatch.from_arrays(
                    [part.field("row_no"), part.field("doc_id"), part.field("held_out"), pa.array(n_tokens),
                     pa.array(np.add.reduceat(is_hot.astype(np.int64), first[:-1])), pa.array(np.add.reduceat(base, first[:-1])), pa.array(total),
                     pa.array(words, pa.list_(pa.int64())), pa.array(often, pa.list_(pa.int64()))],
                    ["row_no", "doc_id", "held_out", "n_tokens", "known", "base", "score", "words", "often"],
                )

    return score


def score_documents(
    docs: DataFrame, shard_bytes: int = SHARD_BYTES, hot_words: int = HOT_WORDS, pass_bytes: int = PASS_BYTES
) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` of every row of ``docs (doc_id, text)``."""
    spark = docs.sparkSession
    own = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), held_out(F.col("doc_id")).alias("held_out"))
    blocks, bits = train(own.where(~F.col("held_out")))
    counts = stored(blocks.select(F.inline(F.arrays_zip("words", "counts"))).toDF("word", "n"))
    n, distinct = counts.agg(F.sum("n"), F.count(F.lit(1))).first()
    n = n or 0
    end = counts.where(F.col("word") == int(signed(np.array([END]))[0])).first()
    hot = spark.sparkContext.broadcast(frequent_words(counts, hot_words))
    last = {"tokens": n, "distinct": distinct, "texts": end["n"] if end else 0}
    shards, copies = shard_count(blocks, bits, min(shard_bytes, pass_bytes))
    chunked = stored(own.select(F.monotonically_increasing_id().alias("row_no"), "doc_id", "held_out", "text").mapInArrow(
        _chunked, "chunk long, rows array<struct<row_no:long,doc_id:long,held_out:boolean,text:string>>"
    ))
    asked = chunked.mapInArrow(_asked(shards, bits, hot), "shard int, chunk long, words binary, pairs binary, n_pairs binary").withColumn(
        "copy", F.pmod(F.xxhash64("chunk"), F.lit(copies)).cast("int")
    )
    sent = blocks.select(
        _shard(F.col("block"), shards, bits).alias("shard"), F.explode(F.sequence(F.lit(0), F.lit(copies - 1))).alias("copy"), "block", "bits"
    )
    dealt = asked.unionByName(sent, allowMissingColumns=True).repartition("shard", "copy")
    dealt = dealt.sortWithinPartitions("shard", "copy", F.col("bits").isNull(), "block")
    found = dealt.mapInArrow(_probe(shards, bits), "chunk long, shard int, words binary, pairs binary")
    found = found.groupBy("chunk").agg(F.sort_array(F.collect_list(F.struct("shard", "words", "pairs"))).alias("found"))
    scored = stored(chunked.join(found, "chunk").select("rows", "found").mapInArrow(
        _score(hot, last),
        "row_no long, doc_id long, held_out boolean, n_tokens long, known long, base double, score double, "
        "words array<long>, often array<long>",
    ))
    asked = scored.select("row_no", F.inline(F.arrays_zip("words", "often"))).toDF("row_no", "word", "often")
    c = F.coalesce("n", F.lit(0))
    rare = asked.join(counts, "word", "left").groupBy("row_no").agg(
        F.sum(F.when(c > 0, F.col("often")).otherwise(0)).alias("rare_known"),
        F.sum(F.col("often") * F.log10((c + PRIOR) / (n + PRIOR * (distinct + 1)))).alias("rare_base"),
    )
    return scored.drop("words", "often").join(rare, "row_no", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"), (F.col("base") + F.coalesce("rare_base", F.lit(0.0))).alias("base_score"), "score",
    )
