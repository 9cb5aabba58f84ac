"""Packing documents into sequences by minimum bin slack.

The plan depends only on how many pieces there are of each length, at most as
many numbers as a sequence is long. For each bin, the longest piece left is
taken and a bitset subset-sum over the lengths left finds the fullest
combination with it; that combination is used as often as its lengths last, so
each step uses up a length and there are no more combinations than lengths,
however many documents there are. Spark then ranks the pieces within each
length and looks their places up.

Defined results: a NULL or empty text is one piece, the end id; repeated rows
are packed each; rows keep no order across sequences.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from backdate.llm.common import stored
from backdate.llm.fingerprints import utf8

LENGTH = 4096
END_ID = 1
TOKENIZER = "word_bpe_49k.json"
RANK_ROWS = 50_000  # rows of one length ranked in one task, about
MOST_WORDS = 1_000_000  # words whose ids a worker remembers

# How the tokenizer's own file splits normalised text, and the same for ASCII without white space.
SPLIT = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
SPLIT_ASCII = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^a-z0-9]+")


class _Encoder:
    """Ids of whole texts as bytes.

    Nothing in the tokenizer reaches across white space, so its ids of a text
    are those of the words in a row; a worker remembers the ids of words.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.marks = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.to_letters = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str
        self.words: dict[bytes, bytes] = {}
        self.parts: dict[str, bytes] = {}

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _part(self, part: str) -> bytes:
        letters = part if part.isascii() and part.isprintable() else self.to_letters(part)[0][0]
        ids = np.array([t.id for t in self.tokenizer.model.tokenize(letters)], "<u4").tobytes()
        if len(self.parts) >= MOST_WORDS:
            self.parts.clear()
        self.parts[part] = ids
        return ids

    def _word(self, word: bytes) -> bytes:
        text = word.decode()
        if any(m in text for m in self.marks):
            ids = self.whole(text)
        else:
            if text.isascii():
                parts = SPLIT_ASCII.findall(text.lower())
            else:
                parts = SPLIT.findall(self.tokenizer.normalizer.normalize_str(text))
            ids = b"".join([self.parts.get(p) or self._part(p) for p in parts])
        if len(self.words) >= MOST_WORDS:
            self.words.clear()
        self.words[word] = ids
        return ids

    def encode(self, text: bytes) -> bytes:
        # bytes.split parts at ASCII white space only, all of which the tokenizer drops.
        words, known = text.split(), self.words
        out = [known.get(w) for w in words]
        if None in out:
            out = [self._word(w) if e is None else e for w, e in zip(words, out, strict=True)]
        return b"".join(out)


@cache
def _encoder(path: str) -> _Encoder:
    return _Encoder(path)


def _pieces(path: str, length: int, end_id: int):
    end = np.array([end_id], "<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(path)
        for batch in batches:
            row, piece, start, size, crc = [], [], [], [], []
            raw, places = utf8(batch.column("text"))
            for i in range(batch.num_rows):
                ids = encoder.encode(raw[places[i] : places[i + 1]].tobytes()) + end
                for n, at in enumerate(range(0, len(ids), 4 * length)):
                    part = ids[at : at + 4 * length]
                    row.append(i)
                    piece.append(n)
                    start.append(at // 4)
                    size.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(row, pa.int32())), pa.array(piece, pa.int32()),
                 *[pa.array(c, pa.int64()) for c in (start, size, crc, row)]],
                ["doc_id", "piece", "start", "length", "ids_crc32", "row_no"],
            )

    return cut


def token_pieces(docs: DataFrame, path: str, length: int = LENGTH, end_id: int = END_ID) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32`` of the pieces of every document's ids, and the row's number in its batch."""
    return docs.select("doc_id", "text").mapInArrow(
        _pieces(path, length, end_id), "doc_id long, piece int, start long, length long, ids_crc32 long, row_no long"
    )


def fullest(room: int, lengths: list[int], counts: dict[int, int]) -> dict[int, int]:
    """The combination of lengths, each used at most as often as counted, that fills ``room`` best.

    ``lengths`` descend. A bitset of the sums within reach grows length by
    length, copies by doubling; the walk back reads off what made the best sum.
    """
    reach, full = 1, (1 << room + 1) - 1
    steps: list[tuple[int, int, int]] = []
    for size in lengths:
        if size > room:
            continue
        left, take = min(counts[size], room // size), 1
        while left > 0:
            take = min(take, left)
            steps.append((size, take, reach))
            reach |= reach << size * take & full
            left -= take
            take *= 2
        if reach >> room:
            break
    at, used = reach.bit_length() - 1, {}
    for size, take, before in reversed(steps):
        if not before >> at & 1:
            used[size] = used.get(size, 0) + take
            at -= size * take
    return used


def plan_bins(counts: dict[int, int], length: int = LENGTH) -> list[tuple[dict[int, int], int]]:
    """Combinations of lengths and how many bins have each."""
    left = {s: n for s, n in counts.items() if n > 0}
    lengths = sorted(left, reverse=True)
    plan = []
    while lengths:
        largest = lengths[0]
        left[largest] -= 1
        used = fullest(length - largest, [s for s in lengths if left[s] > 0], left)
        left[largest] += 1
        used[largest] = used.get(largest, 0) + 1
        times = min(left[s] // n for s, n in used.items())
        plan.append((used, times))
        for s, n in used.items():
            left[s] -= n * times
        lengths = [s for s in lengths if left[s] > 0]
    return plan


def _slots(plan: list[tuple[dict[int, int], int]]) -> list[tuple[int, int, int, int, int, int]]:
    """Per length and combination: ranks from and up to, first sequence, place of the first copy, copies in a sequence."""
    rows, ranked, sequence = [], {}, 0
    for used, times in plan:
        offset = 0
        for size in sorted(used, reverse=True):
            n = used[size]
            low = ranked.get(size, 0)
            rows.append((size, low, low + n * times, sequence, offset, n))
            ranked[size] = low + n * times
            offset += size * n
        sequence += times
    return rows


def ranked(pieces: DataFrame) -> DataFrame:
    """``rank`` of each piece among those of its length, from 0, by ranges of bounded size and their offsets."""
    n = pieces.agg(F.count(F.lit(1))).first()[0]
    salts = max(1, -(-n // RANK_ROWS))
    # The row number parts repeated rows, which may be many.
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "row_no"), F.lit(salts)).cast("int"))
    counts = salted.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n"))
    before = stored(counts.select("length", "salt", (F.sum("n").over(Window.partitionBy("length").orderBy("salt")) - F.col("n")).alias("before")))
    order = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")
    within = salted.withColumn("within", F.row_number().over(order) - 1)
    return within.join(before, ["length", "salt"]).select(
        "doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("within")).alias("rank")
    )


def pack(docs: DataFrame, path: str, length: int = LENGTH, end_id: int = END_ID) -> DataFrame:
    """Every piece with its ``sequence_id`` and ``offset``."""
    spark = docs.sparkSession
    pieces = stored(token_pieces(docs, path, length, end_id))
    # At most ``length`` rows come to the driver, and at most length * sqrt(2 * length) slots go back.
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    slots = spark.createDataFrame(
        _slots(plan_bins(counts, length)), "length long, low long, high long, first long, place long, copies long"
    )
    held = slots.groupBy("length").agg(F.array_sort(F.collect_list(F.struct("high", "low", "first", "place", "copies"))).alias("slots"))
    placed = ranked(pieces).join(F.broadcast(held), "length")
    slot = F.filter("slots", lambda s: (s["high"] > F.col("rank")) & (s["low"] <= F.col("rank")))[0]
    placed = placed.withColumn("slot", slot)
    nth = F.col("rank") - F.col("slot.low")
    return placed.select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        (F.col("slot.first") + F.floor(nth / F.col("slot.copies"))).cast("long").alias("sequence_id"),
        (F.col("slot.place") + (nth % F.col("slot.copies")) * F.col("length")).cast("long").alias("offset"),
    )
