"""Aligning two tokenizers' tokens over the same texts, and how often their tokens meet.

Each text is tokenised whole by both. Byte offsets at which tokens of both end are
shared ends; where both next tokens also begin with a space, the text is cut into
windows. A window is its two tuples of token ids, which is all its alignment depends
on, so a block of documents (about a megabyte of text) aligns a window once and
remembers it, however often it comes.

A document is then a list of windows, and its block holds each of these and each
pair of ids once. Counts of pairs are summed
over blocks, not over links, and looked up once per block and pair; the documents'
sums are taken from their windows where block and counts meet again. So what is
shuffled is a number per word of text and the distinct pairs of a block, and the best
count of each id of the second vocabulary is a table no longer than that vocabulary.

Defined results: a text that is NULL, empty, or whose tokens of either side do not
spell a space and the text (the second tokenizer writes spaces as U+2581, so a text
that holds one is such a text) has no tokens: zeros and ''. Texts without white space
are one window. Repeated rows are aligned and counted each; ids play no part.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from backdate.llm.common import stored
from backdate.llm.fingerprints import BASE, INVERSE, STEP, _power, chunks, mix

TOKENIZER_A = "byte_bpe_50k.json"
TOKENIZER_B = "piece_bpe_32k.model"
BLOCK_BYTES = 1 << 20
MEMO_BYTES = 36 << 20  # what a worker remembers of splits, and of units
ENTRY_BYTES = 200  # of a remembered split, besides its letters
SHIFT = 16  # a pair of ids is one number, the first id above the second
LOW = (1 << SHIFT) - 1
DIGEST = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def byte_letters() -> dict[str, int]:
    """The byte of each letter of a byte-level vocabulary: printable Latin-1 is itself, the others follow from 256."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + n): b for n, b in enumerate(others)}


# How the first tokenizer's file splits texts, for letters up to U+024F and general punctuation, where classes are settled.
SETTLED = re.compile("[\x00-\u024f\u2000-\u206f]*")
_SPACE = "\\t-\\r \x85\xa0\u2000-\u200a\u2028\u2029\u202f\u205f"
_LETTER = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u024f"
_NUMBER = "0-9\xb2\xb3\xb9\xbc-\xbe"
SPLIT = re.compile(
    f"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTER}]+| ?[{_NUMBER}]+| ?[^{_SPACE}{_LETTER}{_NUMBER}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+"
)


UNIT = re.compile(" *[^ ]+| +")


class _Bytes:
    """The byte-level tokenizer, of a space and the text. Its model never looks across a split, so splits are remembered."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        letters = byte_letters()
        self.letters = {b: c for c, b in letters.items()}
        self.tokens = [b""] * self.tokenizer.get_vocab_size()
        for token, i in self.tokenizer.get_vocab().items():
            self.tokens[i] = bytes(letters[c] for c in token) if all(c in letters for c in token) else token.encode()
        self.known: dict[str, bytes] = {}
        self.held = 0

    def _split(self, part: str) -> bytes:
        letters = "".join([self.letters[b] for b in part.encode()])
        ids = np.array([t.id for t in self.tokenizer.model.tokenize(letters)], np.uint16).tobytes()
        self.held += ENTRY_BYTES + len(part)
        if self.held > MEMO_BYTES:
            self.known.clear()
            self.held = 0
        self.known[part] = ids
        return ids

    def ids_of(self, texts: list[str]) -> list[np.ndarray]:
        out, known = [], self.known
        for text in texts:
            text = " " + text
            if SETTLED.fullmatch(text):
                parts = SPLIT.findall(text)
                ids = b"".join([known.get(p) or self._split(p) for p in parts])
                out.append(np.frombuffer(ids, np.uint16))
            else:
                out.append(np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint16))
        return out


class _Pieces:
    """The tokenizer of pieces, of a space and the text. No piece goes on past a letter into a space, so units are remembered."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self.model = SentencePieceProcessor(model_file=path)
        names = [self.model.id_to_piece(i) for i in range(self.model.vocab_size())]
        if any("\u2581" in name.lstrip("\u2581") for name in names):
            raise ValueError("a piece reaches into the next word")
        self.tokens = [
            bytes([int(name[3:5], 16)]) if self.model.is_byte(i) else name.replace("\u2581", " ").encode()
            for i, name in enumerate(names)
        ]
        self.known: dict[str, bytes] = {}
        self.held = 0

    def ids_of(self, texts: list[str]) -> list[np.ndarray]:
        if self.held > MEMO_BYTES:
            self.known.clear()
            self.held = 0
        units = [UNIT.findall(" " + text) if text else [] for text in texts]
        new = list({u for own in units for u in own if u not in self.known})
        # The model puts a unit's first space there itself; of a text that is nothing else it makes no piece.
        for unit, ids in zip(new, self.model.encode([u[1:] for u in new], out_type=int, num_threads=1), strict=True):
            self.known[unit] = np.array(ids if unit != " " else [self.model.piece_to_id("\u2581")], np.uint16).tobytes()
            self.held += ENTRY_BYTES + len(unit)
        return [np.frombuffer(b"".join(map(self.known.__getitem__, own)), np.uint16) for own in units]


def run_hashes(ids: np.ndarray, start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """A hash of each run of ids, from sums over all that are shifted to the run's start."""
    sums = np.zeros(len(ids) + 1, np.uint64)
    np.cumsum((ids.astype(np.uint64) + np.uint64(1)) * _power(BASE, len(ids)), out=sums[1:])
    return mix((sums[start + n] - sums[start]) * _power(INVERSE, len(ids) + 1)[start] + n.astype(np.uint64))


@dataclass
class Windows:
    """Windows laid end to end: the ids of both sides, and how many of them each window has."""

    a: np.ndarray
    b: np.ndarray
    n_a: np.ndarray
    n_b: np.ndarray

    def take(self, rows: np.ndarray) -> Windows:
        sides = []
        for ids, n in ((self.a, self.n_a), (self.b, self.n_b)):
            shift = (np.cumsum(n) - n)[rows] - (np.cumsum(n[rows]) - n[rows])
            sides.append(ids[np.arange(n[rows].sum()) + np.repeat(shift, n[rows])])
        return Windows(*sides, self.n_a[rows], self.n_b[rows])

    def distinct(self) -> tuple[np.ndarray, np.ndarray]:
        """The rows of the first of each pair of id tuples, and which of these every window is."""
        key = np.zeros(len(self.n_a), np.uint64)
        for ids, n in ((self.a, self.n_a), (self.b, self.n_b)):
            key = mix(key * STEP + run_hashes(ids, np.cumsum(n) - n, n))
        _, first, same = np.unique(key, return_index=True, return_inverse=True)
        again = self.take(first[same])
        if all(np.array_equal(getattr(self, c), getattr(again, c)) for c in ("n_a", "n_b", "a", "b")):
            return first, same
        # Two tuples had one hash: compare the tuples themselves.
        ends = zip(np.cumsum(self.n_a).tolist(), self.n_a.tolist(), np.cumsum(self.n_b).tolist(), self.n_b.tolist(), strict=True)
        known: dict[tuple[bytes, bytes], int] = {}
        same = np.array([known.setdefault((self.a[i - n : i].tobytes(), self.b[j - m : j].tobytes()), len(known)) for i, n, j, m in ends])
        return np.unique(same, return_index=True)[1], same


def align(windows: Windows, size_a: np.ndarray, size_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How many links each window has, and all their pairs in order.

    Both sides of a window cover the same bytes, so laid end to end every piece
    between two neighbouring ends, of whichever side, is one link.
    """
    a, b = windows.a.astype(np.int64), windows.b.astype(np.int64)
    ends_a, ends_b = np.cumsum(size_a[a]), np.cumsum(size_b[b])
    ends = np.union1d(ends_a, ends_b)
    pairs = a[np.searchsorted(ends_a, ends)] << SHIFT | b[np.searchsorted(ends_b, ends)]
    window_ends = ends_a[np.cumsum(windows.n_a) - 1]
    return np.diff(np.searchsorted(ends, window_ends, "right"), prepend=0), pairs


class Aligner:
    """Both tokenizers, and the windows and groups of texts."""

    def __init__(self, path_a: str, path_b: str):
        self.a, self.b = _Bytes(path_a), _Pieces(path_b)
        for side in (self.a, self.b):
            if len(side.tokens) > LOW + 1:
                raise ValueError("vocabularies of up to 65,536 ids")
        self.size_a, self.size_b = (np.array([len(t) for t in side.tokens], np.int64) for side in (self.a, self.b))
        self.spaced_a, self.spaced_b = (np.array([t[:1] == b" " for t in side.tokens]) for side in (self.a, self.b))
        # An id as it stands in the text of the groups: inside or at the end of its side of a group.
        self.written = [f"{i}{mark}" for side, marks in ((self.a, ",|"), (self.b, ",;")) for mark in marks for i in range(len(side.tokens))]

    def cut(self, text: str, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, int, str] | None:
        """How many ids of either side each window has, the number of groups, and the groups as text; None if the tokens do not spell it."""
        if not text or not len(a) or not len(b):
            return None
        spelt = b" " + text.encode()
        for side, ids in ((self.a, a), (self.b, b)):
            if b"".join(map(side.tokens.__getitem__, ids.tolist())) != spelt:
                return None
        ends_a, ends_b = np.cumsum(self.size_a[a]), np.cumsum(self.size_b[b])
        at = np.searchsorted(ends_b, ends_a)  # both end at the text's end
        last_a = np.flatnonzero(ends_b[at] == ends_a)
        last_b = at[last_a]
        inner = self.spaced_a[a[last_a[:-1] + 1]] & self.spaced_b[b[last_b[:-1] + 1]]
        cut = np.append(np.flatnonzero(inner), len(last_a) - 1)
        n_a, n_b = (np.diff(last[cut], prepend=-1) for last in (last_a, last_b))
        return n_a, n_b, len(last_a), self._groups(a, b, last_a, last_b)

    def _groups(self, a: np.ndarray, b: np.ndarray, last_a: np.ndarray, last_b: np.ndarray) -> str:
        ids = [a.astype(np.int64), b.astype(np.int64) + 2 * len(self.a.tokens)]
        for tokens, side, last in ((self.a.tokens, ids[0], last_a), (self.b.tokens, ids[1], last_b)):
            side[last] += len(tokens)
        # A token comes after its own side's earlier tokens and those of the other side up to its group.
        order = np.empty(len(a) + len(b), np.int64)
        order[np.arange(len(a)) + np.repeat(np.append(0, last_b[:-1] + 1), np.diff(last_a, prepend=-1))] = ids[0]
        order[np.arange(len(b)) + np.repeat(last_a + 1, np.diff(last_b, prepend=-1))] = ids[1]
        return "".join(map(self.written.__getitem__, order.tolist()))[:-1]


@cache
def _aligner(path_a: str, path_b: str) -> Aligner:
    return Aligner(path_a, path_b)


class _Block:
    """Documents of about a megabyte of text and the windows they are made of, each aligned and held once."""

    def __init__(self, number: int):
        self.number, self.bytes = number, 0
        self.docs: list[tuple] = []
        self.windows: list[tuple[np.ndarray, ...]] = []

    def add(self, aligner: Aligner, ids: list[int | None], texts: list[str]) -> None:
        for doc_id, text, a, b in zip(ids, texts, aligner.a.ids_of(texts), aligner.b.ids_of(texts), strict=True):
            got = aligner.cut(text, a, b)
            if got is None:
                self.docs.append((doc_id, 0, 0, 0, 0, 0, ""))
            else:
                n_a, n_b, n_groups, groups = got
                self.windows.append((a, b, n_a, n_b))
                self.docs.append((doc_id, len(a), len(b), n_groups, len(a) + len(b) - n_groups, len(n_a), groups))
            self.bytes += len(text)

    def batch(self, aligner: Aligner) -> pa.RecordBatch:
        """A row per document, and one last row with the block's windows and pairs."""
        n, nothing = len(self.docs), (np.zeros(0, np.uint16), np.zeros(0, np.uint16), np.zeros(0, np.int64), np.zeros(0, np.int64))
        windows = Windows(*[np.concatenate(c) for c in zip(nothing, *self.windows, strict=True)])
        first, flat = windows.distinct()
        links, codes = align(windows.take(first), aligner.size_a, aligner.size_b)
        pairs, place = np.unique(codes, return_inverse=True)
        counts = np.bincount(place, np.repeat(np.bincount(flat, minlength=len(links)), links), len(pairs)).astype(np.int64)
        *numbers, sizes, groups = (list(c) for c in zip(*self.docs, strict=True))
        ends = np.append(0, np.cumsum(sizes))

        def last(values: np.ndarray, kind: pa.DataType) -> pa.Array:
            """A list column that only the last row has."""
            nulls = pa.nulls(n, pa.list_(kind))
            return pa.concat_arrays([nulls, pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), pa.array(values, kind))])

        places = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int32()))
        return pa.RecordBatch.from_arrays([
            pa.array(np.full(n + 1, self.number), pa.int64()),
            pa.array([True] * n + [False]),
            *[pa.array([*c, None], pa.int64()) for c in numbers],
            pa.array([*groups, None], pa.string()),
            pa.concat_arrays([places, pa.nulls(1, places.type)]),
            last(pairs, pa.int64()), last(counts, pa.int64()), last(np.cumsum(links) - links, pa.int32()), last(place, pa.int32()),
        ], ALIGNED_NAMES)


def summed(of: np.ndarray, flat: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sums of ``of[flat]`` between each end and the next."""
    total = np.zeros(len(flat) + 1, np.int64)
    np.cumsum(of[flat], out=total[1:])
    return total[ends[1:]] - total[ends[:-1]]


ALIGNED = (
    "block long, is_doc boolean, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups string, windows array<int>, "
    "pairs array<long>, counts array<long>, starts array<int>, places array<int>"
)
ALIGNED_NAMES = [c.split()[0] for c in ALIGNED.split(", ")]


def _aligned(path_a: str, path_b: str, block_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = _aligner(path_a, path_b)
        # The same rows make the same blocks when a task is run again.
        number = TaskContext.get().partitionId() << 32
        block = _Block(number)
        for batch in batches:
            for part, _, places in chunks(batch, "text"):
                ids, texts = part.column("doc_id").to_pylist(), part.column("text").fill_null("").to_pylist()
                # Blocks smaller than a chunk cut it.
                cuts = [0, *(np.flatnonzero(np.diff(places // block_bytes)) + 1).tolist()]
                for at, to in zip(cuts, [*cuts[1:], len(texts)], strict=True):
                    if at == to:
                        continue
                    block.add(aligner, ids[at:to], texts[at:to])
                    if block.bytes >= block_bytes:
                        yield block.batch(aligner)
                        number += 1
                        block = _Block(number)
        if block.docs:
            yield block.batch(aligner)

    return run


def aligned_blocks(docs: DataFrame, path_a: str, path_b: str, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Every document with its ``groups`` as text, and every block's windows and pairs; see :data:`ALIGNED`.

    ``windows`` of a document are indexes into its block's ``starts``, which are
    indexes into ``places``, which are indexes into ``pairs`` and ``counts`` (the
    block's distinct linked pairs and how many links hold each).
    """
    return docs.select("doc_id", "text").mapInArrow(_aligned(path_a, path_b, block_bytes), ALIGNED)


def token_groups(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """``doc_id, n_a, n_b, n_groups, n_links, groups`` of every row; groups as ``a1,a2|b1;a3|b2,b3`` in order."""
    return aligned_blocks(docs, path_a, path_b).where("is_doc").select("doc_id", "n_a", "n_b", "n_groups", "n_links", "groups")


def pair_counts(blocks: DataFrame) -> DataFrame:
    """``pair, a, b, count, best``: links of each pair of ids, and whether no other pair of its ``b`` has more."""
    held = blocks.where("NOT is_doc").select(F.explode(F.arrays_zip("pairs", "counts")).alias("of"))
    counts = held.groupBy(F.col("of.pairs").alias("pair")).agg(F.sum("of.counts").alias("count"))
    counts = stored(counts.select("pair", F.shiftright("pair", SHIFT).alias("a"), F.col("pair").bitwiseAND(LOW).alias("b"), "count"))
    most = counts.groupBy("b").agg(F.max("count").alias("most"))  # a row for each id at most, so 65,536
    return counts.join(F.broadcast(most), "b").select("pair", "a", "b", "count", (F.col("count") == F.col("most")).alias("best"))


def _sums(docs: pa.Table, looked_up: pa.Table) -> pa.Table:
    order = np.argsort(looked_up.column("pair").to_numpy())
    count, best = (looked_up.column(c).to_numpy()[order].astype(np.int64) for c in ("count", "best"))
    is_doc = docs.column("is_doc").to_numpy()
    block = docs.filter(pa.array(~is_doc))
    rows = docs.filter(pa.array(is_doc))
    starts, places = (block.column(c).combine_chunks().flatten().to_numpy() for c in ("starts", "places"))
    per_window = [np.add.reduceat(of[places], starts) if len(starts) else np.zeros(0, np.int64) for of in (best, count)]
    windows = rows.column("windows").combine_chunks()
    flat, ends = windows.flatten().to_numpy(), np.append(0, np.cumsum(windows.value_lengths().to_numpy()))
    sums = [pa.array(summed(of, flat, ends)) for of in per_window]
    kept = {c: rows.column(c) for c in DIGEST if c not in ("n_best", "count_sum")}
    return pa.table({**kept, "n_best": sums[0], "count_sum": sums[1]}).select(DIGEST)


def alignment_digest(docs: DataFrame, path_a: str, path_b: str, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """:data:`DIGEST` of every row."""
    digest = F.when(F.col("groups") == "", "").otherwise(F.sha2(F.col("groups").cast("binary"), 256))
    blocks = aligned_blocks(docs, path_a, path_b, block_bytes)
    blocks = stored(blocks.withColumn("groups_sha256", digest).drop("groups"))
    # A new name parts this side's column from the other's.
    own = blocks.where("NOT is_doc").select(F.col("block").alias("of_block"), F.explode("pairs").alias("pair"))
    looked_up = own.join(pair_counts(blocks).select("pair", "count", "best"), "pair")
    rows = blocks.select("block", "is_doc", *[c for c in DIGEST if c not in ("n_best", "count_sum")], "windows", "starts", "places")
    return rows.groupBy("block").cogroup(looked_up.groupBy("of_block")).applyInArrow(
        _sums, "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
    )
