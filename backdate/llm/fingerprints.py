"""Hashes of words and word n-grams of a batch of texts, with numpy over the UTF-8 bytes.

A word is a run of bytes other than space and 9 to 13. Its hash is a polynomial
of its bytes modulo 2**64, then mixed; it depends on the word alone, so it is
the same in every process.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

IS_WORD = np.ones(256, bool)
IS_WORD[[32, 9, 10, 11, 12, 13]] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)
STEP = np.uint64(0xD1342543DE82EF95)
CHUNK_BYTES = 1 << 20

_powers: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose output bits all depend on all input bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power(base: int, n: int) -> np.ndarray:
    """Powers 0 .. n-1 of an odd base."""
    key = str(base)
    if key not in _powers or len(_powers[key]) < n:
        steps = np.full(max(n, CHUNK_BYTES + 1), np.uint64(base))
        steps[0] = 1
        _powers[key] = np.multiply.accumulate(steps)
    return _powers[key][:n]


@dataclass
class Words:
    """Words of some texts in order: hashes, the text each is in, its bytes' place, each text's first word."""

    hashes: np.ndarray
    text: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray  # one more than there are texts

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all strings of a column and where each begins; NULL is empty."""
    column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type)
    _, places, data = column.buffers()
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    places = np.frombuffer(places, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1]
    places = places.astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[places[0] : places[-1]], places - places[0]


def words_of(raw: np.ndarray, places: np.ndarray, lower: bool = False) -> Words:
    n, texts = len(raw), len(places) - 1
    if n == 0:
        none = np.zeros(0, np.int64)
        return Words(np.zeros(0, np.uint64), none, none, none, np.zeros(texts + 1, np.int64))
    if lower:
        raw = LOWER[raw]
    inside = IS_WORD[raw]
    edge = np.zeros(n + 1, bool)
    edge[places] = True
    before = np.zeros(n, bool)
    before[1:] = inside[:-1]
    start = np.flatnonzero(inside & (~before | edge[:-1]))
    after = np.zeros(n, bool)
    after[:-1] = inside[1:]
    end = np.flatnonzero(inside & (~after | edge[1:])) + 1
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * _power(BASE, n), out=sums[1:])
    hashes = (sums[end] - sums[start]) * _power(INVERSE, n)[start]
    hashes = mix(hashes + (end - start).astype(np.uint64) * STEP)
    first = np.searchsorted(start, places)
    text = np.repeat(np.arange(texts), np.diff(first))
    return Words(hashes, text, start, end, first.astype(np.int64))


def ngrams(words: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all n words in a row within one text, and the index of the first word of each."""
    count = len(words.hashes) - n + 1
    if count <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    total = np.zeros(count, np.uint64)
    for j in range(n):
        total = total * STEP + words.hashes[j : j + count]
    at = np.flatnonzero(words.text[:count] == words.text[n - 1 :])
    return mix(total[at]), at


def shingles(words: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Each text's set of n-grams, as (text, hash) in order; a text of 1 to n-1 words has one, all its words."""
    grams, at = ngrams(words, n)
    owner = words.text[at]
    extra, extra_owner = [], []
    for k in range(1, n):
        short = np.flatnonzero(words.counts == k)
        if len(short):
            total = np.full(len(short), np.uint64(k))
            for j in range(k):
                total = total * STEP + words.hashes[words.first[short] + j]
            extra.append(mix(total))
            extra_owner.append(short)
    grams, owner = np.concatenate([grams, *extra]), np.concatenate([owner, *extra_owner])
    order = np.lexsort((grams, owner))
    grams, owner = grams[order], owner[order]
    fresh = np.ones(len(grams), bool)
    fresh[1:] = (grams[1:] != grams[:-1]) | (owner[1:] != owner[:-1])
    return owner[fresh], grams[fresh]


def chunks(batch: pa.RecordBatch, column: str) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of a batch of about a megabyte of text each (a longer text alone), with their bytes and places."""
    raw, places = utf8(batch.column(column))
    at, n = 0, batch.num_rows
    while at < n:
        to = max(at + 1, int(np.searchsorted(places, places[at] + CHUNK_BYTES, "right")) - 1)
        to = min(to, n)
        yield batch.slice(at, to - at), raw[places[at] : places[to]], places[at : to + 1] - places[at]
        at = to


def signed(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint64).view(np.int64)
