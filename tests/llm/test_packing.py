from __future__ import annotations

import random
import zlib
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pytest

from backdate.llm.common import tokenizer_path
from backdate.llm.packing import TOKENIZER, _Encoder, fullest, pack, plan_bins


@pytest.fixture(scope="module")
def encoder():
    return _Encoder(tokenizer_path(TOKENIZER))


def test_encoder_equals_the_tokenizer(encoder):
    texts = [
        "", "  ", "<|endoftext|> a", "x<|startoftext|>y", "İstanbul ΑΣ ΟΔΟΣ. Σ", "I'M don't 'S x'S '’s", "é ǅ ﬁ", "日本語 テスト 123 ４５",
        "a\x00b \x1c\x1d x\x85y a\x1cb", "Å ſ", "😀👨‍👩‍👧 !!!***", "<|endof text|>", "ÀÉ'Re", "﻿x ᠎ y", "ẞß ŉ ΐ", "a\x7fb \x01 ~~",
        " ́x ́", "the*** quick&&& 12.5%", " a b",
    ]
    for text in texts * 2:
        assert encoder.encode(text.encode()) == encoder.whole(text), repr(text)


def test_fullest_by_brute_force():
    rng = random.Random(11)
    for _ in range(200):
        counts = {rng.randrange(1, 30): rng.randrange(1, 4) for _ in range(rng.randrange(1, 5))}
        room = rng.randrange(0, 60)
        used = fullest(room, sorted(counts, reverse=True), counts)
        items = [s for s, n in counts.items() for _ in range(n)]
        best = max(t for k in range(len(items) + 1) for c in combinations(items, k) if (t := sum(c)) <= room)
        assert sum(s * n for s, n in used.items()) == best and all(n <= counts[s] for s, n in used.items())


def test_plan_uses_every_piece_once():
    rng = random.Random(12)
    counts = Counter(min(4096, int(rng.expovariate(1 / 400)) + 1) for _ in range(5000))
    plan = plan_bins(dict(counts))
    used = Counter()
    for combination, times in plan:
        assert sum(s * n for s, n in combination.items()) <= 4096
        for s, n in combination.items():
            used[s] += n * times
    assert used == counts and len(plan) <= len(counts)
    assert sum(t for _, t in plan) <= 1.005 * sum(s * n for s, n in counts.items()) / 4096 + 1


def test_pieces_lie_gapless(odd_docs, no_docs, encoder):
    got = pack(odd_docs, tokenizer_path(TOKENIZER)).collect()
    sequences, by_text = defaultdict(list), Counter()
    for r in got:
        sequences[r.sequence_id].append((r.offset, r.length))
    for own in sequences.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 4096
    for r in odd_docs.collect():
        ids = np.frombuffer(encoder.whole(r.text or ""), "<u4").tolist() + [1]
        for n, start in enumerate(range(0, len(ids), 4096)):
            part = np.array(ids[start : start + 4096], "<u4").tobytes()
            by_text[(r.doc_id, n, start, len(part) // 4, zlib.crc32(part))] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == by_text
    assert pack(no_docs, tokenizer_path(TOKENIZER)).count() == 0
