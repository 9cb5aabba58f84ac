from __future__ import annotations

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from conftest_llm import sentence
from pyspark import SparkContext

from backdate.llm.scoring import AT_LEAST, AT_MOST, Shard, fill, levels_of, score_documents


def tokens(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").split() + ["\0end"]


def held(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 10 == 0


def brute(rows, strength=200.0):
    single, pair = Counter(), Counter()
    for i, t in rows:
        if not held(i):
            own = tokens(t)
            single.update(own)
            pair.update(zip(["\0end", *own], own))
    n, rest = sum(single.values()), sum(single.values()) + 0.1 * (len(single) + 1)
    for i, t in rows:
        own = tokens(t)
        base = sum(math.log10((single[w] + 0.1) / rest) for w in own)
        score = sum(math.log10((pair[v, w] + strength * (single[w] + 0.1) / rest) / (single[v] + strength)) for v, w in zip(["\0end", *own], own))
        yield i, held(i), len(own), sum(single[w] > 0 for w in own), n, base, score


@pytest.mark.parametrize("options", [{}, {"shard_bytes": 4000, "hot_words": 40, "pass_bytes": 8000}])
def test_scores_by_brute_force(make_docs, options):
    rng = random.Random(15)
    phrases = [sentence(rng, 6, 800) for _ in range(60)]
    rows = [(i, " ".join(rng.choice(phrases) for _ in range(rng.randrange(0, 12))).title(), "a") for i in range(400)]
    got = {r.doc_id: r for r in score_documents(make_docs(rows), **options).collect()}
    gain = 0.0
    for i, is_held, n, known, total, base, score in brute([r[:2] for r in rows]):
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (is_held, n, known, total)
        assert r.base_score == pytest.approx(base, rel=1e-9)
        # Levels round counts down by less than a half, false positives are rare.
        assert abs(r.score - score) / n < 0.25
        gain += (r.score - r.base_score) * is_held
    assert gain > 0


def test_the_filter_is_dealt_to_tasks_and_not_broadcast(make_docs, monkeypatch):
    rng = random.Random(16)
    docs = make_docs([(i, sentence(rng, 40, 3000), "a") for i in range(200)])
    sent, own = [], SparkContext.broadcast
    monkeypatch.setattr(SparkContext, "broadcast", lambda self, value: sent.append(value) or own(self, value))
    whole, cut = ({r.doc_id: r.score for r in score_documents(docs, **o).collect()} for o in ({}, {"shard_bytes": 1000}))
    assert whole == cut and len(whole) == 200
    assert all(len(value) == 2 and len(value[0]) < 3002 for value in sent) and len(sent) == 2  # the frequent words of each run


def test_a_block_gives_back_levels():
    rng = np.random.default_rng(2)
    keys = rng.integers(0, 1 << 62, 20_000).astype(np.uint64)
    counts = rng.geometric(0.2, len(keys))
    shard = Shard(3, [fill(keys[:10], levels_of(counts[:10])), fill(keys, levels_of(counts))])
    levels = np.zeros(len(keys), np.uint8)
    shard.probe(keys, np.full(len(keys), 4), levels)
    assert (AT_LEAST[levels] >= AT_LEAST[levels_of(counts)]).all()  # never too low
    assert (levels > levels_of(counts)).mean() < 0.03
    assert ((AT_LEAST[levels_of(counts)] <= counts) & (counts <= AT_MOST[levels_of(counts)])).all()
    absent = np.zeros(len(keys), np.uint8)
    shard.probe(keys + np.uint64(1), np.full(len(keys), 4), absent)
    assert (absent > 0).mean() < 0.03
    shard.probe(keys, np.full(len(keys), 2), absent := np.zeros(len(keys), np.uint8))
    assert not absent.any()  # a block of another shard


def test_keys_not_held_are_rarely_read_as_held():
    """About 1 in 120 probes."""
    rng = np.random.default_rng(3)
    keys = rng.integers(0, 1 << 62, 240_000).astype(np.uint64)
    shard = Shard(0, [fill(keys[:40_000], levels_of(rng.geometric(0.2, 40_000)))])
    levels = np.zeros(200_000, np.uint8)
    shard.probe(keys[40_000:], np.zeros(200_000, np.int64), levels)
    assert (levels > 0).mean() < 0.01


def test_odd_rows_and_empty_tables(odd_docs, no_docs):
    got = score_documents(odd_docs).collect()
    want = {(i, n, round(base, 6)) for i, _, n, _, _, base, _ in brute([(r.doc_id, r.text) for r in odd_docs.collect()])}
    assert len(got) == odd_docs.count() and {(r.doc_id, r.n_tokens, round(r.base_score, 6)) for r in got} == want
    assert score_documents(no_docs).count() == 0
    lone = score_documents(odd_docs.where("doc_id = 7")).collect()
    assert lone[0].n_tokens == 2 and math.isfinite(lone[0].score)
