from __future__ import annotations

import random
import re
from collections import Counter
from itertools import permutations

import numpy as np
import pytest
from conftest_llm import sentence

from backdate.llm import filter_audit as op
from backdate.llm.filter_audit import filter_audit, positional_popcount, text_failures

LABELS = "doc_id long, quality int, toxic int, part string, failed int"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def failures(text):
    words = WORD.findall(text)
    return {c for c, bad in (
        ("A", len(words) < 50), ("B", 100 * len(set(words)) < 65 * len(words)),
        ("C", 100 * len(re.findall("[A-Z]", text)) > 5 * len(text)), ("D", bool(re.search("[#$%&*|]", text))),
    ) if bad}


def brute(rows, labels):
    """Rows of the audit by applying every order of filters to every document."""
    least = {}
    for i, text, _ in rows:
        if i is not None:
            least[text or ""] = min(i, least.get(text or "", i))
    good = {i for i, q, _ in labels if i is not None and q == 1}
    toxic = {i for i, _, t in labels if i is not None and t == 1}
    judged = []
    for i, text, source in rows:
        failed = failures(text or "")
        if i is not None and i > least[text or ""]:
            failed.add("E")
        judged.append((source or "", frozenset(failed), i in good, i in toxic))
    groups, out = Counter(judged), set()
    for part in {g[0] for g in groups}:
        own, shapley, lines = [(g, n) for g, n in groups.items() if g[0] == part], Counter(), []
        for order in permutations("ABCDE"):
            left = own
            for step, f in enumerate(order, 1):
                fails = [(g, n) for g, n in left if f in g[1]]
                left = [(g, n) for g, n in left if f not in g[1]]
                removed, failing = sum(n for _, n in fails), sum(n for g, n in own if f in g[1])
                shapley[f] += removed
                lines.append(("".join(order), step, f, sum(n for _, n in left), removed, failing - removed,
                              sum(n for g, n in own if g[1] == {f}), sum(n for g, n in fails if g[2]), sum(n for g, n in fails if g[3])))
        out |= {(part, o, s, *rest, shapley[f]) for o, s, f, *rest in lines}
    return out


def run(docs, labels):
    rows = filter_audit(docs, labels).collect()
    got = {(r.part, r.filter_order, r.step, r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in rows}
    assert len(got) == len(rows)
    return got


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(43)
    rows = []
    for i in range(600):
        text = sentence(rng, rng.choice([10, 49, 50, 51, 90]), rng.choice([8, 60, 4000]))
        if rng.random() < 0.3:
            text = text.upper()
        if rng.random() < 0.3:
            text += rng.choice([" 50%", " a|b", " ok-", " é", " #"])
        rows.append((i, text, rng.choice(["web", "news", None, ""])))
    rows += [(1000 + i, rows[rng.randrange(30)][1], f"copies{i % 2}") for i in range(200)]
    rng.shuffle(rows)
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in range(0, 1200, 2)]
    return rows, labels + labels[:50] + [(None, 1, 1), (77, 1, 0), (77, 0, 1)]


@pytest.mark.parametrize("floor", [1000, 3])
def test_audit_by_brute_force(spark, make_docs, corpus, monkeypatch, floor):
    """Also with the groups of copies met by broadcast."""
    monkeypatch.setattr(op, "FLOOR", floor)
    rows, labels = corpus
    got = run(make_docs(rows), spark.createDataFrame([(*r, "x", 1) for r in labels], LABELS))
    want = brute(rows, labels)
    assert got == want and len(want) == 600 * len({p or "" for _, _, p in rows})
    assert all(any(r[c] for r in want) for c in range(3, 10))


def test_popcounts_by_counting():
    rng = np.random.default_rng(44)
    for n in (0, 1, 2, 3, 4, 5, 100, 12_345):
        words = rng.integers(0, 1 << 32, n, dtype=np.uint32)
        want = [int(((words >> np.uint32(b)) & 1).sum()) for b in range(32)]
        assert positional_popcount(words).tolist() == want
    assert positional_popcount(np.full(1000, 0xFFFFFFFF, np.uint32)).tolist() == [1000] * 32


def test_conditions_at_their_limits():
    texts = ["", " ", "w " * 50, "w " * 49, " ".join(f"w{i % 65}" for i in range(100)), " ".join(f"w{i % 64}" for i in range(100)),
             "A" + "b" * 19, "A" + "b" * 18, "É" * 5 + "A", "日本" * 9 + "AB", "a#", "a-", "x\x00&", "Z" * 3000]
    data = [t.encode() for t in texts]
    places = np.cumsum([0] + [len(d) for d in data])
    got = text_failures(np.frombuffer(b"".join(data), np.uint8), places)
    assert [{c for i, c in enumerate("ABCD") if f >> i & 1} for f in got] == [failures(t) for t in texts]


def test_odd_rows_and_empty_tables(spark, odd_docs, no_docs):
    rows = [(r.doc_id, r.text, r.source) for r in odd_docs.collect()]
    labels = [(5, 1, 1), (4, None, 1), (None, 1, 1), (3, 1, 0)]
    marks = spark.createDataFrame([(*r, "x", 1) for r in labels], LABELS)
    assert run(odd_docs, marks) == brute(rows, labels)
    assert run(odd_docs, marks.limit(0)) == brute(rows, [])
    assert run(no_docs, marks) == set()
