from __future__ import annotations

import random
from collections import defaultdict

import pytest
from conftest_llm import sentence

from backdate.llm.mixing import mix_sources, mixed_documents


def fill(sizes: dict, share=1.5, most=2.0) -> dict:
    """Targets by dealing again until nothing changes."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    full, target = set(), {}
    while True:
        left = share * sum(sizes.values()) - sum(most * sizes[s] for s in full)
        rest = sum(weight[s] for s in names if s not in full)
        target = {s: most * sizes[s] if s in full else left * weight[s] / rest for s in names}
        over = {s for s in names if s not in full and target[s] > most * sizes[s]}
        if not over:
            return target
        full |= over


def test_targets_and_taken_words(make_docs):
    rng = random.Random(1)
    rows = [(i, sentence(rng, rng.randrange(1, 60)), rng.choice(["a", "b", "B", "c", "d", None, "a", "a", "a"])) for i in range(3000)]
    got = mix_sources(make_docs(rows)).collect()
    assert len(got) == len(rows)
    sizes, taken, target = defaultdict(int), defaultdict(int), {}
    for r in got:
        sizes[r.source] += r.size
        taken[r.source] += r.taken
        target[r.source] = r.target
        assert r.taken in (0, r.size, 2 * r.size)
    want = fill(sizes)
    for s in sizes:
        assert target[s] == pytest.approx(want[s], rel=1e-9)
        assert abs(taken[s] - target[s]) <= 60, s
    again = {(r.doc_id, r.taken) for r in mix_sources(make_docs(rows[::-1])).collect()}
    assert again == {(r.doc_id, r.taken) for r in got}


def test_larger_budgets_take_supersets(make_docs):
    rng = random.Random(2)
    docs = make_docs([(i, sentence(rng, 30), "ab"[i % 2]) for i in range(600)])
    sets = [{r.doc_id for r in mix_sources(docs, share=s).where("taken > 0").collect()} for s in (0.2, 0.5, 0.9)]
    assert sets[0] < sets[1] < sets[2]


def test_odd_rows_and_empty_tables(odd_docs, no_docs):
    got = mix_sources(odd_docs).collect()
    assert len(got) == odd_docs.count()
    assert all(r.size == 0 and r.taken == 0 for r in got if r.doc_id in (1, 2, 3))
    same = {r.taken for r in got if r.doc_id == 5 and r.size == 120}
    assert len(same) == 1  # repeated rows go together
    mixed = mixed_documents(odd_docs)
    assert mixed.columns == odd_docs.columns
    assert mixed.count() == sum(r.copies for r in got)
    assert mix_sources(no_docs).count() == 0 and mixed_documents(no_docs).count() == 0


def test_each_row_is_written_as_often_as_it_is_taken_and_stays_where_it_is(spark, make_docs, tmp_path):
    rng = random.Random(3)
    rows = [(i, sentence(rng, rng.randrange(1, 40)), rng.choice(["a", "b", None, "c"])) for i in range(500)]
    make_docs(rows + rows[:20]).write.parquet(str(tmp_path / "docs"))
    docs = spark.read.parquet(str(tmp_path / "docs"))
    want = defaultdict(int)
    for r in mix_sources(docs).collect():
        want[r.doc_id] += r.copies
    mixed = mixed_documents(docs)
    got = defaultdict(int)
    for r in mixed.collect():
        got[r.doc_id] += 1
    assert dict(got) == {i: n for i, n in want.items() if n}
    final = mixed._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert "BroadcastHashJoin" in final and "Exchange hashpartitioning" not in final
