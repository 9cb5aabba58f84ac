from __future__ import annotations

import random
from itertools import combinations

import pytest
from conftest_llm import change, sentence
from pyspark.sql import functions as F

from backdate.llm.components import components
from backdate.llm.jaccard import bands_for, jaccard_classes, one_per_class


def sets(text):
    w = (text or "").split()
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) or (frozenset([tuple(w)]) if w else frozenset())


def brute(rows, threshold=0.8):
    s = {i: sets(t) for i, t, _ in rows}
    links, least = {i: 0 for i in s}, {i: i for i in s}
    pairs = [(a, b) for a, b in combinations(sorted(s), 2) if s[a] and s[b] and len(s[a] & s[b]) >= threshold * len(s[a] | s[b]) - 1e-9]
    for a, b in pairs:
        links[a] += 1
        links[b] += 1
    moved = True
    while moved:
        moved = False
        for a, b in pairs:
            low = min(least[a], least[b])
            moved |= least[a] != low or least[b] != low
            least[a] = least[b] = low
    return links, least


def near_rows():
    rng = random.Random(6)
    rows, at = [], 0
    for size in (1, 2, 5, 40):
        for _ in range(6):
            base = sentence(rng, rng.randrange(40, 160))
            for _ in range(size):
                rows.append((at, change(rng, base, rng.randrange(0, 4)), "a"))
                at += 1
    rows += [(at + i, rows[100][1], "b") for i in range(30)]  # exact copies
    rows += [(at + 40 + i, t, "b") for i, t in enumerate(["one two", "one two", "one  two", "two one", "a b c d", "a b c d e"])]
    return rows


def test_links_and_classes_by_brute_force(make_docs):
    rows = near_rows()
    links, least = brute(rows)
    got = {r.doc_id: r for r in jaccard_classes(make_docs(rows)).collect()}
    assert {i: r.n_links for i, r in got.items()} == links
    assert {i: r.class_id for i, r in got.items()} == least


def test_blocks_of_a_large_group(make_docs, monkeypatch):
    from backdate.llm import jaccard

    monkeypatch.setattr(jaccard, "BLOCK_ROWS", 12)
    monkeypatch.setattr(jaccard, "CELLS", 64)
    rows = near_rows()
    links, least = brute(rows)
    got = {r.doc_id: (r.n_links, r.class_id) for r in jaccard_classes(make_docs(rows)).collect()}
    assert got == {i: (links[i], least[i]) for i in links}


def test_one_document_of_each_class(make_docs):
    rows = near_rows()
    _, least = brute(rows)
    left = one_per_class(make_docs(rows))
    assert sorted(r.doc_id for r in left.collect()) == sorted(set(least.values()))


def test_one_document_of_each_class_without_ids_or_with_one_id(make_docs):
    rng = random.Random(7)
    texts = [sentence(rng, 60, 10**6) for _ in range(9)]
    rows = [(None, t, "a") for t in texts[:5]] + [(None, change(rng, texts[0], 1), "b"), (None, texts[1], "b")]
    rows += [(3, t, "a") for t in texts[5:8]] + [(3, texts[5], "b"), (None, texts[6], "b"), (9, texts[7], "b"), (4, texts[8], "a")]
    left = [(r.doc_id, r.text) for r in one_per_class(make_docs(rows)).collect()]
    assert len(left) == 9
    assert set(left[i] for i in range(9)) >= {(None, t) for t in texts[1:5]} | {(3, t) for t in texts[5:8]} | {(4, texts[8])}


def test_links_are_verified_on_the_rows_own_text(make_docs):
    """Links by text, whatever ids the rows have: all NULL, all the same, or the same for different texts."""
    rng = random.Random(12)
    bases = [sentence(rng, 60, 10**6) for _ in range(12)]
    texts = [t for b in bases for t in (b, change(rng, b, 1), b)]
    links, _ = brute(list(zip(range(len(texts)), texts, texts, strict=True)))
    for ids in ([None] * 36, [7] * 36, [i % 5 if i % 3 else None for i in range(36)]):
        got = jaccard_classes(make_docs(list(zip(ids, texts, texts, strict=True)))).collect()
        assert sorted(r.n_links for r in got) == sorted(links.values())
        assert len({r.class_key for r in got}) == 12


@pytest.mark.parametrize("threshold", [0.5, 0.8, 0.95])
def test_bands_reach_the_recall(threshold):
    bands, rows = bands_for(threshold)
    assert 1 - (1 - threshold**rows) ** bands >= 0.9995 and bands * rows <= 128


def test_odd_rows_and_empty_tables(odd_docs, no_docs):
    got = jaccard_classes(odd_docs).collect()
    assert len(got) == odd_docs.count()
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append((r.class_id, r.n_links))
    assert by[4] == [(4, 3)] and sorted(by[5])[:2] == [(4, 3), (4, 3)]  # with the row without id
    assert by[1] == [(1, 0)] and by[6][0][0] == by[9][0][0] == 6
    left = one_per_class(odd_docs)
    assert left.columns == odd_docs.columns
    ids = [r.doc_id for r in left.collect()]
    assert ids.count(5) == 1 and {1, 2, 3, 4, 6, 7, 8} <= set(ids) and 9 not in ids
    assert jaccard_classes(no_docs).count() == 0 and one_per_class(no_docs).count() == 0


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 130)] + [(200, 201), (201, 200), (300, 300)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 130)}, 200: 200, 201: 200}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0 and F
