from __future__ import annotations

import hashlib
import random
from collections import Counter, defaultdict

import pytest

from backdate.llm import heavy, line_dedup
from backdate.llm.common import stored
from backdate.llm.line_dedup import keep_bitmaps, line_digest, without_shared_lines

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def key_of(line):
    return line.strip(" \t\n\x0b\x0c\r").translate(LOWER)


def brute(rows, least_chars=40, least_documents=5):
    """(id, number of lines, dropped, kept text) of every row."""
    holders = defaultdict(set)
    for i, text in rows:
        for line in (text or "").split("\n"):
            holders[key_of(line)].add(i)
    order = {i: (i is not None, i or 0) for i, _ in rows}
    out = Counter()
    for i, text in rows:
        lines, kept = (text or "").split("\n"), []
        for line in lines:
            own = holders[key_of(line)]
            shared = len(key_of(line)) >= least_chars and len(own) >= least_documents
            if not shared or i == max(own, key=order.get):
                kept.append(line)
        out[(i, len(lines), len(lines) - len(kept), "\n".join(kept))] += 1
    return out


def digests(rows):
    return Counter((r.doc_id, r.n_lines, r.n_dropped, r.kept_sha256) for r in rows)


def hashed(found):
    return Counter({(i, n, d, hashlib.sha256(t.encode()).hexdigest()): c for (i, n, d, t), c in found.items()})


@pytest.fixture(scope="module")
def shared_lines():
    rng = random.Random(41)
    pool = [f"Shared line {i} " + "with many words " * 2 + "é" * (i % 3) + str(i) for i in range(40)]
    pool += ["x" * 39, "X" * 40, "É" * 40, "é" * 40, "ß" * 40, "日本" * 20]
    rows = []
    for i in range(120):
        lines = [rng.choice(pool) for _ in range(rng.randrange(0, 200 if i % 10 == 0 else 6))]
        lines += [f"own line {i} {j} " + "z" * 30 for j in range(rng.randrange(3))] + [""] * rng.randrange(2)
        rng.shuffle(lines)
        style = [str, str.upper, lambda s: f" \t{s}\r", lambda s: f"\xa0{s}"][i % 4]
        rows.append((i, "\n".join(style(line) for line in lines), "a"))
    rows += [(50, rows[50][1], "a"), (50, rows[51][1], "a"), (None, rows[0][1], None), (None, rows[1][1], "b"), (None, None, "b")]
    return rows


@pytest.mark.parametrize("floor", [1000, 3])
def test_lines_by_brute_force(spark, make_docs, shared_lines, monkeypatch, floor):
    """Also with nearly every key decided in place."""
    monkeypatch.setattr(line_dedup, "heavy_keys", lambda rows, keys: heavy.heavy_keys(rows, keys, floor))
    got = digests(line_digest(make_docs(shared_lines)).collect())
    want = brute([(i, t) for i, t, _ in shared_lines])
    assert got == hashed(want) and sum(d for _, _, d, _ in want) > 500


def test_bitmaps_are_words_of_64_lines_without_full_ones(spark, make_docs):
    line = "a line that is long enough to be dropped, it has"
    long = "\n".join(["own " + str(i) for i in range(300)] + [line] + ["more"])
    df = make_docs([(i, long, "a") for i in range(5)])
    rows = {r.doc_id: r for r in keep_bitmaps(df).collect()}
    assert set(rows) == {0, 1, 2, 3}  # the largest id keeps its line
    for r in rows.values():
        assert r.n_dropped == 1 and [(w.word, w.bits) for w in r.keep] == [(4, ~(1 << 44))]
    assert "text" not in keep_bitmaps(df).columns


def test_line_at_both_ends_of_words_and_only_line(spark, make_docs):
    line = "Y" * 40
    texts = ["\n".join([line] * n) for n in (1, 63, 64, 65, 128, 129)] + [f"a\n{line}\n\n"]
    rows = [(i, t, "a") for i, t in enumerate(texts)]
    assert digests(line_digest(make_docs(rows)).collect()) == hashed(brute([(i, t) for i, t, _ in rows]))


def test_heavy_keys_are_those_beyond_the_limit(spark):
    df = stored(spark.range(5000).selectExpr("xxhash64(id % 100 + if(id < 2000, 0, 1000 + id)) AS h1", "id % 2 AS h2"))
    keys, limit = heavy.heavy_keys(df, ["h1", "h2"], 15)
    want = {(r.h1, r.h2) for r in df.groupBy("h1", "h2").count().where("count > 15").collect()}
    assert limit == 15 and {(r.h1, r.h2) for r in keys.collect()} == want and len(want) == 100
    assert heavy.heavy_keys(df, ["h1", "h2"], 15, 100)[1] == 50


def test_odd_rows_and_empty_tables(spark, odd_docs, no_docs):
    pairs = [(r.doc_id, r.text) for r in odd_docs.collect()]
    assert digests(line_digest(odd_docs).collect()) == hashed(brute(pairs))
    assert line_digest(no_docs).count() == 0
    low = {"least_chars": 1, "least_documents": 2}
    cut = without_shared_lines(odd_docs, **low)
    assert cut.columns == odd_docs.columns
    want = Counter((i, t) for (i, _, _, t), n in brute(pairs, **low).items() for _ in range(n))
    assert Counter((r.doc_id, r.text or "") for r in cut.collect()) == want


def test_no_python_in_the_plan(spark, odd_docs):
    plan = line_digest(odd_docs)._jdf.queryExecution().executedPlan().toString()
    assert not any(n in plan for n in ("InArrow", "InPandas", "EvalPython", "PythonUDF"))
