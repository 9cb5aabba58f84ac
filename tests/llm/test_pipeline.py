"""Every stage of the pipeline against brute force on its own input, and how the parts are registered."""

from __future__ import annotations

import random
import shutil
import subprocess
import sys
from collections import Counter, defaultdict
from pathlib import Path

import duckdb
import numpy as np
import pytest
from conftest_llm import change, sentence
from test_host_rules import measured
from test_jaccard import brute
from test_mixing import fill

import corpus_pipeline
from backdate.llm.common import stored, tokenizer_path
from backdate.llm.oracle import ORACLE_SQL
from backdate.llm.packing import TOKENIZER, _Encoder
from backdate.llm.queries import QUERIES

REPO = Path(__file__).resolve().parents[2]
SMALL = Path("/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(17)
    rows, passages = [], [sentence(rng, 70, 10**6) for _ in range(3)]
    for i in range(150):
        text = sentence(rng, rng.randrange(30, 200), 10**6)
        if i % 5 == 0:
            text += "\n" + passages[i % 3]
        rows.append((i, text, f"s{i % 4}"))
    rows += [(200 + i, rows[i][1], "s0") for i in range(40)]  # exact copies
    rows += [(300 + i, change(rng, rows[40 + i][1], 1), "s1") for i in range(20)]  # near ones, as far as they are long
    rows += [(400, "too short", "s2"), (401, "again " * 90, "s2"), (402, None, None), (403, "", "s3")]
    return rows


def test_stages_by_brute_force(spark, make_docs, corpus):
    docs, seen = make_docs(corpus), {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs.collect()
        docs = stored(stage(spark, docs, ""))
        seen[name] = (before, docs.collect())
        if name != "best-fit packing":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    names = [n for n, _ in corpus_pipeline.STAGES]

    before, after = seen[names[0]]
    failing = {r.doc_id for r in before if (m := measured(r.text))[0] < 20 or 100 * m[4] > 30 * m[0]}
    assert {r.doc_id for r in before} - {r.doc_id for r in after} == failing == {400, 401, 402, 403}

    before, after = seen[names[1]]
    _, least = brute([(r.doc_id, r.text, r.source) for r in before])
    assert sorted(r.doc_id for r in after) == sorted(set(least.values()))

    before, after = seen[names[2]]
    windows = defaultdict(set)
    for r in before:
        w = r.text.split()
        for j in range(len(w) - 49):
            windows[tuple(w[j : j + 50])].add(r.doc_id)
    shared = {w: min(ids) for w, ids in windows.items() if len(ids) > 1}
    assert shared
    left = {r.doc_id: r.text.split() for r in after}
    for r in before:
        own = {tuple(r.text.split()[j : j + 50]) for j in range(len(r.text.split()) - 49)}
        now = {tuple(left.get(r.doc_id, [])[j : j + 50]) for j in range(len(left.get(r.doc_id, [])) - 49)}
        for w in own & set(shared):
            assert (w in now) == (shared[w] == r.doc_id)
        if not own & set(shared):
            assert left[r.doc_id] == r.text.split()

    before, after = seen[names[3]]
    sizes, taken = defaultdict(int), defaultdict(int)
    for r in before:
        sizes[r.source] += len(r.text.split())
    for r in after:
        taken[r.source] += len(r.text.split())
    longest = max(len(r.text.split()) for r in before)
    for s, target in fill(sizes).items():
        assert abs(taken[s] - target) <= longest
    assert max(Counter(r.doc_id for r in after).values()) <= 2
    assert {r.text for r in after} <= {r.text for r in before}

    before, after = seen[names[4]]
    encoder, per, at = _Encoder(tokenizer_path(TOKENIZER)), defaultdict(list), Counter()
    for r in before:
        at[(r.doc_id, len(np.frombuffer(encoder.whole(r.text), "<u4")) + 1)] += 1
    assert Counter((r.doc_id, r.length) for r in after) == at
    for r in after:
        per[r.sequence_id].append((r.offset, r.length))
    for own in per.values():
        assert [o for o, _ in sorted(own)] == [sum(n for _, n in sorted(own)[:i]) for i in range(len(own))]
        assert sum(n for _, n in own) <= 4096


def test_run_is_the_stages_in_turn(spark, make_docs, corpus, tmp_path):
    docs = make_docs(corpus)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    whole = corpus_pipeline.run(spark, str(tmp_path))
    for _, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, str(tmp_path)))
    facts = lambda df: Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in df.collect())
    assert facts(whole) == facts(docs)


def test_an_empty_corpus(spark, no_docs):
    docs = no_docs
    for _, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, ""))
        assert docs.count() == 0


def test_all_queries_and_the_pipeline_are_registered():
    import __spark_entry__ as entry

    names = set(entry.queries())
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
    assert set(QUERIES) <= names and "pipeline" in names and set(ORACLE_SQL) <= set(QUERIES)


def test_the_rest_works_without_them(tmp_path):
    shutil.copytree(REPO, tmp_path / "repo", ignore=shutil.ignore_patterns("llm", "corpus_pipeline.py", ".git", "__pycache__"))
    said = subprocess.run(
        [sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()), 'pipeline' in e.queries())"],
        cwd=tmp_path / "repo", capture_output=True, text=True, check=True,
    )
    n, m, has = said.stdout.split()
    assert n == m and int(n) >= 59 and has == "False"


@pytest.mark.skipif(not SMALL.exists(), reason="needs the generated tables")
@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    df = QUERIES[name](spark, str(SMALL))
    cur = con.execute(ORACLE_SQL[name])
    columns = [c[0] for c in cur.description]
    order = sorted(columns)
    want = sorted(tuple(map(str, (r[columns.index(c)] for c in order))) for r in cur.fetchall())
    assert sorted(df.columns) == order and want
    assert sorted(tuple(str(r[c]) for c in order) for r in df.collect()) == want
