from __future__ import annotations

import random
import re
from collections import Counter

from conftest_llm import sentence

from backdate.llm.host_rules import judge, kept_documents


def measured(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    grams = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    inside = {j for i in range(len(words) - 7) if grams[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)}
    symbols = sum(text.count(c) for c in "#*$%&|<>")
    return len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(inside)


def test_measures_by_brute_force(make_docs, odd_docs):
    rng = random.Random(3)
    texts = [sentence(rng, rng.randrange(0, 60), 5) for _ in range(150)]
    texts += ["a b\n\na b\n a b\nc", "| ** <x> &amp; #$%", "w " * 7, "w " * 8, "w " * 9, "1 2 3 4 5 6 7 8 9 1 2 3 4 5 6 7 8", "\x1c\u2003 x\x85y"]
    docs = make_docs([(i, t, "s") for i, t in enumerate(texts)])
    for frame in (docs, odd_docs):
        text_of = {}
        for r in frame.collect():
            text_of.setdefault(r.doc_id, []).append(measured(r.text))
        for r in judge(frame).collect():
            own = (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words)
            assert own in text_of[r.doc_id]
            assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words)
            assert not (r.kept and r.base_failed)


def test_hosts_decide_and_clean_documents_stay(make_docs):
    rng = random.Random(4)
    clean = lambda: sentence(rng, 80)
    noisy = lambda: " ".join(w + "***" for w in sentence(rng, 80).split())
    rows = [(i, noisy() if i % 4 == 0 else clean(), "noisy") for i in range(400)]
    rows += [(1000 + i, noisy() if i == 0 else clean(), "sound") for i in range(400)]
    rows += [(2000 + i, clean(), f"small{i}") for i in range(50)] + [(3000, "too short", "sound")]
    docs = make_docs(rows)
    kept = {r.doc_id for r in judge(docs).where("kept").collect()}
    assert not kept & {i for i in range(0, 400, 4)}  # failures of a host that fails often
    assert 1000 in kept  # one failure of a sound host is forgiven
    assert 3000 not in kept
    assert {i for i, t, _ in rows if "***" not in t and i != 3000} <= kept
    stay = kept_documents(docs)
    assert stay.columns == docs.columns and {r.doc_id for r in stay.collect()} == kept


def test_odd_rows_and_empty_tables(odd_docs, no_docs):
    got = judge(odd_docs).collect()
    assert len(got) == odd_docs.count()
    assert all(r.base_failed for r in got if r.doc_id in (1, 2, 3, 7))
    stay = kept_documents(odd_docs)
    assert stay.columns == odd_docs.columns and stay.count() == sum(r.kept for r in got)
    assert judge(no_docs).count() == 0 and kept_documents(no_docs).count() == 0


def test_no_python_in_the_plan(odd_docs):
    plan = judge(odd_docs)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))
