from __future__ import annotations

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from conftest_llm import sentence
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from backdate.llm import cross_tokens as op
from backdate.llm.common import tokenizer_path
from backdate.llm.cross_tokens import TOKENIZER_A, TOKENIZER_B, alignment_digest, pair_counts, token_groups

PATHS = tokenizer_path(TOKENIZER_A), tokenizer_path(TOKENIZER_B)
ODD = [
    "", " ", "  ", "a", " a", "a ", "a  b\n\n c\t\td ", "<|endoftext|> a <s> </s> <unk>", "x▁y", "x\x00y \x0b\x1c\x1d\x85 z", "é ǅ ﬁ ß",
    "日本語 テスト 123 ４５", "😀👨‍👩‍👧 !!!***", "don't I'LL 's ’s", "İstanbul ΑΣ ΟΔΟΣ", "﻿x ᠎ y z", "½ ²³ 1⁄2 ª º", "a\xa0b  c d",
    "̀a ́", "x" * 3000, " " * 700, "\n" * 50 + "a", "word " * 500, "1234567890" * 30, "https://a.b/c?d=e&f=%20", "⁥ ⁿ₂ ℵ", "🏴",
]


@pytest.fixture(scope="module")
def brute():
    """Digest rows of texts, straight from the two libraries and the definition."""
    a = Tokenizer.from_file(PATHS[0])
    a.encode_special_tokens = True
    b = SentencePieceProcessor(model_file=PATHS[1])
    letters = op.byte_letters()

    def of(texts):
        docs, counts = [], Counter()
        for text in texts:
            links, groups, n = [], [], (0, 0)
            if text:
                spelt = b" " + text.encode()
                ids_a, ids_b = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
                bytes_a = [bytes(letters[c] for c in a.id_to_token(i)) for i in ids_a]
                bytes_b = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids_b]
                if b"".join(bytes_a) == spelt == b"".join(bytes_b):
                    n = len(ids_a), len(ids_b)
                    ends_a, ends_b = np.cumsum([len(x) for x in bytes_a]), np.cumsum([len(x) for x in bytes_b])
                    both = sorted(set(ends_a.tolist()) & set(ends_b.tolist()))
                    for low, high in zip([0, *both], both):
                        (s, e), (u, v) = np.searchsorted(ends_a, [low, high], "right"), np.searchsorted(ends_b, [low, high], "right")
                        groups.append((ids_a[s:e], ids_b[u:v]))
                    owner_a, owner_b = np.repeat(np.arange(n[0]), np.diff(ends_a, prepend=0)), np.repeat(np.arange(n[1]), np.diff(ends_b, prepend=0))
                    links = [(ids_a[i], ids_b[j]) for i, j in sorted(set(zip(owner_a.tolist(), owner_b.tolist())))]
            counts.update(links)
            docs.append((n, groups, links))
        most = defaultdict(int)
        for (_, j), c in counts.items():
            most[j] = max(most[j], c)
        out = []
        for n, groups, links in docs:
            text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
            out.append((*n, len(groups), len(links), sum(counts[p] == most[p[1]] for p in links), sum(counts[p] for p in links),
                        hashlib.sha256(text.encode()).hexdigest() if text else ""))
        return out, counts, most

    return of


def rows_of(df):
    return Counter(tuple(r[c] for c in op.DIGEST) for r in df.collect())


@pytest.mark.parametrize("block_bytes", [op.BLOCK_BYTES, 300])
def test_digest_by_brute_force(spark, make_docs, brute, block_bytes):
    """In one block a task, and in many."""
    rng = random.Random(47)
    texts = ODD + [sentence(rng, rng.randrange(1, 60), 300) + rng.choice(["", ", and", " naïve café.", " 12,5 %\n", "中文"]) for _ in range(200)]
    texts += ["".join(rng.choice("aB1 é.\n\t'日☃") for _ in range(rng.randrange(60))) for _ in range(200)] + texts[:40]
    docs = make_docs([(i, t, "a") for i, t in enumerate(texts)]).repartition(3, "doc_id")
    want, _, _ = brute(texts)
    assert rows_of(alignment_digest(docs, *PATHS, block_bytes)) == Counter((i, *w) for i, w in enumerate(want))
    assert any(w[4] < w[3] for w in want)


def test_pairs_and_groups_are_given_in_full(spark, make_docs, brute):
    texts = ["the cat's hat, unbelievably", "the the tokenization", "unbelievably tokenized 2024"] * 3
    docs = make_docs([(i, t, "a") for i, t in enumerate(texts)])
    _, counts, most = brute(texts)
    got = {(r.a, r.b): (r["count"], r.best) for r in pair_counts(op.stored(op.aligned_blocks(docs, *PATHS))).collect()}
    assert got == {p: (c, c == most[p[1]]) for p, c in counts.items()}
    groups = {r.doc_id: r for r in token_groups(docs, *PATHS).collect()}
    a, b = (Tokenizer.from_file(PATHS[0]), SentencePieceProcessor(model_file=PATHS[1]))
    for i, t in enumerate(texts):
        sides = [g.split("|") for g in groups[i].groups.split(";")]
        assert [int(x) for s, _ in sides for x in s.split(",")] == a.encode(" " + t).ids
        assert [int(x) for _, s in sides for x in s.split(",")] == b.encode(t) and len(sides) == groups[i].n_groups


def test_tokens_are_those_of_the_library():
    side, whole = op._Bytes(PATHS[0]), Tokenizer.from_file(PATHS[0])
    whole.encode_special_tokens = True
    rng = random.Random(48)
    letters = [chr(c) for c in (*range(0x250), *range(0x2000, 0x2070))]
    texts = ODD + ["".join(rng.choice(letters) for _ in range(40)) for _ in range(400)]
    assert [ids.tolist() for ids in op._Pieces(PATHS[1]).ids_of(texts)] == SentencePieceProcessor(model_file=PATHS[1]).encode(texts)
    texts += ["".join(rng.choice(" \t\n\r\x85\xa0 ab1'.") for _ in range(30)) for _ in range(400)]
    for text, ids in zip(texts, side.ids_of(texts)):
        assert ids.tolist() == whole.encode(" " + text, add_special_tokens=False).ids, repr(text)


def test_a_worker_that_forgets_gives_the_same(monkeypatch):
    rng = random.Random(49)
    texts = [sentence(rng, 50, 200) for _ in range(20)]

    def all_of(aligner):
        block = op._Block(0)
        for t in texts:
            block.add(aligner, [None], [t])
        return block.batch(aligner)

    remembering = all_of(op.Aligner(*PATHS))
    monkeypatch.setattr(op, "MEMO_BYTES", 2000)
    assert all_of(op.Aligner(*PATHS)).equals(remembering)


def test_windows_of_one_hash_are_told_apart(monkeypatch):
    rng = np.random.default_rng(50)
    n_a, n_b = rng.integers(1, 4, 300), rng.integers(1, 3, 300)
    windows = op.Windows(*[rng.integers(0, 3, n.sum()).astype(np.uint16) for n in (n_a, n_b)], n_a, n_b)
    sides = [np.split(ids, np.cumsum(n)[:-1]) for ids, n in ((windows.a, n_a), (windows.b, n_b))]
    keys = [(tuple(a.tolist()), tuple(b.tolist())) for a, b in zip(*sides)]

    def check():
        first, same = windows.distinct()
        assert len(first) == len(set(keys)) and [keys[first[k]] for k in same] == keys

    check()
    monkeypatch.setattr(op, "run_hashes", lambda ids, start, n: np.zeros(len(n), np.uint64))
    check()


def test_odd_rows_and_empty_tables(spark, odd_docs, no_docs, brute):
    rows = odd_docs.collect()
    want, _, _ = brute([r.text for r in rows])
    assert rows_of(alignment_digest(odd_docs, *PATHS)) == Counter((r.doc_id, *w) for r, w in zip(rows, want))
    assert alignment_digest(no_docs, *PATHS).count() == 0
    blank = odd_docs.where("text IS NULL OR text = ''")
    assert {r[1:] for r in rows_of(alignment_digest(blank, *PATHS))} == {(0, 0, 0, 0, 0, 0, "")}
