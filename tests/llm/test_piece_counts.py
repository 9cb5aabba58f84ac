from __future__ import annotations

import random

import pytest
from tokenizers import Regex, Tokenizer, models, pre_tokenizers

from backdate.llm.common import tokenizer_path
from backdate.llm.piece_counts import MARK, TOKENIZER, PieceCounter, count_pieces, vocabulary


def reference(pieces):
    t = Tokenizer(models.Unigram(pieces, unk_id=0, byte_fallback=True))
    t.pre_tokenizer = pre_tokenizers.Sequence([
        pre_tokenizers.Split(Regex(r"[\x20\x09-\x0D]+"), "removed"),
        pre_tokenizers.Metaspace(replacement=MARK, prepend_scheme="always", split=True),
    ])
    return lambda text: len(t.encode(text).ids)


@pytest.fixture(scope="module")
def pieces():
    return vocabulary(tokenizer_path(TOKENIZER))


def test_counts_equal_the_tokenizer(pieces):
    count, want = PieceCounter(pieces), reference(pieces)
    rng = random.Random(13)
    texts = ["", "日本語", "😀a😀", "xéy", "▁▁▁", "a▁b", "<0x41>", "<s>x", "ﷺ", "\x00\x01", "zzzzqqqq", "Ünïcödé", "a\tb\x0bc\x1cd  e"]
    letters = "abcdeéü日😀▁<>0x. "
    texts += ["".join(rng.choice(letters) for _ in range(rng.randrange(1, 40))) for _ in range(400)]
    for text in texts:
        assert count(text.encode()) == want(text), repr(text)


def test_ties_take_the_longest_last_piece():
    """With few scores many splits tie; unknown characters lie between."""
    rng = random.Random(14)
    for _ in range(30):
        made = {MARK: -1.0} | {"".join(rng.choice("ab") for _ in range(rng.randrange(1, 4))): -float(rng.randrange(1, 3)) for _ in range(4)}
        pieces = [("<unk>", 0.0), *((f"<0x{i:02X}>", -9.0) for i in range(256)), *made.items()]
        count, want = PieceCounter(pieces), reference(pieces)
        for _ in range(40):
            text = "".join(rng.choice("abc") for _ in range(rng.randrange(1, 9)))
            assert count(text.encode()) == want(text), (made, text)


def test_odd_rows_and_empty_tables(odd_docs, no_docs, pieces):
    path, want = tokenizer_path(TOKENIZER), reference(pieces)
    got = sorted((str(r.doc_id), r.n_words, r.n_pieces) for r in count_pieces(odd_docs, path).collect())
    text = [(r.doc_id, r.text or "") for r in odd_docs.collect()]
    assert got == sorted((str(i), len(t.encode().split()), want(t)) for i, t in text)
    assert count_pieces(no_docs, path).count() == 0
