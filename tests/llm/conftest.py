from __future__ import annotations

import random
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parent))

from conftest_llm import sentence  # noqa: E402

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
# Names that the operators use inside; none may get in the way.
CLASHES = ["size", "key", "node", "host", "words", "copies", "block", "row", "seed", "label", "score", "rank", "levels",
           "target", "component", "kept", "spans", "copy", "k_key", "bands", "slot", "was_cut", "held_out", "path"]


@pytest.fixture(scope="session")
def make_docs(spark):
    def make(rows):
        full = [(i, t, "en", s, None if t is None else len(t)) for i, t, s in rows]
        return spark.createDataFrame(full, DOCS)

    return make


@pytest.fixture(scope="session")
def odd_docs(make_docs):
    """NULLs in every column, empty and very long texts, repeated rows, one id for two texts, clashing columns."""
    rng = random.Random(5)
    long = sentence(rng, 30_000)
    plain = sentence(rng, 120)
    rows = [
        (1, None, "a"), (2, "", "a"), (3, " \t\n ", None), (None, plain, "a"), (None, None, None), (4, plain, None),
        (5, plain, "b"), (5, plain, "b"), (5, sentence(rng, 90), "b"), (6, long, "b"), (7, "one", "c"),
        (8, "x\x00y \x0b z é 😀 日本語", "c"), (9, long + " tail", "c"), (2**62, "a b c d", "a"), (-3, "word " * 400, "a"),
    ]
    df = make_docs(rows)
    return df.withColumns({c: F.lit(f"extra {c}") for c in CLASHES})


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)
