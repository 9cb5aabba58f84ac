from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from backdate.llm import top_inner as op
from backdate.llm.top_inner import top_inner

ROWS = "vec_id long, embedding array<float>, block int, kind int, v string, norm2 int, floor int"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 1, 2, "x", 3, 4) for i, v in rows], ROWS)


def brute(rows, step, k=5):
    sound = [(i, [math.floor(256 * x) for x in v]) for i, v in rows
             if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    out = set()
    for i, q in sound:
        if i % step == 0:
            scored = sorted((-sum(a * b for a, b in zip(q, c)), j) for j, c in sound if j != i)[:k]
            out |= {(i, n + 1, j, -s) for n, (s, j) in enumerate(scored)}
    return out


def run(df, step):
    rows = top_inner(df, lambda c: c % step == 0).collect()
    got = {(r.query_id, r.rank, r.vec_id, r.score) for r in rows}
    assert len(got) == len(rows)
    return got


@pytest.mark.parametrize("spread", [1.0, 0.02])
def test_results_by_brute_force(spark, monkeypatch, spread):
    monkeypatch.setattr(op, "SEED_ROWS", 20)
    monkeypatch.setattr(op, "BLOCK_ROWS", 64)
    rng = random.Random(16)
    rows = [(i, [rng.gauss(0, 1) * spread / (1 + j) + 0.05 for j in range(24)]) for i in range(700)]
    rows += [(1000 + i, [0.0] * 24) for i in range(8)] + [(2000 + i, rows[7][1]) for i in range(30)]  # ties
    rows = [(i, [float(x) for x in v]) for i, v in rows]
    df = frame(spark, rows)
    exact = [(r.vec_id, list(r.embedding)) for r in df.collect()]
    assert run(df, 10) == brute(exact, 10)


def test_odd_rows_and_empty_tables(spark):
    rows = [(0, [1.0, 2.0]), (1, None), (2, []), (None, [1.0, 1.0]), (3, [float("nan"), 1.0]), (4, [float("inf"), 1.0]),
            (5, [None, 1.0]), (6, [3.0]), (7, [-1.0, -1.0]), (10, [0.0, 0.0]), (20, [1.0, 2.0])]
    df = frame(spark, rows)
    assert run(df, 10) == brute(rows, 10)
    assert run(df.where("vec_id = 0"), 10) == set()
    assert run(df.where("false"), 10) == set() and run(df.where("vec_id = 7"), 10) == set()
    twice = df.where("vec_id in (0, 6, 7)").union(df.where("vec_id = 0"))
    assert run(twice, 10) == {(0, 1, 6, 3 * 256 * 256), (0, 2, 7, -3 * 256 * 256)} and F


def test_components_of_any_finite_size(spark):
    rng = random.Random(5)
    rows = [(i, [rng.gauss(0, 1) for _ in range(6)]) for i in range(120)]
    for i, size in ((3, 1e6), (10, 1e6), (20, 1e30), (30, 1e30), (41, 1e18), (50, 4e307), (61, 1e-300), (70, 4e9), (71, 4e9)):
        rows[i] = (i, [rng.gauss(0, 1) * size for _ in range(6)])
    rows.append((91, rows[70][1]))  # a tie
    rows.append((130, [3e7, -2.0]))  # shorter
    numbers = [(i, [int(x) * 256 if abs(x) >= 2**52 else math.floor(256 * x) for x in v]) for i, v in rows]
    expected = []
    for q_id, q in numbers:
        if q_id % 10 == 0:
            found = sorted((-sum(a * b for a, b in zip(q, v, strict=False)), i) for i, v in numbers if i != q_id)[:5]
            expected += [(q_id, rank, i, max(-(2**63), min(2**63 - 1, -s))) for rank, (s, i) in enumerate(found, 1)]
    got = top_inner(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), lambda i: i % 10 == 0).collect()
    assert sorted((r.query_id, r.rank, r.vec_id, r.score) for r in got) == sorted(expected)
    assert {2**63 - 1} < {r.score for r in got}
    # Without a single ordinary row.
    big = [(i, v) for i, v in rows if max(map(abs, v)) > 1e6]
    got = top_inner(spark.createDataFrame(big, "vec_id long, embedding array<double>"), lambda i: i % 10 == 0).collect()
    assert len(got) == 5 * sum(i % 10 == 0 for i, _ in big)
