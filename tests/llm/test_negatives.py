"""Hard negatives against brute force, the bounds, and odd rows."""

import math

import numpy as np
import pytest

from labelforge.llm import negatives, queries

SCHEMA = "vec_id long, embedding array<double>, label int"


def brute(rows, anchor=lambda i: i % 100 == 0, positives=5, count=5, scale=256):
    fine = {}
    widths = [len(v) for i, v, l in rows if i is not None and l is not None and v]
    for i, v, label in rows:
        if None in (i, v, label) or not v or any(x is None or not math.isfinite(x) for x in v):
            continue
        fine.setdefault(i, []).append((label, [math.floor(scale * x) for x in v]))
    width = max(set(widths), key=lambda w: (widths.count(w), w)) if widths else 0
    fine = {i: min(x for x in v if len(x[1]) == width) for i, v in fine.items() if any(len(x[1]) == width for x in v)}
    out = []
    for a, (label, v) in fine.items():
        if not anchor(a):
            continue
        score = sorted((-sum(x * y for x, y in zip(v, w)), i, other) for i, (other, w) in fine.items() if i != a)
        for p, pos, _ in [s for s in score if s[2] == label][:positives]:
            hard = [s for s in score if s[2] != label and 80 * -p <= 100 * -s[0] <= 100 * -p][:count]
            out += [(a, pos, r + 1, s[1], -p, -s[0]) for r, s in enumerate(hard)]
    return sorted(out)


def mined(spark, rows, **more):
    return sorted(tuple(r) for r in negatives.mine(spark.createDataFrame(rows, SCHEMA), **more).collect())


def vectors(n, width, seed, ties=False):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, width))
    if ties:
        x[: n // 3] = x[0]
    return [(int(i), [float(y) for y in v], int(rng.integers(3))) for i, v in enumerate(x)]


@pytest.mark.parametrize("width", [1, 5, 24])
def test_all_negatives_are_found(spark, width, monkeypatch):
    monkeypatch.setattr(negatives, "ROWS", 64)
    rows = vectors(500, width, width)
    assert mined(spark, rows) == brute(rows)
    assert len(brute(rows)) > 20


def test_a_third_of_all_vectors_are_equal(spark, monkeypatch):
    monkeypatch.setattr(negatives, "ROWS", 32)
    rows = vectors(400, 8, 4, ties=True)
    assert mined(spark, rows) == brute(rows)


def test_odd_rows(spark):
    rows = vectors(250, 4, 9)
    odd = [(None, [1.0] * 4, 1), (300, None, 1), (301, [1.0, None, 0.0, 0.0], 1), (302, [math.nan] * 4, 2), (303, [math.inf, 0.0, 0.0, 0.0], 0)]
    odd += [(304, [1.0] * 4, None), (305, [], 1), (306, [1.0] * 9, 1), (307, [0.0] * 4, 1), (100, [0.5] * 4, 0), rows[3], rows[3]]
    assert mined(spark, rows + odd) == brute(rows + odd)
    assert mined(spark, []) == []
    assert mined(spark, odd[1:4]) == []
    assert mined(spark, rows[:2]) == brute(rows[:2])


def test_large_numbers_stay_exact(spark):
    rows = [(i, [x * 2.0**20 for x in v], l) for i, v, l in vectors(120, 3, 2)]
    assert mined(spark, rows) == brute(rows)


def test_bounds_hold_and_refute():
    rng = np.random.default_rng(0)
    v = np.floor(256 * rng.normal(size=(300, 48)))
    s = negatives.summaries(v).astype("<f4").astype(float)
    x = negatives.Vectors(np.arange(300), np.zeros(300), v, s)
    score, low = v @ v.T, np.full(300, 1.5e6)
    i, j, left = negatives.within(x, x, np.ones((300, 300), bool), low, np.full(300, 3e6))
    assert {(a, b) for a, b in zip(*np.nonzero((score >= 1.5e6) & (score <= 3e6)))} <= set(zip(i.tolist(), j.tolist()))
    assert left[0] > left[-1] and left == sorted(left, reverse=True)


def test_query_columns(spark):
    got = queries.QUERIES["op13_hard_negatives"](spark, "/root/testdata/sf0.001")
    assert got.dtypes == [("anchor_id", "bigint"), ("positive_id", "bigint"), ("rank", "int"), ("negative_id", "bigint"), ("positive_score", "bigint"), ("negative_score", "bigint")]
    rows = [(r.vec_id, r.embedding, (r.label + 1) % 10 if r.vec_id % 7 == 0 else r.label) for r in spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").collect()]
    assert sorted(tuple(r) for r in got.collect()) == brute(rows)
