"""Hard negatives against brute force, and the bounds that rule pairs out."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest

from strandloom.llm import negatives

SCHEMA = "vec_id long, embedding array<double>, label int"


def brute(rows, every=100, positives=5, k=10):
    ready = []
    for vec_id, vector, label in rows:
        if vec_id is None or label is None or vector is None or any(x is None or not math.isfinite(x) for x in vector):
            continue
        ready.append((vec_id, [math.floor(256 * x) for x in vector], (label + 1) % 10 if vec_id % 7 == 0 else label))
    out = []
    for a, v, label in ready:
        if a % every:
            continue
        scored = [(sum(x * y for x, y in zip(v, w, strict=True)), b, own) for b, w, own in ready if b != a and len(w) == len(v)]
        scored.sort(key=lambda s: (-s[0], s[1]))
        for p, b, _ in [s for s in scored if s[2] == label][:positives]:
            fits = [s for s in scored if s[2] != label and 30 * p <= 100 * s[0] <= 90 * p][:k]
            out += [(a, b, rank, c, p, n) for rank, (n, c, _) in enumerate(fits, 1)]
    return sorted(out)


def found(df):
    return sorted((r.anchor_id, r.positive_id, r.rank, r.negative_id, r.positive_score, r.negative_score) for r in df.collect())


def clustered(n, width, seed):
    rng = np.random.default_rng(seed)
    centres = np.cumsum(rng.normal(size=(10, width)), axis=1) / 4
    return [(i, (centres[i % 10 if rng.random() < 0.5 else rng.integers(10)] + rng.normal(size=width) / 3).tolist(), int(rng.integers(6))) for i in range(n)]


@pytest.mark.parametrize("width", [64, 7, 1])
def test_brute_force(spark, monkeypatch, width):
    monkeypatch.setattr(negatives, "ROWS", 100)
    rows = clustered(1200, width, width)
    rows += [(i + 1200, rows[i][1], 3) for i in range(0, 400, 2)]  # copies and ties
    df = spark.createDataFrame(rows, SCHEMA).repartition(7)
    assert found(negatives.hard_negatives(df, every=50, block_rows=2048)) == brute(rows, 50)


def test_a_hot_label_in_parts_and_turns(spark):
    rows = [(i, v, 1 if i % 3 else label) for i, v, label in clustered(5000, 16, 9)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert found(negatives.hard_negatives(df, block_rows=2048, anchor_rows=7)) == brute(rows)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0], 1), (100, [0.0, 0.0], 1), (200, [], 1), (300, [1.0, 2.0, 3.0], 1), (400, None, 1), (500, [1.0, None], 1), (600, [1.0, nan], 1), (700, [inf, 1.0], 1)]
    rows += [(None, [1.0, 2.0], 1), (1, [1.0, 1.0], 1), (2, [0.5, 1.0], 2), (2, [0.5, 1.0], 2), (3, [0.5, 1.0], 2), (4, [0.9, 0.9], None), (8, [-3.0, -3.0], 1), (9, [], 2), (10, [2.0, 2.0, 2.0], 1), (11, [1.0, 1.0, 1.0], 2)]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'x' AS row", "1 AS score", "2 AS rank", "3 AS place", "4 AS size", "5 AS part", "6 AS turn")
    got = found(negatives.hard_negatives(df))
    assert got == brute(rows) and any(x[0] == 100 for x in got)
    assert negatives.hard_negatives(spark.createDataFrame([], SCHEMA)).count() == 0
    assert negatives.hard_negatives(spark.createDataFrame([(5, [1.0], 1)], SCHEMA)).count() == 0


def test_scores_beyond_double_precision(spark):
    rng = random.Random(2)
    rows = [(i, [rng.randint(-(10**9), 10**9) / 1.0 for _ in range(3)], i % 2) for i in range(300)]
    want = brute(rows)
    assert any(abs(x[4]) > 2**53 for x in want)
    df = spark.createDataFrame(rows, SCHEMA)
    inside = [x for x in want if abs(x[4]) < 2**63]
    got = found(negatives.hard_negatives(df))
    assert [x for x in got if x[4] < 2**63 - 1] == inside


def test_bounds_hold_and_rule_out():
    """No pair within its range is ruled out, and of smooth vectors most others are."""
    rng = np.random.default_rng(3)
    rows = np.floor(np.cumsum(rng.normal(size=(600, 64)), axis=1) * 40)
    anchors = rows[:40]
    score = anchors @ rows.T
    least, most = np.quantile(score, 0.95, axis=1), np.quantile(score, 0.99, axis=1)
    search = negatives.Search(rows, np.arange(600), 10)
    left = search.bounded(negatives.Summaries(anchors), negatives.Summaries(rows), least, most, np.ones(score.shape, bool))
    inside = (score >= least[:, None]) & (score <= most[:, None])
    assert (left | ~inside).all() and left.mean() < 0.15
    coarse, fine = (search.tested[s] for s in (4, 32))
    assert coarse[1] > 0 and fine[0] < coarse[0]
