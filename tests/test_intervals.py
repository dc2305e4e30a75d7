"""Masks and places against brute force on small random input."""

from __future__ import annotations

import random

import pytest

from strandloom.operators import intervals, ordering


def disjoint(masks):
    out = []
    for a, b in sorted(masks):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [tuple(x) for x in out]


@pytest.mark.parametrize("n", [0, 1, 40, 200])
def test_masks_over_many_spans(spark, n):
    rng = random.Random(n)
    masks = [(a, a + rng.choice([0, 1, 5, 30, 200])) for a in (rng.randrange(1000) for _ in range(n))]
    df = spark.createDataFrame(masks, "a long, b long")
    rows = sorted((r.a, r.b, r.before) for r in intervals.merged(df, 16).collect())
    assert [r[:2] for r in rows] == disjoint(masks)
    assert [r[2] for r in rows] == [None, *[r[1] for r in rows]][: len(rows)]
    whole = spark.createDataFrame([(100, 900)], "a long, b long")
    left = [x for r in intervals.subtract(whole, df).collect() for x in range(r.a, r.b)]
    assert sorted(left) == sorted(set(range(100, 900)) - {x for a, b in masks for x in range(a, b)})


def test_places(spark):
    keys = random.Random(1).sample(range(-500, 5000), 300)
    df = spark.createDataFrame([(k,) for k in keys], "node long")
    got = {r.node: r.new for r in ordering.places(df, "node", "new", 64).collect()}
    assert got == {k: i for i, k in enumerate(sorted(keys))}


def test_ranks_within_a_hot_key(spark):
    rng = random.Random(2)
    rows = [("hot" if i % 10 else "cold", rng.choice([0.0, 1.0, rng.random()]), i) for i in range(2000)] + [("one", 5.0, 1)]
    df = spark.createDataFrame(rows, "k string, v double, i long")
    got = {(r.k, r.i): (r.nth, r.nth_of) for r in ordering.ranks(df, ["k"], ["v", "i"], "nth", 8).collect()}
    want = {}
    for key in ("hot", "cold", "one"):
        own = sorted((v, i) for k, v, i in rows if k == key)
        want |= {(key, i): (n + 1, len(own)) for n, (_, i) in enumerate(own)}
    assert got == want
