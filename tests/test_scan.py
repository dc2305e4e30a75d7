"""The forward scan over blocks against the recursion over windows."""

from __future__ import annotations

import numpy as np
import pytest
from test_gradient import particles

from strandloom.functions import hmm
from strandloom.operators import fit, scan


@pytest.mark.parametrize(("block", "fan"), [(7, 3), (64, 64), (100_000, 64)])
def test_blocks_join_to_the_whole(spark, monkeypatch, block, fan):
    """One sequence over many tasks, with another that ends early, for three models."""
    monkeypatch.setattr(scan, "FAN", fan)
    rng = np.random.default_rng(block)
    obs = {"a": rng.choice([-1, 0, 0, 0, 0, 1, 2], size=700), "b": rng.choice([0, 1], size=90)}
    rows = [(k, i, int(x)) for k, v in obs.items() for i, x in enumerate(v)]
    model = hmm.to_models(particles(3), 0.2)
    df = spark.createDataFrame(rows, "key string, win long, ob long").repartition(5)
    got = {(r.key, r.model, r.b): r.ll for r in scan.forward(df, "key", hmm.tables_of(*model), block).collect()}
    assert len(got) == 3 * sum(-(-len(v) // block) for v in obs.values())
    for key, values in obs.items():
        for b in range(-(-len(values) // block)):
            want = hmm.log_likelihood(*model, np.minimum(values, 1)[None, : (b + 1) * block])[:, 0]
            assert [got[key, k, b] for k in range(3)] == pytest.approx(want, rel=1e-9)


def test_runs_sum_to_the_windows():
    rng = np.random.default_rng(1)
    obs, x = rng.choice([-1, 0, 0, 0, 1], size=(3, 200)), particles(4)
    model = hmm.to_models(x, 0.2)
    assert hmm.run_likelihood(hmm.tables_of(*model), obs) == pytest.approx(hmm.log_likelihood(*model, obs).sum(axis=1), rel=1e-10)


def test_total_likelihood_with_a_warm_up(spark):
    rng, x = np.random.default_rng(2), particles(3)
    rows = [(i, rng.choice([-1, 0, 1], size=40).tolist()) for i in range(6)]
    want = hmm.log_likelihood(*hmm.to_models(x, 0.2), np.array([r[1] for r in rows]), 5).sum(axis=1)
    assert fit.total_likelihood(spark.createDataFrame(rows, "k long, obs array<byte>"), x, 0.2, 5) == pytest.approx(want)
