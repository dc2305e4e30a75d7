"""Long steps, gradients and blocks of the hidden Markov model."""

from __future__ import annotations

import numpy as np
import pytest

from strandloom.functions import hmm
from strandloom.operators import fit


def particles(n, seed=0):
    rng = np.random.default_rng(seed)
    base = np.concatenate([[np.log(1e-2), np.log(8.0)], np.full(15, np.log(np.expm1(1.0))), [-2.0]])
    return base + 0.4 * rng.normal(size=(n, 18))


def test_wide_gaps_stay_finite():
    t, c = np.array([[0.0, 1.0, 500.0, 3000.0], [0.0, 1e-9, 1e4, 1e7]]), np.ones((2, 4))
    for rho in (1e-8, 1.0, 50.0):
        a = hmm.transition(t, c, np.full(2, rho))
        assert np.isfinite(a).all() and abs(a.sum(axis=-1) - 1).max() < 1e-6


@pytest.mark.parametrize("n", [2, 5])
def test_step_is_the_exponential(n):
    rng = np.random.default_rng(2)
    for r, c in [*rng.uniform(0, 3, (20, 2)), (1.0, 1.0), (0.0, 0.0), (1e-12, 2.0)]:
        q = np.array([[-r, r, 0], [c, -c * n, c * (n - 1)], [0, 0, 0]]) / 2**12
        power = np.eye(3) + q + q @ q / 2 + q @ q @ q / 6
        for _ in range(12):
            power = power @ power
        assert hmm.generator_step(np.array([r]), np.array([c]), n)[0] == pytest.approx(power, abs=1e-9)


@pytest.mark.parametrize("warm", [0, 4])
def test_gradient_is_the_central_difference(warm):
    rng, x = np.random.default_rng(3), particles(3)
    obs = rng.choice([-1, 0, 0, 0, 1], size=(4, 30))
    value, grad = hmm.likelihood_slopes(x, 0.2, obs, warm)
    look = lambda p: hmm.log_likelihood(*hmm.to_models(p, 0.2), obs, warm).sum(axis=1)
    assert value == pytest.approx(look(x))
    for j in range(18):
        move = np.zeros(18)
        move[j] = 1e-4
        assert grad[:, j] == pytest.approx((look(x + move) - look(x - move)) / 2e-4, rel=2e-3, abs=2e-4)


def dense(tables, obs, m=16):
    """Values of the log-likelihood, a window at a time."""
    a, miss, first = tables[:, : m * m].reshape(-1, m, m), tables[:, m * m : m * m + m], tables[:, m * m + m :]
    out = np.zeros(len(tables))
    for row in obs:
        alpha = first
        for x in row:
            alpha = np.einsum("km,kmn->kn", alpha, a) * (1 if x < 0 else miss if x == 0 else 1 - miss)
            out += np.log(alpha.sum(axis=1))
            alpha = alpha / alpha.sum(axis=1, keepdims=True)
    return out


@pytest.mark.parametrize("width", [1, 2, 77, 400])
def test_runs_are_the_windows(width):
    """Values and every slope of the tables, on sequences of long and short runs."""
    rng, x = np.random.default_rng(width), particles(2, width)
    obs = np.array([np.repeat(rng.choice([-1, 0, 0, 1, 2], size=width), rng.integers(1, 40, size=width))[:width] for _ in range(3)])
    tables = hmm.tables_of(*hmm.to_models(x, 0.2))
    value, slope = hmm.run_slopes(tables, obs)
    assert value == pytest.approx(dense(tables, obs), rel=1e-9)
    for j in rng.choice(tables.shape[1], 40, replace=False):
        h = 1e-6 * max(1e-3, abs(tables[:, j]).max())
        up, down = tables.copy(), tables.copy()
        up[:, j] += h
        down[:, j] -= h
        assert slope[:, j] == pytest.approx((dense(up, obs) - dense(down, obs)) / (2 * h), rel=2e-4, abs=1e-3 * max(1, abs(slope[:, j]).max()))


def test_steps_go_with_runs_not_windows():
    obs = np.zeros(1 << 16, np.int64)
    obs[::1000] = 1
    assert len(hmm.schedule(obs)) < 66 * (1 + 10) and len(hmm.schedule(obs[:0])) == 0
    total = sum(1 << j for _, j in hmm.schedule(obs))
    assert total == len(obs)


def test_long_runs_stay_finite():
    x, obs = particles(2), np.zeros((1, 1 << 20), np.int64)
    value, grad = hmm.likelihood_slopes(x, 0.2, obs)
    assert np.isfinite(value).all() and np.isfinite(grad).all()


def test_ragged_rows():
    import pyarrow as pa

    rows = fit.rows_of(pa.array([[0, 1], [1], [], [0, 0, 1]], pa.list_(pa.int8())))
    assert rows.tolist() == [[0, 1, -1], [1, -1, -1], [-1, -1, -1], [0, 0, 1]]
    assert fit.rows_of(pa.array([[0, 1], [1, 1]], pa.list_(pa.int8())).slice(1)).tolist() == [[1, 1]]


def test_blocks_add_up(spark, monkeypatch):
    rng, x = np.random.default_rng(4), particles(5, 1)
    rows = [(i, rng.choice([-1, 0, 1], size=25).tolist()) for i in range(40)]
    chunks = spark.createDataFrame(rows, "k long, obs array<byte>")
    value, grad = hmm.likelihood_slopes(x, 0.2, np.array([r[1] for r in rows]), 5)
    assert fit.total_likelihood(chunks, x, 0.2, 5) == pytest.approx(value)
    monkeypatch.setattr(fit, "CELLS", 2000)
    for got, want in zip(fit.total_slopes(chunks, x, 0.2, 5), (value, grad), strict=True):
        assert got == pytest.approx(want, rel=1e-8, abs=1e-8)
    assert max(b[0].stop for b in fit.blocks(500, 10_000, 16 * 26)) <= 500 + fit.CELLS


def test_a_step_reads_only_the_buckets_it_drew(spark, monkeypatch):
    monkeypatch.setattr(fit, "BUCKET", 2)
    rng = np.random.default_rng(6)
    rows = [(i, rng.choice([-1, 0, 1], size=9).tolist()) for i in range(60)]
    store = fit.store_chunks(spark.createDataFrame(rows, "chunk_id long, obs array<byte>"))
    assert (store.chunks, store.buckets) == (60, 30)
    got = store.drawn(np.array([3, 33, 40, 3]))
    assert sorted((r.chunk_id, list(r.obs)) for r in got.collect()) == sorted((i, rows[i][1]) for i in (3, 3, 33, 40))

    def scanned(plan):
        plan = plan.executedPlan() if "Adaptive" in plan.nodeName() else plan
        found, todo = [], [plan]
        while todo:
            node = todo.pop()
            if node.nodeName().startswith("AdaptiveSparkPlan"):
                todo.append(node.executedPlan())
                continue
            if node.nodeName().startswith("Scan parquet"):
                found.append(node.metrics().apply("numFiles").value())
            kids = node.children()
            todo += [kids.apply(i) for i in range(kids.size())]
            if "QueryStage" in node.nodeName():
                todo.append(node.plan())
        return found

    assert scanned(got._jdf.queryExecution().executedPlan()) == [2]  # 3 and 33 share a bucket of 30


def test_a_lost_particle_does_not_stop_the_fit(spark, monkeypatch):
    rows = [(i, [0, 1, 0, 0, 1, 0]) for i in range(4)]
    chunks = spark.createDataFrame(rows, "chunk_id long, obs array<byte>")
    whole = fit.total_slopes

    def some(*args):
        value, slope = whole(*args)
        slope[0] = np.nan
        return value, slope

    monkeypatch.setattr(fit, "total_slopes", some)
    assert np.isfinite(fit.fit(chunks, 0.2, particles=4, iterations=2)).all()
    monkeypatch.setattr(fit, "total_slopes", lambda *args: tuple(np.full_like(x, np.nan) for x in whole(*args)))
    with pytest.raises(ArithmeticError, match="no finite slope"):
        fit.fit(chunks, 0.2, particles=4, iterations=2)


def test_weights_of_the_density(spark, monkeypatch):
    """Each term's slope counts as often as its weight says."""
    rows = [(i, [0, 1, 0, 0, 1, 0]) for i in range(4)]
    chunks, seen = spark.createDataFrame(rows, "chunk_id long, obs array<byte>"), []
    step = fit.stein_step
    monkeypatch.setattr(fit, "stein_step", lambda x, slope: seen.append(slope) or step(x, slope))
    for weights in ((1, 0, 0), (0, 1, 0), (0, 0, 1), (2, 3, 0.5)):
        fit.fit(chunks, 0.2, particles=3, iterations=1, alpha=0.1, afs=[5.0, 3.0, 2.0, 1.0], weights=weights)
    prior, data, spectrum, mixed = seen
    assert mixed == pytest.approx(2 * prior + 3 * data + 0.5 * spectrum) and all(abs(x).max() > 0 for x in seen)


@pytest.mark.parametrize("width", [1, 9, 25])
def test_shared_beginnings_are_the_runs(width):
    """Values and every slope of the tables, of sequences that count several times."""
    rng, x = np.random.default_rng(width), particles(3, width)
    obs, counts = rng.choice([-1, 0, 0, 1, 2], size=(300, width)), rng.integers(1, 9, size=300).astype(float)
    tables, tree = hmm.tables_of(*hmm.to_models(x, 0.2)), hmm.Beginnings(obs, counts)
    assert tree.nodes <= sum(min(300, 3 ** (i + 1)) for i in range(width)) and [often.sum() for _, _, often in tree.levels] == [counts.sum()] * width
    want = hmm.run_slopes(tables, np.repeat(obs, counts.astype(int), axis=0))
    for got in (hmm.beginning_slopes(tables, tree), hmm.run_slopes(tables, obs, counts)):
        assert got[0] == pytest.approx(want[0], rel=1e-10)
        assert got[1] == pytest.approx(want[1], rel=1e-8, abs=1e-9 * abs(want[1]).max())
    repeated = hmm.run_likelihood(tables, np.repeat(obs[:9], 2, axis=0))
    assert hmm.run_likelihood(tables, obs[:9], np.full(9, 2.0)) == pytest.approx(repeated, rel=1e-10)


def test_short_sequences_go_together_and_long_ones_alone():
    rng = np.random.default_rng(3)
    assert hmm.shared_beginnings(rng.choice([-1, 0, 1], size=(2000, 25))).nodes < 2000 * 20
    assert hmm.shared_beginnings(np.zeros((2, 5000), np.int64)) is None and hmm.shared_beginnings(np.zeros((2, 0), np.int64)) is None


def test_many_short_chunks_are_not_taken_one_by_one(spark, monkeypatch):
    """Equal chunks are taken once, and the steps go with beginnings, not with chunks; the sums are those of all chunks."""
    rng, x = np.random.default_rng(5), particles(3, 1)
    kinds = rng.choice([-1, 0, 1], size=(600, 25))
    rows = [(int(i), kinds[i % 600].tolist()) for i in range(3000)]
    chunks = spark.createDataFrame(rows, "k long, obs array<byte>")
    dealt = fit.counted(chunks).collect()
    assert len(dealt) == len(np.unique(kinds, axis=0)) and sum(r.n for r in dealt) == 3000
    value, slope = hmm.run_slopes(hmm.tables_of(*hmm.to_models(x, 0.2)), kinds)
    early, of_early = hmm.run_slopes(hmm.tables_of(*hmm.to_models(x, 0.2)), kinds[:, :5])
    want = 5 * (value - early), 5 * hmm.number_slopes(x, 0.2, slope - of_early)
    built = []

    class Watched(hmm.Beginnings):
        def __init__(self, *args):
            super().__init__(*args)
            built.append(self.nodes)

    monkeypatch.setattr(hmm, "Beginnings", Watched)
    monkeypatch.setattr(hmm, "run_slopes", lambda *args: pytest.fail("one by one"))
    assert hmm.likelihood_slopes(x, 0.2, kinds, 5)[0] == pytest.approx(value - early) and built[0] < 600 * 21
    monkeypatch.undo()
    for some in (chunks, fit.counted(chunks)):
        for got, find in zip(fit.total_slopes(some, x, 0.2, 5), want, strict=True):
            assert got == pytest.approx(find, rel=1e-7, abs=1e-6)
        assert fit.total_likelihood(some, x, 0.2, 5) == pytest.approx(want[0])
