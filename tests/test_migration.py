"""Two lineages in two populations: against dense exponentials, one population, and lineages that never meet."""

from __future__ import annotations

import numpy as np
import pytest

from strandloom.functions import migration


def models(n, pieces, seed):
    rng = np.random.default_rng(seed)
    t = np.concatenate([np.zeros((n, 1)), np.cumsum(rng.gamma(1, 1, (n, pieces - 1)), axis=1)], axis=1)
    return t, *(rng.gamma(1, 1, (n, pieces)) + 0.01 for _ in range(4))


def dense(q, d):
    values, vectors = np.linalg.eig(q)
    return (vectors @ np.diag(np.exp(values * d)) @ np.linalg.inv(vectors)).real


@pytest.mark.parametrize("d", [0.0, 1e-9, 0.3, 7.0, 300.0])
def test_step_is_the_exponential(d):
    _, *rates = models(5, 3, 1)
    q = migration.generator(*rates)
    got = migration.step(q, np.full(q.shape[:2], d))
    for i in np.ndindex(q.shape[:2]):
        assert got[i] == pytest.approx(dense(q[i], d), abs=1e-12)


def test_rates_and_mean_equal_dense_ones():
    t, *rates = models(3, 4, 2)
    q, start, points = migration.generator(*rates), np.array([0.2, 0.0, 0.8]), np.array([0.0, 0.4, 1.3, 2.9, 9.0])
    found = migration.pair_rate(t, *rates, start, points)
    grid = np.linspace(0, 60, 60_001)
    for k in range(3):
        for p, x in enumerate(points):
            state = start
            for i in range(4):
                end = t[k, i + 1] if i < 3 else np.inf
                state = state @ dense(q[k, i], max(0.0, min(end, x) - t[k, i]))
            piece = int((t[k] <= x).sum()) - 1
            assert found["alive"][k, p] == pytest.approx(state.sum())
            assert found["rate"][k, p] == pytest.approx((state[0] * rates[0][k, piece] + state[1] * rates[1][k, piece]) / state.sum())
        alive = migration.states_at(t[k : k + 1], q[k : k + 1], start, grid).sum(axis=-1)[0]
        assert migration.mean_time(t, *rates, start)[k] == pytest.approx(np.trapezoid(alive, grid), rel=1e-4)


def test_without_migration_it_is_one_population():
    t, c, *_ = models(4, 6, 3)
    none, points = np.zeros_like(c), np.geomspace(0.01, 20, 30)
    found = migration.pair_rate(t, c, 2 * c, none, none, np.array([1.0, 0.0, 0.0]), points)
    piece = (t[:, None] <= points[None, :, None]).sum(axis=-1) - 1
    hazard = (c[:, None] * np.clip(np.minimum(np.append(t[:, 1:], np.full((4, 1), np.inf), axis=1)[:, None], points[None, :, None]) - t[:, None], 0, None)).sum(axis=-1)
    assert found["rate"] == pytest.approx(np.take_along_axis(c, piece, axis=1)) and found["alive"] == pytest.approx(np.exp(-hazard))
    dt, before = np.diff(t), np.concatenate([np.zeros((4, 1)), np.cumsum(np.diff(t) * c[:, :-1], axis=1)], axis=1)
    want = (np.exp(-before[:, :-1]) * -np.expm1(-c[:, :-1] * dt) / c[:, :-1]).sum(axis=1) + np.exp(-before[:, -1]) / c[:, -1]
    assert migration.mean_time(t, c, 2 * c, none, none, np.array([1.0, 0.0, 0.0])) == pytest.approx(want)


def test_lineages_that_meet_when_populations_merge_or_never():
    t, c = np.array([[0.0, 3.0]]), np.array([[1.0, 2.0]])
    none, apart = np.zeros_like(c), np.array([0.0, 0.0, 1.0])
    assert migration.mean_time(t, c, c, none, none, apart) == np.inf
    merged = np.array([[False, True]])
    assert migration.mean_time(t, c, c, none, none, apart, merged) == pytest.approx(3.5)
    found = migration.pair_rate(t, c, c, none, none, apart, np.array([2.9, 3.0, 4.0]), merged)
    assert found["rate"][0].tolist() == pytest.approx([0.0, 2.0, 2.0]) and found["alive"][0].tolist() == pytest.approx([1, 1, np.exp(-2)])
