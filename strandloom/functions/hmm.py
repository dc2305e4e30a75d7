"""The sequentially Markov coalescent on a piecewise-constant history, in NumPy.

Small helpers for Arrow functions: everything has models along the first axis.
"""

from __future__ import annotations

import math

import numpy as np

SMALL = 1e-8


def generator_step(r: np.ndarray, c: np.ndarray, n: int = 2) -> np.ndarray:
    """exp of the generator over not recombined, floating, and coalesced elsewhere.

    The first two states have [[-r, r], [c, -c n]], with eigenvalues top and
    top - 2 gap, both below zero. In exp(top) times the even and odd part of the
    rest nothing grows, however long the step is.
    """
    half, product = (r + c * n) / 2, r * c * (n - 1)
    gap = np.sqrt(np.maximum(half**2 - product, 0))
    top = np.exp(-product / np.maximum(half + gap, 1e-300))  # their product over the lower one
    even = (1 + np.exp(-2 * gap)) / 2
    odd = np.where(gap < 1e-9, 1.0, -np.expm1(-2 * gap) / (2 * np.maximum(gap, 1e-9)))
    out = np.zeros((*r.shape, 3, 3))
    out[..., 0, 0], out[..., 0, 1] = top * (even + (half - r) * odd), top * r * odd
    out[..., 1, 0], out[..., 1, 1] = top * c * odd, top * (even + (half - c * n) * odd)
    out[..., :2, 2] = np.maximum(1 - out[..., :2, :2].sum(axis=-1), 0)
    out[..., 2, 2] = 1
    return out


def expected_times(t: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Expected event time within each piece; the last is open."""
    dt = np.diff(t, axis=-1)
    x = c[..., :-1] * dt
    inner = np.where(x < 1e-6, t[..., :-1] + dt / 2, 1 / c[..., :-1] + t[..., :-1] - dt / np.expm1(np.clip(x, 1e-300, 700)))
    inner = np.where(c[..., :-1] > 100, t[..., :-1], inner)
    return np.maximum(np.concatenate([inner, t[..., -1:] + 1 / c[..., -1:]], axis=-1), 1e-20)


def transition(t: np.ndarray, c: np.ndarray, rho: np.ndarray, n: int = 2) -> np.ndarray:
    """Transition matrices of the event's piece from one window to the next."""
    k, m = t.shape
    ect = expected_times(t, c)
    points = np.stack([t, ect], axis=-1).reshape(k, 2 * m)
    gaps, rates = np.diff(points, axis=-1), np.repeat(c, 2, axis=-1)[:, :-1]
    steps = generator_step(2 * gaps * rho[:, None], gaps * rates, n)
    reach = np.zeros((k, 2 * m + 1, 3))
    reach[:, 0, 0] = 1
    for i in range(2 * m - 1):
        reach[:, i + 1] = np.einsum("ka,kab->kb", reach[:, i], steps[:, i])
    reach[:, 2 * m, 2] = 1
    at, mid = reach[:, ::2], reach[:, 1::2]
    cc = c * (n - 1)
    left = np.exp(-(t[:, 1:] - ect[:, :-1]) * cc[:, :-1])
    left = np.concatenate([left, np.zeros((k, 1))], axis=1)
    stay = np.concatenate([np.exp(-np.diff(t, axis=-1) * cc[:, :-1]), np.zeros((k, 1))], axis=1)
    out = np.zeros((k, m, m))
    clip = lambda x: np.clip(x, SMALL, 1 - SMALL)
    for i in range(m):
        out[:, i, :i] = (at[:, 1:, 2] - at[:, :-1, 2])[:, :i]
        out[:, i, i] = mid[:, i, 0] + mid[:, i, 1] * (1 - left[:, i]) + mid[:, i, 2] - at[:, i, 2]
        past = clip(mid[:, i, 1] * left[:, i])
        for j in range(i + 1, m):
            out[:, i, j] = past * clip(1 - stay[:, j])
            past = past * clip(stay[:, j])
    return out


def revisit(t: np.ndarray, c: np.ndarray, at: float, r: float, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The event time at a distance r from where it is `at`: its density (models, points), and the chance of no change."""
    ends = np.concatenate([t[:, 1:], np.full((len(t), 1), np.inf)], axis=1)

    def until(x: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        span = np.maximum(np.minimum(ends, x) - t, 0)
        steps = generator_step(span * r, span * c)
        row = np.zeros((len(t), 1, 3))
        row[:, 0, 0] = 1
        for i in range(t.shape[1]):
            row = row @ steps[:, i]
        return row[:, 0, 0], row[:, 0, 1], (span * c).sum(axis=1)

    apart, floating, hazard = until(at)
    out = np.empty((len(t), len(points)))
    for j, x in enumerate(points):
        _, afloat, h = until(x)
        rate = np.take_along_axis(c, np.maximum((t <= x).sum(axis=1) - 1, 0)[:, None], axis=1)[:, 0]
        out[:, j] = rate * (afloat if x < at else floating * np.exp(hazard - h))
    return out, apart


def start(t: np.ndarray, c: np.ndarray) -> np.ndarray:
    h = np.concatenate([np.zeros((len(t), 1)), np.cumsum(np.diff(t, axis=-1) * c[:, :-1], axis=-1)], axis=1)
    alive = np.concatenate([np.exp(-h), np.zeros((len(t), 1))], axis=1)
    return alive[:, :-1] - alive[:, 1:]


def log_likelihood(t: np.ndarray, c: np.ndarray, theta: np.ndarray, rho: np.ndarray, obs: np.ndarray, warm: int = 0) -> np.ndarray:
    """(models, sequences): the scaled forward recursion; -1 is missing.

    The step comes before the first emission; the first `warm` windows only set
    the state.
    """
    a, miss = transition(t, c, rho), np.exp(-theta[:, None] * expected_times(t, c))
    emit = np.stack([miss, 1 - miss, np.ones_like(miss)], axis=1)  # 0, 1, and -1 as the last
    alpha = np.repeat(start(t, c)[:, None], len(obs), axis=1)
    total = np.zeros((len(t), len(obs)))
    for i in range(obs.shape[1]):
        alpha = alpha @ a * emit[:, np.clip(obs[:, i], -1, 1)]
        scale = alpha.sum(axis=-1)
        alpha /= scale[..., None]
        if i >= warm:
            total += np.log(scale)
    return total


def tables_of(t: np.ndarray, c: np.ndarray, theta: np.ndarray, rho: np.ndarray) -> np.ndarray:
    """(models, k): transition matrix, chance of no mutation, and start of each model, side by side."""
    return np.concatenate([transition(t, c, rho).reshape(len(t), -1), np.exp(-theta[:, None] * expected_times(t, c)), start(t, c)], axis=1)


def symbols(obs: np.ndarray) -> np.ndarray:
    """Observations as rows of the emission table: 0, 1 for one or more, 2 for missing."""
    return np.where(obs < 0, 2, np.minimum(obs, 1))


def schedule(obs: np.ndarray) -> np.ndarray:
    """(steps, 2): each run of one symbol as powers of two of its step's matrix, the symbol and the power's logarithm.

    There are as many steps as runs have binary digits that are set, however
    many windows the runs take.
    """
    seen = symbols(np.asarray(obs))
    if not len(seen):
        return np.zeros((0, 2), np.int64)
    first = np.flatnonzero(np.concatenate([[True], seen[1:] != seen[:-1]]))
    lengths = np.diff(np.append(first, len(seen)))
    digits = lengths[:, None] >> np.arange(int(lengths.max()).bit_length()) & 1
    run, power = np.nonzero(digits)
    return np.stack([seen[first][run], power], axis=1)


class Ladder:
    """Matrices of a window's step for each symbol, and their powers of two, each scaled to a largest entry of one."""

    def __init__(self, tables: np.ndarray, tops: dict[int, int]):
        k = len(tables)
        self.m = m = int(math.isqrt(tables.shape[1] + 1)) - 1
        self.a, miss, self.first = tables[:, : m * m].reshape(k, m, m), tables[:, m * m : m * m + m], tables[:, m * m + m :]
        self.emit = [miss, 1 - miss, np.ones_like(miss)]
        self.power: dict[tuple[int, int], np.ndarray] = {}
        self.scale: dict[tuple[int, int], np.ndarray] = {}
        for symbol, top in tops.items():
            one, scale = self.a * self.emit[symbol][:, None], np.zeros(k)
            for j in range(top + 1):
                if j:
                    one, scale = one @ one, 2 * scale
                most = one.max(axis=(1, 2))
                one, scale = one / most[:, None, None], scale + np.log(most)
                self.power[symbol, j], self.scale[symbol, j] = one, scale

    def slopes(self, of_power: dict[tuple[int, int], np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Slopes in the transition matrix and in the chance of no mutation, from those in the scaled powers.

        A power is the square of the one before, times a number that its scale
        takes back; so slopes go down the ladder, to a single window's step.
        """
        of_a, of_miss = np.zeros_like(self.a), np.zeros_like(self.emit[0])
        for symbol in {s for s, _ in of_power}:
            top = max(j for s, j in of_power if s == symbol)
            slope = np.zeros_like(self.a)
            for j in range(top, -1, -1):
                if (symbol, j) in of_power:
                    slope = slope + of_power[symbol, j]
                # the scale's logarithm at this rung, less twice that of the rung below
                grown = self.scale[symbol, j] - (2 * self.scale[symbol, j - 1] if j else 0)
                slope = slope / np.exp(grown)[:, None, None]
                if j:
                    below = self.power[symbol, j - 1].transpose(0, 2, 1)
                    slope = slope @ below + below @ slope
            of_a += slope * self.emit[symbol][:, None]
            if symbol < 2:
                of_miss += (1 - 2 * symbol) * (slope * self.a).sum(axis=1)
        return of_a, of_miss


def run_likelihood(tables: np.ndarray, obs: np.ndarray, counts: np.ndarray | None = None) -> np.ndarray:
    """The log-likelihood of all sequences, each as often as counts has it, for each model, by runs; for more models than sequences."""
    plans = [schedule(row) for row in obs]
    every = np.concatenate(plans)
    ladder = Ladder(tables, {int(s): int(every[every[:, 0] == s, 1].max()) for s in np.unique(every[:, 0])})
    value = np.zeros(len(tables))
    for plan, often in zip(plans, np.ones(len(plans)) if counts is None else counts, strict=True):
        alpha, scale = ladder.first[:, None], np.ones((len(tables), 1, 1))
        for symbol, power in plan.tolist():
            alpha = np.matmul(alpha, ladder.power[symbol, power])
            scale = alpha.sum(axis=2, keepdims=True)
            alpha = alpha / scale
            value += often * (np.log(scale[:, 0, 0]) + ladder.scale[symbol, power])
    return value


def run_slopes(tables: np.ndarray, obs: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The log-likelihood of all sequences for each model, and its slope in every number of tables_of().

    A sequence counts as often as counts has it. Runs are taken by powers of two, so the time goes with the runs. Forward
    states are kept at the ends of stretches of about the root of the steps;
    going back, a stretch's own are computed again. What a step adds to the
    slope of its matrix is the chance of what came before times that of what
    comes after.
    """
    k, plans = len(tables), [schedule(row) for row in obs]
    tops: dict[int, int] = {}
    for plan in plans:
        for symbol in range(3):
            own = plan[plan[:, 0] == symbol, 1]
            if len(own):
                tops[symbol] = max(tops.get(symbol, 0), int(own.max()))
    ladder = Ladder(tables, tops)
    value, of_first = np.zeros(k), np.zeros_like(ladder.first)
    of_power = {key: np.zeros_like(ladder.a) for key in ladder.power}
    back = {key: np.ascontiguousarray(x.transpose(0, 2, 1)) for key, x in ladder.power.items()}

    def forward(alpha: np.ndarray, steps: list[tuple[int, int]]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        states, sums = [alpha], []
        for step in steps:
            alpha = np.matmul(alpha, ladder.power[step])
            total = alpha.sum(axis=2, keepdims=True)
            alpha = alpha / total
            states.append(alpha)
            sums.append(total)
        return states, sums

    for plan, often in zip(plans, np.ones(len(plans)) if counts is None else counts, strict=True):
        steps = [(int(s), int(j)) for s, j in plan]
        stretch = max(1, math.isqrt(len(steps)))
        alpha, marks = ladder.first[:, None], []
        for at in range(0, len(steps), stretch):
            marks.append(alpha)
            states, sums = forward(alpha, steps[at : at + stretch])
            alpha = states[-1]
            value += often * np.log(np.concatenate(sums, axis=1)[..., 0]).sum(axis=1)
        for step in steps:
            value += often * ladder.scale[step]
        beta = np.full((k, 1, ladder.m), float(often))
        for nth in range(len(marks) - 1, -1, -1):
            own = steps[nth * stretch : (nth + 1) * stretch]
            states, sums = forward(marks[nth], own)
            after: list[np.ndarray] = [beta] * len(own)
            for i in range(len(own) - 1, -1, -1):
                after[i] = beta / sums[i]
                beta = np.matmul(after[i], back[own[i]])
            for step in set(own):
                mine = [i for i, x in enumerate(own) if x == step]
                before = np.concatenate([states[i] for i in mine], axis=1)
                of_power[step] += before.transpose(0, 2, 1) @ np.concatenate([after[i] for i in mine], axis=1)
        of_first += beta[:, 0] if steps else 0
    of_a, of_miss = ladder.slopes(of_power)
    return value, np.concatenate([of_a.reshape(k, -1), of_miss, of_first], axis=1)


class Beginnings:
    """The beginnings that sequences of one length have in common, each once, counted.

    A level for each window has its nodes by symbol: their parents in the level
    above, where each symbol's begin and end, and how many sequences go through
    each.
    """

    def __init__(self, obs: np.ndarray, counts: np.ndarray | None = None):
        width = obs.shape[1]
        texts = np.ascontiguousarray(symbols(obs) + 1, np.uint8).view(f"S{width}")[:, 0]
        whole, at = np.unique(texts, return_inverse=True)
        rows = whole.view(np.uint8).reshape(-1, width) - 1
        alike = (rows[1:] != rows[:-1]).argmax(axis=1)  # windows that a sequence shares with the one before
        upto = np.concatenate([[0.0], np.cumsum(np.bincount(at, counts))])
        self.levels: list[tuple[np.ndarray, list[int], np.ndarray]] = []
        place = np.zeros(len(rows), np.int64)
        for i in range(width):
            new = np.concatenate([[True], alike <= i])
            first = np.flatnonzero(new)
            symbol = rows[first, i]
            order = np.argsort(symbol, kind="stable")
            often = np.diff(upto[np.append(first, len(rows))])
            self.levels.append((place[first][order], np.searchsorted(symbol[order], range(4)).tolist(), often[order]))
            rank = np.empty_like(order)
            rank[order] = np.arange(len(order))
            place = rank[np.cumsum(new) - 1]

    @property
    def nodes(self) -> int:
        return sum(len(parent) for parent, _, _ in self.levels)


def beginning_slopes(tables: np.ndarray, tree: Beginnings) -> tuple[np.ndarray, np.ndarray]:
    """run_slopes() of many sequences at once: each beginning is gone through once forward and once back."""
    k, m = len(tables), int(math.isqrt(tables.shape[1] + 1)) - 1
    a, miss, first = tables[:, : m * m].reshape(k, m, m), tables[:, m * m : m * m + m], tables[:, m * m + m :]
    emit = np.stack([miss, 1 - miss, np.ones_like(miss)], axis=1)
    value, of_a, of_miss, of_first, unit = np.zeros(k), np.zeros_like(a), np.zeros_like(miss), np.zeros_like(first), np.ones(m)
    for r in range(k):  # one model's states are held at a time
        one = a[r] * emit[r][:, None]
        states, sums = [first[r][None]], []
        for parent, ends, often in tree.levels:
            x = np.empty((len(parent), m))
            for s in range(3):
                if ends[s] < ends[s + 1]:
                    np.matmul(states[-1].take(parent[ends[s] : ends[s + 1]], axis=0), one[s], out=x[ends[s] : ends[s + 1]])
            total = x @ unit
            value[r] += often @ np.log(total)
            x /= total[:, None]
            states.append(x)
            sums.append(total)
        of_one = np.zeros_like(one)
        down = np.repeat(tree.levels[-1][2][:, None], m, axis=1)
        for (parent, ends, _), above, total in zip(tree.levels[::-1], states[-2::-1], sums[::-1], strict=True):
            down /= total[:, None]
            up = np.zeros_like(above)
            for s in range(3):
                if ends[s] < ends[s + 1]:
                    who, mine = parent[ends[s] : ends[s + 1]], down[ends[s] : ends[s + 1]]
                    of_one[s] += above.take(who, axis=0).T @ mine
                    up[who] += mine @ one[s].T  # a node has one child of a symbol at most
            down = up
        of_a[r] = (of_one * emit[r][:, None]).sum(axis=0)
        of_miss[r] = ((of_one[0] - of_one[1]) * a[r]).sum(axis=0)
        of_first[r] = down[0]
    return value, np.concatenate([of_a.reshape(k, -1), of_miss, of_first], axis=1)


def shared_beginnings(obs: np.ndarray, counts: np.ndarray | None = None) -> Beginnings | None:
    """The sequences' beginnings where going by them takes less time than each sequence's runs alone.

    By times measured: a run takes as long as four nodes at least, and a level as
    150.
    """
    if obs.shape[0] * obs.shape[1] == 0:
        return None
    seen = symbols(obs)
    runs = len(seen) + int((seen[:, 1:] != seen[:, :-1]).sum())
    if 150 * obs.shape[1] > 4 * runs:
        return None
    tree = Beginnings(obs, counts)
    return tree if tree.nodes + 150 * obs.shape[1] < 4 * runs else None


def table_slopes(tables: np.ndarray, obs: np.ndarray, warm: int = 0, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The log-likelihood of all sequences after their warm-up for each model, and its slope in every number of tables_of()."""

    def of(part: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        tree = shared_beginnings(part, counts)
        return run_slopes(tables, part, counts) if tree is None else beginning_slopes(tables, tree)

    value, slope = of(obs)
    if warm:
        early, of_early = of(obs[:, :warm])
        value, slope = value - early, slope - of_early
    return value, slope


def number_slopes(x: np.ndarray, theta: float, slope: np.ndarray, h: float = 1e-5) -> np.ndarray:
    """Slopes in the particles' numbers from those in their tables, by central differences of the tables."""
    grad, n = np.empty_like(x), x.shape[1]
    wide = max(1, 1024 // max(1, len(x)))
    for j in range(0, n, wide):
        moves = h * np.eye(n)[j : j + wide]
        moved = (x[:, None] + np.concatenate([moves, -moves])[None]).reshape(-1, n)
        tables = tables_of(*to_models(moved, theta)).reshape(len(x), 2 * len(moves), -1)
        grad[:, j : j + wide] = (slope[:, None] * (tables[:, : len(moves)] - tables[:, len(moves) :])).sum(axis=2) / (2 * h)
    return grad


def likelihood_slopes(x: np.ndarray, theta: float, obs: np.ndarray, warm: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(particles,) and (particles, 18): the log-likelihood of all sequences after their warm-up, and its gradient.

    The data are passed over once forward and once back for each particle; the
    tables' slopes in the particles' numbers need no data.
    """
    value, slope = table_slopes(tables_of(*to_models(x, theta)), obs, warm)
    return value, number_slopes(x, theta, slope)


def default_history(m: int = 16) -> tuple[np.ndarray, np.ndarray]:
    return np.concatenate([[0.0], np.geomspace(1e-3, 15, m - 1)])[None], np.ones((1, m))


def to_models(x: np.ndarray, theta: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Particles of 18 numbers to t, c, theta, rho; rates tied by the pattern 14*1+1*2."""
    first = np.exp(np.clip(x[:, 0], -30, 10))
    last = first + np.exp(np.clip(x[:, 1], -30, 10))
    grid = first[:, None] * (last / first)[:, None] ** (np.arange(15) / 14)
    t = np.concatenate([np.zeros((len(x), 1)), grid], axis=1)
    free = np.logaddexp(0, x[:, 2:17]) + 1e-12
    c = free[:, [*range(14), 14, 14]]
    rate = theta * (0.1 + 9.9 / (1 + np.exp(-x[:, 17])))
    return t, c, np.full(len(x), theta), rate


def log_prior(x: np.ndarray, alpha: float = 0.0, beta: float = 0.0) -> np.ndarray:
    ratio = np.log(0.1 + 9.9 / (1 + np.exp(-x[:, 17])))
    c = np.log(np.logaddexp(0, x[:, 2:17]) + 1e-12)
    return -0.5 * ratio**2 - 0.5 * np.log(2 * np.pi) - alpha * (np.diff(c, axis=1) ** 2).sum(axis=1) - beta * (x**2).sum(axis=1)


def structured(t: np.ndarray, c: np.ndarray, theta: np.ndarray, rho: np.ndarray) -> dict[str, np.ndarray]:
    """The transition matrices' columns below, diagonal and rank-one part above; emissions and start."""
    a = transition(t, c, rho)
    none = np.zeros((len(t), 1))
    below = np.diagonal(a, -1, 1, 2)
    v = np.concatenate([none, a[:, 0, 1:] / a[:, 0, 1:2]], axis=1)
    u = np.diagonal(a, 1, 1, 2) / v[:, 1:]
    miss = np.exp(-theta[:, None] * expected_times(t, c))
    parts = {"b": np.concatenate([below, none], axis=1), "d": np.diagonal(a, 0, 1, 2), "u": np.concatenate([u, none], axis=1), "v": v, "emis0": miss, "emis1": 1 - miss, "pi": start(t, c)}
    return parts


def coalescence_times(t: np.ndarray, c: np.ndarray, n: int) -> np.ndarray:
    """(models, n - 1): the expected times with 2 to n lineages."""
    dt = np.diff(t, axis=-1)
    h = np.concatenate([np.zeros((len(t), 1)), np.cumsum(dt * c[:, :-1], axis=-1)], axis=1)
    k = np.arange(2, n + 1)
    r = (k * (k - 1) / 2)[None, :, None]
    gone = np.concatenate([-np.expm1(-r * (c[:, :-1] * dt)[:, None]), np.ones((len(t), len(k), 1))], axis=2)
    return (np.exp(-r * h[:, None]) / (r * c[:, None]) * gone).sum(axis=2)


def spectrum_term(t: np.ndarray, c: np.ndarray, observed: np.ndarray, weights: np.ndarray, matrix: np.ndarray) -> np.ndarray:
    """The log-likelihood of an observed spectrum, both it and the expected one mapped by matrix."""
    lengths = coalescence_times(t, c, len(observed) + 1) @ weights.T
    expected = lengths / lengths.sum(axis=1, keepdims=True) @ matrix.T
    seen = matrix @ observed
    return np.where(seen > 0, seen * np.log(np.maximum(expected, 1e-300)), 0.0).sum(axis=1)
