"""Two lineages in two populations that exchange migrants: a Markov chain of where they are, in NumPy.

Everything has models along the first axis and pieces of constant rates along
the second. States are both in the first population, both in the second, and
one in each; what is missing from one has coalesced.
"""

from __future__ import annotations

import math

import numpy as np

BOTH_FIRST, BOTH_SECOND, APART = range(3)
TERMS = 24  # of the series for a step of at most one expected event: the rest is below double precision


def generator(c1: np.ndarray, c2: np.ndarray, m12: np.ndarray, m21: np.ndarray) -> np.ndarray:
    """Rates between the states, backwards in time: m12 is a lineage's from the first population to the second."""
    out = np.zeros((*c1.shape, 3, 3))
    out[..., BOTH_FIRST, APART], out[..., BOTH_SECOND, APART] = 2 * m12, 2 * m21
    out[..., APART, BOTH_SECOND], out[..., APART, BOTH_FIRST] = m12, m21
    gone = np.stack([c1, c2, np.zeros_like(c1)], axis=-1)
    out[..., range(3), range(3)] = -(out.sum(axis=-1) + gone)
    return out


def step(q: np.ndarray, d: np.ndarray) -> np.ndarray:
    """exp(q * d) by uniformisation: a Poisson number of jumps of a chain, over a part of the time that is then doubled.

    All terms are positive, so nothing cancels, however long the time is.
    """
    rate = np.maximum(-q[..., range(3), range(3)].min(axis=-1), 1e-300)
    events = float((rate * d).max(initial=0))
    doublings = max(0, math.ceil(math.log2(events))) if events > 1 else 0
    jump = np.eye(3) + q / rate[..., None, None]
    mean = (rate * d / 2**doublings)[..., None, None]
    term = np.broadcast_to(np.eye(3), q.shape) * np.exp(-mean)
    out = term.copy()
    for n in range(1, TERMS):
        term = term @ jump * (mean / n)
        out += term
    for _ in range(doublings):
        out = out @ out
    return out


def states_at(t: np.ndarray, q: np.ndarray, start: np.ndarray, points: np.ndarray, merged: np.ndarray | None = None) -> np.ndarray:
    """(models, points, 3): the chance of each state at each time.

    A piece that is `merged` begins with all lineages moved to the first
    population, as where the second splits off from it.
    """
    ends = np.concatenate([t[:, 1:], np.full((len(t), 1), np.inf)], axis=1)
    spans = np.clip(np.minimum(ends[:, None], points[None, :, None]) - t[:, None], 0, None)
    state = np.broadcast_to(start, (len(t), len(points), 3)).copy()
    for i in range(t.shape[1]):
        if merged is not None:
            into = merged[:, i, None] & (points[None] >= t[:, i, None])
            state = np.where(into[..., None], state.sum(axis=-1, keepdims=True) * np.eye(3)[BOTH_FIRST], state)
        steps = step(np.broadcast_to(q[:, None, i], (len(t), len(points), 3, 3)), spans[..., i])
        state = np.einsum("kpa,kpab->kpb", state, steps)
    return state


def pair_rate(t: np.ndarray, c1: np.ndarray, c2: np.ndarray, m12: np.ndarray, m21: np.ndarray, start: np.ndarray, points: np.ndarray, merged: np.ndarray | None = None) -> dict[str, np.ndarray]:
    """The rate of coalescence of lineages that have not yet coalesced, and the chance that they have not, at each point."""
    state = states_at(t, generator(c1, c2, m12, m21), start, points, merged)
    piece = np.maximum((t[:, None] <= points[None, :, None]).sum(axis=-1) - 1, 0)
    own = [np.take_along_axis(c, piece, axis=1) for c in (c1, c2)]
    alive = state.sum(axis=-1)
    return {"rate": (state[..., BOTH_FIRST] * own[0] + state[..., BOTH_SECOND] * own[1]) / np.maximum(alive, 1e-300), "alive": alive}


def mean_time(t: np.ndarray, c1: np.ndarray, c2: np.ndarray, m12: np.ndarray, m21: np.ndarray, start: np.ndarray, merged: np.ndarray | None = None) -> np.ndarray:
    """The mean time of coalescence: the chance of each state, summed over time; infinite where lineages may never meet.

    Within a piece the time spent is a series of doubled spans too: that of
    twice a span is that of the span, and of the span again from where it led.
    """
    q, total = generator(c1, c2, m12, m21), np.zeros(len(t))
    state = np.broadcast_to(start, (len(t), 3)).astype(float)
    for i in range(t.shape[1]):
        if merged is not None:
            state = np.where(merged[:, i, None], state.sum(axis=-1, keepdims=True) * np.eye(3)[BOTH_FIRST], state)
        if i + 1 < t.shape[1]:
            d = t[:, i + 1] - t[:, i]
            rate = np.maximum(-q[:, i, range(3), range(3)].min(axis=-1), 1e-300)
            doublings = max(0, math.ceil(math.log2(max(1.0, float((rate * d).max()))))) + 6
            part = d / 2**doublings
            lead = step(q[:, i], part)
            spent = np.zeros_like(lead)  # the integral of exp(q u) over the part, by its series
            term = np.broadcast_to(np.eye(3), lead.shape) * part[:, None, None]
            for n in range(1, TERMS):
                spent += term
                term = term @ q[:, i] * (part / (n + 1))[:, None, None]
            for _ in range(doublings):
                spent, lead = spent + lead @ spent, lead @ lead
            total += np.einsum("ka,kab->k", state, spent)
            state = np.einsum("ka,kab->kb", state, lead)
        else:
            for k in range(len(t)):
                total[k] += _last(q[k, i], state[k])
    return total


def _last(q: np.ndarray, state: np.ndarray) -> float:
    """The time spent in an open piece from a state on."""
    reached = state > 0
    while True:  # the states that can be reached
        more = reached | ((q > 0) & reached[:, None]).any(axis=0)
        if (more == reached).all():
            break
        reached = more
    if not reached.any():
        return 0.0
    own = q[np.ix_(reached, reached)]
    leaving = -own.sum(axis=1) > 0
    can = leaving.copy()
    for _ in range(3):  # the states from which coalescence can be reached
        can |= ((own > 0) & can[None]).any(axis=1)
    return float(state[reached] @ np.linalg.solve(-own, np.ones(len(own)))) if can.all() else math.inf
