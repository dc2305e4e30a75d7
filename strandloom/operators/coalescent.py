"""Transition matrices and structured parameters of each history, by Arrow functions."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ..functions import hmm, migration

MODELS = 256  # histories that one NumPy step holds


def _by_model(histories: DataFrame, key: str, columns: dict[str, str], compute: Callable[[np.ndarray, np.ndarray], dict[str, np.ndarray]]) -> DataFrame:
    """One row for each cell of what compute returns for blocks of histories (key, t, c)."""
    kind = histories.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, MODELS):
                batch = whole.slice(at, MODELS)
                t, c = (np.array(batch.column(i).to_pylist(), float) for i in (1, 2))
                found = compute(t, c)
                shape = next(iter(found.values())).shape
                index = np.indices(shape).reshape(len(shape), -1)
                cells = [pa.array(x) for x in index[1:]] + [pa.array(np.ascontiguousarray(x).ravel()) for x in found.values()]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(index[0])), *cells], [key, *columns])

    schema = ", ".join([f"{key} {kind}", *[f"{name} {form}" for name, form in columns.items()]])
    return histories.select(key, "t", "c").mapInArrow(run, schema)


def transitions(histories: DataFrame, key: str, rho: float) -> DataFrame:
    """(key, i, j, p): the chance that the event's piece goes from i to j between two windows."""
    return _by_model(histories, key, {"i": "long", "j": "long", "p": "double"}, lambda t, c: {"p": hmm.transition(t, c, np.full(len(t), rho))})


def structured(histories: DataFrame, key: str, theta: float, rho: float) -> DataFrame:
    """(key, i, b, d, u, v, emis0, emis1, pi): what a step in linear time needs.

    Below its diagonal a transition matrix has one number for each column, b;
    above it has rank one, u_i v_j; d is the diagonal.
    """
    names = {"i": "long"} | {x: "double" for x in ("b", "d", "u", "v", "emis0", "emis1", "pi")}
    return _by_model(histories, key, names, lambda t, c: hmm.structured(t, c, np.full(len(t), theta), np.full(len(t), rho)))


def revisits(histories: DataFrame, key: str, at: float, r: float, points: np.ndarray) -> DataFrame:
    """(key, k, density, atom): the event time's density at points[k] where it is `at` a distance r away, and the chance that it is the same."""

    def compute(t: np.ndarray, c: np.ndarray) -> dict[str, np.ndarray]:
        density, atom = hmm.revisit(t, c, at, r, points)
        return {"density": density, "atom": np.repeat(atom[:, None], len(points), axis=1)}

    return _by_model(histories, key, {"k": "long", "density": "double", "atom": "double"}, compute)


def _populations(batch: pa.RecordBatch) -> list[np.ndarray]:
    """t, c1, c2, m12 and m21 of a batch, each models x pieces."""
    return [column.flatten().to_numpy().reshape(batch.num_rows, -1) for column in batch.columns[1:6]]


def pair_rates(models: DataFrame, key: str, points: np.ndarray, start: tuple[float, float, float] = (0, 0, 1)) -> DataFrame:
    """(key, j, rate, alive): for two lineages of two populations, by default one of each, at each of some points.

    models is (key, t, c1, c2, m12, m21), arrays of one length: the rates of
    coalescence and of migration in pieces that begin at t. rate is that of
    lineages which have not coalesced by then, and alive the chance of that.
    """
    kind, first = models.schema[key].dataType.simpleString(), np.array(start, float)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, MODELS):
                batch = whole.slice(at, MODELS)
                found = migration.pair_rate(*_populations(batch), first, points)
                index = np.indices(found["rate"].shape)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(index[0].ravel())), pa.array(index[1].ravel()), *(pa.array(found[x].ravel()) for x in ("rate", "alive"))], [key, "j", "rate", "alive"])

    return models.select(key, "t", "c1", "c2", "m12", "m21").mapInArrow(run, f"{key} {kind}, j long, rate double, alive double")


def pair_mean_times(models: DataFrame, key: str, start: tuple[float, float, float] = (0, 0, 1)) -> DataFrame:
    """(key, mean): the mean time at which two lineages coalesce, of models as pair_rates() has them."""
    kind, first = models.schema[key].dataType.simpleString(), np.array(start, float)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(migration.mean_time(*_populations(batch), first))], [key, "mean"])

    return models.select(key, "t", "c1", "c2", "m12", "m21").mapInArrow(run, f"{key} {kind}, mean double")
