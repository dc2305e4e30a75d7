"""The forward recursion of long sequences as an associative scan: blocks' products of steps, multiplied up a tree and carried down."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import hmm
from ..sources.scratch import kept

BLOCK, FAN = 4096, 64


def products(obs: DataFrame, key: str, tables: np.ndarray, block: int = BLOCK) -> DataFrame:
    """(key, model, b, product, scale): of each block of windows the product of its steps, for each model.

    The product's largest entry is one, and scale is the logarithm of what was
    taken out. obs is (key, win, ob) with every window from zero on; tables are
    hmm.tables_of(models), a bounded matrix that goes with the tasks.
    """
    kind, m = obs.schema[key].dataType.simpleString(), int(np.sqrt(tables.shape[1] + 1)) - 1
    arrow = pa.list_(pa.float64())

    def multiply(batches):
        for batch in batches:
            for name, b, values in zip(batch.column(0), batch.column(1).to_pylist(), batch.column(2), strict=True):
                plan = hmm.schedule(values.values.to_numpy(zero_copy_only=False))
                tops = {int(s): int(plan[plan[:, 0] == s, 1].max()) for s in np.unique(plan[:, 0])}
                ladder = hmm.Ladder(tables, tops)
                out, scale = np.repeat(np.eye(m)[None], len(tables), axis=0), np.zeros(len(tables))
                for symbol, power in plan.tolist():
                    out = out @ ladder.power[symbol, power]
                    most = out.max(axis=(1, 2))
                    out, scale = out / most[:, None, None], scale + np.log(most) + ladder.scale[symbol, power]
                columns = [pa.array([name.as_py()] * len(tables), batch.schema.field(0).type), pa.array(np.arange(len(tables))), pa.array([b] * len(tables)), pa.array(list(out.reshape(len(tables), -1)), arrow), pa.array(scale)]
                yield pa.RecordBatch.from_arrays(columns, [key, "model", "b", "product", "scale"])

    rows = obs.groupBy(key, F.floor(F.col("win") / block).cast("long").alias("b")).agg(F.transform(F.array_sort(F.collect_list(F.struct("win", "ob"))), lambda x: x["ob"].cast("byte")).alias("obs"))
    return rows.mapInArrow(multiply, f"{key} {kind}, model long, b long, product array<double>, scale double")


def _by_group(rows: DataFrame, key: str, columns: str, compute: Callable[[pa.Table], dict[str, list]]) -> DataFrame:
    """compute's columns for each group of FAN blocks, in their order; a group's rows have their key, model and number."""
    kind = rows.schema[key].dataType.simpleString()

    def run(keys: tuple, table: pa.Table) -> pa.Table:
        found = compute(table.sort_by("b"))
        n = len(next(iter(found.values())))
        named = {key: pa.array([keys[0].as_py()] * n, table.schema.field(key).type), "model": pa.array([keys[1].as_py()] * n, pa.int64())}
        return pa.table(named | {name: pa.array(x, pa.list_(pa.float64()) if name in ("product", "state") else None) for name, x in found.items()})

    return rows.withColumn("g", F.floor(F.col("b") / FAN).cast("long")).groupBy(key, "model", "g").applyInArrow(run, f"{key} {kind}, model long, {columns}")


def _matrices(table: pa.Table) -> np.ndarray:
    flat = table.column("product").combine_chunks().flatten().to_numpy()
    m = int(np.sqrt(len(flat) // table.num_rows))
    return flat.reshape(table.num_rows, m, m)


def _upward(table: pa.Table) -> dict[str, list]:
    out, scale = None, float(np.sum(table.column("scale").to_numpy()))
    for one in _matrices(table):
        out = one if out is None else out @ one
        most = out.max()
        out, scale = out / most, scale + np.log(most)
    return {"b": [table.column("g")[0].as_py()], "product": [out.ravel()], "scale": [scale]}


def _downward(table: pa.Table) -> dict[str, list]:
    """Each block's state and likelihood when it is entered, and the likelihood when it is left."""
    state, ll = np.array(table.column("state")[0].as_py()), table.column("ll")[0].as_py()
    found: dict[str, list] = {"b": table.column("b").to_pylist(), "state": [], "ll": [], "after": []}
    for one, scale in zip(_matrices(table), table.column("scale").to_pylist(), strict=True):
        found["state"].append(state)
        found["ll"].append(ll)
        state = state @ one
        total = state.sum()
        state, ll = state / total, ll + float(np.log(total)) + scale
        found["after"].append(ll)
    return found


def forward(obs: DataFrame, key: str, tables: np.ndarray, block: int = BLOCK) -> DataFrame:
    """(key, model, b, ll): the log-likelihood of a sequence's windows up to the end of each block.

    A sequence is dealt over as many tasks as it has blocks. Their products are
    multiplied in groups of FAN, these in groups again, up to one; then states
    are carried down, each group handing its members theirs. Both ways take as
    many rounds as the number of blocks has digits to the base FAN, and no task
    sees more than FAN matrices of a sequence.
    """
    levels = [kept(products(obs, key, tables, block), "scan-blocks")]
    blocks = (levels[0].agg(F.max("b").alias("b")).first().b or 0) + 1
    while blocks > 1:
        levels.append(kept(_by_group(levels[-1], key, "b long, product array<double>, scale double", _upward), "scan-up"))
        blocks = -(-blocks // FAN)
    m = int(np.sqrt(tables.shape[1] + 1)) - 1
    starts = obs.sparkSession.createDataFrame([(i, row[m * m + m :].tolist()) for i, row in enumerate(tables)], "_model long, state array<double>")
    entered = levels[-1].select(key, "model").join(F.broadcast(starts), F.col("model") == F.col("_model"))  # a row for each model
    entered = entered.select(F.col(key).alias("_key"), "_model", F.lit(0).cast("long").alias("_g"), "state", F.lit(0.0).alias("ll"))
    for level in reversed(levels):
        met = level.withColumn("_group", F.floor(F.col("b") / FAN).cast("long")).join(entered, (F.col(key) == F.col("_key")) & (F.col("model") == F.col("_model")) & (F.col("_group") == F.col("_g")))
        found = _by_group(met.select(key, "model", "b", "product", "scale", "state", "ll"), key, "b long, state array<double>, ll double, after double", _downward)
        entered = found.select(F.col(key).alias("_key"), F.col("model").alias("_model"), F.col("b").alias("_g"), "state", "ll")
    return found.select(key, "model", "b", F.col("after").alias("ll"))
