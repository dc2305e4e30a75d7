"""Ordered computations on observation sequences."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def chunk_count(length: int, chunk: int, overlap: int, cover_tail: bool = False) -> int:
    """By default, windows after the last full stride are left out, as the model's chunking has it."""
    n = (length - overlap) / chunk if cover_tail else length / (chunk + overlap)
    return max(1, math.ceil(n))


def chunks(obs: DataFrame, keys: list[str], length: int | Column, chunk: int, overlap: int, cover_tail: bool = False) -> DataFrame:
    """(keys, k, slot, ob): overlapping slices; slice k starts at window k * chunk.

    Each row goes to the chunks that hold it by a generated sequence: no join.
    length is a column where sequences differ in it.
    """
    if isinstance(length, Column):
        n = F.greatest(F.ceil((length - overlap) / chunk if cover_tail else length / (chunk + overlap)), F.lit(1).cast("long"))
    else:
        n = F.lit(chunk_count(length, chunk, overlap, cover_tail))
    low = F.greatest(F.lit(0), F.ceil((F.col("win") - (chunk + overlap) + 1) / F.lit(chunk))).cast("long")
    high = F.least(n - 1, F.floor(F.col("win") / F.lit(chunk))).cast("long")
    dealt = obs.withColumn("_lo", low).withColumn("_hi", high).filter("_lo <= _hi").withColumn("k", F.explode(F.sequence("_lo", "_hi")))
    clipped = F.greatest(F.lit(-1), F.least(F.lit(1), F.col("ob"))).cast("long")
    return dealt.select(*keys, "k", (F.col("win") - F.col("k") * chunk).cast("long").alias("slot"), clipped.alias("ob"))


def packed(chunked: DataFrame, keys: list[str], width: int) -> DataFrame:
    """One array for each chunk, padded with -1 to width; an array has width elements at most."""
    rows = chunked.groupBy(*keys, "k").agg(F.array_sort(F.collect_list(F.struct("slot", "ob"))).alias("_x"))
    values = F.transform("_x", lambda x: x["ob"].cast("byte"))
    return rows.select(*keys, "k", F.concat(values, F.array_repeat(F.lit(-1).cast("byte"), F.lit(width) - F.size("_x"))).alias("obs"))


def run_lengths(obs: DataFrame, key: str) -> DataFrame:
    """(key, start, ob, n): maximal runs of one value."""
    order = Window.partitionBy(key).orderBy("win")
    island = F.row_number().over(order) - F.row_number().over(Window.partitionBy(key, "ob").orderBy("win"))
    return obs.withColumn("_island", island).groupBy(key, "ob", "_island").agg(F.min("win").alias("start"), F.count(F.lit(1)).alias("n")).drop("_island")


def change_points(rows: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """Rows whose value differs from the one before; the first always."""
    before = F.lag(value).over(Window.partitionBy(key).orderBy(order))
    return rows.withColumn("_before", before).filter(F.col("_before").isNull() | (F.col("_before") != F.col(value))).drop("_before")


def watterson(chunked: DataFrame, overlap: int, window: int) -> DataFrame:
    """Mean of what is observed after each chunk's warm-up, a base pair."""
    kept = chunked.filter((F.col("slot") >= overlap) & (F.col("ob") >= 0))
    return kept.agg((F.avg("ob") / window).alias("theta"))


def smoothed(rows: DataFrame, key: str, order: str, value: str, keep: float = 0.9) -> DataFrame:
    """The last value of the exponential moving average, from the first value on."""
    series = rows.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct(order, value))), lambda x: x[value].cast("double")).alias("_x"))
    mean = F.aggregate(F.slice("_x", 2, F.size("_x")), F.element_at("_x", 1), lambda acc, x: acc * keep + x * (1 - keep))
    return series.select(key, mean.alias("ema"))


def observed(packed_chunks: DataFrame) -> DataFrame:
    """Chunks with at least one window that is not missing."""
    return packed_chunks.filter(F.exists("obs", lambda x: x >= 0))


def trimmed(obs: DataFrame, key: str) -> DataFrame:
    """Rows from a sequence's first window that is not missing to its last."""
    whole = Window.partitionBy(key)
    seen = F.when(F.col("ob") >= 0, F.col("win"))
    marked = obs.withColumn("_first", F.min(seen).over(whole)).withColumn("_last", F.max(seen).over(whole))
    return marked.filter(F.col("win").between(F.col("_first"), F.col("_last"))).drop("_first", "_last")


def early_stop(rows: DataFrame, key: str, order: str, value: str, patience: int) -> DataFrame:
    """(key, best, stop): where a series was best before it stopped for want of a better value."""
    upto = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    record = F.max(value).over(before)
    steps = rows.withColumn("_new", F.when(record.isNull() | (F.col(value) > record), F.col(order)))
    steps = steps.withColumn("_best", F.max("_new").over(upto))
    late = F.when(F.col(order) - F.col("_best") > patience, F.col(order))
    stops = steps.groupBy(key).agg(F.coalesce(F.min(late), F.max(order)).alias("stop"), F.max_by("_best", order).alias("_last"), F.min_by("_best", late).alias("_then"))
    return stops.select(key, F.coalesce("_then", "_last").alias("best"), "stop")


def structured_product(rows: DataFrame, key: str, order: str) -> DataFrame:
    """(key, order, out): x times a matrix with b below, d on and u v above its diagonal.

    rows has b, d, u, v and x; two running sums take the place of the matrix.
    """
    ahead = Window.partitionBy(key).orderBy(order).rowsBetween(1, Window.unboundedFollowing)
    behind = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    low = F.col("b") * F.coalesce(F.sum("x").over(ahead), F.lit(0.0))
    high = F.col("v") * F.coalesce(F.sum(F.col("u") * F.col("x")).over(behind), F.lit(0.0))
    return rows.select(key, order, (low + F.col("d") * F.col("x") + high).alias("out"))
