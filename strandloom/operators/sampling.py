"""Samples that a rerun repeats."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def without_replacement(rows: DataFrame, keys: list[str], n: int, seed: int = 0) -> DataFrame:
    """n rows, the first by the hash of their keys and the seed: a top-n, no full sort."""
    return rows.orderBy(F.md5(F.concat_ws(":", *[F.col(k).cast("string") for k in keys], F.lit(str(seed))).cast("binary")), *keys).limit(n)


def hold_out_first(contigs: DataFrame, order: str) -> DataFrame:
    """Marks the first contig held out, if there are others."""
    ends = contigs.agg(F.min(order).alias("_first"), F.max(order).alias("_last"))
    marked = contigs.crossJoin(F.broadcast(ends))
    return marked.select(*contigs.columns, ((F.col(order) == F.col("_first")) & (F.col("_first") != F.col("_last"))).cast("long").alias("held_out"))


def gather(chunks: DataFrame, draws: DataFrame, key: str) -> DataFrame:
    """A row of chunks for each draw, repeated as often as it was drawn."""
    return draws.join(chunks, key)
