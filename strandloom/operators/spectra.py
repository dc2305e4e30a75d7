"""Linear maps of an allele-frequency spectrum afs(k, n_sites)."""

from __future__ import annotations

from math import comb

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def fold(afs: DataFrame, n: int, value: str = "n_sites") -> DataFrame:
    """Classes k and n - k together; the middle one counts once."""
    return afs.groupBy(F.least(F.col("k"), F.lit(n) - F.col("k")).cast("long").alias("k")).agg(F.sum(value).alias(value))


def projection(n: int, m: int) -> list[tuple[int, int, float]]:
    """(i, j, p): the chance that i of m drawn from n are derived if j are."""
    return [(i, j, comb(j, i) * comb(n - j, m - i) / comb(n, m)) for j in range(1, n) for i in range(1, m) if i <= j and m - i <= n - j]


def project(afs: DataFrame, n: int, m: int, value: str = "n_sites") -> DataFrame:
    """The expected spectrum of m of n ploids; the matrix has fewer than n * m rows."""
    matrix = afs.sparkSession.createDataFrame(projection(n, m), "i long, j long, p double")
    return afs.join(F.broadcast(matrix), F.col("k") == F.col("j")).groupBy(F.col("i").alias("k")).agg(F.sum(F.col(value) * F.col("p")).alias(value))


def bin_tail(afs: DataFrame, alpha: float = 0.1, value: str = "n_sites") -> DataFrame:
    """Keeps the first classes that hold 1 - alpha of the sites, and one more; merges the rest.

    A spectrum has as many rows as there are ploids, so the running sum is one
    small window.
    """
    every = Window.orderBy("k")
    whole = Window.partitionBy()
    share: Column = F.sum(value).over(every) / F.sum(value).over(whole)
    below = F.sum((F.col("_share") <= 1 - alpha).cast("int")).over(whole)
    kept = afs.withColumn("_share", share).withColumn("_kept", below + 1)
    return kept.groupBy(F.least(F.col("k"), F.col("_kept") + 1).cast("long").alias("bin")).agg(F.sum(value).cast("long").alias(value))


def fold_matrix(n: int) -> list[list[float]]:
    """fold() as a matrix of one row for each folded class."""
    return [[float(min(k, n - k) == i) for k in range(1, n)] for i in range(1, n // 2 + 1)]


def fold_bin_matrix(afs: list[float], alpha: float = 0.1) -> list[list[float]]:
    """bin_tail() after fold() as a matrix, its bins taken from the observed spectrum."""
    rows = fold_matrix(len(afs) + 1)
    sites = [sum(m * x for m, x in zip(row, afs, strict=True)) for row in rows]
    whole = sum(sites) or 1.0
    kept = 1 + sum(sum(sites[: i + 1]) / whole <= 1 - alpha for i in range(len(sites)))
    tail = rows[kept:]
    return rows[:kept] + ([[sum(column) for column in zip(*tail, strict=True)]] if tail else [])


def log_likelihood(lengths: DataFrame, afs: DataFrame, keys: list[str], value: str = "n_sites") -> DataFrame:
    """(keys, ll): of an observed folded spectrum under lengths(keys, b, etbl) of n ploids.

    Both sides are small for each key: a spectrum has fewer rows than ploids.
    """
    n = lengths.agg((F.max("b") + 1).alias("_ploids"))
    folded = lengths.crossJoin(F.broadcast(n)).groupBy(*keys, F.least(F.col("b"), F.col("_ploids") - F.col("b")).alias("k")).agg(F.sum("etbl").alias("_e"))
    share = F.col("_e") / F.sum("_e").over(Window.partitionBy(*keys))
    met = folded.withColumn("_p", share).join(F.broadcast(afs), "k")
    return met.groupBy(*keys).agg(F.sum(F.when(F.col(value) == 0, 0.0).otherwise(F.col(value) * F.log("_p"))).alias("ll"))
