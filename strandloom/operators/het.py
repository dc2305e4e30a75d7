"""Heterozygosity observations and frequency spectra from genotype calls."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def window_of(pos: Column, size: int) -> Column:
    return F.floor(pos / F.lit(size)).cast("long")


def is_het(a0: Column, a1: Column) -> Column:
    """1, 0, or -1 where an allele is missing (null)."""
    return F.when(a0.isNull() | a1.isNull(), -1).otherwise((a0 != a1).cast("int")).cast("long")


def het_counts(calls: DataFrame, size: int, contig: str = "contig") -> DataFrame:
    """Heterozygous sites for each sample and window."""
    het = F.greatest(is_het(F.col("a0"), F.col("a1")), F.lit(0))
    return calls.groupBy(contig, "sample", window_of(F.col("pos"), size).alias("win")).agg(F.sum(het).cast("long").alias("n_het"))


def het_any(calls: DataFrame, size: int, missing: str = "homozygous") -> DataFrame:
    """Whether a window has a heterozygous site; with missing='mask', -1 where all calls are missing."""
    het = is_het(F.col("a0"), F.col("a1"))
    value = het if missing == "mask" else F.greatest(het, F.lit(0))
    return calls.groupBy("contig", "sample", window_of(F.col("pos"), size).alias("win")).agg(F.max(value).cast("long").alias("ob"))


def dense(het: DataFrame, windows: int, value: str, fill: int = 0) -> DataFrame:
    """Every window of every contig and sample, filled where there was no site.

    There are `windows` of them, or more where the data go on further.
    """
    last = het.agg(F.greatest(F.max("win"), F.lit(windows - 1).cast("long")).alias("_last"))
    spine = het.select("contig", "sample").distinct().crossJoin(F.broadcast(last))
    spine = spine.select("contig", "sample", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_last"))).alias("win"))
    return spine.join(het, ["contig", "sample", "win"], "left").select("contig", "sample", "win", F.coalesce(value, F.lit(fill)).cast("long").alias(value))


def derived_counts(calls: DataFrame) -> DataFrame:
    """Non-reference alleles of each record, partly missing genotypes included; a position is one where records have no numbers."""
    site = [c for c in ("contig", "pos", "record") if c in calls.columns]
    n = F.coalesce((F.col("a0") > 0).cast("int"), F.lit(0)) + F.coalesce((F.col("a1") > 0).cast("int"), F.lit(0))
    return calls.groupBy(*site).agg(F.sum(n).cast("long").alias("k"))


def spectrum(calls: DataFrame, ploids: int) -> DataFrame:
    """afs(contig, k, n_sites) for 0 < k < ploids."""
    return derived_counts(calls).filter(F.col("k").between(1, ploids - 1)).groupBy("contig", "k").agg(F.count(F.lit(1)).alias("n_sites"))


def add_spectra(afs: DataFrame) -> DataFrame:
    return afs.groupBy("k").agg(F.sum("n_sites").cast("long").alias("n_sites"))


def pair_het_counts(genotypes: DataFrame, pairs: DataFrame, size: int) -> DataFrame:
    """Differences between the two nodes of each pair, for each window."""
    one = genotypes.select("contig", "pos", F.col("node").alias("node0"), F.col("allele").alias("g0"))
    two = genotypes.select("contig", "pos", F.col("node").alias("node1"), F.col("allele").alias("g1"))
    met = pairs.join(one, "node0").join(two, ["contig", "pos", "node1"])
    return met.groupBy("contig", "pair", window_of(F.col("pos"), size).alias("win")).agg(F.sum((F.col("g0") != F.col("g1")).cast("long")).alias("n_het"))
