"""From contigs to a posterior: chunks, spectrum and scale of a fit, and its summaries."""

from __future__ import annotations

import warnings
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import history as H
from ..sources import contigs as C
from . import fit as stein
from . import quantiles, sampling, windows

KEYS = ["contig", "sample", "k"]


@dataclass(frozen=True)
class Training:
    """chunks(contig, sample, k, obs), and the counts of the spectrum's classes 1 to n - 1 or None."""

    chunks: DataFrame
    spectrum: list[float] | None


def counts_of(spectrum: DataFrame | None, ploids: int) -> list[float] | None:
    """A spectrum as a list; it has a class for each ploid."""
    if spectrum is None:
        return None
    out = [0.0] * (ploids - 1)
    for r in spectrum.groupBy("k").agg(F.sum("n_sites").alias("n")).collect():
        out[r.k - 1] = float(r.n)
    return out


def training(sources: list[C.Source], window: int, overlap: int, chunk: int | None = None) -> Training:
    """All contigs in chunks, by default of a fifth of the shortest, and their spectra's sum."""
    lengths = [s.shortest for s in sources if s.shortest is not None]
    if not lengths:
        raise ValueError("no contig has a length")
    if chunk is None:
        chunk = int(min(0.2 * n / window for n in lengths))
    if chunk < 1:
        raise ValueError("the shortest contig is too short for a chunk")
    if chunk < 10 * overlap:
        warnings.warn(f"chunks of {chunk} windows are less than ten times the overlap of {overlap}", stacklevel=2)
    seen = [s.observe(window) for s in sources]
    dealt = [x.het.select(F.lit(i).alias("_source"), "*") for i, x in enumerate(seen) if x.het is not None]
    rows = reduce(DataFrame.unionByName, dealt).withColumn("contig", F.concat_ws("/", F.col("_source").cast("string"), "contig"))
    chunked = windows.chunks(rows, ["contig", "sample"], F.col("windows"), chunk, overlap)
    spectra = [(x.spectrum, s.ploids) for x, s in zip(seen, sources, strict=True) if x.spectrum is not None]
    if len({p for _, p in spectra}) > 1:
        raise ValueError("the contigs' spectra differ in their number of ploids")
    total = counts_of(reduce(DataFrame.unionByName, [s.select("k", "n_sites") for s, _ in spectra]), spectra[0][1]) if spectra else None
    return Training(windows.packed(chunked, ["contig", "sample"], chunk + overlap), total)


def numbered(chunks: DataFrame, most: int, seed: int) -> DataFrame:
    """Adds chunk_id from zero on; more chunks than `most` are sampled without replacement."""
    keys = sampling.without_replacement(chunks.select(*KEYS), KEYS, most, seed)
    ids = keys.withColumn("chunk_id", F.row_number().over(Window.orderBy(*KEYS)).cast("long") - 1)  # `most` short rows
    return chunks.join(ids, KEYS)


def scale(chunks: DataFrame, overlap: int, window: int) -> float:
    """Watterson's estimate for a base pair: the mean of what is seen after each chunk's warm-up."""
    after = F.filter(F.slice("obs", overlap + 1, F.size("obs")), lambda x: x >= 0)
    sums = chunks.select(F.aggregate(after, F.lit(0).cast("long"), lambda s, x: s + x).alias("s"), F.size(after).alias("n")).agg(F.sum("s").alias("s"), F.sum("n").alias("n")).first()
    if not sums.n:
        raise ValueError("nothing is observed after the chunks' warm-up")
    return sums.s / sums.n / window


def sequences(source: C.Source, window: int, samples: int) -> tuple[DataFrame, list[float] | None]:
    """(obs) of a contig's first samples, each behind one missing window, and its spectrum."""
    seen = source.observe(window)
    names = seen.het.select("contig", "sample").distinct().orderBy("contig", F.length("sample"), "sample").limit(samples)
    rows = seen.het.join(names, ["contig", "sample"]).groupBy("contig", "sample").agg(F.array_sort(F.collect_list(F.struct("win", "ob"))).alias("_x"))
    clipped = F.transform("_x", lambda x: F.greatest(F.lit(-1), F.least(F.lit(1), x["ob"])).cast("byte"))
    return rows.select(F.concat(F.array(F.lit(-1).cast("byte")), clipped).alias("obs")), counts_of(seen.spectrum, source.ploids)


def fit(spark: SparkSession, sources: list[C.Source], test: C.Source | None = None, niter: int = 1000, particles: int = 500, window: int = 100, overlap: int = 500, chunk: int | None = None, max_samples: int = 20, mutation_rate: float | None = None, theta: float | None = None, rho_over_theta: float = 1.0, t1: float | None = None, t_last: float | None = None, minibatch: int | None = None, seed: int = 1, callback: Callable[[int, np.ndarray], None] | None = None, **options) -> DataFrame:
    """(particle, t, c, theta, rho): posterior histories of the contigs, rates for a base pair.

    With a mutation rate, times are in generations, and the grid's ends are by
    default 10 and 1e6 of them. A step draws `minibatch` chunks, by default
    their number over niter, 1 to 5; of more than five times what all steps
    draw, so many are kept. A test contig stops the fit early. Further options
    are those of operators.fit.fit.
    """
    data = training(sources, window, overlap, chunk)
    total = data.chunks.persist()
    n = total.count()
    draw = minibatch or max(1, min(5, n // niter))
    chunks = numbered(total, 5 * draw * niter, seed)
    theta = scale(chunks, overlap, window) if theta is None else theta
    if theta <= 0:
        raise ValueError("no window is heterozygous, so there is no scale")
    if mutation_rate is not None:
        size = theta / mutation_rate
        t1, t_last = (5 / size if t1 is None else t1), (5e5 / size if t_last is None else t_last)
    held = {}
    if test is not None:
        held["test"], held["test_afs"] = sequences(test, window, max_samples)
    x = stein.fit(chunks, theta * window, overlap, particles, niter, seed=seed, minibatch=draw, afs=data.spectrum, t1=1e-4 if t1 is None else t1, t_last=15.0 if t_last is None else t_last, rho_over_theta=rho_over_theta, callback=callback, **held, **options)
    total.unpersist()
    return stein.posterior(spark, x, theta, mutation_rate)


def psmc(spark: SparkSession, paths: list[str], window: int = 100, hold_out: bool = True, **options) -> DataFrame:
    """fit() on PSMC-FASTA files; with hold_out, the first record tests the fit if there are others."""
    records = C.psmcfa_records(spark, paths)
    rest, first = C.held_out(records) if hold_out else (records, None)
    test = None if first is None else C.record_contigs(first, window)
    return fit(spark, [C.record_contigs(rest, window)], test, window=window, **options)


def bands(histories: DataFrame, points: int = 1000, width: float | None = 0.95) -> DataFrame:
    """(k, x, median, lo, hi) of the sizes of histories (t, c) on a grid between the outer 2.5 % of their times.

    lo and hi bound the middle `width` of the sizes at each point; without it, there is no band.
    """
    times = histories.select(F.lit(0).alias("_all"), F.explode(F.slice("t", 2, F.size("t"))).alias("t"))
    ends = quantiles.quantiles(times, ["_all"], "t", [0.025, 0.975]).select(F.col("q").alias("_q"))
    lo, hi = F.col("_q")[0], F.col("_q")[1]
    grid = ends.select(F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(points - 1)), lambda i: lo * F.pow(hi / lo, i / F.lit(float(points - 1))))).alias("k", "x"))
    sizes = histories.select("t", "c").crossJoin(F.broadcast(grid)).select(F.col("k").cast("long").alias("k"), "x", (1 / (2 * H.rate_at(F.col("t"), F.col("c"), F.col("x")))).alias("ne"))  # `points` rows
    at = [0.5] if width is None else [0.5, (1 - width) / 2, (1 + width) / 2]
    found = quantiles.quantiles(sizes, ["k", "x"], "ne", at).withColumnRenamed("q", "_q")
    return found.select("k", "x", *[F.col("_q")[i].alias(name) for i, name in enumerate(("median", "lo", "hi")[: len(at)])])
