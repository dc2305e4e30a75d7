"""Contigs: what a fit takes from a source, as relations.

Whatever has `ploids`, `shortest` and `observe(window)` is a source of contigs;
the classes here read genotype calls, pairs of nodes, PSMC-FASTA records and
stored snapshots.
"""

from __future__ import annotations

from dataclasses import dataclass
from pathlib import PurePosixPath
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import genealogy, intervals
from ..operators import het as heterozygosity
from . import text, trees


@dataclass(frozen=True)
class Observed:
    """het(contig, sample, win, ob, windows), a row for each of a contig's windows, and spectrum(k, n_sites).

    ob counts heterozygous sites, or is -1 where a window is missing; windows is
    the contig's number of them. Either relation may be None.
    """

    het: DataFrame | None
    spectrum: DataFrame | None


class Source(Protocol):
    ploids: int | None
    shortest: int | None  # base pairs of the shortest contig

    def observe(self, window: int) -> Observed: ...


def _spine(spark: SparkSession, contig: str, samples: list[str], windows: int) -> DataFrame:
    """Every window of every sample."""
    names = F.explode(F.array(*[F.lit(s) for s in samples]))
    return spark.range(windows).select(F.lit(contig).alias("contig"), names.alias("sample"), F.col("id").alias("win"), F.lit(windows).cast("long").alias("windows"))


def _dense(spine: DataFrame, seen: DataFrame) -> DataFrame:
    met = spine.join(seen, ["sample", "win"], "left")
    return met.select("contig", "sample", "win", F.coalesce("ob", F.lit(0)).cast("long").alias("ob"), "windows")


def region_windows(calls: DataFrame, start: int, windows: int, size: int) -> DataFrame:
    """(sample, win, ob): whether a window from start on has a heterozygous site.

    The last window takes the sites of the rest that is shorter than a window.
    """
    win = F.least(F.floor((F.col("pos") - start) / F.lit(size)), F.lit(windows - 1)).cast("long")
    seen = F.greatest(heterozygosity.is_het(F.col("a0"), F.col("a1")), F.lit(0))
    return calls.groupBy("sample", win.alias("win")).agg(F.max(seen).alias("ob"))


@dataclass(frozen=True)
class CallsContig:
    """Calls (pos, sample, a0, a1, and record, ref and alt where known) of one contig from start to end.

    Every record counts in the spectrum, those that repeat one another too;
    where records have no numbers, positions with equal alleles are one.
    """

    calls: DataFrame
    samples: list[str]
    start: int
    end: int
    name: str = "1"

    def __post_init__(self) -> None:
        if self.start >= self.end:
            raise ValueError("start must be below end")
        if not self.samples or any(not isinstance(s, str) for s in self.samples):
            raise ValueError("samples must be a list of names that is not empty")

    @property
    def ploids(self) -> int:
        return 2 * len(self.samples)

    @property
    def shortest(self) -> int:
        return self.end - self.start

    def observe(self, window: int) -> Observed:
        windows = (self.end - self.start + 1) // window
        if not windows:
            raise ValueError("the region is shorter than a window")
        spine = _spine(self.calls.sparkSession, self.name, self.samples, windows)
        return Observed(_dense(spine, region_windows(self.calls, self.start, windows, window)), site_spectrum(self.calls, self.ploids))


def site_spectrum(calls: DataFrame, ploids: int) -> DataFrame:
    """(k, n_sites) of records, told apart by their numbers, or by position and what is known of alleles where they have none."""
    site = ["record"] if "record" in calls.columns else [c for c in ("pos", "ref", "alt") if c in calls.columns]
    derived = sum((F.coalesce((F.col(a) > 0).cast("int"), F.lit(0)) for a in ("a0", "a1")), F.lit(0))
    counts = calls.groupBy(*site).agg(F.sum(derived).cast("long").alias("k")).filter(F.col("k").between(1, ploids - 1))
    return counts.groupBy("k").agg(F.count(F.lit(1)).alias("n_sites"))


def vcf_contig(spark: SparkSession, path: str, samples: list[str], region: str | None = None, whole: bool = False) -> CallsContig:
    """The samples' calls in a region, contig:start-end; with whole, of a file whose header has one contig."""
    if whole:
        lengths = text.vcf_lengths(spark, path)
        if len(lengths) != 1:
            raise ValueError(f"the header names {len(lengths)} contigs, not one")
        (name, end), start = next(iter(lengths.items())), 1
        calls = text.read_vcf(spark, path, samples).filter(F.col("contig") == name)
    elif region is None:
        raise ValueError("a region, contig:start-end, is needed")
    else:
        name, start, end = text.parse_region(region)
        calls = text.read_vcf(spark, path, samples, region)
    return CallsContig(calls, samples, start, end, name)


def check_pairs(pairs: object) -> None:
    good = isinstance(pairs, list) and pairs and all(isinstance(p, tuple) and len(p) == 2 and all(isinstance(x, int) for x in p) for p in pairs)
    if not good:
        raise ValueError("pairs must be a list of (node, node), two whole numbers each")


@dataclass(frozen=True)
class PairsContig:
    """Genotypes (pos, node, allele) of one contig, its diploids being pairs of nodes.

    Sites within masks (a, b), half-open, do not count in the spectrum; a window
    that overlaps a mask is missing. Each derived allele of a site counts.
    """

    genotypes: DataFrame
    pairs: list[tuple[int, int]]
    length: int
    masks: DataFrame | None = None
    name: str = "1"

    def __post_init__(self) -> None:
        check_pairs(self.pairs)

    @property
    def ploids(self) -> int:
        return 2 * len(self.pairs)

    @property
    def shortest(self) -> int:
        return self.length

    def observe(self, window: int) -> Observed:
        spark = self.genotypes.sparkSession
        windows = -(-self.length // window)
        pairs = spark.createDataFrame([(str(i), *p) for i, p in enumerate(self.pairs)], "pair string, node0 long, node1 long")
        rows = self.genotypes.select(F.lit(self.name).alias("contig"), "pos", "node", "allele")
        counts = heterozygosity.pair_het_counts(rows, F.broadcast(pairs), window)  # as many as samples were named
        seen = counts.select(F.col("pair").alias("sample"), "win", F.col("n_het").alias("ob"))
        het = _dense(_spine(spark, self.name, [str(i) for i in range(len(self.pairs))], windows), seen)
        nodes = sorted({x for p in self.pairs for x in p})
        sites = self.genotypes.filter(F.col("node").isin(nodes) & (F.col("allele") > 0))
        if self.masks is not None:
            het = intervals.mask_windows(het, self.masks, window, "ob")
            sites = intervals.outside(sites, self.masks)
        counts = sites.groupBy("pos", "allele").agg(F.count_distinct("node").alias("k")).filter(F.col("k") < len(nodes))
        return Observed(het.select("contig", "sample", "win", "ob", "windows"), counts.groupBy("k").agg(F.count(F.lit(1)).alias("n_sites")))


@dataclass(frozen=True)
class TreesContig:
    """A tree sequence: edges (left, right, parent, child) and mutations (pos, id, node, state, ancestral), its diploids being pairs of nodes.

    It shows what PairsContig shows of the same genotypes, without making them:
    counts below nodes are kept up along spans of the sequence.
    """

    edges: DataFrame
    mutations: DataFrame
    pairs: list[tuple[int, int]]
    length: int
    masks: DataFrame | None = None
    name: str = "1"
    span: int = genealogy.SPAN

    def __post_init__(self) -> None:
        check_pairs(self.pairs)

    @property
    def ploids(self) -> int:
        return 2 * len(self.pairs)

    @property
    def shortest(self) -> int:
        return self.length

    def observe(self, window: int) -> Observed:
        spark, windows = self.edges.sparkSession, -(-self.length // window)
        named = lambda rows: rows.withColumn("contig", F.lit(self.name))
        counts = genealogy.site_counts(named(self.edges), named(self.mutations), self.pairs, "contig", self.span)
        seen = genealogy.pair_differences(counts, "contig", window).select(F.col("pair").cast("string").alias("sample"), "win", F.col("n_het").alias("ob"))
        het = _dense(_spine(spark, self.name, [str(i) for i in range(len(self.pairs))], windows), seen)
        if self.masks is not None:
            het = intervals.mask_windows(het, self.masks, window, "ob")
            counts = intervals.outside(counts, self.masks)
        nodes = len({x for p in self.pairs for x in p})
        return Observed(het.select("contig", "sample", "win", "ob", "windows"), genealogy.spectrum(counts, nodes, "contig").select("k", "n_sites"))


def trees_contig(spark: SparkSession, path: str, pairs: list[tuple[int, int]] | None = None, masks: DataFrame | None = None) -> TreesContig:
    """A tree sequence file; without pairs, the two nodes of each of its individuals."""
    length = trees.read_table(spark, path, "sequence", ["length"]).first().length
    if pairs is None:
        nodes = trees.read_table(spark, path, "nodes", ["id", "individual"]).filter("individual >= 0")
        both = nodes.groupBy("individual").agg(F.sort_array(F.collect_list("id")).alias("ids")).orderBy("individual").collect()  # as many as were sampled
        if any(len(r.ids) != 2 for r in both):
            raise ValueError("an individual has not two nodes; name pairs of nodes")
        pairs = [tuple(r.ids) for r in both]
    return TreesContig(trees.edges_of(spark, path).drop("file"), trees.mutations_of(spark, path).drop("file"), pairs, int(length), masks)


def contig(spark: SparkSession, path: str, samples: list | None = None, region: str | None = None, window: int = 100) -> Source:
    """A file's source, by its ending.

    Call files (.vcf, .vcf.gz, .vcf.bgz, .bcf) need names of samples and a region,
    contig:start-end. Tree sequences (.trees, .ts) take pairs of nodes, by
    default those of the individuals, and no region. PSMC-FASTA files (.psmcfa,
    .fa, also with .gz) take neither; `window` is theirs.
    """
    if path.endswith((".vcf", ".vcf.gz", ".vcf.bgz", ".bcf")):
        if region is None:
            raise ValueError("a call file needs a region, contig:start-end")
        return vcf_contig(spark, path, samples, region)
    if region is not None:
        raise ValueError(f"a region is for call files, not for {path}")
    if path.endswith((".trees", ".ts")):
        return trees_contig(spark, path, samples)
    if path.endswith((".psmcfa", ".psmcfa.gz", ".fa", ".fa.gz")):
        return record_contigs(psmcfa_records(spark, [path]), window)
    raise ValueError(f"no source reads {path}; there are .vcf, .vcf.gz, .vcf.bgz, .bcf, .trees, .ts, .psmcfa and .fa")


@dataclass(frozen=True)
class RecordContigs:
    """PSMC-FASTA records (contig, win, ob, windows), whose windows the file has set. Their spectrum is one class of one site each."""

    records: DataFrame
    window: int
    shortest: int | None
    contigs: int
    ploids: int = 2

    def observe(self, window: int) -> Observed:
        _same_window(self.window, window)
        het = self.records.select("contig", F.lit("0").alias("sample"), "win", "ob", "windows")
        return Observed(het, self.records.sparkSession.range(1).select(F.lit(1).cast("long").alias("k"), F.lit(self.contigs).cast("long").alias("n_sites")))


def _same_window(own: int, asked: int) -> None:
    if own != asked:
        raise ValueError(f"made with windows of {own} base pairs, not of {asked}")


def psmcfa_records(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(file, record, contig, start, symbols): the records' lines, numbered in the order of the paths and within each file."""
    if not paths:
        raise ValueError("no files")
    rows = None
    for i, path in enumerate(paths):
        one = text.psmcfa_lines(spark, path).select(F.lit(i).alias("file"), "record", F.concat(F.lit(f"{i}:"), F.col("record").cast("string"), F.lit(":"), "contig").alias("contig"), "start", "symbols")
        rows = one if rows is None else rows.unionByName(one)
    return rows


def record_contigs(records: DataFrame, window: int) -> RecordContigs:
    """A source of records' lines (contig, start, symbols)."""
    sizes = records.groupBy(F.col("contig").alias("_c")).agg(F.sum(F.length("symbols")).cast("long").alias("windows"))
    found = sizes.agg(F.min("windows").alias("least"), F.count(F.lit(1)).alias("n")).first()
    rows = text.windows_of(records.join(sizes, F.col("contig") == F.col("_c")), ["contig", "windows"])
    return RecordContigs(rows, window, None if found.least is None else found.least * window, found.n)


def held_out(records: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """The records but the first, and the first; all of them and None if there is only one."""
    first = records.select("file", "record").distinct().orderBy("file", "record").limit(2).collect()
    if len(first) < 2:
        return records, None
    is_first = (F.col("file") == first[0].file) & (F.col("record") == first[0].record)
    return records.filter(~is_first), records.filter(is_first)


@dataclass(frozen=True)
class StoredContig:
    """What a source showed, as store() wrote it."""

    spark: SparkSession
    path: str

    @property
    def _about(self):
        return self.spark.read.json(f"{self.path}/about", schema="window long, ploids long, shortest long, het boolean, spectrum boolean").first()

    @property
    def ploids(self) -> int | None:
        return self._about.ploids

    @property
    def shortest(self) -> int | None:
        return self._about.shortest

    def observe(self, window: int) -> Observed:
        about = self._about
        _same_window(about.window, window)
        part = lambda name: self.spark.read.parquet(f"{self.path}/{name}") if about[name] else None
        return Observed(part("het"), part("spectrum"))


def store(spark: SparkSession, source: Source, window: int, path: str) -> StoredContig:
    """Writes what a source shows, for sources that take long to read."""
    path = str(PurePosixPath(path)) if "://" not in path else path.rstrip("/")
    seen = source.observe(window)
    for name, rows in (("het", seen.het), ("spectrum", seen.spectrum)):
        if rows is not None:
            rows.write.parquet(f"{path}/{name}")
    about = spark.range(1).select(F.lit(window).alias("window"), F.lit(source.ploids).alias("ploids"), F.lit(source.shortest).alias("shortest"), F.lit(seen.het is not None).alias("het"), F.lit(seen.spectrum is not None).alias("spectrum"))
    about.write.json(f"{path}/about")
    return StoredContig(spark, path)
