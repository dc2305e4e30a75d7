"""Sources of contigs, chunks over several of them, and fits from files."""

from __future__ import annotations

import numpy as np
import pytest

from strandloom.functions import hmm
from strandloom.operators import het, intervals, posterior
from strandloom.operators import fit as stein
from strandloom.sources import contigs as C
from strandloom.sources import text

HEAD = "##contig=<ID=1,length=1000>\n##contig=<ID=2,assembly=x>\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\tA\tB\n"


def line(pos, *genotypes, contig="1", alt="T"):
    return "\t".join([contig, str(pos), ".", "A", alt, ".", ".", ".", "GT", *genotypes]) + "\n"


@pytest.fixture
def vcf(tmp_path):
    path = tmp_path / "a.vcf"
    path.write_text(HEAD + line(100, "0|1", "0|1") + line(110, "0|1", "0|0") + line(255, "1|1", "./1") + line(255, "0|1", "0|0", alt="G") + line(349, "0|0", "1|0") + line(120, "0|1", "0|1", contig="2"))
    return str(path)


def cells(df):
    return {(r.sample, r.win): r.ob for r in df.collect()}


def test_region_is_shifted_and_its_rest_joins_the_last_window(spark, vcf):
    source = C.vcf_contig(spark, vcf, ["A", "B"], "1:100-349")
    assert (source.ploids, source.shortest) == (4, 249)
    seen = source.observe(100)  # 250 positions: two windows, and 50 to the second
    assert cells(seen.het) == {("A", 0): 1, ("A", 1): 1, ("B", 0): 0, ("B", 1): 1}
    assert {r.k: r.n_sites for r in seen.spectrum.collect()} == {1: 3, 3: 1}


def test_every_record_counts(spark, tmp_path):
    """Lines that agree in position and alleles are records of their own, and so are those that agree in position."""
    path = tmp_path / "r.vcf"
    twice = line(100, "0|1", "0|0") * 2 + line(200, "1|1", "0|1") * 2 + line(300, "1|1", "1|0") + line(300, "0|1", "0|0", alt="G")
    path.write_text(HEAD + twice)
    seen = C.vcf_contig(spark, str(path), ["A", "B"], "1:1-400").observe(100)
    assert {r.k: r.n_sites for r in seen.spectrum.collect()} == {1: 3, 3: 3}
    assert cells(seen.het) == {("A", w): int(w in (0, 2)) for w in range(4)} | {("B", w): int(w in (1, 2)) for w in range(4)}
    both = het.spectrum(text.read_vcf(spark, str(path), ["A", "B"]), 4)
    assert {r.k: r.n_sites for r in both.collect()} == {1: 3, 3: 3}


def test_whole_file_needs_one_length(spark, vcf):
    assert C.vcf_contig(spark, vcf, ["A"], whole=True).end == 1000
    for bad in (lambda: C.vcf_contig(spark, vcf, ["A"]), lambda: C.vcf_contig(spark, vcf, ["A"], "1:9-9"), lambda: C.vcf_contig(spark, vcf, []), lambda: C.vcf_contig(spark, vcf, ["Z"], "1:1-9"), lambda: C.PairsContig(spark.range(1), [(1, 2, 3)], 9)):
        with pytest.raises(ValueError):
            bad()


def test_pairs_and_masks(spark):
    rows = [(50, 0, 0), (50, 1, 1), (50, 2, 1), (250, 0, 1), (250, 1, 0), (250, 2, 0), (1050, 0, 2), (1050, 1, 1), (1050, 2, 0)]
    genotypes = spark.createDataFrame(rows, "pos long, node long, allele long")
    masks = spark.createDataFrame([(250, 1000)], "a long, b long")
    seen = C.PairsContig(genotypes, [(0, 1), (1, 2)], 1100, masks).observe(100)
    got = cells(seen.het)
    assert [got["0", w] for w in range(11)] == [1, 0] + [-1] * 8 + [1] and got["1", 0] == 0 and got["1", 10] == 1
    assert {r.k: r.n_sites for r in seen.spectrum.collect()} == {1: 2, 2: 1}


def test_masks_hide_their_own_contig_only(spark):
    sites = spark.createDataFrame([("1", 5), ("2", 5)], "contig string, pos long")
    masks = spark.createDataFrame([("1", 0, 10)], "contig string, a long, b long")
    assert [r.contig for r in intervals.outside(sites, masks, keys=["contig"]).collect()] == ["2"]
    het = spark.createDataFrame([("1", 0, 3), ("2", 0, 3)], "contig string, win long, n_het long")
    assert {r.contig: r.n_het for r in intervals.mask_windows(het, masks, 10, keys=["contig"]).collect()} == {"1": -1, "2": 3}


def test_stored_contig(spark, vcf, tmp_path):
    source = C.vcf_contig(spark, vcf, ["A", "B"], "1:100-349")
    again = C.store(spark, source, 100, str(tmp_path / "raw"))
    assert (again.ploids, again.shortest) == (4, 249)
    assert cells(again.observe(100).het) == cells(source.observe(100).het)
    with pytest.raises(ValueError):
        again.observe(50)


def test_chunks_of_contigs_of_different_lengths(spark):
    rng = np.random.default_rng(0)
    rows, want = [], []
    for name, length in (("x", 41), ("y", 17)):
        ob = rng.integers(0, 3, size=length) - 1
        rows += [(name, w, int(o), length) for w, o in enumerate(ob)]
        padded = np.concatenate([ob, np.full(-length % 12, -1)])
        want += [tuple(padded[9 * k : 9 * k + 12]) for k in range(len(padded) // 12)]
    records = C.RecordContigs(spark.createDataFrame(rows, "contig string, win long, ob long, windows long"), 100, 1700, 2)
    with pytest.warns(UserWarning):
        data = posterior.training([records], 100, 3, 9)
    assert sorted(tuple(r.obs) for r in data.chunks.collect()) == sorted(want)
    assert data.spectrum == [2.0]
    kept = np.array([x[3:] for x in want])
    assert posterior.scale(data.chunks, 3, 100) == pytest.approx(kept[kept >= 0].mean() / 100)
    numbered = posterior.numbered(data.chunks, 3, 0).collect()
    assert sorted(r.chunk_id for r in numbered) == [0, 1, 2]


def test_fit_of_a_tiny_contig(spark):
    rows = spark.createDataFrame([("c", w, o, 5) for w, o in enumerate([0, 1, 0, 1, 1])], "contig string, win long, ob long, windows long")
    with pytest.warns(UserWarning):
        found = posterior.fit(spark, [C.RecordContigs(rows, 100, 500, 1)], niter=2, particles=5, chunk=1, overlap=1).collect()
    assert len(found) == 5 and all(len(r.t) == len(r.c) == 16 and r.theta > 0 for r in found)


def test_psmc_files(spark, tmp_path):
    path = tmp_path / "a.psmcfa"
    path.write_text(">1\n" + "K" * 20 + "T" * 60 + "\n" + "K" * 10 + "\n")
    seen = []
    with pytest.warns(UserWarning):
        found = posterior.psmc(spark, [str(path)] * 3, niter=2, particles=5, chunk=1, overlap=1, mutation_rate=1e-8, callback=lambda i, x: seen.append(i)).collect()
    assert len(found) == 5 and seen == [0, 1] and all(r.theta == 1e-8 for r in found)
    rest, first = C.held_out(C.psmcfa_records(spark, [str(path)] * 3))
    assert [x.select("file", "record").distinct().count() for x in (first, rest)] == [1, 2]
    assert C.held_out(C.psmcfa_records(spark, [str(path)]))[1] is None


def test_starting_point():
    x = stein.starting_point(1e-3, 20.0, 2.0)
    t, c, theta, rho = hmm.to_models(x[None], 0.01)
    assert t[0, 1] == pytest.approx(1e-3) and t[0, -1] == pytest.approx(20) and np.allclose(c, 1) and rho[0] == pytest.approx(0.02)
    with pytest.raises(ValueError):
        stein.starting_point(1.0, 0.5, 1.0)


def test_revisit_is_a_law():
    t, c = np.array([[0.0, 0.3, 1.1, 2.5]]), np.array([[1.0, 0.4, 2.0, 0.7]])
    points = np.linspace(0, 40, 80_001)[1:]
    density, atom = hmm.revisit(t, c, 0.8, 0.6, points)
    assert np.trapezoid(density[0], points) + atom[0] == pytest.approx(1, abs=1e-3)


def test_bands(spark):
    rng = np.random.default_rng(1)
    t = np.concatenate([np.zeros((30, 1)), np.cumsum(rng.exponential(size=(30, 4)), axis=1)], axis=1)
    c = rng.exponential(size=(30, 5)) + 0.1
    rows = [(t[i].tolist(), c[i].tolist()) for i in range(30)]
    got = {r.k: r for r in posterior.bands(spark.createDataFrame(rows, "t array<double>, c array<double>"), 50).collect()}
    grid = np.geomspace(*np.quantile(t[:, 1:], [0.025, 0.975]), 50)
    for k, x in enumerate(grid):
        size = np.array([1 / (2 * c[i, np.searchsorted(t[i], x * (1 + 1e-12), side="right") - 1]) for i in range(30)])
        assert [got[k].x, got[k].median, got[k].lo, got[k].hi] == pytest.approx([x, *np.quantile(size, [0.5, 0.025, 0.975])])


def test_patterns_and_large_numbers(spark):
    from pyspark.sql import functions as F

    from strandloom.functions import history as H

    one = spark.range(1)
    assert one.select(H.expand_pattern(F.lit("2*1 + 1*3+4"))).first()[0] == [1, 1, 3, 4]
    for bad in ("", "2*", "0*1", "2*0", "a", "1++1"):
        with pytest.raises(Exception, match="not a pattern"):
            one.select(H.expand_pattern(F.lit(bad).cast("string"))).collect()
    assert one.select(H.softplus(F.lit(1e4)), H.softplus(F.lit(-1e4)), H.softplus(F.lit(0.0))).first() == (1e4, 0.0, pytest.approx(np.log(2)))
    grid = one.select(H.pattern_grid(F.lit("14*1+1*2"))).first()[0]
    assert grid == pytest.approx([0, *np.geomspace(1e-3, 15, 15)])
