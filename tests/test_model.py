"""The hidden Markov model, sources and streaming."""

from __future__ import annotations

import itertools

import numpy as np
import pytest

from strandloom.functions import hmm
from strandloom.functions.history import branch_weights
from strandloom.operators import fit
from strandloom.sources import text

ONE = np.array([1e-2])


def test_reference_numbers():
    t, c = hmm.default_history()
    a = hmm.transition(t, c, ONE)[0]
    assert abs(a.sum(axis=1) - 1).max() < 1e-12
    assert a[0, 0] == pytest.approx(0.9999900117095196, abs=1e-12)
    assert a[15, 15] == pytest.approx(0.8656387545086959, abs=1e-12)
    assert hmm.start(t, c)[0, 0] == pytest.approx(9.99500166624978e-4)
    assert hmm.log_likelihood(t, c, ONE, ONE, np.array([[0, 1, 0, 0, -1, 1, 0]]))[0, 0] == pytest.approx(-8.713219389671579, abs=1e-9)


def test_forward_is_the_sum_over_paths():
    t, c = np.array([[0.0, 0.5, 1.5]]), np.array([[1.0, 0.7, 1.3]])
    a, pi, miss = hmm.transition(t, c, ONE)[0], hmm.start(t, c)[0], np.exp(-0.3 * hmm.expected_times(t, c))[0]
    obs = [0, 1, -1, 0]
    total = 0.0
    for path in itertools.product(range(3), repeat=5):
        p = pi[path[0]]
        for i, o in enumerate(obs):
            z = path[i + 1]
            p *= a[path[i], z] * (1 if o < 0 else miss[z] if o == 0 else 1 - miss[z])
        total += p
    assert hmm.log_likelihood(t, c, np.array([0.3]), ONE, np.array([obs]))[0, 0] == pytest.approx(np.log(total))


def test_branch_weights():
    for n in (4, 9):
        w = np.array([[float(x) for x in row] for row in branch_weights(n)])
        etjj = np.array([2 / (k * (k - 1)) for k in range(2, n + 1)])
        assert w @ etjj == pytest.approx([2 / b for b in range(1, n)])


def test_fit_and_band(spark):
    rng = np.random.default_rng(0)
    rows = [(i, (rng.random(40) < 0.2).astype(int).tolist()) for i in range(6)]
    x = fit.fit(spark.createDataFrame(rows, "k long, obs array<byte>"), 0.2, 5, particles=5, iterations=2)
    assert x.shape == (5, 18) and np.isfinite(x).all()
    curves = spark.createDataFrame([(p, float(g), float(p + g)) for p in range(40) for g in range(5)], "particle long, x double, value double")
    band = {r.x: (r.lo, r.hi) for r in fit.simultaneous_band(curves, 0.9).collect()}
    assert sum(all(lo <= p + g <= hi for g, (lo, hi) in band.items()) for p in range(40)) >= 36


def test_sources(spark, tmp_path):
    (tmp_path / "a.psmcfa").write_text(">1\nKKT\nNK\n>2\nTT\n")
    got = sorted((r.contig, r.win, r.ob) for r in text.read_psmcfa(spark, str(tmp_path / "a.psmcfa")).collect())
    assert got == [("1", 0, 1), ("1", 1, 1), ("1", 2, 0), ("1", 3, -1), ("1", 4, 1), ("2", 0, 0), ("2", 1, 0)]
    head = "##x\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\tA\tB\n"
    (tmp_path / "b.vcf").write_text(head + "1\t10\t.\tA\tT\t.\t.\t.\tGT\t0|1\t./.\n1\t20\t.\tA\tT\t.\t.\t.\tGT:DP\t1/1:3\t0\n")
    rows = text.read_vcf(spark, str(tmp_path / "b.vcf"), ["B", "A"], "1:9-20").collect()
    assert sorted((r.pos, r.sample, r.a0, r.a1) for r in rows if r.sample == "A") == [(10, "A", 0, 1), (20, "A", 1, 1)]
    assert [(r.a0, r.a1) for r in rows if r.sample == "B"] == [(None, None), (0, None)]
    with pytest.raises(ValueError):
        text.read_vcf(spark, str(tmp_path / "b.vcf"), ["C"])
    (tmp_path / "s.txt").write_text("scrm 4 1\nposition time 0 1 2 3\n3.7 0.1 0 1 1 1\nSFS: 1 0\n")
    assert [tuple(r) for r in text.read_simulated(spark, str(tmp_path / "s.txt")).collect()] == [(4, 0, 0, 1), (4, 1, 1, 1)]


def test_stream(spark, tmp_path):
    from strandloom.streaming.observations import event_stream, windowed

    source = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    source.write.parquet(str(tmp_path / "in"))
    stream = windowed(event_stream(spark, str(tmp_path / "in"), source.schema))
    running = stream.writeStream.format("memory").queryName("observed").outputMode("complete").trigger(availableNow=True).start()
    running.awaitTermination(120)
    assert spark.table("observed").count() == windowed(source).count()


def test_structured_form_rebuilds_the_matrix():
    t, c = np.array([[0.0, 0.3, 0.9, 2.0]]), np.array([[1.0, 0.7, 1.3, 0.4]])
    a, s = hmm.transition(t, c, ONE)[0], {k: v[0] for k, v in hmm.structured(t, c, ONE, ONE).items()}
    again = np.diag(s["d"]) + np.triu(np.outer(s["u"], s["v"]), 1) + np.tril(np.ones((4, 4)) * s["b"], -1)
    assert abs(a - again).max() < 1e-7
    x = np.array([0.1, 0.2, 0.3, 0.4])
    assert x @ again == pytest.approx(x @ a, abs=1e-7)


def test_transitions_and_product(spark):
    from strandloom.operators import coalescent, windows

    rows = [(k, [0.0, 0.3, 0.9], [1.0, 0.5 + k, 2.0]) for k in range(600)]
    histories = spark.createDataFrame(rows, "k long, t array<double>, c array<double>")
    sums = coalescent.transitions(histories, "k", 1e-2).groupBy("k", "i").sum("p").collect()
    assert len(sums) == 1800 and all(abs(r[2] - 1) < 1e-6 for r in sums)
    parts = coalescent.structured(histories.filter("k < 3"), "k", 1e-2, 1e-2).withColumnRenamed("pi", "x")
    got = {(r.k, r.i): r.out for r in windows.structured_product(parts, "k", "i").collect()}
    for k, t, c in rows[:3]:
        t, c = np.array([t]), np.array([c])
        want = hmm.start(t, c)[0] @ hmm.transition(t, c, ONE)[0]
        assert [got[k, i] for i in range(3)] == pytest.approx(want, abs=1e-6)
    assert coalescent.transitions(histories.limit(0), "k", 1e-2).count() == 0


def test_spectrum_term():
    from strandloom.operators import spectra

    t, c = np.array([[0.0, 1.0]]), np.array([[1.0, 1.0]])
    weights = np.array(branch_weights(5), float)
    assert hmm.coalescence_times(t, c, 5)[0] == pytest.approx([2 / (k * (k - 1)) for k in range(2, 6)])
    seen = np.array([10.0, 4, 0, 1])
    share = np.array([1, 1 / 2, 1 / 3, 1 / 4]) / (25 / 12)
    assert hmm.spectrum_term(t, c, seen, weights, np.eye(4))[0] == pytest.approx(sum(s * np.log(p) for s, p in zip(seen, share) if s))
    assert spectra.fold_matrix(6) == [[1, 0, 0, 0, 1], [0, 1, 0, 1, 0], [0, 0, 1, 0, 0]]
    assert spectra.fold_bin_matrix([100000, 200, 1, 0, 0, 0]) == [[1, 0, 0, 0, 0, 1], [0, 1, 1, 1, 1, 0]]


def test_fit_with_spectrum_and_minibatch(spark):
    rng = np.random.default_rng(1)
    rows = [(i, (rng.random(30) < 0.2).astype(int).tolist()) for i in range(8)]
    chunks = spark.createDataFrame(rows, "chunk_id long, obs array<byte>")
    x = fit.fit(chunks, 0.2, 5, particles=4, iterations=2, afs=[30.0, 12, 9, 4, 2], minibatch=3)
    assert x.shape == (4, 18) and np.isfinite(x).all()
    assert fit.store_chunks(chunks).drawn(np.array([2, 2, 5])).count() == 3
