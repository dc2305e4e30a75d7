"""Quantiles by refinement against the sorted values, and PSMC-FASTA lines by splits."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandloom.operators import quantiles
from strandloom.sources import contigs as C
from strandloom.sources import text

AT = [0.0, 0.025, 0.5, 0.731, 0.975, 1.0]


@pytest.mark.parametrize(("spans", "few", "buffer"), [(16, 20, 0), (128, 256, 100), (128, 256, 1 << 16)])
def test_quantiles_equal_percentile(spark, monkeypatch, spans, few, buffer):
    """A hot key, ties, one value, far outliers and nulls."""
    monkeypatch.setattr(quantiles, "SPANS", spans)
    monkeypatch.setattr(quantiles, "FEW", few)
    monkeypatch.setattr(quantiles, "BUFFER", buffer)
    rng = random.Random(spans)
    rows = [("hot", rng.gauss(0, 1)) for _ in range(3000)] + [("ties", float(rng.randrange(3))) for _ in range(500)] + [("same", 2.5)] * 400
    rows += [("one", -7.0), ("far", 1e300), ("far", -1e300), ("far", 0.0), ("null", None), ("hot", None)] + [("steep", 10.0 ** rng.randrange(-200, 200)) for _ in range(600)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(6)
    got = {r.k: (r.n, r.q) for r in quantiles.quantiles(df, ["k"], "v", AT).collect()}
    want = {r.k: (r.n, r.q) for r in df.groupBy("k").agg(F.count("v").alias("n"), F.percentile("v", AT).alias("q")).filter("n > 0").collect()}
    assert got.keys() == want.keys()
    for k, (n, q) in want.items():
        assert got[k][0] == n and got[k][1] == pytest.approx(q, rel=1e-15, abs=0)


def test_no_rows(spark):
    assert quantiles.quantiles(spark.createDataFrame([], "k string, v double"), ["k"], "v", [0.5]).count() == 0


@pytest.mark.parametrize("split", [61, 1 << 20])
def test_records_over_splits(spark, tmp_path, split):
    rng, want, whole = random.Random(1), {}, []
    for nth, length in enumerate((300, 1, 75, 0, 410), 1):
        symbols = "".join(rng.choice("KTNx") for _ in range(length))
        whole.append(f">c{nth} about it\n" + "".join(symbols[i : i + 23] + ("\r\n" if i % 2 else "\n") for i in range(0, length, 23)) + "\n" * (nth % 3))
        want |= {(f"c{nth}", i): {"K": 1, "N": -1}.get(x, 0) for i, x in enumerate(symbols)}
    for name in ("a.psmcfa", "b.psmcfa"):
        (tmp_path / name).write_text("".join(whole))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    spark.conf.set("spark.sql.files.openCostInBytes", split)
    try:
        lines = text.psmcfa_lines(spark, str(tmp_path))
        assert split > 100 or spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 10
        got = [((r.contig, r.win), r.ob, r.file[-8]) for r in text.windows_of(lines, ["file", "contig"]).collect()]
        for name in "ab":
            assert {k: v for k, v, f in got if f == name} == want
        assert len(got) == 2 * len(want)
        source = C.record_contigs(C.psmcfa_records(spark, [str(tmp_path / "a.psmcfa")] * 2), 100)
        assert (source.contigs, source.shortest) == (8, 100)
        rest, first = C.held_out(C.psmcfa_records(spark, [str(tmp_path / "a.psmcfa")]))
        assert first.agg(F.sum(F.length("symbols"))).first()[0] == 300 and rest.select("record").distinct().count() == 3
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.files.openCostInBytes")
