"""Each stage of the pipeline on odd and empty tables: no crash, every column kept, a defined result."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

import corpus_pipeline

STAGES = dict(corpus_pipeline.STAGES)
CLASHING = "copies _taken _row _copy key row taken copy n_lines n_removed size rate source_size target node fp h _gone _doc _text stays".split()


@pytest.fixture(scope="session")
def folder(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("labels")
    rows = [(i, 1, i % 2) for i in range(8)] + [(None, None, 1), (9, 0, None), (3, 0, 1)]
    spark.createDataFrame(rows, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path)


@pytest.mark.parametrize("name", STAGES)
def test_odd(spark, odd, folder, name):
    docs = odd.withColumns({x: F.concat(F.lit("kept "), F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))) for x in CLASHING})
    before, got = docs.collect(), STAGES[name](spark, docs, folder)
    after = got.collect()
    if name == "packing":
        assert {r.doc_id for r in after} == {r.doc_id for r in before}
        assert sum(1 for r in after if r.start == 0) == len(before)
        return
    assert got.columns == docs.columns
    for r in after:  # what clashes is as it was
        assert all(r[x] == f"kept {'none' if r.doc_id is None else r.doc_id}" for x in CLASHING)
    if name == "line_dedup":
        assert sorted((r.doc_id or 0, r.source or "") for r in after) == sorted((r.doc_id or 0, r.source or "") for r in before)
        assert [r.text for r in after if r.doc_id == 1] == [None]
    elif name == "source_mixing":
        assert {r.doc_id for r in after} <= {r.doc_id for r in before} and all(r.text and r.text.split() for r in after)
    else:
        assert all(r in before for r in after)
    if name == "simhash_dedup":
        assert sorted(r.doc_id or 0 for r in after) == [0, 1, 4, 6, 7, 9, 10, 11]


@pytest.mark.parametrize("name", STAGES)
def test_empty(spark, empty, folder, name):
    got = STAGES[name](spark, empty, folder)
    assert got.count() == 0 and (name == "packing" or got.columns == empty.columns)
