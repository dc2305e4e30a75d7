"""The pipeline's mixing explodes each row by its own copies, whatever its id."""

from __future__ import annotations

from collections import Counter

import corpus_pipeline
from strandloom.llm import mixing


def test_null_and_repeated_ids(spark):
    rows = [(i, f"word{i} " * (5 + i % 7), "en", "abc"[i % 3], 1) for i in range(60)]
    rows += [(None, f"no id {i} " * 4, "en", "abc"[i % 3], 1) for i in range(9)] + [(3, "the same row again", "en", "a", 1)] * 4
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    copies = Counter()
    for r in mixing.mix(docs).collect():
        copies[r.doc_id, r.size] += r.copies
    got = corpus_pipeline.source_mixing(spark, docs, "")
    assert got.columns == docs.columns
    assert Counter((r.doc_id, len(r.text.split())) for r in got.collect()) == +copies
    assert copies[None, 12] > 0 and copies[3, 4] > 0
