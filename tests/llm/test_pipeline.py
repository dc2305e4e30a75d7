"""The pipeline's stages against plain Python over the same rows."""

from __future__ import annotations

import re
from collections import Counter, defaultdict

from test_near_copies import brute, least_of_classes

import corpus_pipeline
from strandloom.llm import toxicity

SF = "/root/testdata/sf0.01"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, rows = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF).cache()
        rows[name] = (docs.collect(), out.collect())
        if name != "packing":
            assert out.columns == columns
            docs = out
    before, after = rows["toxicity"]
    model = toxicity.fit(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet"))
    place = {x: i for i, x in enumerate(model.names)}
    clean = [r for r in before if model.scores([sorted(place[x] for x in toxicity.features(r.text) & place.keys())])[0] < 0.3]
    assert Counter(clean) == Counter(after)

    before, after = rows["line_dedup"]
    sites = defaultdict(set)
    for r in before:
        for line in r.text.split("\n"):
            if line.strip(" "):
                sites[line].add(r.source)
    seen, want = set(), {}
    for r in sorted(before):
        kept = []
        for line in r.text.split("\n"):
            words = len(re.findall(r"[^\x20\x09-\x0D]+", line))
            common = len(sites.get(line, ())) >= (3 if words >= 50 else 5 if words >= 3 else 10)
            if not common or line not in seen:
                kept.append(line)
            if common:
                seen.add(line)
        want[r.doc_id] = "\n".join(kept)
    assert want == {r.doc_id: r.text for r in after} and all(r.n_chars == len(r.text) for r in after)

    before, after = rows["simhash_dedup"]
    texts = [(r.doc_id, r.text) for r in before]
    assert sorted(r.doc_id for r in after) == sorted(least_of_classes([i for i, _ in texts], brute(texts)))
    assert set(after) <= set(before)

    before, after = rows["source_mixing"]
    words = {r.doc_id: len(re.findall(r"[^\x20\x09-\x0D]+", r.text)) for r in before}
    copies = Counter(r.doc_id for r in after)
    assert set(after) <= set(before) and max(copies.values()) <= 3
    own = Counter()
    for r in after:
        own[r.source] += words[r.doc_id]
    assert 0.95 * sum(words.values()) <= sum(own.values()) <= sum(words.values()) + 20

    before, after = rows["packing"]
    assert Counter(r.doc_id for r in before) == Counter(r.doc_id for r in after if r.start == 0)
