"""Sharding, toxicity and embedding links on whole tables against plain Python."""

from __future__ import annotations

import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from strandloom.llm import embeddings, sharding, toxicity
from strandloom.llm.common import first_linked

SF = "/root/testdata/sf0.01"


def test_shards_are_no_less_even_than_largest_first(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    groups = Counter()
    for r in docs.collect():
        groups[r.text or ""] += len((r.text or "").encode()) + 8
    greedy = [0] * 24
    for size in sorted(groups.values(), reverse=True):
        greedy[greedy.index(min(greedy))] += size
    sums, members = Counter(), defaultdict(set)
    for r in sharding.byte_balanced(docs).collect():
        sums[r.shard] += r.size
        members[r.text_crc32, r.size].add(r.shard)
    assert sum(sums.values()) == sum(greedy) and len(sums) == 24
    assert max(sums.values()) - min(sums.values()) <= max(greedy) - min(greedy)
    assert all(len(x) == 1 for x in members.values())


def test_toxicity_model_and_scores(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    texts = {r.doc_id: r.text for r in docs.collect()}
    marks = {r.doc_id: int(r.toxic == 1) for r in labels.collect() if r.toxic is not None and r.doc_id in texts and zlib.crc32(str(r.doc_id).encode()) % 4 != 2}
    ids = sorted(marks)
    found = {i: toxicity.features(texts[i]) for i in ids}
    n, p = len(ids), sum(marks.values())
    u, k = Counter(), Counter()
    for i in ids:
        u.update(found[i])
        k.update(found[i] if marks[i] else ())
    ranked = []
    for name, seen in u.items():
        share = seen / n
        z = abs(k[name] / p - share) / (math.sqrt(share * (1 - share) * (1 / p + 1 / n)) + 1e-9)
        if seen >= 5 and z > 4:
            ranked.append((-z, name))
    names = [name for _, name in sorted(ranked)[: toxicity.VOCABULARY]]
    place = {name: i for i, name in enumerate(names)}
    weights, bias = toxicity.train([sorted(place[x] for x in found[i] if x in place) for i in ids], np.array([marks[i] == 1 for i in ids]), p / n, len(names))
    model = toxicity.fit(docs, labels)
    assert model.names == names
    for r in toxicity.score(docs, model).collect():
        raw = bias + sum(weights[place[x]] for x in toxicity.features(texts[r.doc_id]) if x in place)
        assert r.score == pytest.approx(1 / (1 + math.exp(-raw)), abs=1e-9)
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and r.predicted == (r.score >= 0.3)


def test_links_of_perturbed_copies(spark):
    """Every vector of the table, and 19 more beside each at cosines from 0.88 to 1."""
    rng, rows = np.random.default_rng(5), []
    given = spark.read.parquet(f"{SF}/embeddings.parquet").orderBy("vec_id").collect()
    for r in given:
        v = np.array(r.embedding, float)
        v /= np.linalg.norm(v)
        rows.append((len(rows), v.astype(np.float32).tolist(), r.label))
        for _ in range(19):
            aside = rng.normal(size=len(v))
            aside -= (aside @ v) * v
            cosine = rng.uniform(0.94, 1)
            near = cosine * v + math.sqrt(1 - cosine**2) * aside / np.linalg.norm(aside)
            rows.append((len(rows), near.astype(np.float32).tolist(), r.label))
    rows += [(len(rows) + i, rows[0][1], rows[0][2]) for i in range(300)]  # a hot vector
    by_label = defaultdict(list)
    for i, v, label in rows:
        by_label[label].append((i, v))
    want, root = {}, {}
    for held in by_label.values():
        ids, unit = np.array([i for i, _ in held]), np.array([v for _, v in held], np.float32).astype(float)
        unit /= np.linalg.norm(unit, axis=1, keepdims=True)
        linked = unit @ unit.T >= 0.93
        want |= dict(zip(ids.tolist(), (linked.sum(axis=1) - 1).tolist(), strict=True))
        root |= dict(zip(ids.tolist(), ids[first_linked(linked)].tolist(), strict=True))
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = {r.vec_id: r for r in embeddings.near_duplicates(table).collect()}
    assert got.keys() == want.keys() and all(got[i].n_links <= want[i] for i in want)
    assert sum(want.values()) > 50_000
    assert sum(r.n_links for r in got.values()) >= 0.99 * sum(want.values())
    assert sum(got[i].component_id == root[i] for i in root) >= 0.99 * len(root)
