"""Near copies that the fingerprints leave, against brute force over five-word shingles."""

from __future__ import annotations

import random
from collections import defaultdict
from pathlib import Path

import numpy as np

import corpus_pipeline
from strandloom.llm import common, near_copies

SF = "/root/testdata/sf0.01"


def runs_of(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else {()}


def brute(rows):
    sets, held, shared = {i: runs_of(t) for i, t in rows}, defaultdict(list), defaultdict(int)
    for i in sorted(sets):
        for x in sets[i]:
            for j in held[x]:
                shared[j, i] += 1
            held[x].append(i)
    return {(a, b) for (a, b), n in shared.items() if 5 * n >= 4 * (len(sets[a]) + len(sets[b]) - n)}


def least_of_classes(ids, pairs):
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i for i in ids if find(i) == i}


def test_hot_groups(spark):
    rng, rows = random.Random(4), []
    for base in range(6):
        words = [f"w{rng.randrange(10**6)}" for _ in range(rng.choice([60, 120, 400]))]
        for k in range(60):
            own = list(words)
            for at in rng.sample(range(len(own)), rng.randrange(4)):
                own[at] = f"v{base}x{k}x{at}"
            rows.append((100 * base + k, " ".join(own)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = least_of_classes([r[0] for r in rows], brute(rows))
    for block in (8, 1024):
        got = [r.doc_id for r in near_copies.one_per_class(df, block=block).collect()]
        assert len(got) == len(set(got)) and set(got) == want


def test_odd_rows(spark, odd, empty):
    got = near_copies.one_per_class(odd)
    assert got.columns == odd.columns
    # 1, 2, 3, 8: no words; 4, 5 and 7, 7: copies; the rest is alone
    assert sorted((r.doc_id or 0) for r in got.collect()) == [0, 1, 4, 6, 7, 9, 10, 11]
    assert near_copies.one_per_class(empty).count() == 0
    text = "one two three four five six seven eight nine ten"
    rows = [(None, text), (None, text), (5, text), (5, text + "!"), (6, text), (5, "another text of its own"), (7, "another text of its own")]
    kept = near_copies.one_per_class(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(kept, key=str) == sorted(([(5, text), (5, text + "!"), (5, "another text of its own"), (None, text), (None, text)]), key=str)


def altered(words, mark, at, n):
    """The words with n of them replaced by others, which breaks n + 4 shingles."""
    return words[:at] + [f"{mark}x{i}" for i in range(n)] + words[at + n :]


def test_no_pair_at_the_threshold_is_left(spark):
    """Some fingerprints of pairs just over 0.8 meet in no table."""
    rng, rows = random.Random(1), []
    for k in range(200):
        words = [f"w{rng.randrange(10**9)}" for _ in range(300)]
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(altered(words, f"v{k}", rng.randrange(40, 200), 28)))]
    assert len(brute(rows)) == 200
    got = [r.doc_id for r in near_copies.one_per_class(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert sorted(got) == list(range(0, 400, 2))


def test_links_beside_a_forest(spark):
    """In large groups a link that fails must not hide others that hold."""
    rng, rows = random.Random(2), []
    for base in range(4):
        words = [f"w{rng.randrange(10**9)}" for _ in range(300)]
        rows += [(1000 * base + i, " ".join(altered(words, f"v{base}x{i}", rng.randrange(270), rng.randint(14, 34)))) for i in range(100)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = least_of_classes([r[0] for r in rows], brute(rows))
    for block in (8, 1024):
        got = [r.doc_id for r in near_copies.one_per_class(df, block=block).collect()]
        assert len(got) == len(set(got)) and set(got) == want


def test_long_texts_are_ruled_out_by_sketches(spark, monkeypatch):
    """Long texts that share half of their shingles meet by their prefixes, and are not opened again."""
    rng, opened, materialize = random.Random(3), [], near_copies.materialize
    words = [f"w{rng.randrange(10**9)}" for _ in range(6000)]
    texts = [altered(words, f"v{k}", 100 + 150 * k, 1800) for k in range(6)]
    rows = [(k, " ".join(text)) for k, text in enumerate([*texts, altered(texts[0], "x", 5000, 10)])]
    assert brute(rows) == {(0, 6)}

    def counted(df, name):
        out = materialize(df, name)
        if name == "open-links":
            opened.extend(out.collect())
        return out

    monkeypatch.setattr(near_copies, "materialize", counted)
    got = [r.doc_id for r in near_copies.one_per_class(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert sorted(got) == list(range(6))
    assert [sorted((r.a.doc_id, r.b.doc_id)) for r in opened] == [[0, 6]]


def test_sketches_fold():
    rng = np.random.default_rng(5)
    for _ in range(50):
        own = [np.unique(rng.integers(-(2**63), 2**63, 3000)) for _ in range(2)]
        odd = [[np.packbits(np.bincount(x & bits - 1, minlength=bits).astype(np.uint8) & 1, bitorder="little").tobytes() for bits in (1024, 8192)] for x in own]
        assert near_copies.differing(odd[0][0], odd[1][1]) == near_copies.differing(odd[0][0], odd[1][0]) == near_copies.differing(odd[0][1], odd[1][0])
        assert near_copies.differing(odd[0][1], odd[0][0]) == 0


def test_what_was_read_is_deleted(spark):
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    rows = [(k, f"a text of some nine or ten words, number {k // 2}") for k in range(40)]
    assert near_copies.one_per_class(spark.createDataFrame(rows, "doc_id long, text string")).count() == 20
    assert spark.conf.get(key, None) == before
    left = [p.name for p in Path(common.scratch_folder(spark).removeprefix("file://")).iterdir()]
    assert not [x for x in left if x.startswith(("wide-fingerprints", "shingle-sets", "near-links", "rest-pairs"))]


def test_tables_cover():
    masks, rng = near_copies.table_masks(4), random.Random(6)
    assert len(masks) == 124
    for _ in range(2000):
        bits = rng.sample(range(128), 19)
        one, two = (sum(1 << b for b in bits if b < 64), sum(1 << (b - 64) for b in bits if b >= 64))
        assert any(not (a & (2**64 - 1)) & one and not (b & (2**64 - 1)) & two for a, b in masks)


def test_pipeline_leaves_no_near_copies(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    stages = [f for name, f in corpus_pipeline.STAGES if name not in ("toxicity", "source_mixing", "packing")]
    for stage in stages:
        docs = stage(spark, docs, SF)
    assert docs.columns == spark.read.parquet(f"{SF}/documents.parquet").columns
    assert not brute([(r.doc_id, r.text) for r in docs.collect()])
