"""The filter audit against plain Python that applies the filters in every order."""

from __future__ import annotations

import random
import re
from collections import defaultdict
from itertools import permutations

import pytest

from strandloom.llm import audit

LABELS = "doc_id long, quality int, toxic int"


def failing(rows):
    """A set of filter names for each row (doc_id, text, lang)."""
    out = []
    for doc_id, text, _ in rows:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        smaller = any(i is not None and doc_id is not None and i < doc_id and (t or "") == text for i, t, _ in rows)
        conditions = (len(words) < 100, 100 * len(set(words)) < 80 * len(words), 100 * len(re.findall("[A-Z]", text)) > 10 * len(text), bool(re.search(r"[#$%&*|]", text)), smaller)
        out.append({name for name, fails in zip("ABCDE", conditions, strict=True) if fails})
    return out


def brute(rows, labels):
    good, toxic = ({i for i, *marks in labels if i is not None and marks[k] == 1} for k in (0, 1))
    by_part, want, shapley = defaultdict(list), {}, defaultdict(int)
    for (doc_id, _, lang), fails in zip(rows, failing(rows), strict=True):
        by_part[lang or ""].append((doc_id, fails))
    for part, own in by_part.items():
        for order in permutations("ABCDE"):
            left = own
            for step, name in enumerate(order, 1):
                removed = [x for x in left if name in x[1]]
                left = [x for x in left if name not in x[1]]
                here = [i for i, _ in removed]
                counts = [len(left), len(removed), sum(name in f for _, f in own) - len(removed), sum(f == {name} for _, f in own), sum(i in good for i in here), sum(i in toxic for i in here)]
                want[part, "".join(order), step] = counts
                shapley[part, name] += len(removed)
    return {key: (*counts, shapley[key[0], key[1][key[2] - 1]]) for key, counts in want.items()}


def found(df):
    rows = df.collect()
    out = {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in rows}
    assert len(out) == len(rows)
    return out


def test_random_documents(spark):
    rng, rows = random.Random(4), []
    for i in range(160):
        words = [f"w{rng.randint(0, rng.choice((60, 2000)))}" for _ in range(rng.choice((3, 99, 100, 101, 160)))]
        if rng.random() < 0.3:
            words = [w.upper() for w in words]
        text = " ".join(words) + rng.choice(("", "", "#", " é ü", "|"))
        rows.append((i, rng.choice(rows)[1] if rows and rng.random() < 0.3 else text, rng.choice(("en", "fr", None, ""))))
    rng.shuffle(rows)
    labels = [(rng.randint(0, 170), rng.choice((0, 1, None)), rng.choice((0, 1))) for _ in range(150)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(5)
    assert found(audit.filter_audit(docs, spark.createDataFrame(labels, LABELS))) == brute(rows, labels)


def test_odd(spark, odd):
    """Nulls in any column, long texts, ties, repeated rows; ids at the edge of equal."""
    labels = [(i, i % 2, 1) for i in range(12)] + [(None, 1, 1), (4, 0, 0), (4, 1, None)]
    rows = [(r.doc_id, r.text, r.lang) for r in odd.collect()]
    assert found(audit.filter_audit(odd, spark.createDataFrame(labels, LABELS))) == brute(rows, labels)


def test_empty(spark, empty, odd):
    none = spark.createDataFrame([], LABELS)
    assert audit.filter_audit(empty, none).count() == 0
    assert all(x[4] == x[5] == 0 for x in found(audit.filter_audit(odd, none)).values())


@pytest.mark.parametrize("names", ["X", "XY", "ABCD"])
def test_other_numbers_of_filters(spark, names):
    """Filters are tables of ids, whatever made them: each keeps what the others remove."""
    rows = spark.range(60).selectExpr("id AS row", "'p' AS part", "0 AS good", "0 AS toxic")
    tables = {name: spark.range(60).filter(f"id % {k + 2} = 0").selectExpr("id AS row") for k, name in enumerate(names)}
    for (_, order, step), counts in found(audit.audit(rows, tables)).items():
        passing = lambda upto: [i for i in range(60) if not any(i % (names.index(x) + 2) == 0 for x in upto)]
        assert counts[0] == len(passing(order[:step])) and counts[1] == len(passing(order[: step - 1])) - counts[0]


def test_names_must_be_letters(spark):
    rows = spark.range(3).selectExpr("id AS row", "'p' AS part", "0 AS good", "0 AS toxic")
    with pytest.raises(ValueError, match="one letter"):
        audit.audit(rows, {"AB": rows.select("row")})
