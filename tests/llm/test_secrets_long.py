"""Long candidates and many matches: whole, in linear time, equal to windows counted anew."""

from __future__ import annotations

import random
import re

import pytest
from test_operators import reference_entropy

from strandloom.llm import secrets

LETTERS = {c[0]: c[2] for c in secrets.CLASSES}


@pytest.mark.parametrize("kind", sorted(LETTERS))
def test_long_candidate(spark, kind):
    _, _, letters, window, bits, _ = next(c for c in secrets.CLASSES if c[0] == kind)
    rng = random.Random(kind)
    head, tail = letters[:2] * 400 + letters[-1] + letters[11], (letters[1] + letters[-1]) * 300
    candidate = head + "".join(rng.choices(letters, k=60_000)) + tail
    df = spark.createDataFrame([(1, f"\u00e9 {candidate} end")], "doc_id long, text string")
    got = [s for s in secrets.find_secrets(df).first().added if s.kind == kind]
    runs = reference_entropy(candidate, window, bits)
    assert runs and [(s.start, s.end, s.found) for s in got] == [(2 + first - window, 2 + last, candidate[first - window : last]) for first, last in runs]


def test_many_runs(spark):
    """Thousands of keys in one candidate, parted by repeated characters."""
    _, _, letters, window, bits, marks = next(c for c in secrets.CLASSES if c[0] == "entropy_base64")
    rng = random.Random(9)
    candidate = "".join("".join(rng.choices(letters[:62], k=40)) + "=" * 60 for _ in range(2000))
    got = [s for s in secrets.find_secrets(spark.createDataFrame([(1, candidate)], "doc_id long, text string")).first().added if s.kind == "entropy_base64"]
    want = [(a - window, b) for a, b in reference_entropy(candidate, window, bits)]
    assert len(got) > 1990 and [(s.start, s.end) for s in got] == [(a, b) for a, b in want if all(re.search(m, candidate[a:b]) for m in marks)]


def test_many_matches(spark):
    rng = random.Random(5)
    runs = ["%0*x" % (rng.choice([12, 16, 20]), rng.getrandbits(48)) for _ in range(40_000)]
    text, at, want = " ".join(runs), 0, []
    for run in runs:
        if len(run) >= 16:
            want.append((at, at + len(run)))
        at += len(run) + 1
    found = secrets.find_secrets(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert [(s.start, s.end) for s in found.hex] == want
