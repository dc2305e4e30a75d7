"""Every registered query with an oracle, against DuckDB on the same tables."""

from __future__ import annotations

import duckdb
import pytest

import __spark_entry__ as entry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SF = "/root/testdata/sf0.001"


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(names), sorted((tuple(r[i] for i in order) for r in rows), key=lambda r: tuple((x is None, str(type(x)), x) for x in r))


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_oracle(spark, duck, name):
    got = entry.queries()[name](spark, SF)
    found = rows_of(got.columns, [tuple(r) for r in got.collect()])
    cur = duck.execute(entry.oracle_sql()[name])
    assert found == rows_of([c[0] for c in cur.description], cur.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
