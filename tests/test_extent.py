"""Grids and wholes go as far as the data do."""

from __future__ import annotations

from datetime import datetime, timedelta
from pathlib import Path

import duckdb

import __spark_entry__ as entry
from strandloom.operators import het
from strandloom.sources import adapters as A


def test_dense_keeps_windows_past_the_grid(spark):
    rows = [("A", 1, 0, 3), ("A", 1, 250, 5), ("R", 2, 199, 7)]
    df = spark.createDataFrame(rows, "contig string, sample long, win long, n_het long")
    got = {(r.contig, r.sample, r.win): r.n_het for r in het.dense(df, 200, "n_het").collect()}
    assert got == {(c, s, w): 0 for c, s in (("A", 1), ("R", 2)) for w in range(251)} | {r[:3]: r[3] for r in rows}


def test_subtract_reaches_the_last_mask(spark, tmp_path: Path):
    keys = [29 * 1_000, 29 * 80_000, 29 * 100_000]
    spark.createDataFrame([(k, 7) for k in keys], "o_orderkey long, o_custkey long").write.parquet(f"{tmp_path}/orders.parquet")
    got = sorted(map(tuple, entry.queries()["o5_interval_subtract"](spark, str(tmp_path)).collect()))
    edges = [0, *(x for k in keys for x in (k * 500, k * 500 + 8))]
    assert got == list(zip(edges[::2], edges[1::2], strict=False))


def test_events_of_any_days_count(spark, tmp_path: Path):
    """The windows go from the first event's day to the last event, in the relation and in its SQL."""
    start = datetime(2031, 5, 3, 7, 30)
    rows = [(i, start + timedelta(hours=h), u, kind) for i, (h, u, kind) in enumerate([(0, 1, "view"), (31 * 24, 1, "error"), (31 * 24 + 1, 1, "view"), (77 * 24 + 15, 2, "click"), (77 * 24 + 15.4, 2, "error")])]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string").write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    got = sorted(tuple(r) for r in A.observations(spark, str(tmp_path)).collect())
    assert got == sorted(con.execute(f"WITH {A.OBS} SELECT * FROM obs").fetchall())
    windows = 77 * 4 + 4  # of six hours from midnight on; the last event is at 22:54
    assert A.window_count(spark, str(tmp_path)) == windows and len(got) == 2 * windows
    assert {(u, w): ob for u, w, ob in got if ob >= 0} == {(1, 1): 0, (1, 31 * 4 + 1): 1, (2, windows - 1): 1}
    queries, sql = entry.queries(), entry.oracle_sql()
    for name in ("w1_chunks", "b2_strided_slices"):
        found = queries[name](spark, str(tmp_path))
        cur = con.execute(sql[name])
        order = [found.columns.index(c[0]) for c in cur.description]
        assert sorted(tuple(r[i] for i in order) for r in found.collect()) == sorted(cur.fetchall())


def test_samples_of_any_order_are_not_missing(spark, tmp_path: Path):
    """Every order counts, not those of some keys alone, in the relation and in its SQL."""
    spark.createDataFrame([(i,) for i in range(1, 7)], "c_custkey long").write.parquet(f"{tmp_path}/customer.parquet")
    spark.createDataFrame([(16, 1), (17, 2), (23, 3), (33, 3), (48, 5)], "o_orderkey long, o_custkey long").write.parquet(f"{tmp_path}/orders.parquet")
    con = duckdb.connect()
    for t in ("customer", "orders"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    got = sorted(tuple(r) for r in entry.queries()["j11_missing_samples"](spark, str(tmp_path)).collect())
    assert got == [(4,), (6,)] == sorted(con.execute(entry.oracle_sql()["j11_missing_samples"]).fetchall())


def test_windows_of_users_are_not_broadcast(spark, tmp_path: Path):
    """Few users have many windows; none of them pass through the driver, and users and kinds that are null are as in SQL."""
    start = datetime(2031, 5, 3)
    rows = [(i, start + timedelta(hours=7 * i), i % 40, "error" if i % 5 == 0 else "view") for i in range(400)] + [(400, start, None, "error"), (401, start + timedelta(days=90), 7, None), (402, None, 41, "view")]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string").write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    for name in ("p10_not_missing", "all"):
        got = A.observations(spark, str(tmp_path)) if name == "all" else entry.queries()[name](spark, str(tmp_path))
        sql = f"WITH {A.OBS} SELECT user_id, win, ob FROM obs" if name == "all" else entry.oracle_sql()[name]
        key = lambda r: tuple((x is None, x) for x in r)
        assert sorted(map(tuple, got.collect()), key=key) == sorted(con.execute(sql).fetchall(), key=key)
        plan = got._jdf.queryExecution().executedPlan().toString()  # after the run, so as it was run
        assert "isFinalPlan=true" in plan and "BroadcastHashJoin" not in plan.split("== Initial Plan ==")[0]
