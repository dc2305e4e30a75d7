"""Registered queries over the adapter relations, with their DuckDB texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import history as H
from ..operators import het, intervals, ordering, quantiles, spectra, windows
from ..sources import adapters as A
from .registry import query

SIZE = 1000
HET = f"{A.CALLS}, het AS (SELECT contig, sample, CAST(floor(pos / {SIZE}e0) AS BIGINT) AS win, CAST(sum(CASE WHEN a0 <> a1 THEN 1 ELSE 0 END) AS BIGINT) AS n_het FROM calls GROUP BY 1, 2, 3)"
AFS = f"{A.CALLS}, nd AS (SELECT contig, pos, sum(a0 + a1) AS k FROM calls GROUP BY 1, 2), afs AS (SELECT contig, CAST(k AS BIGINT) AS k, count(*) AS n_sites FROM nd WHERE k BETWEEN 1 AND {A.PLOIDS - 1} GROUP BY 1, 2), total AS (SELECT k, CAST(sum(n_sites) AS BIGINT) AS n_sites FROM afs GROUP BY 1)"


@query("s3_site_het", f"WITH {A.CALLS} SELECT contig, pos, sample, CAST(CASE WHEN a0 <> a1 THEN 1 ELSE 0 END AS BIGINT) AS het FROM calls")
def s3(spark: SparkSession, d: str) -> DataFrame:
    return A.calls(spark, d).select("contig", "pos", "sample", het.is_het(F.col("a0"), F.col("a1")).alias("het"))


@query("p4_bin", f"SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS line, CAST(floor(l_orderkey * 10 / {SIZE}e0) AS BIGINT) AS win FROM lineitem")
def p4(spark, d):
    return A.table(spark, d, "lineitem").select("l_orderkey", F.col("l_linenumber").cast("long").alias("line"), het.window_of(F.col("l_orderkey") * 10, SIZE).alias("win"))


@query("a1_het_count", f"WITH {HET} SELECT * FROM het")
def a1(spark, d):
    return het.het_counts(A.calls(spark, d), SIZE)


@query("a2_het_or", f"WITH {A.CALLS} SELECT contig, sample, CAST(floor(pos / {SIZE}e0) AS BIGINT) AS win, CAST(max(CASE WHEN a0 <> a1 THEN 1 ELSE 0 END) AS BIGINT) AS ob FROM calls GROUP BY 1, 2, 3")
def a2(spark, d):
    return het.het_any(A.calls(spark, d), SIZE)


@query("a3_afs", f"WITH {AFS} SELECT * FROM afs")
def a3(spark, d):
    return het.spectrum(A.calls(spark, d), A.PLOIDS)


@query("a4_afs_sum", f"WITH {AFS} SELECT * FROM total")
def a4(spark, d):
    return het.add_spectra(het.spectrum(A.calls(spark, d), A.PLOIDS))


FOLD = f"{AFS}, folded AS (SELECT CAST(least(k, {A.PLOIDS} - k) AS BIGINT) AS k, CAST(sum(n_sites) AS BIGINT) AS n_sites FROM total GROUP BY 1)"


@query("af1_fold", f"WITH {FOLD} SELECT * FROM folded")
def af1(spark, d):
    return spectra.fold(a4(spark, d), A.PLOIDS)


@query("af2_project", f"""WITH {AFS}, c AS (SELECT CAST(i.range AS INTEGER) AS i, CAST(j.range AS INTEGER) AS j FROM range(1, 6) i, range(1, {A.PLOIDS}) j),
 p AS (SELECT i, j, (CAST(factorial(CAST(j AS INTEGER)) AS DOUBLE) / (CAST(factorial(CAST(i AS INTEGER)) AS DOUBLE) * CAST(factorial(CAST(j - i AS INTEGER)) AS DOUBLE))) * (CAST(factorial(CAST({A.PLOIDS} - j AS INTEGER)) AS DOUBLE) / (CAST(factorial(CAST(6 - i AS INTEGER)) AS DOUBLE) * CAST(factorial(CAST({A.PLOIDS} - j - 6 + i AS INTEGER)) AS DOUBLE))) / (CAST(factorial(CAST({A.PLOIDS} AS INTEGER)) AS DOUBLE) / (CAST(factorial(CAST(6 AS INTEGER)) AS DOUBLE) * CAST(factorial(CAST({A.PLOIDS} - 6 AS INTEGER)) AS DOUBLE))) AS p FROM c WHERE i <= j AND 6 - i <= {A.PLOIDS} - j)
 SELECT CAST(i AS BIGINT) AS k, round(sum(n_sites * p), 6) AS n_sites FROM total JOIN p ON k = j GROUP BY 1""")
def af2(spark, d):
    return spectra.project(a4(spark, d), A.PLOIDS, 6).select("k", F.round("n_sites", 6).alias("n_sites"))


def bws_sql(source: str) -> str:
    return f"s AS (SELECT k, n_sites, sum(n_sites) OVER (ORDER BY k) / CAST(sum(n_sites) OVER () AS DOUBLE) AS share FROM {source}), i AS (SELECT count(*) FILTER (share <= 0.9e0) + 1 AS kept FROM s) SELECT CAST(least(k, kept + 1) AS BIGINT) AS bin, CAST(sum(n_sites) AS BIGINT) AS n_sites FROM s, i GROUP BY 1"


@query("af3_bws", f"WITH {AFS}, {bws_sql('total')}")
def af3(spark, d):
    return spectra.bin_tail(a4(spark, d))


@query("af4_fold_bws", f"WITH {FOLD}, {bws_sql('folded')}")
def af4(spark, d):
    return spectra.bin_tail(af1(spark, d))


@query("s7_pair_het", f"WITH {HET} SELECT contig, sample AS pair, win, n_het FROM het")
def s7(spark, d):
    genotypes = A.calls(spark, d).select("contig", "pos", F.posexplode(F.array("a0", "a1")).alias("side", "allele"), "sample").select("contig", "pos", (2 * F.col("sample") + F.col("side")).cast("long").alias("node"), "allele")
    pairs = spark.range(1, A.SAMPLES + 1).select(F.col("id").alias("pair"), (2 * F.col("id")).alias("node0"), (2 * F.col("id") + 1).alias("node1"))
    return het.pair_het_counts(genotypes, F.broadcast(pairs), SIZE)


@query("j1_mask_afs", f"WITH {A.CALLS}, {A.MASKS}, kept AS (SELECT c.* FROM calls c WHERE NOT EXISTS (SELECT 1 FROM masks m WHERE c.pos >= m.a AND c.pos < m.b)), nd AS (SELECT contig, pos, sum(a0 + a1) AS k FROM kept GROUP BY 1, 2) SELECT contig, CAST(k AS BIGINT) AS k, count(*) AS n_sites FROM nd WHERE k BETWEEN 1 AND {A.PLOIDS - 1} GROUP BY 1, 2")
def j1(spark, d):
    return het.spectrum(intervals.outside(A.calls(spark, d), A.masks(spark, d)), A.PLOIDS)


@query("j2_mask_columns", f"WITH {HET}, {A.MASKS} SELECT contig, sample, win, CASE WHEN EXISTS (SELECT 1 FROM masks m WHERE win * {SIZE} < m.b AND (win + 1) * {SIZE} > m.a) THEN CAST(-1 AS BIGINT) ELSE n_het END AS n_het FROM het")
def j2(spark, d):
    return intervals.mask_windows(a1(spark, d), A.masks(spark, d), SIZE)


@query("j3_node_lookup", f"WITH {A.INDIVIDUALS}, n AS (SELECT node0 AS node FROM individuals WHERE pop = 3 UNION ALL SELECT node1 FROM individuals WHERE pop = 3), r AS (SELECT node, CAST(row_number() OVER (ORDER BY node) - 1 AS BIGINT) AS new_node FROM n) SELECT i.id, a.new_node AS new0, b.new_node AS new1 FROM individuals i JOIN r a ON a.node = i.node0 JOIN r b ON b.node = i.node1")
def j3(spark, d):
    people = A.individuals(spark, d).filter(F.col("pop") == 3)
    nodes = ordering.places(people.select(F.explode(F.array("node0", "node1")).alias("node")).distinct(), "node", "new")
    one, two = (nodes.select(F.col("node").alias(f"node{i}"), F.col("new").alias(f"new{i}")) for i in (0, 1))
    return people.join(one, "node0").join(two, "node1").select("id", "new0", "new1")


@query("p6_population_filter", f"WITH {A.INDIVIDUALS} SELECT * FROM individuals WHERE pop IN (1, 2)")
def p6(spark, d):
    return A.individuals(spark, d).filter(F.col("pop").isin(1, 2))


@query("p7_restrict_shift", f"WITH {A.CALLS}, m AS (SELECT min(pos) AS lo, max(pos) AS hi FROM calls WHERE contig = 'R') SELECT c.pos - lo AS pos, sample, a0, a1 FROM calls c, m WHERE contig = 'R' AND c.pos >= lo AND c.pos < hi")
def p7(spark, d):
    sites = A.calls(spark, d).filter(F.col("contig") == "R").drop("contig")
    ends = sites.agg(F.min("pos").alias("lo"), F.max("pos").alias("hi"))
    return sites.crossJoin(F.broadcast(ends)).filter((F.col("pos") >= F.col("lo")) & (F.col("pos") < F.col("hi"))).select((F.col("pos") - F.col("lo")).alias("pos"), "sample", "a0", "a1")


@query("p5_region_parse", r"WITH r AS (SELECT o_orderkey, 'chr' || (o_custkey % 22) || ':' || o_orderkey || '-' || (o_orderkey + 100) AS region FROM orders) SELECT o_orderkey, regexp_extract(region, '^(\w+):(\d+)-(\d+)$', 1) AS contig, CAST(regexp_extract(region, '^(\w+):(\d+)-(\d+)$', 2) AS BIGINT) AS lo, CAST(regexp_extract(region, '^(\w+):(\d+)-(\d+)$', 3) AS BIGINT) AS hi FROM r")
def p5(spark, d):
    region = F.concat(F.lit("chr"), F.col("o_custkey") % 22, F.lit(":"), "o_orderkey", F.lit("-"), F.col("o_orderkey") + 100)
    part = lambda i: F.regexp_extract("region", r"^(\w+):(\d+)-(\d+)$", i)
    rows = A.table(spark, d, "orders").select("o_orderkey", region.alias("region"))
    return rows.select("o_orderkey", part(1).alias("contig"), part(2).cast("long").alias("lo"), part(3).cast("long").alias("hi"))


@query("j12_dense_spine", f"WITH {HET}, w AS (SELECT max(win) AS m FROM het), s AS (SELECT DISTINCT contig, sample FROM het) SELECT s.contig, s.sample, CAST(r.range AS BIGINT) AS win, coalesce(n_het, CAST(0 AS BIGINT)) AS n_het FROM s CROSS JOIN (SELECT unnest(range(m + 1)) AS range FROM w) r LEFT JOIN het h ON h.contig = s.contig AND h.sample = s.sample AND h.win = r.range")
def j12(spark, d):
    return het.dense(a1(spark, d), 1, "n_het")


@query("j11_missing_samples", "SELECT CAST(c_custkey AS BIGINT) AS sample FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def j11(spark, d):
    """Samples that were asked for and are not among those of a file."""
    asked = A.table(spark, d, "customer").select(F.col("c_custkey").cast("long").alias("sample"))
    return asked.join(A.table(spark, d, "orders").select(F.col("o_custkey").alias("sample")).distinct(), "sample", "left_anti")


@query("o3_except", "SELECT CAST(p_partkey AS BIGINT) AS id FROM part EXCEPT ALL SELECT CAST(l_partkey AS BIGINT) FROM lineitem WHERE l_quantity > 45")
def o3(spark, d):
    return A.table(spark, d, "part").select(F.col("p_partkey").cast("long").alias("id")).exceptAll(A.table(spark, d, "lineitem").filter("l_quantity > 45").select(F.col("l_partkey").cast("long").alias("id")))


@query("o5_interval_subtract", f"""WITH {A.MASKS}, m1 AS (SELECT *, max(b) OVER (ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM masks),
 m2 AS (SELECT *, sum(CASE WHEN reach IS NULL OR a > reach THEN 1 ELSE 0 END) OVER (ORDER BY a, b) AS run FROM m1), m AS (SELECT min(a) AS a, max(b) AS b FROM m2 GROUP BY run),
 g AS (SELECT b AS a, lead(a) OVER (ORDER BY a) AS b FROM m UNION ALL SELECT CAST(0 AS BIGINT), min(a) FROM m),
 z AS (SELECT greatest(CAST(1000000000 AS BIGINT), max(b)) AS hi FROM masks) SELECT a, coalesce(b, hi) AS b FROM g, z WHERE a < coalesce(b, hi)""")
def o5(spark, d):
    masks = A.masks(spark, d)
    end = F.greatest(F.max("b"), F.lit(1_000_000_000).cast("long"))
    return intervals.subtract(masks.agg(F.lit(0).cast("long").alias("a"), end.alias("b")), masks)


@query("a6_chunk_size", f"WITH {A.CALLS}, l AS (SELECT contig, max(pos) + 1 AS n FROM calls GROUP BY 1) SELECT CAST(floor(min(0.2e0 * n / {SIZE})) AS BIGINT) AS chunk_size FROM l")
def a6(spark, d):
    length = A.calls(spark, d).groupBy("contig").agg((F.max("pos") + 1).alias("n"))
    return length.agg(F.floor(F.min(F.lit(0.2) * F.col("n") / SIZE)).cast("long").alias("chunk_size"))


@query("a7_total_size", f"WITH {A.CALLS}, l AS (SELECT contig, max(pos) + 1 AS n, count(DISTINCT sample) * 2 AS p FROM calls GROUP BY 1) SELECT CAST(sum(n * p) AS BIGINT) AS total FROM l")
def a7(spark, d):
    size = A.calls(spark, d).groupBy("contig").agg((F.max("pos") + 1).alias("n"), (F.count_distinct("sample") * 2).alias("p"))
    return size.agg(F.sum(F.col("n") * F.col("p")).cast("long").alias("total"))


CHUNKED = f"{A.OBS}, ks AS (SELECT unnest(range(greatest(1, CAST(ceil(windows / 25e0) AS BIGINT)))) AS k FROM ext), chunks AS (SELECT user_id, CAST(k AS BIGINT) AS k, CAST(win - k * 20 AS BIGINT) AS slot, ob FROM obs, ks WHERE win >= k * 20 AND win < k * 20 + 25)"


@query("w1_chunks", f"WITH {CHUNKED} SELECT * FROM chunks")
def w1(spark, d):
    return windows.chunks(A.observations(spark, d), ["user_id"], A.window_count(spark, d), 20, 5)


@query("b1_packed_chunks", f"WITH {CHUNKED} SELECT user_id, k, array_to_string(list(ob ORDER BY slot), ',') AS obs FROM chunks GROUP BY 1, 2")
def b1(spark, d):
    rows = windows.packed(w1(spark, d), ["user_id"], 25)
    return rows.select("user_id", "k", F.array_join(F.transform("obs", lambda x: x.cast("string")), ",").alias("obs"))


@query("a5_watterson", f"WITH {CHUNKED} SELECT round(avg(ob) / {SIZE}, 12) AS theta FROM chunks WHERE slot >= 5 AND ob >= 0")
def a5(spark, d):
    return windows.watterson(w1(spark, d), 5, SIZE).select(F.round("theta", 12).alias("theta"))


@query("w11_rle", f"WITH {A.OBS}, r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY win) - row_number() OVER (PARTITION BY user_id, ob ORDER BY win) AS g FROM obs) SELECT user_id, ob, min(win) AS start, count(*) AS n FROM r GROUP BY user_id, ob, g")
def w11(spark, d):
    return windows.run_lengths(A.observations(spark, d), "user_id")


@query("w6_change_points", f"WITH {A.OBS}, r AS (SELECT *, lag(ob) OVER (PARTITION BY user_id ORDER BY win) AS p FROM obs) SELECT user_id, win, ob FROM r WHERE p IS NULL OR p <> ob")
def w6(spark, d):
    return windows.change_points(A.observations(spark, d), "user_id", "win", "ob")


@query("w8_ema", f"WITH RECURSIVE {A.OBS}, e AS (SELECT user_id, win, CAST(ob AS DOUBLE) AS ema FROM obs WHERE win = 0 UNION ALL SELECT o.user_id, o.win, e.ema * 0.9e0 + o.ob * (1 - 0.9e0) FROM e JOIN obs o ON o.user_id = e.user_id AND o.win = e.win + 1) SELECT user_id, round(ema, 6) AS ema FROM e, ext WHERE win = windows - 1")
def w8(spark, d):
    return windows.smoothed(A.observations(spark, d), "user_id", "win", "ob").select("user_id", F.round("ema", 6).alias("ema"))


@query("s12_psmcfa_decode", f"WITH {A.OBS}, s AS (SELECT user_id, string_agg(CASE ob WHEN 1 THEN 'K' WHEN -1 THEN 'N' ELSE 'T' END, '' ORDER BY win) AS seq FROM obs GROUP BY 1) SELECT user_id, CAST(i.range AS BIGINT) AS win, CAST(CASE seq[i.range + 1] WHEN 'K' THEN 1 WHEN 'N' THEN -1 ELSE 0 END AS BIGINT) AS ob FROM s, (SELECT unnest(range(windows)) AS range FROM ext) i")
def s12(spark, d):
    from ..sources.text import decode_symbols

    symbol = F.when(F.col("ob") == 1, "K").when(F.col("ob") == -1, "N").otherwise("T")
    rows = A.observations(spark, d).groupBy("user_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("win", symbol.alias("s")))), lambda x: x["s"]), "").alias("seq"))
    return decode_symbols(rows, ["user_id"], "seq")


@query("s13_holdout", f"WITH {A.OBS}, u AS (SELECT DISTINCT user_id FROM obs) SELECT user_id, CAST(CASE WHEN user_id = (SELECT min(user_id) FROM u) THEN 1 ELSE 0 END AS BIGINT) AS held_out FROM u")
def s13(spark, d):
    from ..operators.sampling import hold_out_first

    return hold_out_first(A.observations(spark, d).select("user_id").distinct(), "user_id")


@query("t2_first_n", f"WITH {HET} SELECT * FROM het WHERE sample < 3")
def t2(spark, d):
    return a1(spark, d).filter(F.col("sample") < 3)


@query("f6_pattern_expand", "WITH p AS (SELECT o_orderkey, (o_orderkey % 5 + 1) AS n, (o_custkey % 3 + 1) AS w FROM orders) SELECT o_orderkey, CAST(n * w + 2 AS BIGINT) AS m, CAST(n + 1 AS BIGINT) AS free FROM p")
def f6(spark, d):
    pattern = F.concat((F.col("o_orderkey") % 5 + 1).cast("string"), F.lit("*"), (F.col("o_custkey") % 3 + 1).cast("string"), F.lit("+2"))
    rows = A.table(spark, d, "orders").select("o_orderkey", H.expand_pattern(pattern).alias("w"))
    return rows.select("o_orderkey", F.aggregate("w", F.lit(0).cast("long"), lambda s, x: s + x).alias("m"), F.size("w").cast("long").alias("free"))


def rounded(df: DataFrame, *names: str, digits: int = 6) -> DataFrame:
    return df.withColumns({n: F.round(n, digits) for n in names})


@query("w2_cumhaz", f"WITH {A.ETA} SELECT vec_id, i, round(h, 6) AS h FROM eta")
def w2(spark, d):
    return rounded(A.eta(spark, d).select("vec_id", "i", "h"), "h")


@query("w5_diff", f"WITH {A.ETA} SELECT vec_id, i, round(dt, 6) AS dt FROM eta WHERE dt IS NOT NULL")
def w5(spark, d):
    return rounded(A.eta(spark, d).filter("dt is not null").select("vec_id", "i", "dt"), "dt")


@query("h4_surv", f"WITH {A.ETA} SELECT vec_id, i, round(CASE WHEN dt IS NULL THEN 0e0 ELSE exp(-(h + c * dt)) END, 6) AS s FROM eta")
def h4(spark, d):
    return rounded(H.survival(A.eta(spark, d)).select("vec_id", "i", "s"), "s")


PI = "CASE WHEN dt IS NULL THEN exp(-h) ELSE exp(-h) - exp(-(h + c * dt)) END"


@query("h5_pi", f"WITH {A.ETA} SELECT vec_id, i, round({PI}, 6) AS p FROM eta")
def h5(spark, d):
    return rounded(H.piece_probability(A.eta(spark, d)).select("vec_id", "i", "p"), "p")


@query("h9_ect", f"WITH {A.ETA} SELECT vec_id, i, round(CASE WHEN dt IS NULL THEN t + 1e0 / c WHEN c * dt < 1e-4 THEN t + dt / 2 - c * dt * dt / 12 ELSE 1e0 / c + t - dt / (exp(c * dt) - 1) END, 6) AS ect FROM eta")
def h9(spark, d):
    return rounded(H.expected_time(A.eta(spark, d)).select("vec_id", "i", "ect"), "ect")


QUANTILE = "g AS (SELECT q, -ln(1 - q) AS hq FROM (VALUES (0.1e0), (0.5e0), (0.9e0)) v(q)) SELECT vec_id, q, round(t + (hq - h) / c, 6) AS x FROM eta, g WHERE h <= hq AND (dt IS NULL OR hq < h + c * dt)"


@query("h10_quantile", f"WITH {A.ETA}, {QUANTILE}")
def h10(spark, d):
    return rounded(H.quantile(A.eta(spark, d), ["vec_id"], [0.1, 0.5, 0.9]), "x")


@query("h11_balance", f"WITH {A.ETA}, g AS (SELECT r.range AS j, -ln(1 - r.range / 8e0) AS hq FROM range(0, 8) r) SELECT vec_id, CAST(j AS BIGINT) AS j, round(t + (hq - h) / c, 6) AS t, round(c, 6) AS c FROM eta, g WHERE h <= hq AND (dt IS NULL OR hq < h + c * dt)")
def h11(spark, d):
    return rounded(H.balanced(A.eta(spark, d), ["vec_id"], 8), "t", "c")


@query("h12_rescale", f"WITH {A.ETA} SELECT vec_id, i, round(t * (0.01e0 / 2 / 1.25e-8), 3) AS t, round(c / (0.01e0 / 2 / 1.25e-8), 12) AS c FROM eta")
def h12(spark, d):
    t, c = H.rescaled(F.col("t"), F.col("c"), F.lit(0.01), 1.25e-8)
    rows = H.pieces_of(A.histories(spark, d).select("vec_id", t.alias("t"), c.alias("c")), ["vec_id"])
    return rows.select("vec_id", "i", F.round("t", 3).alias("t"), F.round("c", 12).alias("c"))


@query("h13_mu", f"WITH {A.ETA} SELECT vec_id, round(sum(CASE WHEN dt IS NULL THEN exp(-h) / c ELSE exp(-h) * (1 - exp(-c * dt)) / c END), 6) AS mu FROM eta GROUP BY 1")
def h13(spark, d):
    return rounded(H.mean_time(A.eta(spark, d), ["vec_id"]), "mu")


ETJJ = "etjj AS (SELECT vec_id, CAST(k.range AS BIGINT) AS k, sum(CASE WHEN dt IS NULL THEN exp(-h * k.range * (k.range - 1) / 2e0) ELSE exp(-h * k.range * (k.range - 1) / 2e0) * (1 - exp(-c * dt * k.range * (k.range - 1) / 2e0)) END / (c * k.range * (k.range - 1) / 2e0)) AS etjj FROM eta, range(2, 9) k GROUP BY 1, 2)"


@query("h14_etjj", f"WITH {A.ETA}, {ETJJ} SELECT vec_id, k, round(etjj, 6) AS etjj FROM etjj")
def h14(spark, d):
    return rounded(H.coalescence_times(A.eta(spark, d), ["vec_id"], 8), "etjj")


def weights_sql(n: int) -> str:
    rows = ", ".join(f"({b + 1}, {j + 2}, {float(w)!r})" for b, row in enumerate(H.branch_weights(n)) for j, w in enumerate(row))
    return f"w AS (SELECT CAST(b AS BIGINT) AS b, CAST(j AS BIGINT) AS j, CAST(w AS DOUBLE) AS w FROM (VALUES {rows}) v(b, j, w))"


@query("h15_etbl", f"WITH {A.ETA}, {ETJJ}, {weights_sql(8)} SELECT vec_id, b, round(sum(etjj * w), 6) AS etbl FROM etjj JOIN w ON k = j GROUP BY 1, 2")
def h15(spark, d):
    return rounded(H.branch_lengths(A.eta(spark, d), ["vec_id"], 8), "etbl")


PAIRED = """r AS (SELECT vec_id, t, c AS c1, NULL::DOUBLE AS c2 FROM eta UNION ALL SELECT vec_id - 1, t * 1.5e0, NULL::DOUBLE, c FROM eta WHERE vec_id > 0),
 p AS (SELECT vec_id, t, max(c1) AS c1, max(c2) AS c2 FROM r GROUP BY 1, 2),
 g AS (SELECT vec_id, t, lead(t) OVER w - t AS dt, last_value(c1 IGNORE NULLS) OVER w AS c1, last_value(c2 IGNORE NULLS) OVER w AS c2 FROM p WINDOW w AS (PARTITION BY vec_id ORDER BY t)),
 k AS (SELECT * FROM g WHERE vec_id IN (SELECT vec_id - 1 FROM eta))"""


def neighbours(spark, d):
    one = A.eta(spark, d)
    two = one.filter("vec_id > 0").select((F.col("vec_id") - 1).alias("vec_id"), (F.col("t") * 1.5).alias("t"), "c")
    return one.join(two.select("vec_id").distinct(), "vec_id", "left_semi"), two


@query("h17_tv", f"""WITH {A.ETA}, {PAIRED}, a AS (SELECT *, coalesce(sum(c1 * dt) OVER o, 0e0) AS h1, coalesce(sum(c2 * dt) OVER o, 0e0) AS h2 FROM k WINDOW o AS (PARTITION BY vec_id ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
 still AS (SELECT vec_id, (ln(c1) - ln(c2) - h1 + h2) / nullif(c1 - c2, 0) AS u, t, dt, h1, h2, c1, c2 FROM a),
 gap AS (SELECT vec_id, t AS x, exp(-h1) - exp(-h2) AS g FROM a UNION ALL SELECT vec_id, t + u, exp(-h1 - c1 * u) - exp(-h2 - c2 * u) FROM still WHERE u > 0 AND (dt IS NULL OR u < dt) UNION ALL SELECT DISTINCT vec_id, 1e300, 0e0 FROM a),
 turn AS (SELECT vec_id, abs(g - lag(g) OVER (PARTITION BY vec_id ORDER BY x)) AS moved FROM gap)
 SELECT vec_id, round(sum(moved) / 2, 6) AS tv FROM turn GROUP BY 1""")
def h17(spark, d):
    return rounded(H.total_variation(*neighbours(spark, d), "vec_id"), "tv")


@query("h18_l2", f"WITH {A.ETA}, {PAIRED} SELECT vec_id, round(sqrt(sum(pow(1 / (2 * c1) - 1 / (2 * c2), 2) * least(coalesce(dt, 1e300), 10e0 - t))), 6) AS l2 FROM k WHERE t < 10 GROUP BY 1")
def h18(spark, d):
    return rounded(H.size_distance(*neighbours(spark, d), "vec_id", 10.0), "l2")


@query("o1_union_grid", f"WITH {A.ETA}, {PAIRED} SELECT vec_id, round(t, 9) AS t FROM k")
def o1(spark, d):
    return H.merged_grid(*neighbours(spark, d), "vec_id").select("vec_id", F.round("t", 9).alias("t"))


@query("s24_from_pmf", f"WITH {A.ETA} SELECT vec_id, i, round(CASE WHEN dt IS NULL THEN 1e0 ELSE c END, 6) AS c FROM eta")
def s24(spark, d):
    rows = H.piece_probability(A.eta(spark, d)).select("vec_id", "i", "t", "p")
    return rounded(H.from_probabilities(rows, ["vec_id"]).select("vec_id", "i", "c"), "c")


GRID = "x AS (SELECT 0.002e0 * pow(7000e0, r.range / 19e0) AS x FROM range(0, 20) r)"


def on_grid(spark, d):
    """Each history beside each point x. Round x in a later select: a lambda's x takes an alias x beside it."""
    grid = spark.range(1).select(F.explode(H.geomspace(0.002, 14.0, 20)).alias("x"))
    return A.histories(spark, d).crossJoin(F.broadcast(grid))  # twenty times, whatever the input


@query("j4_step_lookup", f"WITH {A.ETA}, {GRID} SELECT vec_id, round(x, 9) AS x, round(c, 6) AS c FROM x JOIN eta ON t <= x AND (dt IS NULL OR x < t + dt)")
def j4(spark, d):
    rows = on_grid(spark, d).select("vec_id", "x", H.rate_at(F.col("t"), F.col("c"), F.col("x")).alias("c"))
    return rounded(rounded(rows, "c"), "x", digits=9)


@query("h6_density", f"WITH {A.ETA}, {GRID} SELECT vec_id, round(x, 9) AS x, round(c * exp(-(h + c * (x - t))), 6) AS density, round(1 - exp(-(h + c * (x - t))), 6) AS cdf FROM x JOIN eta ON t <= x AND (dt IS NULL OR x < t + dt)")
def h6(spark, d):
    hazard = H.hazard_at(F.col("t"), F.col("c"), F.col("x"))
    rows = on_grid(spark, d).select("vec_id", "x", (H.rate_at(F.col("t"), F.col("c"), F.col("x")) * F.exp(-hazard)).alias("density"), (1 - F.exp(-hazard)).alias("cdf"))
    return rounded(rounded(rows, "density", "cdf"), "x", digits=9)


@query("k2_posterior_bands", f"WITH {A.ETA}, {GRID}, v AS (SELECT x, 1 / (2 * c) AS ne FROM x JOIN eta ON t <= x AND (dt IS NULL OR x < t + dt)) SELECT round(x, 9) AS x, round(quantile_cont(ne, 0.025e0), 6) AS lo, round(quantile_cont(ne, 0.5e0), 6) AS median, round(quantile_cont(ne, 0.975e0), 6) AS hi FROM v GROUP BY 1")
def k2(spark, d):
    rows = rounded(on_grid(spark, d).select("x", (1 / (2 * H.rate_at(F.col("t"), F.col("c"), F.col("x")))).alias("ne")), "x", digits=9)
    bands = quantiles.quantiles(rows, ["x"], "ne", [0.025, 0.5, 0.975])
    return rounded(bands.select("x", F.col("q")[0].alias("lo"), F.col("q")[1].alias("median"), F.col("q")[2].alias("hi")), "lo", "median", "hi")


@query("k4_epochs", f"WITH {A.ETA} SELECT vec_id, CAST(15 - i AS BIGINT) AS epoch, round(t, 6) AS end_time, round(1 / (2 * c), 6) AS start_size FROM eta")
def k4(spark, d):
    """Epochs as an export has them: the oldest first, of constant size."""
    rows = A.histories(spark, d).select("vec_id", F.posexplode(F.reverse(F.arrays_zip("t", "c"))).alias("epoch", "x"))
    return rounded(rows.select("vec_id", F.col("epoch").cast("long").alias("epoch"), F.col("x.t").alias("end_time"), (1 / (2 * F.col("x.c"))).alias("start_size")), "end_time", "start_size")


@query("m9_log_prior", f"WITH {A.ETA}, l AS (SELECT vec_id, ln(c) - lag(ln(c)) OVER (PARTITION BY vec_id ORDER BY i) AS g FROM eta), s AS (SELECT vec_id, sum(g * g) AS s FROM l GROUP BY 1), z AS (SELECT vec_id, ln(0.1e0 + 9.9e0 / (1 + exp(-CAST(embedding[18] AS DOUBLE)))) AS r FROM embeddings) SELECT vec_id, round(-0.5e0 * r * r - 0.5e0 * ln(2 * pi()) - 0.1e0 * s, 6) AS log_prior FROM s JOIN z USING (vec_id)")
def m9(spark, d):
    c = F.transform(F.slice("embedding", 1, 16), lambda x: F.log(F.log1p(F.exp(x.cast("double")))))
    gaps = F.zip_with(F.slice(c, 2, 15), F.slice(c, 1, 15), lambda a, b: (a - b) * (a - b))
    r = F.log(F.lit(0.1) + F.lit(9.9) / (1 + F.exp(-F.element_at("embedding", 18).cast("double"))))
    value = -0.5 * r * r - 0.5 * F.log(2 * F.pi()) - 0.1 * F.aggregate(gaps, F.lit(0.0), lambda s, x: s + x)
    return A.table(spark, d, "embeddings").select("vec_id", F.round(value, 6).alias("log_prior"))


@query("m2_to_history", "SELECT vec_id, CAST(r.range AS BIGINT) AS i, round(CASE WHEN r.range = 0 THEN 0e0 ELSE exp(CAST(embedding[1] AS DOUBLE)) * pow(1 + exp(CAST(embedding[2] AS DOUBLE)) / exp(CAST(embedding[1] AS DOUBLE)), (r.range - 1) / 14e0) END, 6) AS t, round(ln(1 + exp(CAST(embedding[least(r.range, 14) + 3] AS DOUBLE))), 6) AS c FROM embeddings, range(16) r")
def m2(spark, d):
    """Particles to histories: times between their first two numbers, rates tied by the pattern 14*1+1*2."""
    e = lambda i: F.element_at("embedding", i).cast("double")
    t1, rest = F.exp(e(1)), F.exp(e(2))
    index = F.sequence(F.lit(0), F.lit(15))
    t = F.transform(index, lambda i: F.when(i == 0, 0.0).otherwise(t1 * F.pow(1 + rest / t1, (i - 1) / F.lit(14.0))))
    c = F.transform(index, lambda i: F.log1p(F.exp(F.element_at("embedding", F.least(i, F.lit(14)) + 3).cast("double"))))
    rows = A.table(spark, d, "embeddings").select("vec_id", t.alias("t"), c.alias("c"))
    return rounded(H.pieces_of(rows, ["vec_id"]).select("vec_id", "i", "t", "c"), "t", "c")


@query("h21_invert_hazard", f"WITH {A.ETA} SELECT vec_id, i, round(h, 6) AS x, round(1 / c, 6) AS slope, round(t, 6) AS y FROM eta")
def h21(spark, d):
    """The inverse of the cumulative hazard, a piecewise-linear function: axes exchanged."""
    rows = A.eta(spark, d).select("vec_id", "i", F.col("h").alias("x"), (1 / F.col("c")).alias("slope"), F.col("t").alias("y"))
    return rounded(rows, "x", "slope", "y")


def packed_users(spark, d):
    rows = A.observations(spark, d).withColumn("k", F.lit(0).cast("long")).withColumnRenamed("win", "slot")
    return windows.packed(rows, ["user_id"], A.window_count(spark, d))


@query("m12_stein_fit")
def m12(spark, d):
    """A short fit, of sixty particles and twelve steps, over every user's chunks; a whole one has 500 and 1000."""
    from ..operators import fit

    chunks = windows.packed(w1(spark, d), ["user_id"], 25)
    theta = max(a5(spark, d).first().theta or 0.0, 1e-6) * SIZE
    return fit.posterior(spark, fit.fit(chunks, theta, 5, particles=60, iterations=12), theta)


@query("m15_simultaneous_band", f"""WITH {A.ETA}, {GRID}, v AS (SELECT vec_id AS particle, round(x, 9) AS x, 1 / (2 * c) AS value FROM x JOIN eta ON t <= x AND (dt IS NULL OR x < t + dt)),
 r AS (SELECT *, row_number() OVER (PARTITION BY x ORDER BY value, particle) AS nth, count(*) OVER (PARTITION BY x) AS n FROM v),
 e AS (SELECT particle, min(least(nth, n - nth + 1)) AS depth, sum(least(nth, n - nth + 1)) AS total FROM r GROUP BY 1),
 p AS (SELECT particle, percent_rank() OVER (ORDER BY depth DESC, total DESC, particle) AS place FROM e)
 SELECT x, round(min(value), 6) AS lo, round(max(value), 6) AS hi FROM v JOIN p USING (particle) WHERE place <= 0.95e0 GROUP BY x""")
def m15(spark, d):
    from ..operators.fit import simultaneous_band

    value = 1 / (2 * H.rate_at(F.col("t"), F.col("c"), F.col("x")))
    curves = on_grid(spark, d).select(F.col("vec_id").alias("particle"), "x", value.alias("value"))
    return rounded(simultaneous_band(rounded(curves, "x", digits=9)), "lo", "hi")
