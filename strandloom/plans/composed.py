"""Registered queries that compose sources, chunks, model and summaries."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..functions import history as H
from ..functions import hmm
from ..operators import coalescent, posterior, quantiles, scan
from ..operators.fit import likelihoods
from ..sources import adapters as A
from ..sources import contigs as C
from ..sources import text
from .model import CUBIC, ON_GRID, polynomials, steps_sql, transition_sql
from .queries import GRID, SIZE, on_grid, packed_users, rounded
from .registry import query

NAMES = [str(i) for i in range(1, A.SAMPLES + 1)]


def region_contig(spark, d, contig: str) -> C.CallsContig:
    """A contig's calls from its first site, left out, to its last."""
    calls = A.calls(spark, d).filter(F.col("contig") == contig).withColumn("sample", F.col("sample").cast("string"))
    ends = calls.agg(F.min("pos").alias("lo"), F.max("pos").alias("hi")).first()
    return C.CallsContig(calls.filter((F.col("pos") > ends.lo) & (F.col("pos") <= ends.hi)), NAMES, ends.lo, ends.hi, contig)


REGION = f"{A.CALLS}, n AS (SELECT min(pos) AS lo, (max(pos) - min(pos) + 1) // {SIZE} AS w FROM calls WHERE contig = 'R'), met AS (SELECT calls.*, lo, w FROM calls, n WHERE contig = 'R' AND pos > lo)"


@query("s4_region_windows", f"""WITH {REGION}, seen AS (SELECT sample, least((pos - lo) // {SIZE}, w - 1) AS win, max(CASE WHEN a0 <> a1 THEN 1 ELSE 0 END) AS ob FROM met GROUP BY 1, 2),
 spine AS (SELECT CAST(s.range AS BIGINT) AS sample, unnest(range(w)) AS win FROM n, range(1, {A.SAMPLES + 1}) s)
 SELECT CAST(spine.sample AS VARCHAR) AS sample, CAST(spine.win AS BIGINT) AS win, CAST(coalesce(ob, 0) AS BIGINT) AS ob FROM spine LEFT JOIN seen ON seen.sample = spine.sample AND seen.win = spine.win""")
def s4(spark, d):
    """What a region shows in windows: the origin shifted, the last window taking the rest, windows without a site filled."""
    return region_contig(spark, d, "R").observe(SIZE).het.select("sample", "win", "ob")


@query("s4_region_spectrum", f"WITH {REGION}, nd AS (SELECT pos, CAST(sum(a0 + a1) AS BIGINT) AS k FROM met GROUP BY 1) SELECT k, count(*) AS n_sites FROM nd WHERE k BETWEEN 1 AND {A.PLOIDS - 1} GROUP BY 1")
def s4_spectrum(spark, d):
    return region_contig(spark, d, "R").observe(SIZE).spectrum


@query("s6_header_lengths", f"WITH {A.CALLS} SELECT contig, max(pos) AS length FROM calls GROUP BY 1")
def s6(spark, d):
    """Contigs and lengths read from the header lines of a call file."""
    ends = A.calls(spark, d).groupBy("contig").agg(F.max("pos").alias("n"))
    return text.header_lengths(ends.select(F.concat(F.lit("##contig=<ID="), "contig", F.lit(",length="), "n", F.lit(",assembly=x>")).alias("value")))


PAIRS = [(2, 5), (4, 3), (6, 9), (2, 11)]


def pairs_contig(spark, d) -> C.PairsContig:
    """Pairs of nodes that are not one sample's, on a contig with masks."""
    calls = A.calls(spark, d).filter(F.col("contig") == "R")
    sides = F.array(*[F.struct((2 * F.col("sample") + i).alias("node"), F.col(f"a{i}").alias("allele")) for i in (0, 1)])
    end = calls.agg(F.max("pos").alias("hi")).first().hi
    return C.PairsContig(calls.select("pos", F.inline(sides)), PAIRS, end + 1, A.masks(spark, d), "R")


NODES = f"""{A.CALLS}, {A.MASKS}, g AS (SELECT pos, 2 * sample AS node, a0 AS allele FROM calls WHERE contig = 'R' UNION ALL SELECT pos, 2 * sample + 1, a1 FROM calls WHERE contig = 'R'),
 pairs AS (SELECT * FROM (VALUES {", ".join(f"('{i}', {a}, {b})" for i, (a, b) in enumerate(PAIRS))}) v(pair, n0, n1))"""


@query("s8_masked_windows", f"""WITH {NODES}, seen AS (SELECT pair, x.pos // {SIZE} AS win, count(*) FILTER (x.allele <> y.allele) AS ob FROM pairs JOIN g x ON x.node = n0 JOIN g y ON y.node = n1 AND y.pos = x.pos GROUP BY 1, 2),
 spine AS (SELECT pair, unnest(range((SELECT max(pos) FROM g) // {SIZE} + 1)) AS win FROM pairs), hit AS (SELECT DISTINCT unnest(range(a // {SIZE}, (b - 1) // {SIZE} + 1)) AS win FROM masks WHERE a < b)
 SELECT s.pair AS sample, CAST(s.win AS BIGINT) AS win, CAST(CASE WHEN hit.win IS NOT NULL THEN -1 ELSE coalesce(ob, 0) END AS BIGINT) AS ob FROM spine s LEFT JOIN seen ON seen.pair = s.pair AND seen.win = s.win LEFT JOIN hit ON hit.win = s.win""")
def s8(spark, d):
    return pairs_contig(spark, d).observe(SIZE).het.select("sample", "win", "ob")


@query("s8_masked_spectrum", f"""WITH {NODES}, k AS (SELECT pos, count(DISTINCT node) AS k FROM g WHERE allele > 0 AND node IN (SELECT n0 FROM pairs UNION SELECT n1 FROM pairs) GROUP BY 1)
 SELECT k, count(*) AS n_sites FROM k WHERE k < {len({x for p in PAIRS for x in p})} AND NOT EXISTS (SELECT 1 FROM masks WHERE pos >= a AND pos < b) GROUP BY 1""")
def s8_spectrum(spark, d):
    return pairs_contig(spark, d).observe(SIZE).spectrum


PARTICLES = """particles AS (SELECT vec_id, CAST(r.range AS BIGINT) AS i, CASE WHEN r.range = 0 THEN 0e0 ELSE exp(CAST(embedding[1] AS DOUBLE)) * pow(1 + exp(CAST(embedding[2] AS DOUBLE)) / exp(CAST(embedding[1] AS DOUBLE)), (r.range - 1) / 14e0) END AS t,
  ln(1 + exp(CAST(embedding[least(r.range, 14) + 3] AS DOUBLE))) AS c FROM embeddings, range(16) r)"""


@query("k2_posterior_on_own_grid", f"""WITH {PARTICLES}, ends AS (SELECT quantile_cont(t, 0.025e0) AS lo, quantile_cont(t, 0.975e0) AS hi FROM particles WHERE i > 0), grid AS (SELECT CAST(r.range AS BIGINT) AS k, lo * pow(hi / lo, r.range / 999e0) AS x FROM ends, range(1000) r),
 h AS (SELECT *, lead(t) OVER (PARTITION BY vec_id ORDER BY i) AS nxt FROM particles), v AS (SELECT k, x, 1 / (2 * c) AS ne FROM grid JOIN h ON x >= t AND (nxt IS NULL OR x < nxt))
 SELECT k, round(x, 6) AS x, round(quantile_cont(ne, 0.5e0), 6) AS median, round(quantile_cont(ne, 0.025e0), 6) AS lo, round(quantile_cont(ne, 0.975e0), 6) AS hi FROM v GROUP BY k, x""")
def k2(spark, d):
    """Median and band of all particles' sizes at a thousand times between the outer 2.5 % of theirs."""
    e = lambda i: F.element_at("embedding", i).cast("double")
    index = F.sequence(F.lit(0), F.lit(15))
    t = F.transform(index, lambda i: F.when(i == 0, 0.0).otherwise(F.exp(e(1)) * F.pow(1 + F.exp(e(2)) / F.exp(e(1)), (i - 1) / F.lit(14.0))))
    c = F.transform(index, lambda i: F.log1p(F.exp(F.element_at("embedding", F.least(i, F.lit(14)) + 3).cast("double"))))
    return rounded(posterior.bands(A.table(spark, d, "embeddings").select(t.alias("t"), c.alias("c"))), "x", "median", "lo", "hi")


@query("k5_live_summary", f"""WITH {PARTICLES}, ends AS (SELECT min(t) FILTER (i = 1) AS lo, max(t) FILTER (i = 15) AS hi FROM particles), grid AS (SELECT CAST(r.range AS BIGINT) AS k, lo * pow(hi / lo, r.range / 999e0) AS x FROM ends, range(1000) r),
 h AS (SELECT *, lead(t) OVER (PARTITION BY vec_id ORDER BY i) AS nxt FROM particles), v AS (SELECT k, x, 1 / (2 * c) AS ne FROM grid JOIN h ON x >= t AND (nxt IS NULL OR x < nxt) WHERE c > 0.1e0)
 SELECT k, count(*) AS finite, round(quantile_cont(ne, 0.025e0), 6) AS lo, round(quantile_cont(ne, 0.5e0), 6) AS median, round(quantile_cont(ne, 0.975e0), 6) AS hi FROM v GROUP BY k""")
def k5(spark, d):
    """Bands of one iteration's particles at a thousand times from their first to their last; rates near zero have no size and are passed over."""
    e = lambda i: F.element_at("embedding", i).cast("double")
    first, last = F.exp(e(1)), F.exp(e(1)) * (1 + F.exp(e(2)) / F.exp(e(1)))
    rows = A.table(spark, d, "embeddings").select(first.alias("first"), (F.exp(e(2)) / F.exp(e(1))).alias("ratio"), last.alias("last"), F.slice("embedding", 3, 15).alias("free"))
    ends = rows.agg(F.min("first").alias("lo"), F.max("last").alias("hi"))
    points = F.transform(F.sequence(F.lit(0), F.lit(999)), lambda i: F.col("lo") * F.pow(F.col("hi") / F.col("lo"), i / F.lit(999.0)))
    grid = ends.select(F.posexplode(points).alias("k", "x"))
    index = F.sequence(F.lit(0), F.lit(15))
    t = F.transform(index, lambda i: F.when(i == 0, 0.0).otherwise(F.col("first") * F.pow(1 + F.col("ratio"), (i - 1) / F.lit(14.0))))
    c = F.transform(index, lambda i: F.log1p(F.exp(F.element_at("free", F.least(i, F.lit(14)) + 1).cast("double"))))
    curves = rows.select(t.alias("t"), c.alias("c")).crossJoin(F.broadcast(grid))  # a thousand times, whatever the input
    rate = H.rate_at(F.col("t"), F.col("c"), F.col("x"))
    sizes = curves.select(F.col("k").cast("long").alias("k"), F.when(rate > 0.1, 1 / (2 * rate)).alias("ne"))
    found = quantiles.quantiles(sizes, ["k"], "ne", [0.025, 0.5, 0.975])
    return rounded(found.select("k", F.col("n").alias("finite"), F.col("q")[0].alias("lo"), F.col("q")[1].alias("median"), F.col("q")[2].alias("hi")), "lo", "median", "hi")


@query("h21_inverse_at", f"WITH {A.ETA}, y AS (SELECT (r.range - 4) / 4e0 AS y FROM range(20) r) SELECT vec_id, y, round(CASE WHEN y >= 0 THEN t + (y - h) / c END, 6) AS x FROM y JOIN eta ON (h <= y AND (dt IS NULL OR y < h + c * dt)) OR (y < 0 AND i = 0)")
def h21(spark, d):
    """Where a history's hazard reaches y; no number below zero."""
    y = F.explode(F.transform(F.sequence(F.lit(0), F.lit(19)), lambda r: (r - 4) / F.lit(4.0)))
    rows = A.histories(spark, d).select("vec_id", "t", "c", y.alias("y")).withColumn("x", H.hazard_inverse_at(F.col("t"), F.col("c"), F.col("y")))
    return rows.select("vec_id", "y", F.round(F.when(~F.isnan("x"), F.col("x")), 6).alias("x"))


@query("h13_mu_until", f"WITH {A.ETA}, {GRID} SELECT vec_id, round(x, 9) AS x, round(sum(exp(-h) * (1 - exp(-c * least(coalesce(dt, x - t), x - t))) / c), 6) AS mu FROM x JOIN eta ON t < x GROUP BY vec_id, x.x")
def h13(spark, d):
    rows = on_grid(spark, d).select("vec_id", "x", H.mean_time_until(F.col("t"), F.col("c"), F.col("x")).alias("mu"))
    return rounded(rounded(rows, "mu"), "x", digits=9)


@query("h12_rescale_rates", "SELECT vec_id, 1.25e-8 AS theta, round((0.1e0 + 9.9e0 / (1 + exp(-CAST(embedding[18] AS DOUBLE)))) * 0.01e0 / (0.01e0 / 2 / 1.25e-8), 15) AS rho FROM embeddings")
def h12(spark, d):
    rho = (0.1 + 9.9 / (1 + F.exp(-F.element_at("embedding", 18).cast("double")))) * 0.01
    theta, rate = H.rescaled_rates(F.lit(0.01), rho, 1.25e-8)
    return A.table(spark, d, "embeddings").select("vec_id", theta.alias("theta"), F.round(rate, 15).alias("rho"))


@query("h20_derivative", f"WITH {ON_GRID}, p AS (SELECT met.vec_id, x, x - t AS u, {CUBIC} FROM met JOIN embeddings e ON e.vec_id = met.vec_id) SELECT vec_id, round(x, 9) AS x, round((3 * a0 * u + 2 * a1) * u + a2, 4) AS slope FROM p")
def h20(spark, d):
    rows = on_grid(spark, d).join(polynomials(spark, d), F.col("vec_id") == F.col("_id"))
    values = rows.select("vec_id", "x", H.polynomial_at(F.col("t"), F.transform("a", H.derivative), F.col("x")).alias("slope"))
    return rounded(rounded(values, "slope", digits=4), "x", digits=9)


@query("s23_exponential_grid", "SELECT o_orderkey, CAST(r.range AS BIGINT) AS i, round(-ln(1 - r.range / (o_custkey % 15 + 2)::DOUBLE), 6) AS t FROM orders, range(17) r WHERE r.range < o_custkey % 15 + 2")
def s23(spark, d):
    grid = H.exponential_grid(F.col("o_custkey") % 15 + 2)
    return A.table(spark, d, "orders").select("o_orderkey", F.posexplode(grid).alias("i", "t")).select("o_orderkey", F.col("i").cast("long").alias("i"), F.round(F.col("t") + 0.0, 6).alias("t"))


@query("s23_pattern_grid", "SELECT o_orderkey, CAST(r.range AS BIGINT) AS i, round(CASE WHEN r.range = 0 THEN 0e0 ELSE 1e-3 * pow(15000e0, (r.range - 1) / (o_custkey % 5 + 2)::DOUBLE) END, 6) AS t FROM orders, range(8) r WHERE r.range < o_custkey % 5 + 4")
def s23_pattern(spark, d):
    pattern = F.concat((F.col("o_custkey") % 5 + 2).cast("string"), F.lit("*1+1*2"))
    rows = A.table(spark, d, "orders").select("o_orderkey", F.posexplode(H.pattern_grid(pattern)).alias("i", "t"))
    return rounded(rows.select("o_orderkey", F.col("i").cast("long").alias("i"), "t"), "t")


AT, APART = 1.0, 0.5
POINTS = [0.05 + 0.25 * k for k in range(12)]


@query("m5_conditional_density", f"""WITH RECURSIVE {A.ETA}, pts AS (SELECT CAST(r.range AS BIGINT) AS k, CASE WHEN r.range = 12 THEN {AT!r} ELSE 0.05e0 + 0.25e0 * r.range END AS x FROM range(13) r),
 legs AS (SELECT vec_id, k, i, greatest(least(coalesce(t + dt, x), x) - t, 0e0) * {APART!r} AS r, greatest(least(coalesce(t + dt, x), x) - t, 0e0) * c AS q FROM eta, pts), {steps_sql("legs", "vec_id, k, i, q")},
 f AS (SELECT DISTINCT vec_id, k, CAST(0 AS BIGINT) AS i, 1e0 AS f0, 0e0 AS f1, 0e0 AS h FROM legs UNION ALL SELECT f.vec_id, f.k, f.i + 1, f0 * s00 + f1 * s10, f0 * s01 + f1 * s11, h + q FROM f JOIN gen ON gen.vec_id = f.vec_id AND gen.k = f.k AND gen.i = f.i),
 z AS (SELECT * FROM f WHERE i = {A.EPOCHS}) SELECT z.vec_id, z.k, round(c * CASE WHEN x < {AT!r} THEN z.f1 ELSE s.f1 * exp(s.h - z.h) END, 6) AS density, round(s.f0, 6) AS atom
 FROM z JOIN pts USING (k) JOIN z s ON s.vec_id = z.vec_id AND s.k = 12 JOIN eta ON eta.vec_id = z.vec_id AND eta.t <= x AND (dt IS NULL OR x < eta.t + dt) WHERE z.k < 12""")
def m5(spark, d):
    """The density of the event time where it is one at a distance of a half, and the chance that it stays."""
    return rounded(coalescent.revisits(A.histories(spark, d), "vec_id", AT, APART, np.array(POINTS)), "density", "atom")


FORWARD = f"""WITH RECURSIVE {A.OBS}, e0 AS (SELECT 0 AS vec_id, CAST(r.range AS BIGINT) AS i, CASE WHEN r.range = 0 THEN 0e0 ELSE 1e-3 * pow(15000e0, (r.range - 1) / 14e0) END AS t, 1e0 AS c FROM range(16) r),
 one AS (SELECT *, lead(t) OVER (ORDER BY i) - t AS dt, t AS h FROM e0), {transition_sql("one")},
 cols AS (SELECT j, list(p ORDER BY i) AS col FROM a GROUP BY 1), tab AS (SELECT list(col ORDER BY j) AS cols FROM cols),
 vec AS (SELECT list(exp(-0.01e0 * e) ORDER BY i) AS miss, list(exp(-h) - CASE WHEN dt IS NULL THEN 0e0 ELSE exp(-h - c * dt) END ORDER BY i) AS pi FROM ect),
 fwd AS (SELECT DISTINCT user_id, CAST(0 AS BIGINT) AS win, pi AS alpha, 0e0 AS ll FROM obs, vec UNION ALL
  SELECT user_id, win + 1, list_transform(x, lambda v: v / list_sum(x)), ll + ln(list_sum(x)) FROM (SELECT fwd.user_id, fwd.win, ll,
   list_transform(range(1, 17), lambda j: list_dot_product(alpha, cols[j]) * CASE ob WHEN 0 THEN miss[j] WHEN 1 THEN 1 - miss[j] ELSE 1e0 END) AS x FROM fwd JOIN obs ON obs.user_id = fwd.user_id AND obs.win = fwd.win, tab, vec) y)"""


@query("m7_forward_likelihood", f"{FORWARD} SELECT user_id, round(ll, 6) AS ll FROM fwd, ext WHERE win = windows")
def m7(spark, d):
    """The log-likelihood of each user's windows under the default history."""
    one = np.array([1e-2])
    return rounded(likelihoods(packed_users(spark, d), (*hmm.default_history(), one, one), "user_id"), "ll")


EXCHANGE = 0.3  # migration to and from either population
TIMES = [0.002 * 7000 ** (k / 19) for k in range(20)]
#: Populations of one size with equal migration: lineages are together or apart, two states whose exponential is closed.
TOGETHER = f"""{A.ETA}, legs AS (SELECT vec_id, k.range AS j, i, c, {{span}} AS d FROM eta, {{points}} k),
 e AS (SELECT vec_id, j, i, c, exp((s + g) * d) AS hi, exp((s - g) * d) AS lo, g FROM (SELECT *, -(4 * {EXCHANGE!r} + c) / 2 AS s, sqrt(c * c / 4 + 4 * {EXCHANGE!r} * {EXCHANGE!r}) AS g FROM legs) z),
 w AS MATERIALIZED (SELECT vec_id, j, i, c, (hi + lo) / 2 - (hi - lo) / (2 * g) * c / 2 AS tt, (hi - lo) / (2 * g) * 2 * {EXCHANGE!r} AS ta, (hi + lo) / 2 + (hi - lo) / (2 * g) * c / 2 AS aa FROM e),
 f AS (SELECT DISTINCT vec_id, j, CAST(0 AS BIGINT) AS i, 0e0 AS p, 1e0 AS a FROM legs UNION ALL SELECT f.vec_id, f.j, f.i + 1, p * tt + a * ta, p * ta + a * aa FROM f JOIN w ON w.vec_id = f.vec_id AND w.j = f.j AND w.i = f.i)"""


def exchanging(spark, d):
    """Two populations with the sizes of each history, and lineages that migrate."""
    move = F.transform("c", lambda x: F.lit(EXCHANGE))
    return A.histories(spark, d).select("vec_id", "t", F.col("c").alias("c1"), F.col("c").alias("c2"), move.alias("m12"), move.alias("m21"))


@query("s20_two_populations", f"""WITH RECURSIVE {TOGETHER.format(span="greatest(least(coalesce(t + dt, 1e9), 0.002e0 * pow(7000e0, k.range / 19e0)) - t, 0e0)", points="range(20)")}
 SELECT f.vec_id, f.j, round(eta.c * p / (p + a), 6) AS rate, round(p + a, 6) AS alive FROM f JOIN eta ON eta.vec_id = f.vec_id AND f.i = {A.EPOCHS} AND t <= 0.002e0 * pow(7000e0, j / 19e0) AND (dt IS NULL OR 0.002e0 * pow(7000e0, j / 19e0) < t + dt)""")
def s20_two(spark, d):
    """The rate at which lineages of two populations coalesce, along a geometric grid."""
    return rounded(coalescent.pair_rates(exchanging(spark, d), "vec_id", np.array(TIMES)), "rate", "alive")


@query("s21_two_populations", f"""WITH RECURSIVE {TOGETHER.format(span="coalesce(dt, 0e0)", points="range(1)")}, n AS (SELECT f.vec_id, f.i, eta.c, f.p, f.a, eta.dt, lead(f.p) OVER o AS p1, lead(f.a) OVER o AS a1 FROM f JOIN eta ON eta.vec_id = f.vec_id AND eta.i = f.i WINDOW o AS (PARTITION BY f.vec_id ORDER BY f.i))
 SELECT vec_id, round(sum((p - CASE WHEN dt IS NULL THEN 0e0 ELSE p1 END) * 2 / c + (a - CASE WHEN dt IS NULL THEN 0e0 ELSE a1 END) * (2 / c + 1 / (2 * {EXCHANGE!r}))) / 2, 6) AS n0 FROM n GROUP BY 1""")
def s21_two(spark, d):
    """Half of the mean time at which lineages of two populations coalesce."""
    found = coalescent.pair_mean_times(exchanging(spark, d), "vec_id")
    return found.select("vec_id", F.round(F.col("mean") / 2, 6).alias("n0"))


SCAN_BLOCK = 16


@query("w7_forward_scan", f"{FORWARD} SELECT user_id, (win - 1) // {SCAN_BLOCK} AS b, round(ll, 6) AS ll FROM fwd, ext WHERE win > 0 AND (win = windows OR win % {SCAN_BLOCK} = 0)")
def w7_scan(spark, d):
    """The log-likelihood of each user's windows up to the end of each block, blocks being multiplied apart and then joined."""
    one = np.array([1e-2])
    tables = hmm.tables_of(*hmm.default_history(), one, one)
    found = scan.forward(A.observations(spark, d), "user_id", tables, SCAN_BLOCK)
    return rounded(found.select("user_id", "b", "ll"), "ll")


@query("u1_fit_contigs")
def u1(spark, d):
    """From the calls of three contigs to posterior histories: sixty particles and ten steps; a whole fit has 500 and 1000."""
    return posterior.fit(spark, [region_contig(spark, d, c) for c in ("A", "N", "R")], niter=10, particles=60, window=SIZE, overlap=2, mutation_rate=1.25e-8)
