"""Registered queries of the model's parts, sources in text form, polynomials and control."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import history as H
from ..operators import coalescent, sampling, spectra, windows
from ..sources import adapters as A
from ..sources import text
from .queries import CHUNKED, FOLD, GRID, a1, af1, HET, on_grid, rounded, w1, weights_sql
from .registry import query



def transition_sql(pieces: str = "eta", rho: float = 1e-2) -> str:
    """ect, gen, f and a(vec_id, i, j, p): transition matrices of pieces(vec_id, i, t, dt, c, h), stepped through from boundary to expected time."""
    return f"""ect AS MATERIALIZED (SELECT *, greatest(CASE WHEN dt IS NULL THEN t + 1 / c WHEN c > 100 THEN t WHEN c * dt < 1e-6 THEN t + dt / 2 ELSE 1 / c + t - dt / (2 * exp(c * dt / 2) * sinh(c * dt / 2)) END, 1e-20) AS e FROM {pieces}),
 legs AS (SELECT vec_id, 2 * i AS s, 2 * (e - t) * {rho!r} AS r, (e - t) * c AS q FROM ect UNION ALL SELECT vec_id, 2 * i + 1, 2 * (t + dt - e) * {rho!r}, (t + dt - e) * c FROM ect WHERE dt IS NOT NULL),
 {steps_sql("legs", "vec_id, s")},
 f AS (SELECT DISTINCT vec_id, CAST(0 AS BIGINT) AS s, 1e0 AS f0, 0e0 AS f1, 0e0 AS f2 FROM ect UNION ALL
  SELECT f.vec_id, f.s + 1, f0 * s00 + f1 * s10, f0 * s01 + f1 * s11, f0 * greatest(1 - s00 - s01, 0e0) + f1 * greatest(1 - s10 - s11, 0e0) + f2 FROM f JOIN gen ON gen.vec_id = f.vec_id AND gen.s = f.s),
 p0 AS (SELECT ect.vec_id, i, m.f0 + m.f1 * (1 - CASE WHEN dt IS NULL THEN 0e0 ELSE exp(-(t + dt - e) * c) END) + m.f2 - b.f2 AS own, CASE WHEN dt IS NULL THEN 1e0 ELSE coalesce(n.f2, 1e0) END - b.f2 AS low,
   least(greatest(m.f1 * CASE WHEN dt IS NULL THEN 0e0 ELSE exp(-(t + dt - e) * c) END, 1e-8), 1 - 1e-8) AS past, CASE WHEN dt IS NULL THEN 0e0 ELSE exp(-dt * c) END AS stay
  FROM ect JOIN f b ON b.vec_id = ect.vec_id AND b.s = 2 * i JOIN f m ON m.vec_id = ect.vec_id AND m.s = 2 * i + 1 LEFT JOIN f n ON n.vec_id = ect.vec_id AND n.s = 2 * i + 2),
 p1 AS MATERIALIZED (SELECT *, sum(ln(least(greatest(stay, 1e-8), 1 - 1e-8))) OVER (PARTITION BY vec_id ORDER BY i) AS upto, least(greatest(1 - stay, 1e-8), 1 - 1e-8) AS go FROM p0),
 a AS MATERIALIZED (SELECT x.vec_id, x.i, y.i AS j, CASE WHEN y.i < x.i THEN y.low WHEN y.i = x.i THEN x.own ELSE x.past * exp(coalesce(z.upto, 0e0) - x.upto) * y.go END AS p
  FROM p1 x JOIN p1 y ON y.vec_id = x.vec_id LEFT JOIN p1 z ON z.vec_id = y.vec_id AND z.i = y.i - 1)"""


def steps_sql(legs: str, keys: str) -> str:
    """gen(keys, s00, s01, s10, s11): the exponential of [[-r, r], [q, -2 q]] for each of legs(keys, r, q)."""
    return f"""g0 AS (SELECT {keys}, r, q, (r + 2 * q) / 2 AS half, sqrt(greatest((r + 2 * q) * (r + 2 * q) / 4 - r * q, 0e0)) AS gap FROM {legs}),
 g1 AS (SELECT *, exp(-r * q / greatest(half + gap, 1e-300)) AS top, (1 + exp(-2 * gap)) / 2 AS even, CASE WHEN gap < 1e-9 THEN 1e0 ELSE exp(-gap) * sinh(gap) / gap END AS odd FROM g0),
 gen AS MATERIALIZED (SELECT {keys}, top * (even + (half - r) * odd) AS s00, top * r * odd AS s01, top * q * odd AS s10, top * (even + (half - 2 * q) * odd) AS s11 FROM g1)"""


ON_GRID = f"{A.ETA}, {GRID}, met AS (SELECT vec_id, i, x, t, c, h FROM x JOIN eta ON t <= x AND (dt IS NULL OR x < t + dt))"


@query("k6_vcf_lines", f"WITH {A.CALLS} SELECT contig || chr(9) || pos || chr(9) || concat_ws(chr(9), '.', 'A', 'T', '.', 'PASS', '.', 'GT') || chr(9) || string_agg(a0 || '|' || a1, chr(9) ORDER BY sample) AS value FROM calls GROUP BY contig, pos")
def k6(spark, d):
    return text.vcf_lines(A.calls(spark, d))


@query("s14_simulated_parse", f"WITH {A.CALLS} SELECT pos + 1 AS pos, CAST(s.range AS BIGINT) AS sample, CAST(CASE s.range WHEN 0 THEN a0 ELSE 1 - a0 END AS INTEGER) AS a0, CAST(a1 AS INTEGER) AS a1 FROM calls, range(2) s")
def s14(spark, d):
    """Each call written as a simulator's line of four haplotypes and read again."""
    line = F.concat_ws(" ", F.concat("pos", F.lit(".7")), F.lit("0.1"), "a0", "a1", 1 - F.col("a0"), "a1")
    return text.parse_simulated(A.calls(spark, d).select(line.alias("value")))


@query("s21_half_mean_time", f"WITH {A.ETA} SELECT vec_id, round(sum(CASE WHEN dt IS NULL THEN exp(-h) / c ELSE exp(-h) * (1 - exp(-c * dt)) / c END) / 2, 6) AS n0 FROM eta GROUP BY 1")
def s21(spark, d):
    return H.mean_time(A.eta(spark, d), ["vec_id"]).select("vec_id", F.round(F.col("mu") / 2, 6).alias("n0"))


@query("s22_from_trajectory", f"WITH {ON_GRID}, p AS (SELECT *, lag(c) OVER (PARTITION BY vec_id ORDER BY x) AS before FROM met) SELECT vec_id, round(x, 9) AS t, round(c, 6) AS c FROM p WHERE before IS NULL OR before <> c")
def s22(spark, d):
    rows = on_grid(spark, d).select("vec_id", "x", (1 / (2 * H.rate_at(F.col("t"), F.col("c"), F.col("x")))).alias("ne"))
    found = H.from_trajectory(rows, "vec_id")
    return found.select("vec_id", F.round("t", 9).alias("t"), F.round("c", 6).alias("c"))


@query("k3_step_points", f"WITH {A.ETA} SELECT vec_id, round(t, 6) AS x, round(1 / (2 * c), 6) AS y FROM eta UNION ALL SELECT vec_id, round(t + dt, 6), round(1 / (2 * c), 6) FROM eta WHERE dt IS NOT NULL")
def k3(spark, d):
    return rounded(H.step_points(A.eta(spark, d), ["vec_id"]), "x", "y")


@query("p2_clip", f"WITH {HET} SELECT contig, sample, win, CAST(greatest(-1, least(1, n_het)) AS BIGINT) AS ob FROM het")
def p2(spark, d):
    return a1(spark, d).select("contig", "sample", "win", F.greatest(F.lit(-1), F.least(F.lit(1), F.col("n_het"))).cast("long").alias("ob"))


@query("p11_observed_chunks", f"WITH {CHUNKED} SELECT user_id, k FROM chunks GROUP BY 1, 2 HAVING max(ob) >= 0")
def p11(spark, d):
    return windows.observed(windows.packed(w1(spark, d), ["user_id"], 25)).select("user_id", "k")


@query("p12_trim", f"WITH {A.OBS}, e AS (SELECT user_id, min(win) AS lo, max(win) AS hi FROM obs WHERE ob >= 0 GROUP BY 1) SELECT o.user_id, win, ob FROM obs o JOIN e ON o.user_id = e.user_id AND win BETWEEN lo AND hi")
def p12(spark, d):
    return windows.trimmed(A.observations(spark, d), "user_id")


@query("j6_minibatch", f"WITH {CHUNKED}, n AS (SELECT user_id, count(*) FILTER (ob >= 0) AS n_seen FROM chunks GROUP BY 1) SELECT o_orderkey AS draw, user_id, n_seen FROM orders JOIN n ON user_id = o_custkey")
def j6(spark, d):
    """Each order draws the chunks of a user, the same user again and again."""
    seen = w1(spark, d).groupBy("user_id").agg(F.count_if(F.col("ob") >= 0).alias("n_seen"))
    draws = A.table(spark, d, "orders").select(F.col("o_orderkey").alias("draw"), F.col("o_custkey").alias("user_id"))
    return sampling.gather(seen, draws, "user_id").select("draw", "user_id", "n_seen")


@query("t4_sample", f"WITH {CHUNKED}, u AS (SELECT DISTINCT user_id, k FROM chunks) SELECT user_id, k FROM u ORDER BY md5(user_id || ':' || k || ':0'), user_id, k LIMIT 500")
def t4(spark, d):
    """Five hundred chunks without replacement, the same in every run."""
    return sampling.without_replacement(w1(spark, d).select("user_id", "k").distinct(), ["user_id", "k"], 500)


@query("w9_early_stop", f"""WITH {A.OBS}, r AS (SELECT *, max(ob) OVER (PARTITION BY user_id ORDER BY win ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS record FROM obs),
 b AS (SELECT *, max(CASE WHEN record IS NULL OR ob > record THEN win END) OVER (PARTITION BY user_id ORDER BY win ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS best FROM r),
 s AS (SELECT user_id, coalesce(min(CASE WHEN win - best > 30 THEN win END), max(win)) AS stop FROM b GROUP BY 1)
 SELECT s.user_id, b.best, s.stop FROM s JOIN b ON b.user_id = s.user_id AND b.win = s.stop""")
def w9(spark, d):
    return windows.early_stop(A.observations(spark, d), "user_id", "win", "ob", 30)


@query("b9_structured_product", f"""WITH {A.ETA}, r AS (SELECT vec_id, i, exp(-h) AS b, c AS d, 1 / (1 + c) AS u, exp(-c) AS v, c * c AS x FROM eta)
 SELECT vec_id, i, round(b * coalesce(sum(x) OVER (PARTITION BY vec_id ORDER BY i ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 0e0) + d * x + v * coalesce(sum(u * x) OVER (PARTITION BY vec_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0e0), 6) AS out FROM r""")
def b9(spark, d):
    c = F.col("c")
    rows = A.eta(spark, d).select("vec_id", "i", F.exp(-F.col("h")).alias("b"), c.alias("d"), (1 / (1 + c)).alias("u"), F.exp(-c).alias("v"), (c * c).alias("x"))
    return rounded(windows.structured_product(rows, "vec_id", "i"), "out")


@query("m4_transition", f"WITH RECURSIVE {A.ETA}, {transition_sql()} SELECT vec_id, i, j, round(p, 9) AS p FROM a")
def m4(spark, d):
    """Transition matrices of every history."""
    return rounded(coalescent.transitions(A.histories(spark, d), "vec_id", 1e-2), "p", digits=9)


@query("m6_structured", f"""WITH RECURSIVE {A.ETA}, {transition_sql()}, top AS (SELECT vec_id, j, p / max(CASE WHEN j = 1 THEN p END) OVER (PARTITION BY vec_id) AS v FROM a WHERE i = 0)
 SELECT e.vec_id, e.i, round(coalesce(b.p, 0e0), 9) AS b, round(d.p, 9) AS d, round(coalesce(up.p / nxt.v, 0e0), 9) AS u, round(CASE WHEN e.i = 0 THEN 0e0 ELSE top.v END, 6) AS v,
  round(exp(-0.01e0 * e.e), 9) AS emis0, round(2 * exp(-0.005e0 * e.e) * sinh(0.005e0 * e.e), 9) AS emis1, round(CASE WHEN e.dt IS NULL THEN exp(-e.h) ELSE 2 * exp(-e.h - e.c * e.dt / 2) * sinh(e.c * e.dt / 2) END, 9) AS pi
 FROM ect e JOIN a d ON d.vec_id = e.vec_id AND d.i = e.i AND d.j = e.i JOIN top ON top.vec_id = e.vec_id AND top.j = e.i LEFT JOIN a b ON b.vec_id = e.vec_id AND b.i = e.i + 1 AND b.j = e.i
  LEFT JOIN a up ON up.vec_id = e.vec_id AND up.i = e.i AND up.j = e.i + 1 LEFT JOIN top nxt ON nxt.vec_id = e.vec_id AND nxt.j = e.i + 1""")
def m6(spark, d):
    """The linear-time form of every history's transition matrix, with emissions and start; v runs to hundreds and has six decimals."""
    rows = coalescent.structured(A.histories(spark, d), "vec_id", 1e-2, 1e-2)
    return rounded(rounded(rows, "b", "d", "u", "emis0", "emis1", "pi", digits=9), "v")


@query("m10_spectrum_term", f"""WITH {A.ETA}, etjj AS (SELECT vec_id, CAST(k.range AS BIGINT) AS k, sum(CASE WHEN dt IS NULL THEN exp(-h * k.range * (k.range - 1) / 2e0) ELSE exp(-h * k.range * (k.range - 1) / 2e0) * (1 - exp(-c * dt * k.range * (k.range - 1) / 2e0)) END / (c * k.range * (k.range - 1) / 2e0)) AS etjj FROM eta, range(2, {A.PLOIDS + 1}) k GROUP BY 1, 2),
 {weights_sql(A.PLOIDS)}, l AS (SELECT vec_id, least(b, {A.PLOIDS} - b) AS k, sum(etjj * w) AS e FROM etjj JOIN w ON k = j GROUP BY 1, 2),
 p AS (SELECT vec_id, k, e / sum(e) OVER (PARTITION BY vec_id) AS p FROM l), {FOLD} SELECT vec_id, round(sum(n_sites * ln(p)), 2) AS ll FROM p JOIN folded USING (k) GROUP BY 1""")
def m10(spark, d):
    lengths = H.branch_lengths(A.eta(spark, d), ["vec_id"], A.PLOIDS)
    return rounded(spectra.log_likelihood(lengths, af1(spark, d), ["vec_id"]), "ll", digits=2)


CUBIC = ", ".join(f"CAST(embedding[4 * i + {k + 1}] AS DOUBLE) AS a{k}" for k in range(4))


def polynomials(spark, d):
    """Cubic pieces from a vector's numbers, four to a piece."""
    numbers = A.table(spark, d, "embeddings").select(F.col("vec_id").alias("_id"), F.transform(F.sequence(F.lit(0), F.lit(A.EPOCHS - 1)), lambda i: F.transform(F.slice("embedding", 4 * i + 1, 4), lambda x: x.cast("double"))).alias("a"))
    return numbers


@query("j5_polynomial_lookup", f"WITH {ON_GRID}, p AS (SELECT met.vec_id, x, x - t AS u, {CUBIC} FROM met JOIN embeddings e ON e.vec_id = met.vec_id) SELECT vec_id, round(x, 9) AS x, round(((a0 * u + a1) * u + a2) * u + a3, 4) AS y FROM p")
def j5(spark, d):
    rows = on_grid(spark, d).join(polynomials(spark, d), F.col("vec_id") == F.col("_id"))
    values = rows.select("vec_id", "x", H.polynomial_at(F.col("t"), F.col("a"), F.col("x")).alias("y"))
    return rounded(rounded(values, "y", digits=4), "x", digits=9)


@query("h20_antiderivative", f"WITH {A.ETA}, p AS (SELECT eta.vec_id, i, t, dt, {CUBIC} FROM eta JOIN embeddings e ON e.vec_id = eta.vec_id) SELECT vec_id, i, round(coalesce(sum((((a0 / 4 * dt + a1 / 3) * dt + a2 / 2) * dt + a3) * dt) OVER (PARTITION BY vec_id ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0e0), 4) AS area FROM p")
def h20(spark, d):
    pieces = A.eta(spark, d).join(polynomials(spark, d), F.col("vec_id") == F.col("_id")).withColumn("a", F.get("a", F.col("i").cast("int")))
    return rounded(H.area_before(pieces, ["vec_id"]).select("vec_id", "i", "area"), "area", digits=4)


@query("g2_special_functions", "WITH x AS (SELECT vec_id, abs(CAST(embedding[1] AS DOUBLE)) + 0.1e0 AS x FROM embeddings) SELECT vec_id, round(1 / (exp(x) - 1), 6) AS expm1inv, round(ln(1 + exp(x)), 6) AS softplus, round(ln(exp(x) - 1), 6) AS softplus_inv, round(1 / (1 + exp(-x)), 6) AS expit FROM x")
def g2(spark, d):
    x = F.col("x")
    rows = A.table(spark, d, "embeddings").select("vec_id", (F.abs(F.element_at("embedding", 1).cast("double")) + 0.1).alias("x"))
    return rounded(rows.select("vec_id", H.expm1inv(x).alias("expm1inv"), H.softplus(x).alias("softplus"), H.softplus_inv(x).alias("softplus_inv"), (1 / (1 + F.exp(-x))).alias("expit")), "expm1inv", "softplus", "softplus_inv", "expit")
