"""Registered queries of the smaller operators: predicates, slices, summaries over particles, parameters."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import history as H
from ..operators import intervals, windows
from ..sources import adapters as A
from .model import ON_GRID
from .queries import HET, a1, on_grid, rounded
from .registry import query

HAZARD = "h + c * (x - t)"


@query("h2_sizes", f"WITH {A.ETA} SELECT vec_id, count(*) AS pieces, round(min(1 / (2 * c)), 6) AS smallest, round(max(1 / (2 * c)), 6) AS largest FROM eta GROUP BY 1")
def h2(spark, d):
    size = 1 / (2 * F.col("c"))
    return rounded(A.eta(spark, d).groupBy("vec_id").agg(F.count(F.lit(1)).alias("pieces"), F.min(size).alias("smallest"), F.max(size).alias("largest")), "smallest", "largest")


@query("h3_hazard", f"WITH {ON_GRID} SELECT vec_id, round(x, 9) AS x, round({HAZARD}, 6) AS hazard FROM met")
def h3(spark, d):
    rows = on_grid(spark, d).select("vec_id", "x", H.hazard_at(F.col("t"), F.col("c"), F.col("x")).alias("hazard"))
    return rounded(rounded(rows, "hazard"), "x", digits=9)


@query("h7_survival_lineages", f"WITH {ON_GRID} SELECT vec_id, round(x, 9) AS x, round(exp(-6 * ({HAZARD})), 6) AS sf, round(1 - exp(-6 * ({HAZARD})), 6) AS cdf FROM met")
def h7(spark, d):
    """Of the first event among four lineages, so at six times the rate."""
    alive = F.exp(-6 * H.hazard_at(F.col("t"), F.col("c"), F.col("x")))
    return rounded(rounded(on_grid(spark, d).select("vec_id", "x", alive.alias("sf"), (1 - alive).alias("cdf")), "sf", "cdf"), "x", digits=9)


@query("s20_truth_curve", f"WITH {ON_GRID} SELECT vec_id, round(x * 2e4, 6) AS generation, round(c / 2e4, 12) AS rate FROM met")
def s20(spark, d):
    """The pairwise rate of one population along a geometric grid, in generations."""
    rows = on_grid(spark, d).select("vec_id", (F.col("x") * 2e4).alias("generation"), (H.rate_at(F.col("t"), F.col("c"), F.col("x")) / 2e4).alias("rate"))
    return rounded(rounded(rows, "generation"), "rate", digits=12)


@query("a12_predictive_density", f"WITH {ON_GRID} SELECT round(x, 9) AS x, round(avg(ln(c) - ({HAZARD})), 6) AS elpd FROM met GROUP BY 1")
def a12(spark, d):
    """The mean log density over particles, at each point."""
    log_density = F.log(H.rate_at(F.col("t"), F.col("c"), F.col("x"))) - H.hazard_at(F.col("t"), F.col("c"), F.col("x"))
    rows = rounded(on_grid(spark, d).select("x", log_density.alias("_l")), "x", digits=9)
    return rounded(rows.groupBy("x").agg(F.avg("_l").alias("elpd")), "elpd")


@query("a16_best_particle", f"WITH {ON_GRID}, r AS (SELECT round(x, 9) AS x, vec_id, round(c * exp(-({HAZARD})), 9) AS density FROM met), n AS (SELECT *, row_number() OVER (PARTITION BY x ORDER BY density DESC, vec_id) AS place FROM r) SELECT x, vec_id AS best FROM n WHERE place = 1")
def a16(spark, d):
    density = H.rate_at(F.col("t"), F.col("c"), F.col("x")) * F.exp(-H.hazard_at(F.col("t"), F.col("c"), F.col("x")))
    rows = rounded(rounded(on_grid(spark, d).select("x", "vec_id", density.alias("_d")), "_d", "x", digits=9), "x", digits=9)
    return rows.groupBy("x").agg(F.max_by("vec_id", F.struct("_d", -F.col("vec_id"))).alias("best"))


@query("m1_from_linear", f"WITH {A.ETA} SELECT vec_id, round(ln(min(t) FILTER (i = 1)), 6) AS first, round(ln(max(t) - min(t) FILTER (i = 1)), 6) AS span, round(sum(c + ln(1 - exp(-c))), 5) AS rates FROM eta GROUP BY 1")
def m1(spark, d):
    """Unconstrained parameters: logarithms of the grid's ends, and the rates' inverse softplus, added up."""
    rows = A.histories(spark, d).select("vec_id", F.element_at("t", 2).alias("_first"), F.element_at("t", -1).alias("_last"), F.aggregate(F.transform("c", H.softplus_inv), F.lit(0.0), lambda s, v: s + v).alias("rates"))
    out = rows.select("vec_id", F.log("_first").alias("first"), F.log(F.col("_last") - F.col("_first")).alias("span"), "rates")
    return rounded(rounded(out, "first", "span"), "rates", digits=5)


@query("a10_sequence_flags", f"WITH {A.OBS} SELECT user_id, bool_or(ob = 1) AS any_het, bool_and(ob >= 0) AS whole, count(DISTINCT ob) AS n_values, min(win) FILTER (ob >= 0) AS first, max(win) FILTER (ob >= 0) AS last FROM obs GROUP BY 1")
def a10(spark, d):
    seen = F.when(F.col("ob") >= 0, F.col("win"))
    return A.observations(spark, d).groupBy("user_id").agg(F.bool_or(F.col("ob") == 1).alias("any_het"), F.bool_and(F.col("ob") >= 0).alias("whole"), F.count_distinct("ob").alias("n_values"), F.min(seen).alias("first"), F.max(seen).alias("last"))


@query("p10_not_missing", f"WITH {A.OBS} SELECT user_id, win, ob FROM obs WHERE ob > -1")
def p10(spark, d):
    return A.observations(spark, d).filter("ob > -1")


@query("o2_distinct_nodes", f"WITH {A.INDIVIDUALS} SELECT node0 AS node FROM individuals UNION SELECT node1 FROM individuals")
def o2(spark, d):
    return A.individuals(spark, d).select(F.explode(F.array_distinct(F.array("node0", "node1"))).alias("node")).distinct()


@query("o4_bag_union", f"WITH {HET}, {A.OBS} SELECT contig || ':' || sample AS sequence, win, n_het AS ob FROM het UNION ALL SELECT 'user:' || user_id, win, ob FROM obs")
def o4(spark, d):
    """The windows of all sources, each row named by its sequence, so that no order is needed."""
    one = a1(spark, d).select(F.concat_ws(":", "contig", "sample").alias("sequence"), "win", F.col("n_het").alias("ob"))
    two = A.observations(spark, d).select(F.concat(F.lit("user:"), F.col("user_id")).alias("sequence"), "win", "ob")
    return one.unionByName(two)


@query("b2_strided_slices", f"WITH {A.OBS}, k AS (SELECT CAST(unnest(range(greatest(1, CAST(ceil(windows / 25e0) AS BIGINT)))) AS BIGINT) AS k FROM ext) SELECT user_id, k, array_to_string(list(ob ORDER BY win), ',') AS obs FROM obs JOIN k ON win >= k * 20 AND win < k * 20 + 25 GROUP BY 1, 2")
def b2(spark, d):
    """Overlapping slices of sequences that are stored as arrays."""
    length = A.window_count(spark, d)
    whole = windows.packed(A.observations(spark, d).select("user_id", F.lit(0).alias("k"), F.col("win").alias("slot"), "ob"), ["user_id"], length)
    cut = whole.select("user_id", "obs", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(windows.chunk_count(length, 20, 5) - 1).cast("long"))).alias("k"))
    return cut.select("user_id", "k", F.array_join(F.slice("obs", (F.col("k") * 20 + 1).cast("int"), F.lit(25)).cast("array<string>"), ",").alias("obs"))


@query("b8_split_warm_up", f"WITH {A.OBS} SELECT user_id, CAST(sum(CASE WHEN win < 5 THEN ob ELSE 0 END) AS BIGINT) AS warm, CAST(sum(CASE WHEN win >= 5 THEN ob ELSE 0 END) AS BIGINT) AS rest FROM obs GROUP BY 1")
def b8(spark, d):
    length = A.window_count(spark, d)
    whole = windows.packed(A.observations(spark, d).select("user_id", F.lit(0).alias("k"), F.col("win").alias("slot"), "ob"), ["user_id"], length)
    total = lambda part: F.aggregate(part, F.lit(0).cast("long"), lambda s, v: s + v)
    return whole.select("user_id", total(F.slice("obs", 1, 5)).alias("warm"), total(F.slice("obs", 6, length)).alias("rest"))


@query("s1_source_kinds", r"WITH p AS (SELECT o_orderkey, 'run' || o_custkey || CASE o_orderkey % 6 WHEN 0 THEN '.vcf' WHEN 1 THEN '.vcf.gz' WHEN 2 THEN '.bcf' WHEN 3 THEN '.trees' WHEN 4 THEN '.tsz' ELSE '.psmcfa' END AS path FROM orders) SELECT o_orderkey, CASE WHEN regexp_matches(path, '\.(vcf|vcf\.gz|bcf)$') THEN 'vcf' WHEN regexp_matches(path, '\.(trees|ts)$') THEN 'trees' WHEN regexp_matches(path, '\.(tsz|tszip)$') THEN 'compressed trees' ELSE 'other' END AS kind FROM p")
def s1(spark, d):
    """The kind of source that a path's ending names."""
    ending = F.element_at(F.array(*map(F.lit, [".vcf", ".vcf.gz", ".bcf", ".trees", ".tsz", ".psmcfa"])), (F.col("o_orderkey") % 6 + 1).cast("int"))
    path = F.concat(F.lit("run"), F.col("o_custkey"), ending)
    ends = lambda *marks: F.rlike(F.col("_path"), F.lit(rf"\.({'|'.join(marks)})$"))
    kind = F.when(ends("vcf", r"vcf\.gz", "bcf"), "vcf").when(ends("trees", "ts"), "trees").when(ends("tsz", "tszip"), "compressed trees").otherwise("other")
    return A.table(spark, d, "orders").select("o_orderkey", path.alias("_path")).select("o_orderkey", kind.alias("kind"))


@query("p9_chromosomes", "SELECT CAST(l_orderkey AS BIGINT) AS id, CAST(l_linenumber AS BIGINT) AS nth FROM lineitem WHERE l_linenumber = 2 AND l_discount > 0 AND regexp_matches(CAST(l_partkey AS VARCHAR), '^[0-9]+$')")
def p9(spark, d):
    """Contigs of two copies, with recombination and a number for a name."""
    rows = A.table(spark, d, "lineitem").filter((F.col("l_linenumber") == 2) & (F.col("l_discount") > 0) & F.rlike(F.col("l_partkey").cast("string"), F.lit("^[0-9]+$")))
    return rows.select(F.col("l_orderkey").cast("long").alias("id"), F.col("l_linenumber").cast("long").alias("nth"))


@query("g5_log_densities", "WITH x AS (SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS z, 1 / (1 + exp(-CAST(embedding[2] AS DOUBLE))) AS p FROM embeddings) SELECT vec_id, round(-0.5e0 * z * z - 0.5e0 * ln(2 * pi()), 6) AS log_pdf, round(CASE WHEN z <= 0 THEN 0e0 ELSE z * ln(p) END, 6) AS xlogy, round(-ln(1 - p), 6) AS ppf, round(ln(p / (1 - p)), 6) AS logit FROM x")
def g5(spark, d):
    z, p = F.col("embedding")[0].cast("double"), 1 / (1 + F.exp(-F.col("embedding")[1].cast("double")))
    out = A.table(spark, d, "embeddings").select("vec_id", (-0.5 * z * z - 0.5 * F.log(2 * F.pi())).alias("log_pdf"), F.when(z <= 0, 0.0).otherwise(z * F.log(p)).alias("xlogy"), (-F.log1p(-p)).alias("ppf"), F.log(p / (1 - p)).alias("logit"))
    return rounded(out, "log_pdf", "xlogy", "ppf", "logit")


@query("o5_merged_masks", f"""WITH {A.MASKS}, wide AS (SELECT a, b + a // 14500 % 3 * 9000 AS b FROM masks),
m1 AS (SELECT *, max(b) OVER (ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM wide),
m2 AS (SELECT *, sum(CASE WHEN reach IS NULL OR a > reach THEN 1 ELSE 0 END) OVER (ORDER BY a, b) AS run FROM m1) SELECT min(a) AS a, max(b) AS b FROM m2 GROUP BY run""")
def o5_merged(spark, d):
    """Overlapping masks as disjoint ones; every third mask is widened, and meets the next."""
    wide = A.masks(spark, d).withColumn("b", F.col("b") + F.floor(F.col("a") / 14_500) % 3 * 9000)
    return intervals.merged(wide).select("a", "b")
