"""Relations of the sequence model, derived from the star-schema tables.

Each adapter has the DuckDB text of the same relation, for the oracles.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SAMPLES = 7
PLOIDS = 2 * SAMPLES
EPOCHS = 16


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """calls(contig, pos, sample, a0, a1): one genotype for each site and sample."""
    rows = table(spark, sf_dir, "lineitem").select(
        F.col("l_returnflag").alias("contig"), (F.col("l_orderkey") * 10).cast("long").alias("pos"), F.col("l_linenumber").cast("long").alias("sample"),
        F.pmod(F.floor("l_quantity"), F.lit(2)).cast("long").alias("a0"), F.pmod(F.col("l_suppkey"), F.lit(2)).cast("long").alias("a1"),
    )
    return rows.groupBy("contig", "pos", "sample").agg(F.max("a0").alias("a0"), F.max("a1").alias("a1"))


CALLS = """calls AS (SELECT l_returnflag AS contig, CAST(l_orderkey * 10 AS BIGINT) AS pos, CAST(l_linenumber AS BIGINT) AS sample,
  CAST(max(CAST(floor(l_quantity) AS BIGINT) % 2) AS BIGINT) AS a0, CAST(max(l_suppkey % 2) AS BIGINT) AS a1 FROM lineitem GROUP BY 1, 2, 3)"""


def masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """masks(a, b): half-open intervals on every contig."""
    rows = table(spark, sf_dir, "orders").filter(F.col("o_orderkey") % 29 == 0)
    return rows.select((F.col("o_orderkey") * 500).cast("long").alias("a"), (F.col("o_orderkey") * 500 + 1 + F.col("o_custkey") % 300).cast("long").alias("b"))


MASKS = "masks AS (SELECT CAST(o_orderkey * 500 AS BIGINT) AS a, CAST(o_orderkey * 500 + 1 + o_custkey % 300 AS BIGINT) AS b FROM orders WHERE o_orderkey % 29 = 0)"

WIDTH = 21_600_000_000  # microseconds of a window of events


def window_count(spark: SparkSession, sf_dir: str) -> int:
    """How many windows there are from the day of the first event to the last event."""
    ends = table(spark, sf_dir, "events").agg(F.min("ts").alias("lo"), F.max("ts").alias("hi"))
    last = F.floor(F.timestamp_diff("MICROSECOND", F.date_trunc("day", "lo"), F.col("hi").cast("timestamp")) / F.lit(WIDTH))
    return (ends.select(last.cast("long").alias("n")).first().n or 0) + 1


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """obs(user_id, win, ob): 1 if a user's window has an error, 0 if other events, -1 if none."""
    events = table(spark, sf_dir, "events").filter("ts is not null")
    start = events.agg(F.date_trunc("day", F.min("ts")).alias("_start"))
    events = events.crossJoin(F.broadcast(start))  # one row
    win = F.floor(F.timestamp_diff("MICROSECOND", "_start", F.col("ts").cast("timestamp")) / F.lit(WIDTH)).cast("long")
    user, error = F.col("user_id").cast("long").alias("user_id"), F.when(F.col("event_type") == "error", 1).otherwise(0).cast("long")
    seen = events.filter("user_id is not null").select(user, win.alias("win"), error.alias("ob"))
    windows = F.sequence(F.lit(0).cast("long"), F.lit(window_count(spark, sf_dir) - 1).cast("long"))
    spine = events.select(user).distinct().select("user_id", F.explode(windows).alias("win"), F.lit(-1).cast("long").alias("ob"))
    # no join: a plan that takes the users' size for that of their windows would broadcast them
    return seen.union(spine).groupBy("user_id", "win").agg(F.max("ob").alias("ob"))


OBS = f"""ext AS (SELECT date_trunc('day', min(ts)) AS t0, CAST(floor(date_diff('microsecond', date_trunc('day', min(ts)), max(ts)) / {WIDTH}.0) AS BIGINT) + 1 AS windows FROM events),
obs AS (SELECT u.user_id, w.win, CAST(coalesce(e.ob, -1) AS BIGINT) AS ob
  FROM (SELECT DISTINCT CAST(user_id AS BIGINT) AS user_id FROM events WHERE ts IS NOT NULL) u CROSS JOIN (SELECT CAST(unnest(range(windows)) AS BIGINT) AS win FROM ext) w
  LEFT JOIN (SELECT CAST(user_id AS BIGINT) AS user_id, CAST(floor(date_diff('microsecond', t0, ts) / {WIDTH}.0) AS BIGINT) AS win,
    max(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) AS ob FROM events, ext GROUP BY 1, 2) e ON e.user_id = u.user_id AND e.win = w.win)"""


def time_grid(i):
    return F.when(i == 0, F.lit(0.0)).otherwise(F.lit(1e-3) * F.pow(F.lit(15000.0), (i - 1) / F.lit(14.0)))


def histories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """histories(vec_id, t, c): a size history in arrays for each vector."""
    index = F.sequence(F.lit(0), F.lit(EPOCHS - 1))
    c = F.transform(F.slice("embedding", 1, EPOCHS), lambda x: F.log1p(F.exp(x.cast("double"))))
    return table(spark, sf_dir, "embeddings").select("vec_id", F.transform(index, lambda i: time_grid(i)).alias("t"), c.alias("c"))


def eta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """eta(vec_id, i, t, dt, c, h): the pieces of each history and the hazard before them; the last dt is null."""
    long = histories(spark, sf_dir).select("vec_id", F.posexplode(F.arrays_zip("t", "c")).alias("i", "x")).select("vec_id", F.col("i").cast("long").alias("i"), F.col("x.t").alias("t"), F.col("x.c").alias("c"))
    return with_hazard(long, ["vec_id"])


def with_hazard(pieces: DataFrame, keys: list[str]) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy("t")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    return pieces.withColumn("dt", F.lead("t").over(order) - F.col("t")).withColumn("h", F.coalesce(F.sum(F.col("c") * F.col("dt")).over(before), F.lit(0.0)))


ETA = """eta0 AS (SELECT vec_id, CAST(r.range AS BIGINT) AS i, CASE WHEN r.range = 0 THEN 0e0 ELSE 1e-3 * pow(15000e0, (r.range - 1) / 14e0) END AS t,
  ln(1e0 + exp(CAST(embedding[r.range + 1] AS DOUBLE))) AS c FROM embeddings, range(16) r),
eta1 AS (SELECT *, lead(t) OVER (PARTITION BY vec_id ORDER BY t) - t AS dt FROM eta0),
eta AS (SELECT *, coalesce(sum(c * dt) OVER (PARTITION BY vec_id ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0e0) AS h FROM eta1)"""


def individuals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """individuals(id, pop, node0, node1)."""
    key = F.col("c_custkey").cast("long")
    return table(spark, sf_dir, "customer").select(key.alias("id"), F.col("c_nationkey").cast("long").alias("pop"), (2 * key).alias("node0"), (2 * key + 1).alias("node1"))


INDIVIDUALS = "individuals AS (SELECT CAST(c_custkey AS BIGINT) AS id, CAST(c_nationkey AS BIGINT) AS pop, CAST(2 * c_custkey AS BIGINT) AS node0, CAST(2 * c_custkey + 1 AS BIGINT) AS node1 FROM customer)"


HAPLOIDS, LINEAGES = 14, 27  # nodes 0 to 13 are samples, 14 to 25 are older ones, 26 is the oldest
ORIGINS = ("A", "N", "R")


def sequence_length(spark: SparkSession, sf_dir: str) -> int:
    ends = table(spark, sf_dir, "lineitem").agg(F.max("l_orderkey").alias("n")).first().n, table(spark, sf_dir, "orders").agg(F.max("o_orderkey").alias("n")).first().n
    return 10 * max(x or 0 for x in ends) + 20


def lineages(spark: SparkSession, sf_dir: str, span: int = 1 << 20) -> DataFrame:
    """edges(contig, left, right, parent, child): a line moves a node below an older one, until the node's next move.

    The next move is the next within a span of positions, or else the first of
    later spans, so no task holds all moves of a node.
    """
    low = lambda node: F.greatest(node + 1, F.lit(HAPLOIDS))
    child = F.col("l_partkey") % (LINEAGES - 1)
    moves = table(spark, sf_dir, "lineitem").select(
        F.col("l_returnflag").alias("contig"), (F.col("l_orderkey") * 10).cast("long").alias("left"), child.cast("long").alias("child"), (low(child) + F.col("l_suppkey") % (LINEAGES - low(child))).cast("long").alias("parent")
    )
    moves = moves.withColumn("span", F.floor(F.col("left") / span))
    firsts = moves.groupBy(F.col("contig").alias("_c"), F.col("child").alias("_n"), F.col("span").alias("_s")).agg(F.min("left").alias("_first"))
    firsts = firsts.withColumn("_later", F.lead("_first").over(Window.partitionBy("_c", "_n").orderBy("_s"))).drop("_first")
    # of a node's moves at one place the last counts, that below the oldest
    following = F.lead("left").over(Window.partitionBy("contig", "child", "span").orderBy("left", "parent"))
    last = moves.withColumn("_next", following).filter(F.col("_next").isNull() | (F.col("_next") > F.col("left")))
    met = last.join(firsts, (F.col("contig") == F.col("_c")) & (F.col("child") == F.col("_n")) & (F.col("span") == F.col("_s")))
    end = F.coalesce("_next", "_later", F.lit(sequence_length(spark, sf_dir)).cast("long"))
    return met.select("contig", "left", end.alias("right"), "parent", "child")


def mutations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """mutations(contig, pos, id, node, state, ancestral): one at each order's site, and at every fourth a second on another node; some go back."""
    key, node = F.col("o_orderkey"), (F.col("o_custkey") % LINEAGES).cast("long")
    other = ((F.col("o_custkey") * 7 + 3) % LINEAGES).cast("long")
    second = F.when((key % 4 == 0) & (node != other), F.struct(F.lit(1).cast("long").alias("id"), other.alias("node"), F.when(key % 8 == 0, "G").otherwise("A").alias("state")))
    first = F.struct(F.lit(0).cast("long").alias("id"), node.alias("node"), F.lit("T").alias("state"))
    contig = F.element_at(F.array(*map(F.lit, ORIGINS)), (key % 3 + 1).cast("int"))
    rows = table(spark, sf_dir, "orders").select(contig.alias("contig"), (key * 10 + 5).cast("long").alias("pos"), F.explode(F.array_compact(F.array(first, second))).alias("m"))
    return rows.select("contig", "pos", "m.id", "m.node", "m.state", F.lit("A").alias("ancestral"))


LINES = f"""moves AS (SELECT l_returnflag AS contig, CAST(l_orderkey * 10 AS BIGINT) AS lft, l_partkey % {LINEAGES - 1} AS child, max(greatest(l_partkey % {LINEAGES - 1} + 1, {HAPLOIDS}) + l_suppkey % ({LINEAGES} - greatest(l_partkey % {LINEAGES - 1} + 1, {HAPLOIDS}))) AS parent FROM lineitem GROUP BY 1, 2, 3),
muts AS (SELECT CASE o_orderkey % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'N' ELSE 'R' END AS contig, CAST(o_orderkey * 10 + 5 AS BIGINT) AS pos, o_custkey % {LINEAGES} AS node, 'T' AS state FROM orders
 UNION ALL SELECT CASE o_orderkey % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'N' ELSE 'R' END, CAST(o_orderkey * 10 + 5 AS BIGINT), (o_custkey * 7 + 3) % {LINEAGES}, CASE WHEN o_orderkey % 8 = 0 THEN 'G' ELSE 'A' END FROM orders WHERE o_orderkey % 4 = 0 AND (o_custkey * 7 + 3) % {LINEAGES} <> o_custkey % {LINEAGES}),
sites AS (SELECT DISTINCT contig, pos FROM muts), asked AS (SELECT contig, pos, child FROM sites, (SELECT unnest(range({LINEAGES - 1})) AS child)),
up AS MATERIALIZED (SELECT q.contig, q.pos, q.child, m.parent FROM asked q ASOF JOIN moves m ON m.contig = q.contig AND m.child = q.child AND m.lft <= q.pos),
path AS (SELECT contig, pos, s.range AS sample, CAST(s.range AS BIGINT) AS node, 0 AS depth FROM sites, range({HAPLOIDS}) s UNION ALL
 SELECT p.contig, p.pos, sample, CAST(u.parent AS BIGINT), depth + 1 FROM path p JOIN up u ON u.contig = p.contig AND u.pos = p.pos AND u.child = p.node),
gt AS MATERIALIZED (SELECT p.contig, p.pos, sample, coalesce(min_by(state, depth) FILTER (state IS NOT NULL), 'A') AS allele FROM path p LEFT JOIN muts m ON m.contig = p.contig AND m.pos = p.pos AND m.node = p.node GROUP BY 1, 2, 3)"""
