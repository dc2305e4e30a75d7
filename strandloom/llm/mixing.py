"""Mixing sources to target weights by entropy balancing."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from .common import materialize, partitions

CONSTRAINTS = 1024
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def capped_targets(sizes: list[int], weights: list[float], most: float) -> list[float]:
    """Shares of the total by weight; none above most times its size, the excess reshared."""
    targets, free, left = [0.0] * len(sizes), set(range(len(sizes))), float(sum(sizes))
    while free:
        unit = left / sum(weights[i] for i in free)
        over = {i for i in free if weights[i] * unit > most * sizes[i]}
        for i in over or free:
            targets[i] = most * sizes[i] if over else weights[i] * unit
        if not over:
            break
        left -= sum(targets[i] for i in over)
        free -= over
    return targets


def tilted(cells: DataFrame, tilts: DataFrame) -> DataFrame:
    """(ids, p): the tokens of each cell (ids, mass) under the multipliers (_id, _tilt), of which it needs all of its own.

    Cells of one constraint each, as sources are, need no more than the join.
    """
    each = cells.select("ids", "mass", F.explode("ids").alias("id")).join(tilts, F.col("id") == F.col("_id"))
    sums = each.groupBy("ids", "mass").agg(F.sum("_tilt").alias("_sum"), F.count(F.lit(1)).alias("_n"))
    return sums.filter(F.col("_n") == F.size("ids")).select("ids", (F.col("mass") * F.exp("_sum")).alias("p"))


def balance(cells: DataFrame, targets: dict[str, float], tolerance: float = 1e-10, rounds: int = 60) -> dict[str, float]:
    """Multipliers of the convex dual of entropy balancing.

    cells: (ids array<string>, mass): the constraints that a cell's tokens count
    for, and how many they are. Among all rates whose tokens meet every
    constraint's target, the nearest to keeping every token once, by relative
    entropy, are exp of the sum of a document's multipliers. They minimise
    sum(mass * exp(sum of multipliers)) - sum(multiplier * target). Each Newton
    step is one distributed aggregation, of gradient and Hessian, which have a
    row for each constraint and pair of constraints; only those reach the
    driver, so there may be CONSTRAINTS of them at most. Constraints with target
    or mass zero get minus infinity.
    """
    if len(targets) > CONSTRAINTS:
        raise ValueError(f"{len(targets)} overlapping constraints; the driver solves for {CONSTRAINTS} at most")
    spark = cells.sparkSession
    names = sorted(k for k, v in targets.items() if v > 0)
    goal, at = np.array([targets[k] for k in names]), np.zeros(len(names))
    place = {k: i for i, k in enumerate(names)}
    if not names:
        return dict.fromkeys(targets, -np.inf)

    def look(point: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        tilt = F.broadcast(spark.createDataFrame([(k, float(point[i])) for k, i in place.items()], "_id string, _tilt double"))
        sums = tilted(cells, tilt)
        pairs = sums.select("p", "ids", F.explode("ids").alias("i")).select("p", "i", F.explode("ids").alias("j"))
        hessian = np.zeros((len(names), len(names)))
        for r in pairs.groupBy("i", "j").agg(F.sum("p").alias("p")).collect():
            hessian[place[r.i], place[r.j]] = r.p
        total = sums.agg(F.sum("p")).first()[0] or 0.0
        return total - float(point @ goal), hessian.diagonal() - goal, hessian

    value, slope, hessian = look(at)
    for _ in range(rounds):
        if (np.abs(slope) <= tolerance * goal).all():
            break
        step, scale = np.linalg.lstsq(hessian, -slope, rcond=None)[0], 1.0
        gain = float(step @ slope)
        while True:  # the dual is convex: shorten the step until it goes down
            found = look(at + scale * step)
            if found[0] <= value + 1e-4 * scale * gain or scale < 1e-6:
                break
            scale /= 2
        at, (value, slope, hessian) = at + scale * step, found
    return {k: float(at[place[k]]) if k in place else -np.inf for k in targets}


def newton(classes: DataFrame, sources: DataFrame, tolerance: float = 1e-12, rounds: int = 200) -> DataFrame:
    """sources (_source, target) with _tilt, the multipliers of the convex dual of entropy balancing.

    classes is (_source, size, n): how many documents have a source and a size.
    The dual is the tokens of all documents at their rates, exp of the source's
    multiplier, less each multiplier times its target. A round is one
    distributed aggregation over the classes, which gives each source the
    dual's slope and curvature; a document counts for one source, so the
    curvatures off the diagonal are zero, and a source's step is its slope over
    its curvature. Multipliers stay a table; what reaches the driver is the
    largest slope, as a share of its target. From rate one, a step overshoots
    upwards once at most and then falls to the root. Sources without a target
    or tokens get minus infinity.
    """
    classes = materialize(classes, "size-classes")
    state = materialize(sources.select("_source", "target", F.when(F.col("target") > 0, F.lit(0.0)).otherwise(F.lit(float("-inf"))).alias("_tilt")), "tilts")
    for _ in range(rounds):
        known = state.filter("target > 0").select(F.col("_source").alias("_s"), "target", "_tilt")
        each = classes.join(known, F.col("_source") == F.col("_s"))
        slopes = each.groupBy("_s").agg(F.sum(F.col("size") * F.col("n") * F.exp("_tilt")).alias("_mass"), F.first("target").alias("_goal"))
        step = (F.col("_mass") - F.col("_goal")) / F.col("_mass")
        met = state.join(slopes, F.col("_source") == F.col("_s"), "left")
        moved = F.when(F.col("_mass") > 0, F.col("_tilt") - step).otherwise(F.lit(float("-inf")))
        off = F.when(F.col("_mass") > 0, F.abs(F.col("_mass") - F.col("_goal")) / F.col("_goal"))
        seen = Observation()
        state = materialize(met.select("_source", "target", moved.alias("_tilt"), off.alias("_off")).observe(seen, F.max("_off").alias("most")).drop("_off"), "tilts")
        if (seen.get["most"] or 0.0) <= tolerance:
            return state
    raise ArithmeticError(f"the multipliers have not settled in {rounds} rounds")


def numbered(sources: DataFrame) -> DataFrame:
    """Adds _nth, the place of each _source by code point, null last.

    Names are dealt into ranges that a sample of them bounds, whatever they
    begin with; a range is numbered by itself and begins where the counts of
    earlier ranges end.
    """
    ranged = materialize(sources.repartitionByRange(partitions(sources.sparkSession), "_source").withColumn("_range", F.spark_partition_id()), "ranges")
    before = Window.orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    starts = ranged.groupBy(F.col("_range").alias("_r")).agg(F.count(F.lit(1)).alias("_n")).select("_r", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    within = F.row_number().over(Window.partitionBy("_range").orderBy("_source")) - 1
    return ranged.withColumn("_row", within).join(starts, F.col("_range") == F.col("_r")).withColumn("_nth", F.col("_row") + F.col("_start")).drop("_range", "_r", "_row", "_start")


def with_targets(sources: DataFrame, weights: tuple[float, ...], most: float) -> DataFrame:
    """Adds target to (_source, source_size): shares of the total by weight, none above most times its size.

    All targets are min(weight * level, most * size). The level rises until no
    further source is capped; a round brings two sums and a count to the driver.
    """
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("_nth") % len(weights) + 1).cast("int"))
    sources = materialize(numbered(sources).withColumn("_weight", weight), "sources")
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    level, capped = 0.0, -1
    while True:
        over = F.col("_weight") * level > most * F.col("source_size")
        r = sources.agg(F.count_if(over).alias("n"), F.sum(F.when(over, most * F.col("source_size")).otherwise(0)).alias("size"), F.sum(F.when(over, 0.0).otherwise(F.col("_weight"))).alias("weight")).first()
        if r.n == capped or not r.weight:
            break
        level, capped = (total - r.size) / r.weight, r.n
    return sources.withColumn("target", F.least(F.col("_weight") * level, (most * F.col("source_size")).cast("double"))).drop("_nth", "_weight")


def extra_copies(classes: DataFrame) -> DataFrame:
    """(_source, size, extra) for classes(_source, size, n, share, room): how many of n documents get one more copy.

    Each class gets its share, rounded down. What then is left of a source's
    room goes to its remaining documents, longest first, as long as they fit. A
    pass takes the longest ones up to the first that does not fit; as that one
    is no longer than what was taken, a pass at least halves the room, so there
    are few. In the end no document that is left out fits.
    """
    source = Window.partitionBy("_source")
    longer = source.orderBy(F.desc("size")).rowsBetween(Window.unboundedPreceding, -1)
    size, room = F.col("size"), F.col("room")

    def after(state: DataFrame) -> DataFrame:
        left = room - F.sum(F.col("_more") * size).over(source)
        return materialize(state.select("_source", "size", "n", (F.col("extra") + F.col("_more")).alias("extra"), left.alias("room")), "extra")

    taken = after(classes.withColumn("extra", F.lit(0).cast("long")).withColumn("_more", F.floor(F.col("share") * F.col("n") + 1e-6).cast("long")))
    fits = (size > 0) & (size <= room) & (F.col("n") > F.col("extra"))
    while not taken.filter(fits).isEmpty():
        words = F.when(fits, size * (F.col("n") - F.col("extra"))).otherwise(0)
        still = F.greatest(room - F.coalesce(F.sum(words).over(longer), F.lit(0)), F.lit(0))
        taken = after(taken.withColumn("_more", F.when(fits, F.least(F.col("n") - F.col("extra"), F.floor(still / size))).otherwise(0).cast("long")))
    return taken.select("_source", "size", "extra")


def mix(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), most: int = 3, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, size, source_size, target, taken, copies, rate) of every row; size in words.

    Sources, by code point and null last, take `weights` in turn, and share all
    words; a target stops at `most` times its source's size. The dual of entropy
    balancing gives each document's rate, exp of its source's multiplier. It is
    rounded into whole copies: its integer part, and one more for some documents
    of each size, chosen by extra_copies() and taken in the order of a hash of
    text and id. So a source's words miss its target by less than the shortest
    document that got no further copy, and never exceed it; no document is taken
    more than `most` times. Results do not depend on how rows are dealt out.

    Nothing about single sources or sizes reaches the driver or is broadcast; a
    hot source or size is split by the leading digits of the hash. Null texts
    have size 0 and are never taken. Repeated rows are documents of their own;
    equal ones take turns in an undefined order. Other columns are not looked
    at; those in carry, such as a key of the rows, come after the result's own.
    An empty table gives an empty result.
    """
    text = F.col(text_col).cast("string")
    turn = F.md5(F.concat_ws(":", F.coalesce(text, F.lit("")), F.col(id_col).cast("string")).cast("binary"))
    rows = docs.select(
        F.col(id_col).alias("doc_id"), word_count(text).alias("size"), F.coalesce(F.concat(F.lit("s"), F.col(source_col).cast("string")), F.lit("t")).alias("_source"),
        F.substring(turn, 1, 2).alias("_salt"), F.substring(turn, 3, 14).alias("_turn"), *carry,
    )
    rows = materialize(rows, "words")
    parts = materialize(rows.groupBy("_source", "size", "_salt").agg(F.count(F.lit(1)).alias("_n")), "classes")
    sources = with_targets(parts.groupBy("_source").agg(F.sum(F.col("size") * F.col("_n")).alias("source_size")), weights, most)
    tilts = newton(parts.groupBy("_source", "size").agg(F.sum("_n").alias("n")), sources).select(F.col("_source").alias("_ts"), "_tilt")
    sources = sources.join(tilts, F.col("_source") == F.col("_ts")).withColumn("rate", F.least(F.exp("_tilt"), F.lit(float(most)))).drop("_ts", "_tilt")
    whole = F.floor(F.col("rate") + 1e-9).cast("int")
    classes = parts.groupBy("_source", "size").agg(F.sum("_n").alias("n")).join(sources.withColumnRenamed("_source", "_s"), F.col("_source") == F.col("_s")).drop("_s")
    share = F.when(whole >= most, 0.0).otherwise(F.greatest(F.col("rate") - whole, F.lit(0.0)))
    room = F.when(whole >= most, 0).otherwise(F.floor(F.col("target") + 1e-6) - whole * F.col("source_size")).cast("long")
    classes = materialize(classes.select("_source", "size", "n", "source_size", "target", "rate", whole.alias("_whole"), share.alias("share"), room.alias("room")), "rates")
    extra = extra_copies(classes).select(F.col("_source").alias("_s"), F.col("size").alias("_z"), "extra")
    plan = classes.join(extra, (F.col("_source") == F.col("_s")) & (F.col("size") == F.col("_z"))).drop("_s", "_z", "n", "share", "room")
    before = Window.partitionBy("_source", "size").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    starts = starts.join(plan.withColumnsRenamed({"_source": "_s", "size": "_z"}), (F.col("_source") == F.col("_s")) & (F.col("size") == F.col("_z")))
    starts = starts.select(F.col("_source").alias("_ps"), F.col("size").alias("_pz"), F.col("_salt").alias("_pt"), "_before", "source_size", "target", "rate", "_whole", "extra")
    rank = F.row_number().over(Window.partitionBy("_source", "size", "_salt").orderBy("_turn", "doc_id")) - 1
    placed = rows.withColumn("_rank", rank).join(starts, (F.col("_source") == F.col("_ps")) & (F.col("size") == F.col("_pz")) & (F.col("_salt") == F.col("_pt")))
    copies = F.when(F.col("size") > 0, F.col("_whole") + (F.col("_rank") + F.col("_before") < F.col("extra")).cast("int")).otherwise(0)
    return placed.select("doc_id", "size", "source_size", "target", (F.col("size") * copies).alias("taken"), copies.alias("copies"), F.round("rate", 9).alias("rate"), *carry)


#: Rates and levels in closed form, which the Newton steps reach; the longest-first filling as a recursion over a source's sizes.
ORACLE = r"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce(text, '') AS text, CASE WHEN source IS NULL THEN 't' ELSE 's' || source END AS source FROM documents),
w AS (SELECT doc_id, source, CAST(len(regexp_extract_all(text, '[^ 	-
]+')) AS BIGINT) AS size, md5(CASE WHEN doc_id IS NULL THEN text ELSE text || ':' || doc_id END) AS turn FROM d),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, [5e0, 2e0, 1e0][1 + (row_number() OVER (ORDER BY source) - 1) % 3] AS weight FROM w GROUP BY source),
q AS (SELECT *, 3 * source_size / weight AS cap, coalesce(sum(3 * source_size) OVER (ORDER BY 3 * source_size / weight, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below,
      sum(weight) OVER (ORDER BY 3 * source_size / weight, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS above, sum(source_size) OVER () AS total FROM s),
lv AS (SELECT (total - below) / above AS level FROM q WHERE (total - below) / above <= cap ORDER BY cap, source LIMIT 1),
t AS (SELECT source, source_size, least(weight * level, CAST(3 * source_size AS DOUBLE)) AS target FROM s, lv),
r AS (SELECT *, CASE WHEN source_size > 0 THEN least(target / source_size, 3e0) ELSE 0e0 END AS rate FROM t),
c AS (SELECT r.source, w.size, count(*) AS n, any_value(rate) AS rate, any_value(source_size) AS source_size, any_value(target) AS target, CAST(floor(any_value(rate) + 1e-9) AS BIGINT) AS whole FROM r JOIN w USING (source) GROUP BY 1, 2),
e AS (SELECT *, CASE WHEN whole >= 3 THEN 0 ELSE CAST(floor(greatest(rate - whole, 0e0) * n + 1e-6) AS BIGINT) END AS base, row_number() OVER (PARTITION BY source ORDER BY size DESC) AS k FROM c),
m AS (SELECT source, CASE WHEN any_value(whole) >= 3 THEN 0 ELSE CAST(floor(any_value(target) + 1e-6) AS BIGINT) - any_value(whole) * any_value(source_size) END - sum(base * size) AS room FROM e GROUP BY 1),
f AS (SELECT source, CAST(0 AS BIGINT) AS k, CAST(room AS BIGINT) AS room, CAST(0 AS BIGINT) AS more FROM m UNION ALL
      SELECT e.source, e.k, f.room - e.size * g.more, g.more FROM f JOIN e ON e.source = f.source AND e.k = f.k + 1,
      LATERAL (SELECT CASE WHEN e.size > 0 AND f.room > 0 THEN least(e.n - e.base, CAST(f.room // e.size AS BIGINT)) ELSE 0 END AS more) g),
p AS (SELECT e.source, e.size, e.source_size, e.target, e.rate, e.whole, e.base + f.more AS extra FROM e JOIN f USING (source, k)),
o AS (SELECT doc_id, source, size, row_number() OVER (PARTITION BY source, size ORDER BY turn, doc_id) AS nth FROM w),
x AS (SELECT doc_id, size, source_size, target, CASE WHEN size > 0 THEN whole + CASE WHEN nth <= extra THEN 1 ELSE 0 END ELSE 0 END AS copies, rate FROM o JOIN p USING (source, size))
SELECT doc_id, size, source_size, target, CAST(size * copies AS BIGINT) AS taken, CAST(copies AS INTEGER) AS copies, round(rate, 9) AS rate FROM x
"""
