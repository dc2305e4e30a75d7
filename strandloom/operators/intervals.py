"""Masks of half-open intervals, as joins on integer buckets."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def merged(masks: DataFrame, span: int = 1 << 20) -> DataFrame:
    """(a, b, before): disjoint intervals, overlapping and touching ones made one.

    before is the end of the interval before, null for the first. Positions are
    cut into spans of `span`; what earlier spans reach, and where their last
    interval begins, comes from a pass with one row for each span, so no task
    holds all masks.
    """
    rows = masks.select("a", "b", F.floor(F.col("a") / span).alias("_s"))
    within = Window.partitionBy("_s").orderBy("a", "b")
    reach = F.greatest(F.max("b").over(within.rowsBetween(Window.unboundedPreceding, -1)), F.col("_b_before"))
    marked = _carried(rows, "b").withColumn("before", reach)
    marked = marked.withColumn("_from", F.when(F.col("before").isNull() | (F.col("a") > F.col("before")), F.col("a")))
    run = F.greatest(F.max("_from").over(within.rowsBetween(Window.unboundedPreceding, Window.currentRow)), F.col("_from_before"))
    numbered = _carried(marked.drop("_b_before"), "_from").withColumn("_run", run)
    first = F.max(F.when(F.col("_from").isNotNull(), F.col("before")))
    return numbered.groupBy(F.col("_run").alias("a")).agg(F.max("b").alias("b"), first.alias("before"))


def _carried(rows: DataFrame, value: str) -> DataFrame:
    """Adds the largest value of all earlier spans."""
    tops = rows.groupBy(F.col("_s").alias("_t")).agg(F.max(value).alias("_top"))
    earlier = Window.orderBy("_t").rowsBetween(Window.unboundedPreceding, -1)
    name = f"_{value.lstrip('_')}_before"
    return rows.join(tops.select("_t", F.max("_top").over(earlier).alias(name)), F.col("_s") == F.col("_t")).drop("_t")


def buckets(masks: DataFrame, size: int, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, win, a, b): the windows that each interval overlaps, by an equi-join key."""
    whole = masks.filter("a < b")
    return whole.select(*keys, F.explode(F.sequence(F.floor(F.col("a") / size).cast("long"), F.floor((F.col("b") - 1) / size).cast("long"))).alias("win"), "a", "b")


def outside(sites: DataFrame, masks: DataFrame, size: int = 4096, keys: Sequence[str] = ()) -> DataFrame:
    """Sites in no interval: an anti-join on the bucket, the range checked within it.

    With keys, such as the contig, a mask hides sites of its own keys only.
    """
    near = buckets(masks, size, keys).withColumnsRenamed({"win": "_win"} | {k: f"_k_{k}" for k in keys})
    site = sites.withColumn("_b", F.floor(F.col("pos") / size).cast("long"))
    met = reduce(and_, [F.col(k) == F.col(f"_k_{k}") for k in keys], F.lit(True)) & (F.col("_b") == F.col("_win")) & (F.col("pos") >= F.col("a")) & (F.col("pos") < F.col("b"))
    return site.join(near, met, "left_anti").drop("_b")


def mask_windows(het: DataFrame, masks: DataFrame, size: int, value: str = "n_het", keys: Sequence[str] = ()) -> DataFrame:
    """-1 in every window that overlaps an interval, of the same keys if there are any."""
    hit = buckets(masks, size, keys).select(*keys, "win").distinct().withColumn("_hit", F.lit(True))
    return het.join(hit, [*keys, "win"], "left").withColumn(value, F.when(F.col("_hit"), F.lit(-1)).otherwise(F.col(value)).cast("long")).drop("_hit")


def subtract(whole: DataFrame, masks: DataFrame) -> DataFrame:
    """What of the interval (a, b) of the one row of whole no mask covers."""
    bounds = whole.select(F.col("a").alias("_lo"), F.col("b").alias("_hi")).limit(1)
    cut = merged(masks).crossJoin(F.broadcast(bounds)).filter((F.col("b") > F.col("_lo")) & (F.col("a") < F.col("_hi")))
    gaps = cut.select(F.greatest("before", "_lo").alias("a"), F.col("a").alias("b"))
    reach = cut.agg(F.max("b").alias("_reach"))
    rest = bounds.crossJoin(F.broadcast(reach)).select(F.greatest("_reach", "_lo").alias("a"), F.col("_hi").alias("b"))
    return gaps.union(rest).filter("a < b")
