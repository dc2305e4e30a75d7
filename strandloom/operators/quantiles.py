"""Exact quantiles by counting: spans of values, and within them only those that hold a wanted rank."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import kept

SPANS, FEW = 128, 256
BUFFER = 1 << 16  # values of a key that one aggregation buffer may hold
BROADCAST = 1 << 17  # short rows


def _matched(keys: list[str]) -> Column:
    return reduce(and_, [F.col(k) == F.col(f"_k_{k}") for k in keys], F.lit(True))


def _small(df: DataFrame) -> DataFrame:
    """A stored table, broadcast if its rows are few."""
    return F.broadcast(df) if df.limit(BROADCAST + 1).count() <= BROADCAST else df


def quantiles(rows: DataFrame, keys: list[str], value: str, at: list[float]) -> DataFrame:
    """(keys, n, q): the number of each key's values and their quantiles, between ranks in a straight line as percentile() has them.

    Where no key has more than BUFFER values this is percentile() itself. Else
    a key's values are never sorted or held together: the values between a
    range's ends are counted in parts that approximate quantiles cut, by
    aggregation before the shuffle; of a part that holds a wanted rank, the
    least and greatest value are the next range's ends. That ends where a range
    holds one value, or at most FEW rows, which are then looked at. However the
    values are spread, each pass makes ranges almost SPANS times smaller. Nulls do not count; keys and values must not be null or
    not-a-number otherwise.
    """
    names = [F.col(k).alias(f"_k_{k}") for k in keys]
    rows = rows.filter(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("_v"))
    most = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).agg(F.max("_n").alias("most")).first().most or 0
    if most <= BUFFER:
        return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.percentile("_v", at).alias("q"))
    rows = kept(rows, "quantile-values")
    ends = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    places = F.array_distinct(F.flatten(F.array(*[F.array(F.floor(F.lit(p) * (F.col("n") - 1)).cast("long"), F.ceil(F.lit(p) * (F.col("n") - 1)).cast("long")) for p in at])))
    ranges = kept(ends.select(*keys, "n", F.explode(places).alias("rank"), "_lo", "_hi", F.lit(0).cast("long").alias("_before"), F.col("n").alias("_in")), "quantile-ranges")
    wide = (F.col("_lo") < F.col("_hi")) & (F.col("_in") > FEW)

    def inside(these: DataFrame) -> DataFrame:
        """The rows of the ranges, each range's once."""
        ranged = _small(kept(these.select(*names, "_lo", "_hi", "_before").distinct(), "quantile-open"))
        return rows.join(ranged, _matched(keys) & (F.col("_v") >= F.col("_lo")) & (F.col("_v") <= F.col("_hi")))

    while not ranges.filter(wide).isEmpty():
        open_ = ranges.filter(wide)
        near = inside(open_)
        cuts = near.groupBy(*names, F.col("_lo").alias("_clo"), F.col("_hi").alias("_chi")).agg(F.percentile_approx("_v", [i / SPANS for i in range(1, SPANS)], 10 * SPANS).alias("_cuts"))
        cuts = _small(kept(cuts, "quantile-cuts"))
        near = near.drop(*[f"_k_{k}" for k in keys]).join(cuts, _matched(keys) & (F.col("_lo") == F.col("_clo")) & (F.col("_hi") == F.col("_chi")))
        # a cut is a value of the range, and a part of its own, so that every pass makes ranges smaller
        place = 2 * F.size(F.filter("_cuts", lambda c: c < F.col("_v"))) + F.array_contains("_cuts", F.col("_v")).cast("int")
        parts = near.groupBy(*keys, "_lo", "_hi", "_before", place.alias("_part")).agg(F.count(F.lit(1)).alias("_c"), F.min("_v").alias("_a"), F.max("_v").alias("_b"))
        earlier = Window.partitionBy(*keys, "_lo", "_hi").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # twice SPANS rows at most
        parts = parts.withColumn("_start", F.col("_before") + F.coalesce(F.sum("_c").over(earlier), F.lit(0)))
        parts = parts.select(*names, F.col("_lo").alias("_plo"), F.col("_hi").alias("_phi"), "_a", "_b", "_start", "_c")
        on = _matched(keys) & (F.col("_lo") == F.col("_plo")) & (F.col("_hi") == F.col("_phi")) & (F.col("rank") >= F.col("_start")) & (F.col("rank") < F.col("_start") + F.col("_c"))
        nearer = open_.join(parts, on).select(*keys, "n", "rank", F.col("_a").alias("_lo"), F.col("_b").alias("_hi"), F.col("_start").alias("_before"), F.col("_c").alias("_in"))
        ranges = kept(ranges.filter(~wide).unionByName(nearer), "quantile-ranges")
    held = inside(ranges.filter("_lo < _hi")).groupBy(*names, F.col("_lo").alias("_hlo"), F.col("_hi").alias("_hhi")).agg(F.sort_array(F.collect_list("_v")).alias("_values"))
    met = ranges.join(held, _matched(keys) & (F.col("_lo") == F.col("_hlo")) & (F.col("_hi") == F.col("_hhi")), "left")
    found = F.when(F.col("_lo") == F.col("_hi"), F.col("_lo")).otherwise(F.get("_values", (F.col("rank") - F.col("_before")).cast("int")))
    by_rank = met.select(*keys, "n", "rank", found.alias("_x")).groupBy(*keys, "n").agg(F.map_from_entries(F.collect_list(F.struct("rank", "_x"))).alias("_m"))

    def quantile(p: float) -> Column:
        place = F.lit(p) * (F.col("n") - 1)
        low, high = F.floor(place).cast("long"), F.ceil(place).cast("long")
        return F.when(low == high, F.col("_m")[low]).otherwise((high - place) * F.col("_m")[low] + (place - low) * F.col("_m")[high])

    return by_rank.select(*keys, "n", F.array(*[quantile(p) for p in at]).alias("q"))
