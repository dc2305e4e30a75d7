"""Places in a global order without a task that holds all rows."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def places(ids: DataFrame, key: str, name: str, span: int = 1 << 20) -> DataFrame:
    """Adds the place of each distinct integer key, from zero.

    Keys are numbered within spans of `span` values; how many come before a
    span is counted with one row for each span.
    """
    cut = ids.withColumn("_s", F.floor(F.col(key) / span))
    sizes = cut.groupBy(F.col("_s").alias("_t")).agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.orderBy("_t").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_t", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_start"))
    within = F.row_number().over(Window.partitionBy("_s").orderBy(key)) - 1
    met = cut.withColumn(name, within.cast("long")).join(starts, F.col("_s") == F.col("_t"))
    return met.withColumn(name, F.col(name) + F.col("_start")).drop("_s", "_t", "_start")


def ranks(rows: DataFrame, keys: list[str], order: list[str], name: str, spans: int = 64) -> DataFrame:
    """Adds the place, from one, of each row in the order of columns within its keys, and under name + "_of" the keys' number of rows.

    A key's rows are cut into spans at approximate quantiles of the first order
    column, so a key that holds most rows is numbered by many tasks; rows that
    agree in that column stay together. keys must not be null.
    """
    named = [F.col(k).alias(f"_k_{k}") for k in keys]
    same = reduce(and_, [F.col(k) == F.col(f"_k_{k}") for k in keys])
    cuts = rows.groupBy(*named).agg(F.percentile_approx(order[0], [i / spans for i in range(1, spans)], 1000).alias("_cuts"))
    cut = rows.join(cuts, same).withColumn("_s", F.size(F.filter("_cuts", lambda c: c < F.col(order[0])))).select(*rows.columns, "_s")
    sizes = cut.groupBy(*keys, "_s").agg(F.count(F.lit(1)).alias("_n"))
    whole = Window.partitionBy(*keys)
    before = F.sum("_n").over(whole.orderBy("_s").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select(*named, F.col("_s").alias("_t"), F.coalesce(before, F.lit(0)).alias("_start"), F.sum("_n").over(whole).alias(f"{name}_of"))
    within = F.row_number().over(Window.partitionBy(*keys, "_s").orderBy(*order))
    met = cut.withColumn("_within", within).join(starts, same & (F.col("_s") == F.col("_t")))
    return met.select(*rows.columns, (F.col("_within") + F.col("_start")).alias(name), f"{name}_of")
