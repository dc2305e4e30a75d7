"""How filters of documents interact: failing-id relations, joined for every order of the filters."""

from __future__ import annotations

from collections.abc import Mapping
from itertools import permutations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize

SPACE = r"[\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def text_filters(text: Column) -> dict[str, Column]:
    """Failure conditions of a text that is not null: short, repetitive, shouting, and of code or markup."""
    words = F.array_remove(F.split(text, SPACE, -1), "")
    count, distinct = F.size(words).cast("long"), F.size(F.array_distinct(words)).cast("long")
    upper = (F.char_length(text) - F.char_length(F.translate(text, UPPER, ""))).cast("long")
    return {"A": count < 100, "B": 100 * distinct < 80 * count, "C": 100 * upper > 10 * F.char_length(text).cast("long"), "D": F.regexp_like(text, F.lit(r"[#$%&*|]"))}


def mark(docs: DataFrame, labels: DataFrame) -> tuple[DataFrame, dict[str, DataFrame]]:
    """(row, part, good, toxic) of every document, and the table of failing rows of each filter A to E.

    The texts are read once; what is stored of them is hashes and marks. The
    first document of a text is that with its smallest id; others of the text
    with larger ids fail E, by an anti-join on hash and id, so that the copies
    of one text are spread. Documents without an id are neither first nor copies.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"), text.alias("_x"))
    conditions = text_filters(F.col("_x"))
    failed = F.array_compact(F.array(*[F.when(fails, F.lit(name)) for name, fails in conditions.items()]))
    marks = rows.select(F.monotonically_increasing_id().alias("row"), "doc_id", "part", F.unhex(F.sha2(F.col("_x"), 256)).alias("same"), failed.alias("failed"))
    marks = materialize(marks, "audit-marks")
    firsts = marks.groupBy(F.col("same").alias("_s")).agg(F.min("doc_id").alias("_first"))
    copies = marks.filter("doc_id is not null").join(firsts, (F.col("same") == F.col("_s")) & (F.col("doc_id") == F.col("_first")), "left_anti")
    failing = {name: materialize(marks.filter(F.array_contains("failed", name)).select("row"), f"audit-fails-{name}") for name in conditions}
    failing["E"] = materialize(copies.select("row"), "audit-fails-E")
    known = labels.filter("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("_id"))
    known = known.agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    # the second key spreads documents without an id, which meet no label
    apart = F.when(F.col("doc_id").isNull(), F.col("row")).otherwise(F.lit(-1))
    met = marks.join(known.withColumn("_none", F.lit(-1).cast("long")), (F.col("doc_id") == F.col("_id")) & (apart == F.col("_none")), "left")
    return met.select("row", "part", F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic")), failing


def survived(rows: DataFrame, failing: Mapping[str, DataFrame]) -> DataFrame:
    """rows and `sets`: the sets of filters that each row survives, as bits.

    One filter after another: the rows that it fails (left-semi) keep the sets
    they have, and the others (left-anti) survive each of them with the filter
    added too. A table keeps its number of rows, whatever the number of sets.
    """
    out = rows.withColumn("sets", F.array(F.lit(0)))
    for i, (name, ids) in enumerate(failing.items()):
        out = materialize(out, f"audit-before-{name}")
        bit = F.lit(1 << i)
        added = F.concat("sets", F.transform("sets", lambda s: s.bitwiseOR(bit)))  # noqa: B023
        out = out.join(ids, "row", "left_semi").unionByName(out.join(ids, "row", "left_anti").withColumn("sets", added))
    return materialize(out, "audit-survived")


def orders(spark: SparkSession, names: str) -> DataFrame:
    """(filter_order, step, filter, before, after): every order's steps, with the sets of filters before and after."""
    steps = []
    for order in permutations(names):
        before = 0
        for step, name in enumerate(order, 1):
            after = before | 1 << names.index(name)
            steps.append(("".join(order), step, name, before, after))
            before = after
    return spark.createDataFrame(steps, "filter_order string, step int, filter string, before int, after int")


def audit(rows: DataFrame, failing: Mapping[str, DataFrame]) -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley).

    rows is (row, part, good, toxic), a row for each document, and failing has
    each filter's table of ids (row), under a name of one letter. Filters, of
    which there are seven at most, are applied in every order. A set of filters
    leaves the same documents in whatever order it was applied, so survivors
    and removals are counted for sets and looked up for orders:

    kept          documents of the part that survive the filters up to this step
    removed       of the survivors before, those in the filter's table (left-semi)
    redundant     documents in its table that did not survive so far
    unique_fails  those in its table that survive all other filters
    good_lost, toxic_lost  removed ones with good = 1, toxic = 1
    shapley       its removals, summed over all orders

    Every part of rows has all its rows, zeros included. No rows, no parts.
    """
    names = "".join(failing)
    if len(names) != len(failing) or not 1 <= len(names) <= 7:
        raise ValueError("one to seven filters with names of one letter are needed")
    spark = rows.sparkSession
    whole = survived(rows, failing)
    one = F.lit(1).cast("long")
    kept = whole.select("part", F.explode("sets").alias("_after")).groupBy(F.col("part").alias("_kp"), "_after").agg(F.sum(one).alias("_kept"))
    lost, fails = [], []
    for i, (name, ids) in enumerate(failing.items()):
        own = whole.join(ids, "row", "left_semi").withColumn("_f", F.lit(name))
        fails.append(own.groupBy(F.col("part").alias("_fp"), "_f").agg(F.sum(one).alias("_fails")))
        bit = F.lit(1 << i)
        before = own.select("part", "_f", "good", "toxic", F.explode(F.filter("sets", lambda s: s.bitwiseAND(bit) == 0)).alias("_before"))  # noqa: B023
        sums = {"_n": one, "_good": F.col("good").cast("long"), "_toxic": F.col("toxic").cast("long")}
        lost.append(before.groupBy("part", "_f", "_before").agg(*[F.sum(v).alias(k) for k, v in sums.items()]))
    for more in (lost, fails):
        while len(more) > 1:
            more.append(more.pop(0).unionByName(more.pop(0)))
    # counts, a row for each part and set; read more than once below
    lost = materialize(lost[0].withColumnRenamed("part", "_lp"), "audit-lost")
    alone = lost.select(F.col("_lp").alias("_up"), F.col("_f").alias("_uf"), F.col("_before").alias("_others"), F.col("_n").alias("_unique"))
    grid = rows.select("part").distinct().crossJoin(F.broadcast(orders(spark, names)))  # as many steps as the filters have, for each part
    rest = F.lit((1 << len(names)) - 1) - (F.col("after") - F.col("before"))
    out = grid.join(kept, (F.col("part") == F.col("_kp")) & (F.col("after") == F.col("_after")), "left")
    out = out.join(lost, (F.col("part") == F.col("_lp")) & (F.col("filter") == F.col("_f")) & (F.col("before") == F.col("_before")), "left").drop("_f")
    out = out.join(fails[0], (F.col("part") == F.col("_fp")) & (F.col("filter") == F.col("_f")), "left")
    out = out.join(alone, (F.col("part") == F.col("_up")) & (F.col("filter") == F.col("_uf")) & (rest == F.col("_others")), "left")
    count = lambda name: F.coalesce(F.col(name), F.lit(0)).cast("long")
    out = out.withColumn("_n", count("_n"))
    return out.select(
        "part", "filter_order", "step", count("_kept").alias("kept"), F.col("_n").alias("removed"), (count("_fails") - F.col("_n")).alias("redundant"),
        count("_unique").alias("unique_fails"), count("_good").alias("good_lost"), count("_toxic").alias("toxic_lost"),
        F.sum("_n").over(Window.partitionBy("part", "filter")).alias("shapley"),
    )


def filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The audit of five filters over whole texts, by language.

    Fail: A under 100 words; B fewer than 80 distinct words in 100; C more than
    10 capital letters A-Z in 100 code points; D any of #$%&*|; E the text of a
    document with a smaller id. Words are maximal runs without white space.

    A null text is empty: it fails A, and E where an empty text has a smaller
    id. A null language is the empty string. A document without an id meets no
    label and no E. Rows that repeat an id are documents of their own, and none
    of equal id fails E by the other; labels that repeat one count as one, good
    or toxic if any is. Texts of any length are read whole. Other columns are
    not looked at. An empty table gives an empty result.
    """
    return audit(*mark(docs, labels))


ORACLE = r"""
WITH t AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS x, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY 1),
m AS (SELECT part, CAST(len(w) < 100 AS INT) + 2 * CAST(100 * len(list_distinct(w)) < 80 * len(w) AS INT) + 4 * CAST(100 * length(regexp_replace(x, '[^A-Z]', '', 'g')) > 10 * length(x) AS INT)
  + 8 * CAST(regexp_matches(x, '[#$%&*|]') AS INT) + 16 * CAST(coalesce(doc_id > min(doc_id) OVER (PARTITION BY x), false) AS INT) AS mask, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic FROM t LEFT JOIN g USING (doc_id)),
c AS (SELECT part, mask, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM m GROUP BY 1, 2),
f AS (SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) v(name, bit)),
o AS (SELECT a.name || b.name || c.name || d.name || e.name AS filter_order FROM f a, f b, f c, f d, f e WHERE a.bit | b.bit | c.bit | d.bit | e.bit = 31),
s AS (SELECT filter_order, step, bit, coalesce((SELECT sum(p.bit) FROM f p WHERE contains(left(filter_order, step - 1), p.name)), 0) AS before
  FROM o, (SELECT unnest(range(1, 6)) AS step), f WHERE f.name = filter_order[step]),
r AS (SELECT part, filter_order, step, bit, coalesce(sum(n) FILTER (mask & (CAST(before AS INT) | bit) = 0), 0) AS kept, coalesce(sum(n) FILTER (mask & bit > 0 AND mask & CAST(before AS INT) = 0), 0) AS removed,
  coalesce(sum(n) FILTER (mask & bit > 0 AND mask & CAST(before AS INT) > 0), 0) AS redundant, coalesce(sum(n) FILTER (mask = bit), 0) AS unique_fails,
  coalesce(sum(good) FILTER (mask & bit > 0 AND mask & CAST(before AS INT) = 0), 0) AS good_lost, coalesce(sum(toxic) FILTER (mask & bit > 0 AND mask & CAST(before AS INT) = 0), 0) AS toxic_lost FROM c, s GROUP BY 1, 2, 3, 4)
SELECT part, filter_order, CAST(step AS INT) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
  CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley FROM r
"""
