"""Hard negatives: segment summaries bound integer inner products, finer ones where coarse ones leave them open."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, partitions, small_arrow_batches
from .embeddings import as_matrix

LEVELS = (4, 16, 32)  # segments of a vector, coarse to fine
ROWS, ANCHORS = 4096, 256  # scored at once
EXACT = 2.0**53
LEAST, MOST = -(2**63), 2**63 - 1


def finite(vector: Column) -> Column:
    """Not null, and no null or non-finite component."""
    return vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))


def quantised(vectors: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        out = np.floor(256 * vectors)
    if np.isfinite(out).all():
        return out
    return np.array([[int(x) * 256 if abs(x) > EXACT else int(np.floor(256 * x)) for x in row] for row in vectors.tolist()], object).reshape(vectors.shape)


class Summaries:
    """Means and deviations of each vector's segments, at every level, made when they are first asked for."""

    def __init__(self, vectors: np.ndarray):
        self.vectors, self.levels = vectors, {}

    def at(self, segments: int) -> tuple[np.ndarray, np.ndarray]:
        """Both are scaled by the root of the segment's length, so that products need no weights."""
        if segments not in self.levels:
            width = self.vectors.shape[1]
            ends = np.linspace(0, width, segments + 1).round().astype(int)
            parts = [self.vectors[:, a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]
            root = np.sqrt(np.diff(ends))
            self.levels[segments] = (np.stack([p.mean(axis=1) for p in parts], axis=1) * root, np.stack([p.std(axis=1) for p in parts], axis=1) * root)
        return self.levels[segments]


def inner(anchors: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Inner products as whole numbers, exact; beyond a long they are held at its ends."""
    if anchors.dtype != object and rows.dtype != object:
        width = anchors.shape[1]
        most = np.abs(anchors).max(initial=0) * np.abs(rows).max(initial=0) * max(1, width)
        if most < EXACT:  # so are all partial sums, in any order
            return (anchors @ rows.T).astype(np.int64)
    whole = lambda m: np.array([[int(x) for x in row] for row in m.tolist()], object).reshape(m.shape)
    found = whole(anchors) @ whole(rows).T if anchors.shape[1] else np.zeros((len(anchors), len(rows)), object)
    return np.array([[min(max(int(x), LEAST), MOST) for x in row] for row in found.tolist()], np.int64).reshape(found.shape)


class Search:
    """The first k rows of each of an anchor's score ranges, by score and then by smaller id."""

    def __init__(self, rows: np.ndarray, ids: np.ndarray, k: int):
        self.k = k
        self.ids, self.rows = ids, rows
        self.tested: dict[int, list[int]] = {s: [0, 0] for s in LEVELS if s < rows.shape[1]}  # pairs tested, pairs ruled out
        self.scored = 0
        self.exact_only = rows.dtype == object
        self.chunks = [] if self.exact_only else [Summaries(rows[a : a + ROWS]) for a in range(0, len(rows), ROWS)]

    def useful(self, segments: int) -> bool:
        """A level that rules out less than a hundredth of what it tests is left out after a while; no result depends on it."""
        tested, ruled_out = self.tested[segments]
        return tested < 1 << 20 or ruled_out * 100 >= tested

    def bounded(self, anchors: Summaries, rows: Summaries, least: np.ndarray, most: np.ndarray, allowed: np.ndarray) -> np.ndarray:
        """Which allowed pairs may have a score from least to most: levels in turn, each on what the last left open.

        A segment's products sum to the product of means, plus or minus the
        product of deviations at most, each times the segment's length.
        """
        slack = 1e-9 * (1 + np.sqrt((anchors.vectors**2).sum(axis=1).max(initial=0) * (rows.vectors**2).sum(axis=1).max(initial=0)))
        open_ = allowed
        for segments in self.tested:
            if not self.useful(segments) or not open_.any():
                continue
            (am, ad), (rm, rd) = anchors.at(segments), rows.at(segments)
            before = int(open_.sum())
            if before * 8 > open_.size:
                middle, spread = am @ rm.T, ad @ rd.T + slack
                open_ = open_ & (middle + spread >= least[:, None]) & (middle - spread <= most[:, None])
            else:
                i, j = np.nonzero(open_)
                middle, spread = (am[i] * rm[j]).sum(axis=1), (ad[i] * rd[j]).sum(axis=1) + slack
                left = (middle + spread >= least[i]) & (middle - spread <= most[i])
                open_ = np.zeros_like(open_)
                open_[i[left], j[left]] = True
            self.tested[segments][0] += before
            self.tested[segments][1] += before - int(open_.sum())
        return open_

    def scores(self, anchors: np.ndarray, rows: np.ndarray, wanted: np.ndarray) -> np.ndarray:
        """Exact scores of the wanted pairs: pair by pair where few are left, else of all in one product."""
        i, j = np.nonzero(wanted)
        most = 0 if anchors.dtype == object or rows.dtype == object else np.abs(anchors).max(initial=0) * np.abs(rows).max(initial=0) * anchors.shape[1]
        if len(i) * 8 > wanted.size or not 0 < most < EXACT:
            self.scored += wanted.size
            return inner(anchors, rows)
        self.scored += len(i)
        out = np.zeros(wanted.shape, np.int64)
        out[i, j] = np.einsum("pd,pd->p", anchors[i], rows[j]).astype(np.int64)
        return out

    def first(self, anchors: np.ndarray, low: np.ndarray, high: np.ndarray, allowed: Callable[[slice, slice], np.ndarray]) -> list[tuple[int, int, int, int]]:
        """(anchor, range, id, score) of the k first in each range from low to high, both anchors x ranges.

        allowed tells which pairs of a slice of anchors and one of rows count.
        A range's k-th score so far is its lower end from then on.
        """
        out = []
        for start in range(0, len(anchors), ANCHORS):
            mine = slice(start, min(start + ANCHORS, len(anchors)))
            own, floor, high_ = anchors[mine], low[mine].copy(), high[mine]
            summaries = None if own.dtype == object else Summaries(own)
            best: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}
            for at in range(0, len(self.rows), ROWS):
                block = slice(at, min(at + ROWS, len(self.rows)))
                rows, ids, wanted = self.rows[block], self.ids[block], allowed(mine, block)
                valid = floor <= high_
                least, most = np.where(valid, floor, MOST).min(axis=1), np.where(valid, high_, LEAST).max(axis=1)
                wanted = wanted & valid.any(axis=1)[:, None]
                if summaries is not None and not self.exact_only:
                    wanted = self.bounded(summaries, self.chunks[at // ROWS], least.astype(float), most.astype(float), wanted)
                near = np.flatnonzero(wanted.any(axis=0))
                if not len(near):
                    continue
                wanted, rows, ids = wanted[:, near], rows[near], ids[near]
                score = self.scores(own, rows, wanted)
                wanted = wanted & (score >= least[:, None]) & (score <= most[:, None])
                for i in np.flatnonzero(wanted.any(axis=1)).tolist():
                    j = np.flatnonzero(wanted[i])
                    values, names = score[i, j], ids[j]
                    for q in np.flatnonzero(valid[i]).tolist():
                        fits = (values >= floor[i, q]) & (values <= high_[i, q])
                        if not fits.any():
                            continue
                        v, n = values[fits], names[fits]
                        if (i, q) in best:
                            v, n = np.concatenate([best[i, q][0], v]), np.concatenate([best[i, q][1], n])
                        # -v would overflow at a long's lower end, ~v does not
                        order = np.lexsort((n, ~v))[: self.k]
                        best[i, q] = v[order], n[order]
                        if len(order) == self.k:
                            floor[i, q] = v[order[-1]]
            for (i, q), (v, n) in best.items():
                out += [(start + i, q, m, s) for m, s in zip(n.tolist(), v.tolist(), strict=True)]
        return out


def dealt(rows: DataFrame, asked: DataFrame, keys: list[str], block_rows: int, anchor_rows: int) -> tuple[DataFrame, DataFrame, list[str]]:
    """Both sides in parts, so that each part of a key's rows meets each part of the key's anchors once.

    A key's rows are cut by hash into parts of about block_rows, its anchors
    into turns of about anchor_rows; keys are few, but one may have most rows.
    """
    there = asked.groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(F.count(F.lit(1)).alias("_q"))
    plan = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).join(there, [F.col(k) == F.col(f"_{k}") for k in keys])
    plan = plan.select(*[F.col(f"_{k}") for k in keys], F.ceil(F.col("_n") / block_rows).cast("int").alias("_parts"), F.ceil(F.col("_q") / anchor_rows).cast("int").alias("_turns"))
    plan = materialize(plan, "negatives-plan")
    plan = F.broadcast(plan) if plan.limit(10_001).count() <= 10_000 else plan
    same = [F.col(k) == F.col(f"_{k}") for k in keys]
    data = rows.join(plan, same).withColumn("part", F.pmod(F.xxhash64("row"), F.col("_parts")).cast("int")).withColumn("turn", F.explode(F.sequence(F.lit(0), F.col("_turns") - 1)))
    ask = asked.join(plan, same).withColumn("turn", F.pmod(F.xxhash64("row"), F.col("_turns")).cast("int")).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)))
    helpers = [f"_{k}" for k in keys] + ["_parts", "_turns"]
    return data.drop(*helpers), ask.drop(*helpers), [*keys, "part", "turn"]


def prepared(vectors: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """(row, vec_id, label, size, vector) of the rows that take part, labels moved where the id is divisible by 7."""
    vec_id, label = F.col(id_col).cast("long"), F.col(label_col).cast("long")
    label = F.when(F.pmod(vec_id, F.lit(7)) == 0, (label + 1) % 10).otherwise(label)
    rows = vectors.select(F.monotonically_increasing_id().alias("row"), vec_id.alias("vec_id"), label.alias("label"), F.col(vector_col).alias("vector"))
    rows = rows.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.coalesce(finite(F.col("vector")), F.lit(False)))
    return materialize(rows.select("row", "vec_id", "label", F.size("vector").alias("size"), "vector"), "negatives-rows")


def hard_negatives(vectors: DataFrame, every: int = 100, positives: int = 5, k: int = 10, low: int = 30, high: int = 90, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", block_rows: int = 16_384, anchor_rows: int = 2048) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    Anchors are the rows whose id is divisible by `every`. A row's score is the
    inner product with the anchor of vectors rounded down to 256ths, a whole
    number. An anchor's positives are its first `positives` rows of the same
    label, by score and smaller id; for each, the first k rows of other labels
    with low to high hundredths of the positive's score are its negatives. All
    rows are searched and the results are exact: summaries of vector segments
    rule out pairs whose bounds miss every range, and the others are scored.

    Rows with a null id, label or vector, or with null or non-finite components,
    take no part; zero and empty vectors do. Vectors of different lengths are
    not compared, nor are rows with the anchor's id. Rows that repeat one
    another are anchors, positives and negatives each. Scores beyond a long are
    held at its ends. Other columns are not looked at. Without rows there are
    no results.
    """
    spark = vectors.sparkSession
    small_arrow_batches(spark)
    rows = prepared(vectors, id_col, vector_col, label_col)
    anchors = rows.filter(F.col("vec_id") % every == 0)
    block = max(2048, min(block_rows, -(-rows.count() // partitions(spark))))

    def meet(found: Callable[[pa.Table, pa.Table, np.ndarray, np.ndarray], pa.Table]):
        def run(left: pa.Table, right: pa.Table) -> pa.Table:
            right = right.rename_columns([x.removeprefix("to_") for x in right.column_names])
            if not left.num_rows or not right.num_rows:
                return found(left.slice(0, 0), right.slice(0, 0), np.zeros((0, 1)), np.zeros((0, 1)))
            return found(left, right, quantised(as_matrix(left.column("vector"))), quantised(as_matrix(right.column("vector"))))

        return run

    def near(left: pa.Table, right: pa.Table, data: np.ndarray, asked: np.ndarray) -> pa.Table:
        ids, own = left.column("vec_id").to_numpy(), right.column("vec_id").to_numpy()
        ends = np.full((len(asked), 1), MOST, np.int64)
        out = Search(data, ids, positives).first(asked, np.full_like(ends, LEAST), ends, lambda a, r: own[a, None] != ids[None, r]) if len(asked) else []
        nth, _, found, score = (np.array(x, np.int64) for x in zip(*out, strict=True)) if out else [np.zeros(0, np.int64)] * 4
        return pa.table({"row": right.column("row").take(pa.array(nth)), "positive_id": pa.array(found), "score": pa.array(score)})

    def hard(left: pa.Table, right: pa.Table, data: np.ndarray, asked: np.ndarray) -> pa.Table:
        ids, labels, own = left.column("vec_id").to_numpy(), left.column("label").to_numpy(), right.column("label").to_numpy()
        given = right.column("positives").to_pylist()
        least, most = (np.full((len(asked), positives), end, np.int64) for end in (MOST, LEAST))
        for i, those in enumerate(given):
            for p in those:  # the ranges' ends in whole numbers
                least[i, p["place"] - 1], most[i, p["place"] - 1] = -(-low * p["score"] // 100), high * p["score"] // 100
        out = Search(data, ids, k).first(asked, least, most, lambda a, r: own[a, None] != labels[None, r]) if len(asked) else []
        nth, place, found, score = (np.array(x, np.int64) for x in zip(*out, strict=True)) if out else [np.zeros(0, np.int64)] * 4
        return pa.table({"row": right.column("row").take(pa.array(nth)), "place": pa.array(place + 1), "negative_id": pa.array(found), "negative_score": pa.array(score)})

    def cogroup(data: DataFrame, ask: DataFrame, keys: list[str], function, schema: str) -> DataFrame:
        ask = ask.select(*[F.col(x).alias(f"to_{x}") for x in ask.columns])  # both come from the same rows
        return data.groupBy(*keys).cogroup(ask.groupBy(*[f"to_{x}" for x in keys])).applyInArrow(meet(function), schema)

    data, ask, keys = dealt(rows.select("size", "label", "row", "vec_id", "vector"), anchors, ["size", "label"], block, anchor_rows)
    found = cogroup(data, ask, keys, near, "row long, positive_id long, score long")
    place = F.row_number().over(Window.partitionBy("row").orderBy(F.desc("score"), "positive_id"))
    chosen = materialize(found.withColumn("place", place).filter(F.col("place") <= positives), "negatives-positives")
    listed = chosen.groupBy(F.col("row").alias("_row")).agg(F.array_sort(F.collect_list(F.struct("place", "score"))).alias("positives"))  # `positives` of them at most
    asked = materialize(anchors.join(listed, F.col("row") == F.col("_row")).drop("_row"), "negatives-anchors")
    data, ask, keys = dealt(rows.select("size", "label", "row", "vec_id", "vector"), asked, ["size"], block, anchor_rows)
    found = cogroup(data, ask, keys, hard, "row long, place long, negative_id long, negative_score long")
    rank = F.row_number().over(Window.partitionBy("row", "place").orderBy(F.desc("negative_score"), "negative_id"))
    best = found.withColumn("rank", rank).filter(F.col("rank") <= k)
    named = chosen.select(F.col("row").alias("_row"), F.col("place").cast("long").alias("_place"), "positive_id", F.col("score").alias("positive_score"))
    out = best.join(named, (F.col("row") == F.col("_row")) & (F.col("place") == F.col("_place")))
    out = out.join(anchors.select(F.col("row").alias("_anchor"), F.col("vec_id").alias("anchor_id")), F.col("row") == F.col("_anchor"))
    return out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


ORACLE = """
WITH v AS (SELECT CAST(vec_id AS BIGINT) AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(CAST(embedding AS DOUBLE[]), lambda e: floor(256 * e)) AS x FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND list_count(embedding) = len(embedding) AND len(list_filter(embedding, lambda e: NOT isfinite(e))) = 0),
s AS (SELECT a.id AS a, b.id AS b, a.label = b.label AS same, CAST(list_inner_product(a.x, b.x) AS BIGINT) AS score FROM v a, v b WHERE a.id % 100 = 0 AND a.id <> b.id AND len(a.x) = len(b.x)),
p AS (SELECT a, b, score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, b) <= 5)
SELECT p.a AS anchor_id, p.b AS positive_id, CAST(row_number() OVER (PARTITION BY p.a, p.b ORDER BY n.score DESC, n.b) AS INT) AS rank, n.b AS negative_id, p.score AS positive_score, n.score AS negative_score
FROM p JOIN s n ON n.a = p.a AND NOT n.same AND 30 * p.score <= 100 * n.score AND 100 * n.score <= 90 * p.score QUALIFY rank <= 10
"""
