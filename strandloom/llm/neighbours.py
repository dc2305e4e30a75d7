"""Approximate nearest neighbours: stable projections in a kd-tree, chi-square stop."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, small_arrow_batches
from .embeddings import as_matrix, usable

SAMPLE, MOST_LEAVES = 8192, 512
BATCH = 256  # rows verified at once
ROUNDING = 1e-20  # of a square, far below what double precision tells apart


def chi_square_quantile(p: float, even_degrees: int) -> float:
    """The p-quantile of the chi-square law with an even number of degrees."""

    def above(x: float) -> float:
        term, total = 1.0, 1.0
        for i in range(1, even_degrees // 2):
            term *= x / 2 / i
            total += term
        return math.exp(-x / 2) * total

    low, high = 0.0, 1.0
    while above(high) > 1 - p:
        high *= 2
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if above(mid) > 1 - p else (low, mid)
    return high


def kd_leaves(points: np.ndarray, size: int = 128) -> list[np.ndarray]:
    """Leaves of a kd-tree: row numbers, cut at the median of the widest axis."""
    out, open_ = [], [np.arange(len(points))]
    while open_:
        rows = open_.pop()
        if len(rows) <= size:
            out.append(rows)
            continue
        axis = int(np.argmax(np.ptp(points[rows], axis=0)))
        order = rows[np.argpartition(points[rows, axis], len(rows) // 2)]
        open_ += [order[: len(rows) // 2], order[len(rows) // 2 :]]
    return out


class Block:
    """Rows of a block with their projections, in the leaves of a kd-tree."""

    def __init__(self, ids: np.ndarray, data: np.ndarray, axes: np.ndarray):
        flat = data @ axes
        leaves = kd_leaves(flat)
        order = np.concatenate(leaves)
        self.axes = axes
        self.ids, self.data, self.flat = ids[order], data[order], flat[order]
        self.ends = np.cumsum([len(x) for x in leaves])
        self.starts = self.ends - [len(x) for x in leaves]
        self.low = np.array([self.flat[a:b].min(axis=0) for a, b in zip(self.starts, self.ends, strict=True)])
        self.high = np.array([self.flat[a:b].max(axis=0) for a, b in zip(self.starts, self.ends, strict=True)])
        self.verified = 0

    def by_projection(self, at: np.ndarray, most: Callable[[], float]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(rows, squares of projected distances): batches of rows, nearest in the projection first, up to most().

        Leaves are opened by the distance of their boxes; rows of opened leaves
        are handed on once no box that is still closed can hold a nearer one.
        """
        box = (np.maximum(np.maximum(self.low - at, at - self.high), 0) ** 2).sum(axis=1)
        order = np.argsort(box, kind="stable")
        box = box[order]
        rows, gaps, nth, done = np.zeros(0, np.int64), np.zeros(0), 0, 0
        while True:
            reach = gaps[done] if done < len(rows) else (box[nth] if nth < len(box) else math.inf)
            if nth < len(box) and box[nth] <= min(reach, most()):
                after = int(np.searchsorted(box, min(reach, most()), "right"))
                new = np.concatenate([np.arange(self.starts[x], self.ends[x]) for x in order[nth:after]])
                nth = after
                rows, gaps = np.concatenate([rows[done:], new]), np.concatenate([gaps[done:], ((self.flat[new] - at) ** 2).sum(axis=1)])
                sort = np.argsort(gaps, kind="stable")
                rows, gaps, done = rows[sort], gaps[sort], 0
                continue
            if done == len(rows) or gaps[done] > most():
                return
            upto = min(done + BATCH, int(np.searchsorted(gaps, box[nth], "right")) if nth < len(box) else len(gaps))
            yield rows[done:upto], gaps[done:upto]
            done = upto

    def search(self, own: int, query: np.ndarray, bound: float, k: int, stop: float) -> tuple[np.ndarray, np.ndarray]:
        """The ids and squared distances of the k rows nearest to a query that are found within its bound.

        With d the k-th distance so far, a row nearer than d is projected beyond
        stop * d ** 2 with the test's small probability only. So rows are
        verified on the original vectors in the order of the projection, until
        the next one's projected distance is beyond that.
        """
        limit, slack = bound**2 * (1 + 1e-9), ROUNDING * float(query @ query)  # copies need not project to equal numbers
        best_d, best_i, worst = np.zeros(0), np.zeros(0, np.int64), limit
        most = lambda: stop * worst + slack
        for rows, gaps in self.by_projection(query @ self.axes, most):
            rows = rows[(gaps <= most()) & (self.ids[rows] != own)]
            self.verified += len(rows)
            square = ((self.data[rows] - query) ** 2).sum(axis=1)
            best_d, best_i = np.concatenate([best_d, square]), np.concatenate([best_i, self.ids[rows]])
            first = np.lexsort((best_i, best_d))[:k]
            best_d, best_i = best_d[first], best_i[first]
            worst = min(limit, best_d[-1]) if len(first) == k else limit
        return best_i, best_d


def search_block(ids: np.ndarray, data: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, bounds: np.ndarray, k: int, stop: float, axes: np.ndarray) -> list[tuple[int, int, float]]:
    """(number of the query, neighbour, distance): the k nearest that each query finds in this block."""
    block, out = Block(ids, data, axes), []
    for nth, (own, query, bound) in enumerate(zip(query_ids.tolist(), queries, bounds.tolist(), strict=True)):
        found, square = block.search(own, query, bound, k, stop)
        out += zip([nth] * len(found), found.tolist(), np.sqrt(square).tolist(), strict=True)
    return out


def kd_splits(points: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Axis and cut of each inner node of a full kd-tree, in the order of a heap."""
    axes, cuts = np.zeros(2**depth - 1, np.int64), np.zeros(2**depth - 1)
    held = [points]
    for node in range(2**depth - 1):
        own = held[node]
        if len(own):
            axes[node] = np.argmax(np.ptp(own, axis=0))
            cuts[node] = np.median(own[:, axes[node]])
        right = own[:, axes[node]] > cuts[node]
        held += [own[~right], own[right]]
    return axes, cuts


def leaf_of(points: np.ndarray, axes: np.ndarray, cuts: np.ndarray, depth: int) -> np.ndarray:
    node = np.zeros(len(points), np.int64)
    for _ in range(depth):
        node = 2 * node + 1 + (points[np.arange(len(points)), axes[node]] > cuts[node])
    return node - (2**depth - 1)


def _axes(seed: int, width: int, projections: int) -> np.ndarray:
    return np.random.default_rng([seed, width]).normal(size=(width, projections))


def _project(column: pa.Array, seed: int, projections: int) -> np.ndarray:
    """Projections of vectors that may differ in length."""
    data, sizes = as_matrix(column), column.value_lengths().to_numpy()
    out = np.zeros((len(sizes), projections))
    for width in np.unique(sizes):
        out[sizes == width] = data[sizes == width, :width] @ _axes(seed, width, projections)
    return out


def nearest(vectors: DataFrame, every: int = 100, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", projections: int = 24, confidence: float = 0.97, block_rows: int = 8192, query_rows: int = 4096, sample: int = SAMPLE, seed: int = 11) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest by Euclidean distance.

    Queries are the rows whose id is divisible by `every`; candidates all rows
    but those with the query's id. A kd-tree over `projections` Gaussian
    projections, its cuts taken from `sample` rows at most, deals all rows into
    leaves. A query first searches its own leaf; the k-th distance found there
    is its bound, and by the stopping test it goes on only to the leaves whose
    boxes the bound leaves open. Leaves, of which there are MOST_LEAVES at most,
    are cut by hash into blocks of about block_rows, each with a finer kd-tree
    of its own, which hands on rows in the order of their projections. A neighbour is lost with a probability of about 1 - confidence,
    whatever the number of rows.

    Vectors null, zero or with null or non-finite components take no part, nor
    do rows without an id; vectors of different lengths are not compared. With
    fewer candidates than k all are returned; ties go to the smaller id;
    repeated rows are candidates each. Other columns are not looked at. An
    empty table gives an empty result.
    """
    if projections % 2:
        raise ValueError("projections must be even")
    spark = vectors.sparkSession
    small_arrow_batches(spark)
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("vector"))
    rows = rows.filter(F.col("vec_id").isNotNull() & usable(F.col("vector"))).withColumn("size", F.size("vector"))
    count = rows.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("size").alias("sizes")).first()
    wanted = max(1, -(-count.n // block_rows))  # by rows alone: which neighbours are missed does not change with a session
    depth = int(math.log2(min(MOST_LEAVES, wanted)))
    axes, cuts = np.zeros(0, np.int64), np.zeros(0)
    if depth:
        picked = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).select("vector").toArrow()
        axes, cuts = kd_splits(_project(picked.column("vector").combine_chunks(), seed, projections), depth)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = _project(batch.column(1), seed, projections)
            leaf = pa.array(leaf_of(flat, axes, cuts, depth).astype(np.int32))
            ends = pa.array(np.arange(0, flat.size + 1, projections, dtype=np.int32))
            yield pa.RecordBatch.from_arrays([*batch.columns, leaf, pa.ListArray.from_arrays(ends, pa.array(flat.ravel()))], [*batch.schema.names, "leaf", "flat"])

    kind = rows.schema["vector"].dataType.simpleString()
    placed = materialize(rows.mapInArrow(place, f"vec_id long, vector {kind}, size int, leaf int, flat array<double>"), "placed")
    bounded = F.broadcast if count.sizes <= 64 else (lambda df: df)  # a row for each leaf and length
    stop = chi_square_quantile(confidence, projections)
    target = max(2048, -(-count.n // wanted))
    queries = placed.filter(F.col("vec_id") % every == 0).withColumnRenamed("vec_id", "query_id").withColumn("tag", F.xxhash64("vector"))

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple[int, int, float]] = []
        if left.num_rows and right.num_rows:
            data, asked = as_matrix(left.column("vector")), as_matrix(right.column("query"))
            out = search_block(left.column("vec_id").to_numpy(), data, right.column("query_id").to_numpy(), asked, right.column("bound").to_numpy(), k, stop, _axes(seed, data.shape[1], projections))
        nth, found, score = zip(*out, strict=True) if out else ([], [], [])
        nth = pa.array(nth, pa.int64())
        return pa.table([right.column("query_id").take(nth), right.column("tag").take(nth), pa.array(found, pa.int64()), pa.array(score, pa.float64())], ["query_id", "tag", "vec_id", "score"])

    def visit(asked: DataFrame) -> DataFrame:
        """What queries (query_id, tag, vector, size, leaf, bound) find in their leaves."""
        here = placed.groupBy("size", "leaf").agg(F.count(F.lit(1)).alias("_n"))
        there = asked.groupBy(F.col("size").alias("_z"), F.col("leaf").alias("_f")).agg(F.count(F.lit(1)).alias("_q"))
        plan = here.join(bounded(there), (F.col("size") == F.col("_z")) & (F.col("leaf") == F.col("_f")))
        plan = bounded(plan.select("_z", "_f", F.ceil(F.col("_n") / target).alias("_parts"), F.ceil(F.col("_q") / query_rows).alias("_turns")))
        same = (F.col("size") == F.col("_z")) & (F.col("leaf") == F.col("_f"))
        first = F.lit(0).cast("long")
        data = placed.select("vec_id", "vector", "size", "leaf").join(plan, same).withColumn("part", F.pmod(F.xxhash64("vec_id", "vector"), F.col("_parts"))).withColumn("turn", F.explode(F.sequence(first, F.col("_turns") - 1)))
        ask = asked.join(plan, same).withColumn("turn", F.pmod(F.xxhash64("query_id", "tag"), F.col("_turns"))).withColumn("part", F.explode(F.sequence(first, F.col("_parts") - 1)))
        keys = ["size", "leaf", "part", "turn"]
        data = data.select(*keys, "vec_id", "vector")
        ask = ask.select(*[F.col(x).alias(f"to_{x}") for x in keys], "query_id", "tag", F.col("vector").alias("query"), "bound")
        return data.groupBy(*keys).cogroup(ask.groupBy(*[f"to_{x}" for x in keys])).applyInArrow(search, "query_id long, tag long, vec_id long, score double")

    found = materialize(visit(queries.select("query_id", "tag", "vector", "size", "leaf", F.lit(math.inf).alias("bound"))), "home")
    if depth:
        nth = F.row_number().over(Window.partitionBy("query_id", "tag").orderBy("score"))
        reach = found.withColumn("_nth", nth).filter(F.col("_nth") == k).select(F.col("query_id").alias("_i"), F.col("tag").alias("_t"), F.col("score").alias("_bound"))
        known = queries.join(reach, (F.col("query_id") == F.col("_i")) & (F.col("tag") == F.col("_t")), "left").withColumn("bound", F.coalesce("_bound", F.lit(math.inf)))
        sides = [F.struct(F.min(F.col("flat")[i]).alias("low"), F.max(F.col("flat")[i]).alias("high")) for i in range(projections)]
        boxes = placed.groupBy(F.col("size").alias("_size"), F.col("leaf").alias("_leaf")).agg(F.array(*sides).alias("_box"))
        apart = F.zip_with("flat", "_box", lambda x, b: F.pow(F.greatest(b["low"] - x, x - b["high"], F.lit(0.0)), F.lit(2.0)))
        gap = F.aggregate(apart, F.lit(0.0), lambda total, x: total + x)
        slack = F.lit(ROUNDING) * F.aggregate("flat", F.lit(0.0), lambda total, x: total + x * x)
        open_ = known.join(bounded(boxes), F.col("size") == F.col("_size")).filter((F.col("leaf") != F.col("_leaf")) & (gap <= stop * F.col("bound") * F.col("bound") + slack))
        onward = materialize(open_.select("query_id", "tag", "vector", "size", F.col("_leaf").alias("leaf"), "bound"), "onward")
        found = found.union(materialize(visit(onward), "onward-found"))
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
