"""Near-duplicate vectors by iterative quantisation and multi-index Hamming tables."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import components, first_linked, materialize, runs, small_arrow_batches, spread_hot

SAMPLE = 8192
WORD = 64


def usable(vector: Column) -> Column:
    """Not null, not zero, and no null or non-finite component."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(math.inf)))
    return vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0)


def as_matrix(column: pa.ChunkedArray | pa.Array, width: int | None = None) -> np.ndarray:
    """Rows of an Arrow list column in double precision, cut or padded to width."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if len(sizes) and (sizes == sizes[0]).all() and width in (None, sizes[0]):
        return flat.reshape(len(sizes), sizes[0])
    out = np.zeros((len(sizes), width or max([0, *sizes])))
    at = 0
    for i, n in enumerate(sizes):
        out[i, : min(n, out.shape[1])] = flat[at : at + n][: out.shape[1]]
        at += n
    return out


@dataclass
class Quantiser:
    """Rotations learnt by iterative quantisation; each gives one word of code bits."""

    mean: np.ndarray
    maps: np.ndarray  # words x dimensions x bits
    cuts: np.ndarray  # words x bits: medians, so that every bit is balanced
    bits: int
    tables: int

    def keys(self, unit: np.ndarray) -> np.ndarray:
        """The substring of the code that each table is indexed by."""
        code = np.concatenate([(unit - self.mean) @ m > c for m, c in zip(self.maps, self.cuts, strict=True)], axis=1)
        code = code[:, : self.tables * self.bits].reshape(len(unit), self.tables, self.bits)
        return code @ (1 << np.arange(self.bits))


def fit(sample: np.ndarray, rows: int, threshold: float, seed: int = 7, rounds: int = 25, miss: float = 0.002, most: int = 256) -> Quantiser:
    """Learns rotations, and as many tables as pairs at the threshold need.

    A substring has about log2(rows) - 3 bits, so that buckets of the largest
    label hold some eight rows at any size. How often a bit differs between
    vectors at the threshold is measured on perturbed copies of the sample;
    tables are added until the share of such pairs that meet in none of them is
    miss or less. Where `most` tables do not reach it, substrings get shorter,
    bit by bit: buckets grow, and are cut into blocks, but no pair is given up.
    """
    rng = np.random.default_rng(seed)
    unit = sample / np.linalg.norm(sample, axis=1, keepdims=True)
    mean = unit.mean(axis=0)
    centred = unit - mean
    _, axes = np.linalg.eigh(centred.T @ centred)
    axes = axes[:, ::-1][:, :WORD]
    flat = centred @ axes
    noise = rng.normal(size=unit.shape)
    noise -= (noise * unit).sum(axis=1, keepdims=True) * unit
    size = np.linalg.norm(noise, axis=1, keepdims=True)
    near = threshold * unit + math.sqrt(1 - threshold**2) * noise / np.where(size > 0, size, 1)
    maps, cuts, apart = [], [], np.zeros((len(unit), 0), bool)

    def learn() -> None:
        nonlocal apart
        turn, _ = np.linalg.qr(rng.normal(size=(flat.shape[1], flat.shape[1])))
        for _ in range(rounds):  # nearest binary codes, then the rotation nearest to them
            u, _, vt = np.linalg.svd(np.sign(flat @ turn).T @ flat, full_matrices=False)
            turn = (u @ vt).T
        full = axes @ turn
        maps.append(full)
        cuts.append(np.median(centred @ full, axis=0))
        apart = np.concatenate([apart, (centred @ full > cuts[-1]) != ((near - mean) @ full > cuts[-1])], axis=1)

    wanted = min(31, max(4, round(math.log2(max(2, rows))) - 3))
    for bits in range(wanted, 0, -1):
        missed = np.ones(len(unit), bool)
        for table in range(most):
            while (table + 1) * bits > apart.shape[1]:
                learn()
            missed &= apart[:, table * bits : (table + 1) * bits].any(axis=1)
            if missed.mean() <= miss:
                return Quantiser(mean, np.array(maps), np.array(cuts), bits, table + 1)
            # the share missed falls by a steady factor: give up a length that will not get there
            if table >= 15 and missed.mean() > 0 and missed.mean() ** (most / (table + 1)) > 2 * miss:
                break
    raise ArithmeticError(f"{most} tables miss more than {miss} of the pairs at {threshold}")


def _verify(threshold: float):
    keys = ["label", "size", "t", "key", "_p1", "_p2"]

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, cut in runs(batches, keys):
            code, unit = as_matrix(table.column("keys")).astype(np.int32), as_matrix(table.column("vector"))
            unit = unit / np.linalg.norm(unit, axis=1, keepdims=True)
            node, copies, t, side = (table.column(x).to_numpy() for x in ("node", "copies", "t", "_side"))
            apart = table.column("_p1").to_numpy() != table.column("_p2").to_numpy()
            out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
            for i, j in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
                if j - i < 2:
                    continue
                linked = unit[i:j] @ unit[i:j].T >= threshold
                np.fill_diagonal(linked, False)
                if apart[i]:
                    linked &= side[i:j, None] != side[None, i:j]
                if not linked.any():
                    continue
                for earlier in range(t[i]):  # a pair counts in the first table where it meets
                    linked &= code[i:j, None, earlier] != code[None, i:j, earlier]
                links = linked @ copies[i:j]
                some = np.flatnonzero(links)
                out.append((node[i + some], links[some], node[i + first_linked(linked)[some]]))
            columns = [np.concatenate(x) for x in zip(*out, strict=True)] if out else [np.zeros(0, np.int64)] * 3
            yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in columns], ["node", "links", "root"])

    return check


def near_duplicates(vectors: DataFrame, threshold: float = 0.93, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str | None = "label", block: int = 512, sample: int = SAMPLE, spread: int = 16) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row.

    Rows with one label whose vectors have a cosine of threshold or more, in
    double precision, are linked if they meet in a table; found links are exact.
    The quantiser is fitted on at most `sample` rows, taken by the hash of the
    id; all rows are indexed. Rows with equal label and vector are one node
    that counts its copies, so copies are never paired. A bucket beyond `block`
    nodes is compared by pairs of blocks; a bucket hands on counts and a
    spanning forest of its links, no pairs.

    Vectors that are null, zero or hold null or non-finite components, and rows
    with a null label or id, link with nothing: no links, their own component,
    kept. Vectors of different lengths never link. Rows that repeat one another
    are copies and link. Other columns are not looked at. An empty table gives
    an empty result.
    """
    spark = vectors.sparkSession
    small_arrow_batches(spark)
    label = F.col(label_col).cast("string") if label_col else F.lit("")
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("vector"), label.alias("label"))
    ready = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & usable(F.col("vector"))
    rows = rows.withColumn("ready", F.coalesce(ready, F.lit(False)))
    nodes = materialize(rows.filter("ready").groupBy("label", "vector").agg(F.min("vec_id").alias("node"), F.count(F.lit(1)).alias("copies")), "vectors")
    stats = nodes.groupBy("label").agg(F.count(F.lit(1)).alias("n")).agg(F.sum("n").alias("n"), F.max("n").alias("largest")).first()
    # a vector without copies is its own node; the copies of others are looked up, the many of one in parts
    repeated = nodes.filter("copies > 1").select(F.col("label").alias("_l"), F.col("vector").alias("_v"), F.col("node").alias("_node"), F.col("copies").alias("_copies"), F.explode(F.sequence(F.lit(0), F.lit(spread - 1))).alias("_s"))
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64("vec_id"), F.lit(spread)).cast("int"))
    ties = salted.join(repeated, F.col("ready") & (F.col("label") == F.col("_l")) & (F.col("vector") == F.col("_v")) & (F.col("_salt") == F.col("_s")), "left")
    ties = ties.select("vec_id", F.when(F.col("ready"), F.coalesce("_node", "vec_id")).alias("node"), F.coalesce("_copies", F.lit(1)).alias("copies"))
    if not stats.n:
        found = ties.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
        return found.withColumn("kept", F.lit(True))
    picked = nodes.orderBy(F.xxhash64("node"), "node").limit(sample).select("vector").toArrow()
    model = fit(as_matrix(picked.column("vector")), stats.largest, threshold)
    width = len(model.mean)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            unit = as_matrix(batch.column(2), width)
            size = np.linalg.norm(unit, axis=1, keepdims=True)
            keys = model.keys(unit / np.where(size > 0, size, 1)).astype(np.int32)  # 31 bits at most
            flat = pa.ListArray.from_arrays(np.arange(0, keys.size + 1, model.tables, dtype=np.int32), pa.array(keys.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns, flat], [*batch.schema.names, "keys"])

    kind = nodes.schema["vector"].dataType.simpleString()
    coded = nodes.select("label", F.size("vector").alias("size"), "vector", "node", "copies").mapInArrow(encode, f"label string, size int, vector {kind}, node long, copies long, keys array<int>")
    coded = materialize(coded, "codes").select("*", F.posexplode("keys").alias("t", "key"))
    groups = spread_hot(coded, ["label", "size", "t", "key"], "node", block)
    groups = groups.select("label", "size", "t", "key", "_p1", "_p2", "_side", "node", "copies", "vector", "keys")
    found = materialize(groups.mapInArrow(_verify(threshold), "node long, links long, root long"), "links")
    links = found.groupBy(F.col("node").alias("_n")).agg(F.sum("links").alias("_links"))
    roots = components(found.select(F.col("node").alias("a"), F.col("root").alias("b"))).select(F.col("node").alias("_m"), F.col("root").alias("_root"))
    out = ties.join(links, F.col("node") == F.col("_n"), "left").join(roots, F.col("node") == F.col("_m"), "left")
    out = out.select(
        "vec_id",
        F.coalesce(F.coalesce("_links", F.lit(0)) + F.col("copies") - 1, F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("_root", "node", "vec_id").alias("component_id"),
    )
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


#: The links of near_duplicates() over all pairs of a label; for tables on which that many pairs can be compared.
ORACLE = """WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings
  WHERE label IS NOT NULL AND list_count(embedding) = len(embedding) AND list_bool_and(list_transform(embedding, lambda e: isfinite(e))) AND list_bool_or(list_transform(embedding, lambda e: e <> 0))),
 l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND len(a.x) = len(b.x) AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.x, b.x) >= 0.93e0),
 r AS (SELECT vec_id AS node, vec_id AS root FROM embeddings UNION SELECT l.b, r.root FROM r JOIN l ON l.a = r.node),
 c AS (SELECT node, min(root) AS root FROM r GROUP BY 1), n AS (SELECT a, count(*) AS n FROM l GROUP BY 1)
 SELECT vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, CAST(root AS BIGINT) AS component_id, vec_id = root AS kept FROM embeddings JOIN c ON node = vec_id LEFT JOIN n ON a = vec_id"""
