"""Toxicity by non-negative positive-unlabelled learning."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, small_arrow_batches

SAMPLE, VOCABULARY = 24_000, 2048
EDGES = ".,;:!?\"'()[]{}<>*%&$#@|~^_=+/\\`-"


def features(text: str | None) -> set[str]:
    """The distinct words of a text, without marks at their edges, and the words' first 4 and 5 letters."""
    words = {w.strip(EDGES) for w in set((text or "").lower().split())}
    words.discard("")
    return words | {"4:" + w[:4] for w in words} | {"5:" + w[:5] for w in words}


@dataclass
class Classifier:
    names: list[str]
    weights: np.ndarray
    bias: float

    def scores(self, rows: list[list[int]]) -> np.ndarray:
        raw = np.array([self.bias + self.weights[x].sum() if x else self.bias for x in rows])
        return 1 / (1 + np.exp(-np.clip(raw, -60, 60)))


def train(rows: list[list[int]], positive: np.ndarray, prior: float, size: int, epochs: int = 60, rate: float = 0.05, decay: float = 1e-4, batch: int = 2048, seed: int = 5) -> tuple[np.ndarray, float]:
    """Weights and bias of a linear classifier by the non-negative PU risk.

    rows are the features of the unlabelled texts; positive marks the rows that
    are confirmed positives. The risk is prior * R+(P) + max(0, R-(U) - prior *
    R-(P)) with the logistic loss. Where a batch's second part is below zero,
    the step goes up that part alone, which keeps the classifier from fitting
    the positives by heart.
    """
    rng = np.random.default_rng(seed)
    ends = np.cumsum([len(x) for x in rows])
    flat = np.concatenate([np.array(x, np.int64) for x in rows]) if rows else np.zeros(0, np.int64)
    starts = ends - [len(x) for x in rows]
    w, b = np.zeros(size + 1), 0.0
    m, v, t = np.zeros(size + 1), np.zeros(size + 1), 0
    known = np.flatnonzero(positive)

    def gather(picked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = ends[picked] - starts[picked]
        at = np.repeat(starts[picked] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        return flat[at], np.repeat(np.arange(len(picked)), n)

    def slope(cols, owner, pull):
        out = np.bincount(cols, pull[owner], size + 1)
        out[size] = pull.sum()
        return out

    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for i in range(0, len(rows), batch):
            u = order[i : i + batch]
            p = rng.choice(known, min(len(known), 512), replace=False)
            (cu, ou), (cp, op) = gather(u), gather(p)
            zu = np.bincount(ou, w[cu], len(u)) + w[size]
            zp = np.bincount(op, w[cp], len(p)) + w[size]
            su, sp = 1 / (1 + np.exp(-zu)), 1 / (1 + np.exp(-zp))
            second = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
            away = slope(cu, ou, su / len(u)) - slope(cp, op, prior * sp / len(p))
            grad = -away if second < 0 else slope(cp, op, -prior * (1 - sp) / len(p)) + away
            grad[:size] += decay * w[:size]
            t += 1
            m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
            w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w[:size], float(w[size] + b)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE, vocabulary: int = VOCABULARY) -> Classifier:
    """Trains on at most `sample` labelled rows that are not held out.

    The sample is taken by the hash of the id. Its rows marked 1 are the
    confirmed positives; all its rows, their labels hidden, are the unlabelled
    texts; the share of the marked ones is the class prior. The vocabulary are
    the features whose document counts differ most, in standard errors, between
    the two; they are counted by Spark, and only they reach the driver, with
    the sample's rows reduced to them.
    """
    spark = docs.sparkSession
    small_arrow_batches(spark)
    known = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(F.col(id_col)))
    known = known.groupBy(F.col(id_col).alias("_id")).agg(F.max((F.col(label_col) == 1).cast("int")).alias("_y"))
    texts = docs.select(F.col(id_col).alias("_doc"), F.col(text_col).cast("string").alias("_text"))
    chosen = known.join(texts.select("_doc").distinct(), F.col("_id") == F.col("_doc"), "left_semi").orderBy(F.xxhash64("_id"), "_id").limit(sample)
    rows = texts.join(F.broadcast(chosen), F.col("_doc") == F.col("_id")).select("_id", "_y", "_text")  # `sample` ids at most

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (whole.slice(i, 100) for whole in batches for i in range(0, whole.num_rows, 100)):
            found = [sorted(features(x)) for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.list_(pa.string()))], ["id", "y", "features"])

    seen = materialize(rows.mapInArrow(expand, f"id {rows.schema['_id'].dataType.simpleString()}, y int, features array<string>"), "features")
    total = seen.agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("p")).first()
    n, p = total.n, int(total.p or 0)
    if not p or p == n:  # nothing to tell apart: everything is clean, or toxic
        return Classifier([], np.zeros(0), 4.0 if p else -4.0)
    counts = seen.select("y", F.explode("features").alias("name")).groupBy("name").agg(F.count(F.lit(1)).alias("u"), F.sum("y").alias("k"))
    share = F.col("u") / n
    error = F.sqrt(share * (1 - share) * (1 / p + 1 / n)) + 1e-9
    ranked = counts.filter(F.col("u") >= 5).withColumn("z", F.abs(F.col("k") / p - share) / error).filter("z > 4")
    names = [r.name for r in ranked.orderBy(F.desc("z"), "name").limit(vocabulary).collect()]
    if not names:
        rate = p / n
        return Classifier([], np.zeros(0), float(np.log(rate / (1 - rate))))
    listed = spark.createDataFrame([(x, i) for i, x in enumerate(names)], "_name string, _nth int")
    kept = seen.select("id", "y", F.explode_outer("features").alias("name")).join(F.broadcast(listed), F.col("name") == F.col("_name"), "left")
    table = kept.groupBy("id").agg(F.max("y").alias("y"), F.array_sort(F.collect_set("_nth")).alias("x")).orderBy("id").toArrow()
    lists = table.column("x").to_pylist()
    weights, bias = train(lists, table.column("y").to_numpy() == 1, p / n, len(names))
    return Classifier(names, weights, bias)


def score(docs: DataFrame, model: Classifier, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row's whole text, without a shuffle.

    A null text counts as empty and gets the classifier's bias. Repeated rows
    get equal scores; a null id is not held out; other columns are no inputs;
    an empty table gives an empty result.
    """
    small_arrow_batches(docs.sparkSession)
    place = {name: i for i, name in enumerate(model.names)}

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = place.keys()
        for batch in batches:
            found = [[place[x] for x in features(t) & known] for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.scores([sorted(x) for x in found]), pa.float64())], ["doc_id", "score"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    scored = rows.mapInArrow(compute, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, model: Classifier, text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """The rows of docs whose text scores below the threshold; all its columns."""
    small_arrow_batches(docs.sparkSession)
    place = {name: i for i, name in enumerate(model.names)}
    at = docs.columns.index(text_col)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = place.keys()
        for batch in batches:
            rows = [sorted(place[x] for x in features(t) & known) for t in batch.column(at).to_pylist()]
            yield batch.filter(pa.array(model.scores(rows) < threshold))

    return docs.mapInArrow(keep, docs.schema)
