"""Packing tokenized documents into sequences, shortest pack first."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize, prefix_sums, small_arrow_batches
from .tokens import PieceIds, worker_cache

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def pieces(docs: DataFrame, path: str, capacity: int = 2048, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each document's ids, with end_id after them, cut into full sequences and a rest."""
    small_arrow_batches(docs.sparkSession)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = worker_cache(PieceIds, path)
        last = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            out: list[tuple] = []
            for doc, ids in zip(batch.column(0).to_pylist(), ids_of.many(x.as_py() or "" for x in batch.column(1)), strict=True):
                ids += last
                n = len(ids) // 4
                out += [(doc, at, min(capacity, n - at), zlib.crc32(ids[4 * at : 4 * (at + capacity)]), n) for at in range(0, n, capacity)]
            columns = zip(*out, strict=True) if out else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns], ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    rows = docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string"))
    return rows.mapInArrow(cut, PIECES)


def shortest_pack_first(histogram: dict[int, int], capacity: int) -> list[tuple[int, tuple[tuple[int, int], ...]]]:
    """Packing patterns and how often each is used, from counts of lengths.

    Lengths are placed longest first, each into packs with the least in them;
    new packs are opened when even those have no room. Packs of one pattern
    are moved together, so the work grows with the number of lengths and
    patterns, not with the number of documents. A pattern is a tuple of
    (length, times).
    """
    packs: dict[int, dict[tuple, int]] = {}

    def put(fill: int, pattern: tuple, n: int) -> None:
        if n:
            group = packs.setdefault(fill, {})
            group[pattern] = group.get(pattern, 0) + n

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            fill = min(packs, default=capacity)
            if fill + length <= capacity:
                pattern, n = next(iter(packs[fill].items()))
                del packs[fill][pattern]
                if not packs[fill]:
                    del packs[fill]
                used = min(n, left)
                put(fill, pattern, n - used)
                head = pattern[:-1] if pattern[-1][0] == length else pattern
                times = pattern[-1][1] if pattern[-1][0] == length else 0
                put(fill + length, (*head, (length, times + 1)), used)
                left -= used
            else:
                each = capacity // length
                put(each * length, ((length, each),), left // each)
                if left % each:
                    put(left % each * length, ((length, left % each),), 1)
                left = 0
    return [(n, pattern) for fill in sorted(packs, reverse=True) for pattern, n in packs[fill].items()]


def intervals(patterns: list[tuple[int, tuple[tuple[int, int], ...]]]) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, rank after the last, times, offset, first sequence)."""
    out, ranks, sequence = [], {}, 0
    for n, pattern in patterns:
        offset = 0
        for length, times in pattern:
            first = ranks.get(length, 0)
            ranks[length] = first + n * times
            out.append((length, first, first + n * times, times, offset, sequence))
            offset += length * times
        sequence += n
    return out


def pack(docs: DataFrame, path: str, capacity: int = 2048, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each piece: PIECES and sequence_id, offset.

    The histogram of lengths has at most capacity rows, and so are the patterns
    that the driver makes from it bounded by the lengths, whatever the number
    of documents. Ranks within a length, which may be hot, come from salted
    prefix sums.

    A null or empty text has the end id alone. Repeated rows and rows without
    an id are packed like any other; other columns are not looked at; an empty
    table gives an empty result.
    """
    spark = docs.sparkSession
    cut = materialize(pieces(docs, path, capacity, end_id, id_col, text_col), "pieces")
    histogram = {r.length: r.n for r in cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    plan = intervals(shortest_pack_first(histogram, capacity))
    schema = T.StructType([T.StructField(x, T.LongType(), False) for x in ("_length", "_first", "_after", "_times", "_offset", "_sequence")])
    ranked = prefix_sums(cut, ["length"], ["doc_id", "start", "ids_crc32"], {"_rank": F.lit(1).cast("long")})
    where = F.broadcast(spark.createDataFrame(plan, schema))
    placed = ranked.join(where, (F.col("length") == F.col("_length")) & (F.col("_rank") >= F.col("_first")) & (F.col("_rank") < F.col("_after")))
    nth = F.col("_rank") - F.col("_first")
    return placed.select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens",
        (F.col("_sequence") + F.floor(nth / F.col("_times"))).cast("long").alias("sequence_id"),
        (F.col("_offset") + F.pmod(nth, F.col("_times")) * F.col("length")).cast("long").alias("offset"),
    )
