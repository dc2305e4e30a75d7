"""Shards of equal size by Karmarkar-Karp differencing of indivisible groups."""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, prefix_sums


def differencing(sizes: list[int], ways: int) -> list[int]:
    """The part, from 0 to ways - 1, of each size.

    Every size starts as a partial partition of its own. The two with the
    largest spread are combined, the largest part of one with the smallest of
    the other, until a single partition is left.
    """
    if not sizes:
        return []
    heap = [(-size, i, [0] * (ways - 1) + [size], [[] for _ in range(ways - 1)] + [[i]]) for i, size in enumerate(sizes)]
    heapq.heapify(heap)
    n = len(sizes)
    while len(heap) > 1:
        _, _, one, left = heapq.heappop(heap)
        _, _, two, right = heapq.heappop(heap)
        # both ascend; members move from the shorter list to the longer
        parts = []
        for a, b, x, y in zip(one, reversed(two), left, reversed(right), strict=True):
            x, y = (x, y) if len(x) >= len(y) else (y, x)
            x.extend(y)
            parts.append((a + b, x))
        parts.sort(key=lambda p: p[0])
        low = parts[0][0]
        heapq.heappush(heap, (low - parts[-1][0], n, [s for s, _ in parts], [m for _, m in parts]))
        n += 1
    out = [0] * len(sizes)
    for part, members in enumerate(heap[0][3]):
        for i in members:
            out[i] = part
    return out


def byte_balanced(docs: DataFrame, shards: int = 24, id_col: str = "doc_id", text_col: str = "text", overhead: int = 8, grains: int = 4096) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) of every row.

    Rows with equal texts are one group and stay together. Groups of at least
    a 64th of a shard, of which there are 64 * shards at most, go into the
    differencing by themselves; the others as `grains` bundles, made by the
    hash of the text. So the driver holds at most 64 * shards + grains sums,
    whatever the input. Near-equal bytes are the law; a group larger than a
    shard's share exceeds it by what is indivisible.

    A null text has no bytes, counts as equal to the empty one, and still has
    its overhead. Repeated rows and null ids are placed like any other; other
    columns are not looked at; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("doc_id"), (F.octet_length(text) + overhead).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"), F.unhex(F.md5(text.cast("binary"))).alias("_text"),
    )
    rows = materialize(rows, "sizes")
    groups = materialize(rows.groupBy("_text").agg(F.sum("size").alias("_bytes")), "groups")
    total = groups.agg(F.sum("_bytes")).first()[0] or 0
    heavy = F.col("_bytes") * F.lit(64 * shards) >= F.lit(total)
    grain = F.pmod(F.xxhash64("_text"), F.lit(grains)).cast("int")
    single = [(bytes(r[0]), r[1]) for r in groups.filter(heavy).select("_text", "_bytes").orderBy("_text").collect()]
    bundles = [(r[0], r[1]) for r in groups.filter(~heavy).groupBy(grain.alias("_grain")).agg(F.sum("_bytes").alias("_bytes")).orderBy("_grain").collect()]
    parts = differencing([x[1] for x in single] + [x[1] for x in bundles], shards)
    own = F.broadcast(spark.createDataFrame([(x[0], p) for x, p in zip(single, parts, strict=False)], "_own binary, _own_shard int"))
    rest = F.broadcast(spark.createDataFrame([(x[0], p) for x, p in zip(bundles, parts[len(single) :], strict=True)], "_bundle int, _bundle_shard int"))
    placed = rows.join(own, F.col("_text") == F.col("_own"), "left").join(rest, grain == F.col("_bundle"), "left")
    placed = placed.select("doc_id", "size", "text_crc32", F.coalesce("_own_shard", "_bundle_shard").alias("shard"))
    slots = prefix_sums(materialize(placed, "placed"), ["shard"], ["doc_id", "text_crc32", "size"], {"slot": F.lit(1).cast("long")})
    return slots.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
