"""SimHash near-duplicates by covering locality-sensitive hashing."""

from __future__ import annotations

from collections.abc import Callable, Collection, Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, first_linked, materialize, runs, small_arrow_batches, spread_hot

BITS = 64
CHUNK = 65_280


def covering_masks(radius: int, bits: int = BITS) -> list[int]:
    """2 ** (radius + 1) - 1 masks of that many bits, one of which misses any radius bits.

    Bit i carries the non-zero vector 1 + i mod (2 ** (radius + 1) - 1) over
    GF(2); the mask of a non-zero vector v holds the bits whose vector has an
    odd product with v. The vectors of radius bits span fewer than radius + 1
    dimensions, so some v has an even product with each of them: fingerprints
    that differ in those bits alone agree under the mask of v.
    """
    tables = 2 ** (radius + 1) - 1
    return [sum(1 << i for i in range(bits) if ((1 + i % tables) & v).bit_count() % 2) for v in range(1, tables + 1)]


def shingle_digests(text: bytes | None, words: int, digest: Callable[[bytes], bytes]) -> Iterator[list[bytes]]:
    """Digests of the runs of `words` words, in lists of CHUNK at most; none for a text without words."""
    tokens = (text or b"").lower().split()  # bytes: A-Z and ASCII white space only
    line = b" ".join(tokens)
    if len(tokens) <= words:
        yield [digest(line)] if tokens else []
        return
    sizes = np.fromiter(map(len, tokens), np.int64, len(tokens))
    ends = np.cumsum(sizes + 1) - 1
    starts = ends - sizes
    firsts, lasts = starts[: len(tokens) - words + 1], ends[words - 1 :]
    for at in range(0, len(firsts), CHUNK):
        a, b = firsts[at : at + CHUNK].tolist(), lasts[at : at + CHUNK].tolist()
        yield [digest(line[i:j]) for i, j in zip(a, b, strict=True)]


def majority(chunks: Iterable[Collection[bytes]], size: int) -> bytes:
    """Of digests of `size` bytes, the bits that are set in over half of them."""
    votes, n = np.zeros(8 * size, np.int64), 0
    for chunk in chunks:
        bits = np.unpackbits(np.frombuffer(b"".join(chunk), np.uint8).reshape(-1, size), axis=1)
        full = len(bits) // 255 * 255
        votes += bits[:full].reshape(-1, 255, 8 * size).sum(axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64)
        votes += bits[full:].sum(axis=0, dtype=np.uint8)
        n += len(bits)
    return np.packbits(2 * votes > n).tobytes()


def fingerprint(text: bytes | None, words: int = 4, seed: int = 42) -> int:
    """Majority of the bits of the shingles' XXH64; 0 for a text without words."""
    return int.from_bytes(majority(shingle_digests(text, words, lambda x: xxhash.xxh64_digest(x, seed)), 8), "big")


def wide_digests(text: bytes | None, words: int, seed: int = 42) -> set[bytes]:
    """The distinct shingles' 128-bit XXH3; their bits' majority is the wide fingerprint."""
    return set().union(*shingle_digests(text, words, lambda x: xxhash.xxh3_128_digest(x, seed)))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4, seed: int = 42) -> DataFrame:
    """(doc_id, fp) for every row; null texts count as empty, fp is a signed long."""
    small_arrow_batches(docs.sparkSession)

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint(x, words, seed) for x in batch.column(1).cast(pa.binary()).to_pylist()]
            signed = np.array(found, np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(signed)], ["doc_id", "fp"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(compute, "doc_id long, fp long")


def _links(radius: int):
    """Edges (a, b) of a spanning forest of each group's links."""
    keys = ["t", "key", "_p1", "_p2"]

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, cut in runs(batches, keys):
            fp, node = table.column("fp").to_numpy(), table.column("node").to_numpy()
            side = table.column("_side").to_numpy()
            apart = table.column("_p1").to_numpy() != table.column("_p2").to_numpy()
            size = np.diff(cut)
            first = cut[:-1][size == 2]
            close = np.bitwise_count((fp[first] ^ fp[first + 1]).view(np.uint64)) <= radius
            a, b = [node[first[close]]], [node[first[close] + 1]]
            for i, n in zip(cut[:-1][size > 2].tolist(), size[size > 2].tolist(), strict=True):
                own = fp[i : i + n].view(np.uint64)
                linked = np.bitwise_count(own[:, None] ^ own[None, :]) <= radius
                if apart[i]:
                    linked &= side[i : i + n, None] != side[None, i : i + n]
                root = first_linked(linked)
                moved = np.flatnonzero(root != np.arange(n))
                a.append(node[i + moved])
                b.append(node[i + root[moved]])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], ["a", "b"])

    return near


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4, radius: int = 4, seed: int = 42, block: int = 1024, spread: int = 16) -> DataFrame:
    """(doc_id, fp, component_id) of every row: classes of linked fingerprints.

    Texts with fingerprints at radius differing bits or fewer are linked; a
    component's id is the smallest doc_id reachable. Copies share a fingerprint
    and are never paired: only distinct fingerprints enter the tables, each in
    all of them, under its bits of the table's mask. Groups larger than block
    are compared by pairs of blocks, and a group hands on a spanning forest of
    its links, no pairs. Rows of a hot fingerprint are named in `spread` parts.

    Null and empty texts have fingerprint 0 and link like any other; rows are
    kept as often as they are repeated; a null doc_id is never the smallest,
    and a component of such rows alone has a null id. Other columns are not
    looked at. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    prints = materialize(fingerprints(docs, id_col, text_col, words, seed), "fingerprints")
    known = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("node"), F.count(F.lit(1)).alias("n")), "distinct-fingerprints")
    signed = [m - (1 << 64) if m >> 63 else m for m in covering_masks(radius)]
    masks = F.array(*[F.lit(m).cast("long") for m in signed])
    members = known.filter("node is not null").select("fp", "node", F.posexplode(masks).alias("t", "mask"))
    members = members.select("fp", "node", "t", F.col("fp").bitwiseAND(F.col("mask")).alias("key"))
    groups = spread_hot(materialize(members, "masked"), ["t", "key"], "fp", block)
    edges = groups.select("t", "key", "_p1", "_p2", "_side", "fp", "node").mapInArrow(_links(radius), "a long, b long")
    roots = components(edges).select(F.col("node").alias("_n"), F.col("root").alias("_r"))
    named = known.join(roots, F.col("node") == F.col("_n"), "left").withColumn("_root", F.coalesce("_r", "node"))
    # only shared fingerprints name another row; theirs may be hot, and are spread
    shared = named.filter((F.col("n") > 1) | ~F.col("node").eqNullSafe(F.col("_root")))
    shared = shared.select(F.col("fp").alias("_fp"), "_root", F.explode(F.sequence(F.lit(0), F.lit(spread - 1))).alias("_s"))
    salt = F.pmod(F.xxhash64("doc_id"), F.lit(spread)).cast("int")
    met = prints.withColumn("_salt", salt).join(shared, (F.col("fp") == F.col("_fp")) & (F.col("_salt") == F.col("_s")), "left")
    return met.select("doc_id", "fp", F.when(F.col("_fp").isNull(), F.col("doc_id")).otherwise(F.col("_root")).alias("component_id"))


def fingerprint_hex(fp):
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def one_per_component(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of docs that are the smallest id of their component, once each.

    Of repeated rows with one id a single one stays; rows without an id stay.
    """
    found = simhash_components(docs, id_col, text_col, **options)
    kept = found.filter("doc_id = component_id").select(F.col("doc_id").alias("_kept")).distinct()
    first = docs.filter(F.col(id_col).isNotNull()).join(kept, F.col(id_col) == F.col("_kept"), "left_semi")
    return first.dropDuplicates([id_col]).unionByName(docs.filter(F.col(id_col).isNull()))
