"""Near copies by SimHash: covering tables over wide fingerprints, the exact similarity of what they find, and an exact pass for the rest."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, discard, few, materialize, shuffles_dropped, small_arrow_batches
from .simhash import covering_masks, majority, shingle_digests, wide_digests

PARTS, PART_BITS = 4, 32  # of a fingerprint of 128 bits
SMALL = 16  # groups up to this size are compared by shifts, for many groups at once
NODE = ["none", "doc_id", "h", "s"]
BATCH = 32_768  # rows that a task compares at once; a group is never cut
PAIRS = 1 << 17  # pairs that a task holds before it hands them on, or those of one strip
SKETCH = 1024  # bits of a set's sketch; a wide one has two for each shingle or more
SHARE, COMMON = 64, 1 << 16  # a SHARE-th of the texts tells which COMMON shingles at most are ordered last


def common_shingles(docs: DataFrame, text_col: str, words: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that several texts of a sample share, sorted, and their ranks, the most frequent one last.

    The order of shingles that they give makes the prefixes of wide_fingerprints()
    rare ones. Any order finds the same pairs: the sample bears on work alone.
    """
    small_arrow_batches(docs.sparkSession)

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [np.frombuffer(b"".join(wide_digests(x.as_py(), words, seed)), "<i8")[::2] for x in batch.column(1).cast(pa.binary())]
            ends = np.cumsum([0, *map(len, sets)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(ends, pa.array(np.concatenate([np.zeros(0, np.int64), *sets])))], ["h", "set"])

    text = F.col(text_col).cast("string")
    some = docs.select(F.xxhash64(text).alias("h"), text.alias("text")).filter(F.col("text").isNotNull() & (F.pmod("h", F.lit(SHARE)) == 0))
    sets = some.mapInArrow(compute, "h long, set array<long>").dropDuplicates(["h"])
    counts = sets.select(F.explode("set").alias("x")).groupBy("x").agg(F.count(F.lit(1)).alias("n")).filter("n > 2")
    found = counts.orderBy(F.desc("n"), "x").limit(COMMON).toPandas()
    x = found["x"].to_numpy(np.int64)
    order = np.argsort(x)
    return x[order], (len(x) - np.arange(len(x)))[order].astype(np.int32)


def wide_fingerprints(docs: DataFrame, id_col: str, text_col: str, words: int, seed: int, percent: int) -> DataFrame:
    """(doc_id, h, f1, f2, s, size, prefix, sketch, wide) of each row.

    h is a hash of the text, f1 and f2 are the halves of its fingerprint, s is
    a hash of its set of shingles, which has size ones. prefix holds the first
    shingles of the set, the rare ones first, as many as a text needs to share
    one with any text that is similar to percent / 100 or more. sketch tells of
    each of SKETCH classes of shingles whether the set has an odd number; wide,
    null where sketch is as good, tells it of more classes, a power of two.
    """
    common, rank = common_shingles(docs, text_col, words, seed)

    def first(digests: np.ndarray) -> np.ndarray:
        late = np.zeros(len(digests), np.int32)
        if len(common):
            at = np.minimum(np.searchsorted(common, digests), len(common) - 1)
            late = np.where(common[at] == digests, rank[at], 0)
        n = len(digests)
        return digests[np.lexsort((digests, late))][: n + (-percent * n // 100) + 1 if n else 0]

    def parities(own: np.ndarray, bits: int) -> bytes:
        # bit i in place i, the lowest first, so that halves of a sketch fold into a narrower one
        return np.packbits((np.bincount(own & bits - 1, minlength=bits) & 1).astype(np.uint8), bitorder="little").tobytes()

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints, sets, sizes, heads, odd, wide = [], [], [], [], [], []
            for x in batch.column(2).cast(pa.binary()):
                digests = wide_digests(x.as_py(), words, seed)
                own = np.unique(np.frombuffer(b"".join(digests), "<i8")[::2])
                prints.append(majority([digests], 16))
                sets.append(xxhash.xxh64_intdigest(own.tobytes(), seed))
                sizes.append(len(own))
                heads.append(first(own))
                odd.append(parities(own, SKETCH))
                bits = 1 << (2 * len(own) - 1).bit_length() if len(own) else SKETCH
                wide.append(parities(own, bits) if bits > SKETCH else None)
            halves = np.frombuffer(b"".join(prints), ">i8").astype(np.int64).reshape(-1, 2)
            ends = np.cumsum([0, *map(len, heads)]).astype(np.int32)
            flat = pa.array(np.concatenate([np.zeros(0, np.int64), *heads]))
            made = [pa.array(halves[:, 0]), pa.array(halves[:, 1]), pa.array(np.array(sets, np.uint64).view(np.int64)), pa.array(sizes, pa.int32()), pa.ListArray.from_arrays(ends, flat), pa.array(odd, pa.binary()), pa.array(wide, pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *made], ["doc_id", "h", "f1", "f2", "s", "size", "prefix", "sketch", "wide"])

    text = F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("h"), text.alias("text"))
    return rows.mapInArrow(compute, "doc_id long, h long, f1 long, f2 long, s long, size int, prefix array<long>, sketch binary, wide binary")


def table_masks(radius: int) -> list[tuple[int, int]]:
    """For each table its mask on the first and the second half, as signed longs."""
    out = []
    for part in range(PARTS):
        for mask in covering_masks(radius, PART_BITS):
            whole = mask << (PART_BITS * (part % 2))
            signed = whole - (1 << 64) if whole >> 63 else whole
            out.append((signed, 0) if part < 2 else (0, signed))
    return out


def _dealt(members: DataFrame, keys: DataFrame, block: int, by: list[str]) -> DataFrame:
    """members with (cut, side), sorted by key and cut. keys has the key of each member.

    A group of more than block rows of a key is dealt into pairs of blocks; all
    of its rows meet, two from one block in the pair of that block with itself.
    """
    sizes = keys.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    hot = materialize(sizes.filter(F.col("n") > block).select(F.col("key").alias("_hot"), F.ceil(F.col("n") / block).cast("long").alias("_blocks")), "hot-groups")
    dealt = members.join(few(hot), F.col("key") == F.col("_hot"), "left").withColumn("_blocks", F.coalesce("_blocks", F.lit(1).cast("long")))
    dealt = dealt.withColumn("side", F.pmod(F.xxhash64(*by), F.col("_blocks")).cast("int"))
    dealt = dealt.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks").cast("int") - 1)))
    cut = F.shiftleft(F.least("side", "_other").cast("long"), 32) + F.greatest("side", "_other")
    rest = [x for x in members.columns if x != "key"]
    return dealt.select("key", cut.alias("cut"), "side", *rest).repartition("key", "cut").sortWithinPartitions("key", "cut")


def groups(known: DataFrame, radius: int, block: int) -> DataFrame:
    """(key, cut, side, f1, f2), sorted by key and cut: fingerprints that agree under a table's mask, dealt by _dealt()."""
    masks = F.array(*[F.struct(F.lit(t).cast("long").alias("t"), F.lit(a).cast("long").alias("a"), F.lit(b).cast("long").alias("b")) for t, (a, b) in enumerate(table_masks(radius))])
    each = known.select("f1", "f2", F.explode(masks).alias("m"))
    under = F.when(F.col("m.a") != 0, F.col("f1").bitwiseAND(F.col("m.a"))).otherwise(F.col("f2").bitwiseAND(F.col("m.b")))
    # a part fills one half of its word; the table's number takes the other
    odd = F.floor(F.col("m.t") / (2 ** (radius + 1) - 1)) % 2 == 1
    members = each.select("f1", "f2", F.when(odd, F.shiftrightunsigned(under, PART_BITS)).otherwise(under).bitwiseOR(F.shiftleft(F.col("m.t"), PART_BITS)).alias("key"))
    return _dealt(members, members, block, ["f1", "f2"])


def _whole_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables of BATCH rows or more, cut between groups."""
    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows < BATCH:
            continue
        table = pa.Table.from_batches(held).combine_chunks()
        key, cut = (table.column(x).to_numpy() for x in ("key", "cut"))
        ends = np.flatnonzero((key[1:] != key[:-1]) | (cut[1:] != cut[:-1]))
        if len(ends):
            last = int(ends[-1]) + 1
            yield table.slice(0, last)
            table = table.slice(last)
        held, rows = table.to_batches(), table.num_rows
    if rows:
        yield pa.Table.from_batches(held).combine_chunks()


def _spanning(near: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """A spanning forest of the pairs at most `most` apart, closest pairs first (Prim)."""
    n = len(near)
    open_ = (near <= most).sum(axis=1) > 0
    far = most + 1
    while open_.any():
        seed = int(np.argmax(open_))
        open_[seed] = False
        least, source = np.where(open_, near[seed], far), np.full(n, seed)
        while (at := int(np.argmin(least))) is not None and least[at] <= most:
            yield int(source[at]), at
            open_[at], least[at] = False, far
            closer = open_ & (near[at] < least)
            least[closer], source[closer] = near[at][closer], at


def near_links(radius: int, most: int):
    """Links (a1, a2, b1, b2, d) of fingerprints d <= most bits apart, from groups().

    A pair counts in the first table where it meets. Large groups hand on a
    spanning forest of their links, the closest first, and no pairs. A link
    that is not in the forest, or of fingerprints that meet nowhere, is left to
    prefix_pairs().
    """
    masks = np.array(table_masks(radius), np.int64)

    def earlier(x1: np.ndarray, x2: np.ndarray, t: np.ndarray) -> np.ndarray:
        """Whether differing bits x1, x2 meet in a table before t."""
        met = np.zeros(x1.shape, bool)
        for k in range(int(np.max(t, initial=0))):
            met |= ((x1 & masks[k, 0]) == 0) & ((x2 & masks[k, 1]) == 0) & (k < t)
        return met

    def apart(x1: np.ndarray, x2: np.ndarray) -> np.ndarray:
        return np.bitwise_count(x1.view(np.uint64)).astype(np.int16) + np.bitwise_count(x2.view(np.uint64))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole_groups(batches):
            key, cut, side, f1, f2 = (table.column(x).to_numpy() for x in ("key", "cut", "side", "f1", "f2"))
            new = np.concatenate([[True], (key[1:] != key[:-1]) | (cut[1:] != cut[:-1])])
            starts = np.flatnonzero(new)
            sizes = np.diff(np.append(starts, len(key)))
            small = np.repeat(sizes <= SMALL, sizes)
            nth, owner = np.cumsum(new) - 1, key >> PART_BITS
            one, two = [], []
            for shift in range(1, min(SMALL, len(key))):
                i = np.flatnonzero(small[:-shift] & (nth[shift:] == nth[:-shift]))
                if not len(i):
                    break
                x1, x2 = f1[i] ^ f1[i + shift], f2[i] ^ f2[i + shift]
                close = apart(x1, x2) <= most
                i, x1, x2 = i[close], x1[close], x2[close]
                first = ~earlier(x1, x2, owner[i])
                one.append(i[first])
                two.append(i[first] + shift)
            for at, n in zip(starts[sizes > SMALL].tolist(), sizes[sizes > SMALL].tolist(), strict=True):
                own1, own2, own = f1[at : at + n], f2[at : at + n], side[at : at + n]
                gap = np.full((n, n), most + 1, np.int16)
                split = cut[at] >> 32 != cut[at] & 0xFFFFFFFF
                for row in range(0, n, 128):  # a strip at a time
                    x1, x2 = own1[row : row + 128, None] ^ own1[None], own2[row : row + 128, None] ^ own2[None]
                    strip = apart(x1, x2)
                    close = (strip <= most) & ((x1 | x2) != 0)
                    if split:
                        close &= own[row : row + 128, None] != own[None]
                    i, j = np.nonzero(close)
                    first = ~earlier(x1[i, j], x2[i, j], owner[at])
                    i, j = i[first], j[first]
                    gap[row + i, j] = strip[i, j]
                if (gap <= most).any():
                    links = list(_spanning(gap, most))
                    if links:
                        a, b = np.array(links).T + at
                        one.append(a)
                        two.append(b)
            a, b = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (one, two))
            swap = (f1[a] > f1[b]) | ((f1[a] == f1[b]) & (f2[a] > f2[b]))
            a, b = np.where(swap, b, a), np.where(swap, a, b)
            d = apart(f1[a] ^ f1[b], f2[a] ^ f2[b]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (f1[a], f2[a], f1[b], f2[b], d)], ["a1", "a2", "b1", "b2", "d"])

    return compare


def prefix_pairs(percent: int):
    """Pairs (a, b, most) of s with different roots that share a shingle of their prefixes and may be similar, from _dealt().

    Before the first shingle that two prefixes share nothing is common, so what
    follows it bounds what is: most is a bound for shared shingles. A pair may
    be found again at a later shingle.
    """

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole_groups(batches):
            key, cut, side, s, root, size, place = (table.column(x).to_numpy() for x in ("key", "cut", "side", "s", "root", "size", "place"))
            after, split = (size - place).astype(np.int64), cut >> 32 != cut & 0xFFFFFFFF
            size = size.astype(np.int64)

            def pairs(i: np.ndarray, j: np.ndarray) -> pa.RecordBatch:
                a, b, most = np.minimum(s[i], s[j]), np.maximum(s[i], s[j]), np.minimum(after[i], after[j]).astype(np.int32)
                return pa.RecordBatch.from_arrays([pa.array(x) for x in (a, b, most)], ["a", "b", "most"])

            def may(i, j) -> np.ndarray:
                enough = (100 + percent) * np.minimum(after[i], after[j]) >= percent * (size[i] + size[j])
                return enough & (root[i] != root[j]) & (~split[i] | (side[i] != side[j]))

            new = np.concatenate([[True], (key[1:] != key[:-1]) | (cut[1:] != cut[:-1])])
            starts = np.flatnonzero(new)
            sizes = np.diff(np.append(starts, len(key)))
            small, nth = np.repeat(sizes <= SMALL, sizes), np.cumsum(new) - 1
            for shift in range(1, min(SMALL, len(key))):
                i = np.flatnonzero(small[:-shift] & (nth[shift:] == nth[:-shift]))
                if not len(i):
                    break
                i = i[may(i, i + shift)]
                if len(i):
                    yield pairs(i, i + shift)
            one, two, held = [], [], 0
            for at, n in zip(starts[sizes > SMALL].tolist(), sizes[sizes > SMALL].tolist(), strict=True):
                for row in range(at, at + n, 128):  # a strip at a time, with itself and what follows
                    up, across = np.arange(row, min(row + 128, at + n))[:, None], np.arange(row, at + n)[None]
                    i, j = np.nonzero(may(up, across) & (up < across))
                    one.append(row + i)
                    two.append(row + j)
                    held += len(i)
                    if held >= PAIRS:
                        yield pairs(np.concatenate(one), np.concatenate(two))
                        one, two, held = [], [], 0
            if held:
                yield pairs(np.concatenate(one), np.concatenate(two))

    return compare


def differing(one: bytes, two: bytes) -> int:
    """Bits in which two sketches differ, the wider one folded to the width of the other."""
    a, b = sorted((np.frombuffer(x, np.uint64) for x in (one, two)), key=len)
    return int(np.bitwise_count(a ^ np.bitwise_xor.reduce(b.reshape(-1, len(a)), axis=0)).sum(dtype=np.int64))


def unruled(links: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """The links (a, b, w), a and b being s of nodes, that sketches do not rule out; none that is similar to percent / 100 or more goes.

    A differing bit of two sketches needs a shingle that only one set has, so
    sets that differ in more bits than similar ones of their sizes can differ in
    shingles are not similar. Sketches of SKETCH bits come first; what they leave
    of large sets, of which they tell little, is held against the wide ones.
    """

    def narrow(k1: list[bytes], k2: list[bytes]) -> np.ndarray:
        one, two = (np.frombuffer(b"".join(k), np.uint64).reshape(-1, SKETCH // 64) for k in (k1, k2))
        return np.bitwise_count(one ^ two).sum(axis=1, dtype=np.int64)

    def wide(k1: list[bytes], k2: list[bytes]) -> np.ndarray:
        return np.array([differing(x, y) for x, y in zip(k1, k2, strict=True)], np.int64)

    def left(links: DataFrame, sketch: str, count: Callable[[list[bytes], list[bytes]], np.ndarray]) -> DataFrame:
        def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                both = batch.column("_z1").to_numpy().astype(np.int64) + batch.column("_z2").to_numpy()
                least = -(-percent * both // (100 + percent))  # shingles that similar sets share
                differ = count(batch.column("_k1").to_pylist(), batch.column("_k2").to_pylist())
                yield batch.filter(pa.array(differ <= both - 2 * least)).select(["a", "b", "w"])

        one, two = (nodes.select(F.col("node.s").alias(f"_n{i}"), F.col("size").alias(f"_z{i}"), F.expr(sketch).alias(f"_k{i}")) for i in (1, 2))
        met = links.join(one, F.col("a") == F.col("_n1")).join(two, F.col("b") == F.col("_n2")).select("a", "b", "w", "_z1", "_z2", "_k1", "_k2")
        return met.mapInArrow(keep, "a long, b long, w int")

    return left(materialize(left(links, "sketch", narrow), "unruled"), "coalesce(wide, sketch)", wide)


def named_links(links: DataFrame, nodes: DataFrame) -> DataFrame:
    """The links (a, b, w) of s as links of nodes, the smaller one first."""
    one, two = (nodes.select(F.col("node.s").alias(f"_s{i}"), F.col("node").alias(f"_n{i}")) for i in (1, 2))
    met = links.join(one, F.col("a") == F.col("_s1")).join(two, F.col("b") == F.col("_s2"))
    return met.select(F.least("_n1", "_n2").alias("a"), F.greatest("_n1", "_n2").alias("b"), "w")


def similar(links: DataFrame, docs: DataFrame, id_col: str, text_col: str, words: int, percent: int) -> DataFrame:
    """The links (a, b) between texts whose sets of shingles have a Jaccard similarity of percent / 100 or more.

    a and b are nodes of classes(); shingles are made of the linked texts alone. A stored table.
    """
    known = links.select(F.explode(F.array("a", "b")).alias("n")).distinct().select(F.col("n.doc_id").alias("_id"), F.col("n.h").alias("_h"), F.col("n").alias("_node"))
    known = materialize(known, "linked")
    text = F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("h"), text.alias("text"))
    met = rows.join(few(known), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("h") == F.col("_h"))).select("text", "_node.*")

    def shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (whole.slice(i, 200) for whole in batches for i in range(0, whole.num_rows, 200)):
            sets = [np.frombuffer(b"".join(set().union(*shingle_digests(x.as_py(), words, xxhash.xxh64_digest))), "<i8") for x in batch.column(0).cast(pa.binary())]
            ends = np.cumsum([0, *map(len, sets)]).astype(np.int32)
            flat = pa.array(np.concatenate(sets) if sets else np.zeros(0, np.int64), pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.ListArray.from_arrays(ends, flat)], [*NODE, "set"])

    sets = met.mapInArrow(shingles, "none boolean, doc_id long, h long, s long, set array<long>").dropDuplicates(NODE)
    sets = materialize(sets.select(F.struct(*NODE).alias("node"), "set"), "shingle-sets")
    one, two = (sets.select(F.col("node").alias(f"_n{i}"), F.col("set").alias(f"_s{i}")) for i in (1, 2))
    pairs = links.join(one, F.col("a") == F.col("_n1")).join(two, F.col("b") == F.col("_n2"))
    shared = F.size(F.array_intersect("_s1", "_s2"))
    found = materialize(pairs.filter(100 * shared >= percent * (F.size("_s1") + F.size("_s2") - shared)).select("a", "b"), "verified")
    discard(known, sets)
    return found


def _apart(links: DataFrame, roots: DataFrame) -> DataFrame:
    """The links whose ends have different roots, with these as _a and _b."""
    for name in "ab":
        own = roots.select(F.col("node").alias("_n"), F.col("root").alias(f"_{name}"))
        links = links.join(own, F.col(name) == F.col("_n"), "left").drop("_n").withColumn(f"_{name}", F.coalesce(f"_{name}", name))
    return links.filter("_a <> _b")


def rest_pairs(nodes: DataFrame, roots: DataFrame, percent: int, block: int) -> DataFrame:
    """(a, b, w), of s, w a bound for shared shingles: the pairs of nodes in different classes that prefix_pairs() finds, once each."""
    own = roots.select(F.col("node").alias("_n"), F.col("root.s").alias("_r"))
    each = nodes.select("node", "size", "prefix").join(own, F.col("node") == F.col("_n"), "left").select("node.s", F.coalesce("_r", "node.s").alias("root"), "size", F.posexplode("prefix").alias("place", "key"))
    found = _dealt(each.select("key", "s", "root", "size", "place"), nodes.select(F.explode("prefix").alias("key")), block, ["s"]).mapInArrow(prefix_pairs(percent), "a long, b long, most int")
    return materialize(found.groupBy("a", "b").agg(F.max("most").alias("w")), "rest-pairs")


def distinct_sets(prints: DataFrame) -> DataFrame:
    """(node, f1, f2, n, size, prefix, sketch, wide) of each distinct set of shingles, n rows having it. A stored table.

    A node is the struct NODE of a set's first row, none for one without an id,
    so that such rows come last.
    """
    of_set = ("f1", "f2", "size", "prefix", "sketch", "wide")
    nodes = prints.groupBy("s").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h")).alias("first"), F.count(F.lit(1)).alias("n"), *[F.first(x).alias(x) for x in of_set])
    return materialize(nodes.select(F.struct("first.none", "first.doc_id", "first.h", "s").alias("node"), "n", *of_set), "nodes")


def classes(docs: DataFrame, nodes: DataFrame, id_col: str, text_col: str, words: int, percent: int, radius: int, most: int, block: int) -> DataFrame:
    """(node, root) of those nodes of distinct_sets() that are linked to others.

    Links that sketches do not rule out are verified
    by the fingerprints' distance, the closest first, in two rounds; in the
    second only those that still join two classes are. What they leave, for fingerprints meet with a probability and
    large groups hand on forests, is found exactly by prefixes: first one pair
    of two classes, then all that are not yet verified. So each pair of similar
    texts ends in one class.
    """
    known = materialize(nodes.groupBy("f1", "f2").agg(F.min("node").alias("least")), "distinct-fingerprints")
    found = materialize(groups(known, radius, block).mapInArrow(near_links(radius, most), "a1 long, a2 long, b1 long, b2 long, d int"), "near-links")
    one, two = (known.select(F.col("f1").alias(f"_{i}1"), F.col("f2").alias(f"_{i}2"), F.col("least").alias(f"_{i}")) for i in "ab")
    named = found.join(one, (F.col("a1") == F.col("_a1")) & (F.col("a2") == F.col("_a2"))).join(two, (F.col("b1") == F.col("_b1")) & (F.col("b2") == F.col("_b2")))
    same = nodes.select("node", "f1", "f2").join(one, (F.col("f1") == F.col("_a1")) & (F.col("f2") == F.col("_a2"))).filter(F.col("node") != F.col("_a"))
    named = named.select(F.least("_a", "_b").alias("a"), F.greatest("_a", "_b").alias("b"), "d").union(same.select(F.col("_a").alias("a"), F.col("node").alias("b"), F.lit(0).alias("d")))
    named = named.select("a.s", F.col("b.s").alias("b"), F.col("d").alias("w")).withColumnRenamed("s", "a").distinct()
    named = materialize(named_links(unruled(named, nodes, percent), nodes), "named-links")
    discard(known, found)
    sure = tried = roots = None

    def verify(links: DataFrame) -> None:
        nonlocal sure, tried, roots
        open_ = materialize(links.select("a", "b"), "open-links")
        met = similar(open_, docs, id_col, text_col, words, percent)
        sure, tried = (met, open_) if sure is None else (sure.union(met), tried.union(open_))
        roots = materialize(components(sure), "roots")

    def untried(links: DataFrame) -> DataFrame:
        done = tried.select(F.col("a").alias("_ta"), F.col("b").alias("_tb"))
        return links.join(done, (F.col("a") == F.col("_ta")) & (F.col("b") == F.col("_tb")), "left_anti")

    verify(named.filter(F.col("w") <= most // 2))
    verify(_apart(named.filter(F.col("w") > most // 2), roots))
    pairs = rest_pairs(nodes, roots, percent, block)
    rest = materialize(unruled(pairs, nodes, percent), "unruled")
    discard(pairs)
    rest = materialize(untried(named_links(rest, nodes)), "rest")
    best = _apart(rest, roots).groupBy(F.least("_a", "_b").alias("_1"), F.greatest("_a", "_b").alias("_2")).agg(F.max(F.struct("w", "a", "b")).alias("x"))
    verify(best.select("x.a", "x.b"))
    verify(_apart(untried(rest), roots))
    return roots


def one_per_class(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80, radius: int = 4, most: int = 30, block: int = 1024, seed: int = 42) -> DataFrame:
    """The rows of docs that have the smallest id of their class of near copies, once each; all its columns.

    Texts whose sets of `words`-word shingles have a Jaccard similarity of
    percent / 100 or more are linked, all of them. Fingerprints are majorities
    over distinct shingles, of 128 bits in four parts; covering tables on each
    part guarantee that two at 4 * radius + 3 bits or fewer, 19 by default,
    agree in a table. At a similarity of 0.8 fingerprints are some 19 bits
    apart: about 97 % of such pairs meet, and 99.5 % of those at 0.85. What
    meets at `most` bits or fewer is held against the exact similarity; pairs
    that are still in two classes then meet by the first shingles of their sets
    and are held against it too.

    Words are as in simhash.fingerprint(); a shorter text is one shingle. Null
    texts and those without words are copies of one another. Of rows that
    repeat id and text one stays; rows without an id always stay; rows that
    share an id but not a text are told apart. Other columns are not looked at.
    An empty table gives an empty result.
    """
    with shuffles_dropped(docs.sparkSession):
        prints = materialize(wide_fingerprints(docs, id_col, text_col, words, seed, percent), "wide-fingerprints")
        nodes, sets = distinct_sets(prints), materialize(prints.select("doc_id", "h", "s"), "sets-of-rows")
        discard(prints)
        roots = classes(docs, nodes, id_col, text_col, words, percent, radius, most, block)
        root = F.coalesce("_r", "node")
        named = nodes.join(roots.select(F.col("node").alias("_n"), F.col("root").alias("_r")), F.col("node") == F.col("_n"), "left")
        # a lone set's one row stays; others are looked up, the hot ones in parts
        shared = named.filter((F.col("n") > 1) | (root != F.col("node"))).select(F.col("node.s").alias("_set"), root.alias("_root"), F.explode(F.sequence(F.lit(0), F.lit(15))).alias("_s"))
        salted = sets.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "h"), F.lit(16)).cast("int"))
        own = salted.join(shared, (F.col("s") == F.col("_set")) & (F.col("_salt") == F.col("_s"))).filter("doc_id is not null")
        stays = (F.col("doc_id") == F.col("_root.doc_id")) & (F.col("h") == F.col("_root.h"))
        rows = materialize(own.groupBy("doc_id", "h").agg(F.bool_or(stays).alias("stays"), F.count(F.lit(1)).alias("n")), "members")
        discard(nodes, sets)
    h = F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit("")))

    def named_in(these: DataFrame, how: str) -> DataFrame:
        listed = these.select(F.col("doc_id").alias("_near_id"), F.col("h").alias("_near_h"))
        return docs.join(few(listed), (F.col(id_col) == F.col("_near_id")) & (h == F.col("_near_h")), how)

    kept = named_in(rows.filter("not stays or n > 1"), "left_anti")
    again = rows.filter("stays and n > 1")
    if again.isEmpty():
        return kept
    return kept.unionByName(named_in(again, "left_semi").withColumn("_near_h", h).dropDuplicates([id_col, "_near_h"]).drop("_near_h"))
