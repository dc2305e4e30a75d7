"""Block-compressed files: splits at blocks, and regions read through a binned index.

A file is a row of gzip members of up to 64 KB of text, each of which says how
long it is. A virtual offset is a block's place in the file, times 65,536, plus
a place within its text.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

# The beginning of a block, the block that ends a file, the text that a block may hold; numbers of the index formats.
START = b"\x1f\x8b\x08\x04"
END = bytes.fromhex("1f8b08040000000000ff0600424302001b0003000000000000000000")
TEXT = 0xFF00
LINEAR_SHIFT = 14
TBI, CSI = b"TBI\x01", b"CSI\x01"

SPLIT = 8 << 20  # compressed bytes of a partition


def open_file(path: str) -> pa.NativeFile:
    store, inner = fs.FileSystem.from_uri(path)
    return store.open_input_file(inner)


def exists(path: str) -> bool:
    store, inner = fs.FileSystem.from_uri(path)
    return store.get_file_info(inner).type == fs.FileType.File


def block_length(head: bytes, at: int = 0) -> int | None:
    """The bytes of the block whose header stands at a place; None where there is none."""
    if head[at : at + 4] != START or len(head) < at + 18:
        return None
    extra = struct.unpack_from("<H", head, at + 10)[0]
    place, end = at + 12, at + 12 + extra
    while place + 4 <= min(end, len(head)):
        name, size = head[place : place + 2], struct.unpack_from("<H", head, place + 2)[0]
        if name == b"BC" and size == 2 and place + 6 <= len(head):
            return struct.unpack_from("<H", head, place + 4)[0] + 1
        place += 4 + size
    return None


def is_blocked(path: str) -> bool:
    """Whether a file is block-compressed; one in a store that only Spark opens is taken for plain."""
    try:
        with open_file(path) as file:
            return block_length(file.read(64)) is not None
    except (OSError, pa.ArrowInvalid):
        return False


def block_text(file: pa.NativeFile, at: int) -> tuple[bytes, int]:
    """A block's text and the next block's place; nothing at the file's end."""
    file.seek(at)
    head = file.read(18)
    if not head:
        return b"", at
    extra = struct.unpack_from("<H", head, 10)[0] if len(head) == 18 else 0
    head += file.read(max(0, extra - 6))
    length = block_length(head)
    if length is None:
        raise ValueError(f"no block begins at {at}")
    rest = file.read(length - len(head))
    if len(head) + len(rest) < length:
        raise ValueError(f"the block at {at} is cut off")
    text = zlib.decompressobj(-15).decompress(rest[:-8])
    crc, size = struct.unpack("<II", rest[-8:])
    if zlib.crc32(text) != crc or len(text) != size:
        raise ValueError(f"the block at {at} is damaged")
    return text, at + length


def first_block(file: pa.NativeFile, low: int) -> int:
    """The first place from `low` on at which a block begins, and another or the end after it; else the file's size."""
    size, at = file.size(), low
    while at < size:
        file.seek(at)
        data = file.read((1 << 16) + 32)
        place = data.find(START)
        while 0 <= place < 1 << 16:
            length = block_length(data, place)
            if length is not None:
                after = at + place + length
                file.seek(after)
                head = file.read(18)
                if after == size or head[:4] == START:
                    return at + place
            place = data.find(START, place + 1)
        at += 1 << 16
    return size


def blocks(file: pa.NativeFile, at: int) -> Iterator[tuple[int, bytes]]:
    while True:
        text, after = block_text(file, at)
        if after == at:
            return
        yield at, text
        at = after


def lines(file: pa.NativeFile, start: int, end: int | None, skip: bool = False, end_too: bool = False) -> Iterator[tuple[int, bytes]]:
    """(virtual offset, line) of the lines that begin from start to below end, or to the end itself with end_too.

    skip leaves out what comes before the first line's end: the rest of a line
    that began before, or a line that begins at start itself.
    """
    carry: list[bytes] = []
    begun = None
    for at, text in blocks(file, start >> 16):
        place = start & 0xFFFF if at == start >> 16 else 0
        parts = text[place:].split(b"\n")
        for i, one in enumerate(parts):
            ended = i < len(parts) - 1
            if begun is None and (ended or one):
                here = at << 16 | place
                if end is not None and (here > end or here == end and not end_too):
                    return
                begun = here
            carry.append(one)
            if ended:
                if skip:
                    skip = False
                else:
                    yield begun, b"".join(carry).removesuffix(b"\r")
                carry, begun = [], None
                place += len(one) + 1
    if begun is not None and not skip:
        yield begun, b"".join(carry).removesuffix(b"\r")


# the index


@dataclass
class Index:
    """For each sequence its bins' chunks of virtual offsets, and what is known of where its positions begin."""

    shift: int = LINEAR_SHIFT
    depth: int = 5
    names: list[str] = field(default_factory=list)
    bins: list[dict[int, list[tuple[int, int]]]] = field(default_factory=list)
    linear: list[list[int]] = field(default_factory=list)
    first: list[dict[int, int]] = field(default_factory=list)  # by bin, where the linear index is absent

    def level_start(self, level: int) -> int:
        return ((1 << 3 * level) - 1) // 7

    def over(self, low: int, high: int) -> Iterator[int]:
        """The bins that overlap positions from low to below high, counted from zero."""
        for level in range(self.depth + 1):
            shift = self.shift + 3 * (self.depth - level)
            for k in range(low >> shift, (high - 1 >> shift) + 1):
                yield self.level_start(level) + k

    def bin_of(self, low: int, high: int) -> int:
        """The smallest bin that holds all positions from low to below high."""
        for level in range(self.depth, 0, -1):
            shift = self.shift + 3 * (self.depth - level)
            if low >> shift == high - 1 >> shift:
                return self.level_start(level) + (low >> shift)
        return 0

    def chunks(self, name: str, low: int, high: int) -> list[tuple[int, int]]:
        """Disjoint ranges of virtual offsets that hold all records which overlap positions low to below high."""
        if name not in self.names or low >= high:
            return []
        own = self.names.index(name)
        high = min(high, 1 << self.shift + 3 * self.depth)
        if self.linear and self.linear[own]:
            known = self.linear[own]
            least = known[min(low >> LINEAR_SHIFT, len(known) - 1)]
        else:
            least = max([0, *(self.first[own].get(b, 0) for b in self.over(low, low + 1))]) if self.first else 0
        out: list[tuple[int, int]] = []
        for a, b in sorted(c for one in self.over(low, high) for c in self.bins[own].get(one, ()) if c[1] > least):
            a = max(a, least)
            if out and a <= out[-1][1]:
                out[-1] = out[-1][0], max(out[-1][1], b)
            else:
                out.append((a, b))
        return out

    def add(self, name: str, low: int, high: int, start: int, end: int) -> None:
        """A record of positions low to below high that stands from virtual offset start to end."""
        if name not in self.names:
            self.names.append(name)
            self.bins.append({})
            self.linear.append([])
            self.first.append({})
        own = self.names.index(name)
        one = self.bin_of(low, high)
        held = self.bins[own].setdefault(one, [])
        if held and held[-1][1] == start:
            held[-1] = held[-1][0], end
        else:
            held.append((start, end))
        known = self.linear[own]
        for k in range(low >> LINEAR_SHIFT, (high - 1 >> LINEAR_SHIFT) + 1):
            known += [start] * (k + 1 - len(known))
        for b in self.over(low, high):
            self.first[own].setdefault(b, start)


def text_of(path: str) -> bytes:
    with open_file(path) as file:
        return b"".join(text for _, text in blocks(file, 0)) if is_blocked(path) else file.read()


def read_index(path: str) -> Index | None:
    """The index beside a file, .csi or .tbi; its size goes with the sequences' length, not with the records."""
    for ending in (".csi", ".tbi"):
        if exists(path + ending):
            return parse_index(text_of(path + ending))
    return None


def parse_index(raw: bytes) -> Index:
    take = lambda form, at: (struct.unpack_from(form, raw, at), at + struct.calcsize(form))
    out = Index()
    if raw[:4] == TBI:
        (sequences, *_, size), at = take("<8i", 4)
        out.names = [x.decode() for x in raw[at : at + size].split(b"\0")[:-1]]
        at += size
    elif raw[:4] == CSI:
        (out.shift, out.depth, size), at = take("<3i", 4)
        if size >= 28:
            length = struct.unpack_from("<i", raw, at + 24)[0]
            out.names = [x.decode() for x in raw[at + 28 : at + 28 + length].split(b"\0")[:-1]]
        (sequences,), at = take("<i", at + size)
    else:
        raise ValueError("neither a .tbi nor a .csi index")
    limit = out.level_start(out.depth + 1)
    for _ in range(sequences):
        (n,), at = take("<i", at)
        bins, first = {}, {}
        for _ in range(n):
            if raw[:4] == TBI:
                (number, chunks), at = take("<Ii", at)
            else:
                (number, first_offset, chunks), at = take("<IQi", at)
                first[number] = first_offset
            ends, at = take(f"<{2 * chunks}Q", at)
            if number < limit:  # a bin beyond holds counts
                bins[number] = list(zip(ends[::2], ends[1::2], strict=True))
        out.bins.append(bins)
        out.first.append(first)
        if raw[:4] == TBI:
            (n,), at = take("<i", at)
            known, at = take(f"<{n}Q", at)
            out.linear.append(list(known))
    return out


def encode_index(index: Index, kind: bytes = TBI) -> bytes:
    """The index of a call file: columns one and two, comment lines begin with a number sign."""
    names = b"".join(x.encode() + b"\0" for x in index.names)
    about = struct.pack("<7i", 2, 1, 2, 0, ord("#"), 0, len(names)) + names
    out = [kind, struct.pack("<i", len(index.names)), about] if kind == TBI else [kind, struct.pack("<3i", index.shift, index.depth, len(about)), about, struct.pack("<i", len(index.names))]
    for bins, known, first in zip(index.bins, index.linear, index.first, strict=True):
        out.append(struct.pack("<i", len(bins)))
        for number, chunks in sorted(bins.items()):
            out.append(struct.pack("<Ii", number, len(chunks)) if kind == TBI else struct.pack("<IQi", number, first[number], len(chunks)))
            out += [struct.pack("<QQ", *c) for c in chunks]
        if kind == TBI:
            out.append(struct.pack(f"<i{len(known)}Q", len(known), *known))
    return b"".join(out)


class Writer:
    """Bytes in blocks; a mark is the virtual offset of what comes next."""

    def __init__(self, level: int = 6):
        self.done, self.held, self.level, self.out = 0, b"", level, []

    @property
    def mark(self) -> int:
        return self.done << 16 | len(self.held)

    def write(self, data: bytes) -> None:
        while data:
            room = TEXT - len(self.held)
            self.held, data = self.held + data[:room], data[room:]
            if len(self.held) == TEXT:
                self.flush()

    def flush(self) -> None:
        if self.held:
            deflate = zlib.compressobj(self.level, zlib.DEFLATED, -15)
            body = deflate.compress(self.held) + deflate.flush()
            head = START + struct.pack("<IBBH2sHH", 0, 0, 255, 6, b"BC", 2, len(body) + 25)
            self.out.append(head + body + struct.pack("<II", zlib.crc32(self.held), len(self.held)))
            self.done += len(self.out[-1])
            self.held = b""

    def finish(self) -> bytes:
        self.flush()
        return b"".join(self.out) + END


def compressed(data: bytes, level: int = 6) -> bytes:
    out = Writer(level)
    out.write(data)
    return out.finish()


def indexed_calls(head: list[str], rows: list[str], kind: bytes = TBI) -> tuple[bytes, bytes]:
    """A call file in blocks and its index; rows are its lines by contig and position."""
    out, index = Writer(), Index()
    out.write("".join(f"{x}\n" for x in head).encode())
    for row in rows:
        name, pos, _, ref, _ = row.split("\t", 4)
        data, start = (row + "\n").encode(), out.mark
        if len(out.held) + len(data) > TEXT:  # a record begins a block where it would not fit
            out.flush()
            start = out.mark
        out.write(data)
        index.add(name, int(pos) - 1, int(pos) - 1 + len(ref), start, out.mark)
    return out.finish(), compressed(encode_index(index, kind))


# the source


@dataclass(frozen=True)
class Stretch(InputPartition):
    """Virtual offsets; where `begins` or `ends` is false, that end is the first block found from there on."""

    path: str
    start: int
    end: int
    begins: bool = True
    ends: bool = True


def stretches(path: str, chunks: list[tuple[int, int]] | None, split: int) -> list[Stretch]:
    """The file, or chunks of it, in pieces of about `split` compressed bytes."""
    if chunks is None:
        with open_file(path) as file:
            chunks = [(0, file.size() << 16)]
    out = []
    for start, end in chunks:
        cuts = [start, *(c << 16 for c in range((start >> 16) + split, end >> 16, split)), end]
        out += [Stretch(path, a, b, a == start, b == end) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    return out


def stretch_lines(file: pa.NativeFile, one: Stretch) -> Iterator[tuple[int, bytes]]:
    """A piece's lines: those that begin after its first block's beginning, and the one that begins with the next piece's."""
    start = one.start if one.begins else first_block(file, one.start >> 16) << 16
    end = one.end if one.ends else first_block(file, one.end >> 16) << 16
    return iter(()) if start >= end else lines(file, start, end, skip=not one.begins, end_too=not one.ends)


class BlockLinesReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.split, self.region = options["path"], int(options.get("split", SPLIT)), options.get("region")

    def files(self) -> list[str]:
        store, inner = fs.FileSystem.from_uri(self.path)
        info = store.get_file_info(inner)
        if info.type == fs.FileType.Directory:
            return sorted(self.path.rstrip("/") + "/" + x.base_name for x in store.get_file_info(fs.FileSelector(inner)) if x.base_name.endswith((".gz", ".bgz")))
        return [self.path]

    def partitions(self) -> list[InputPartition]:
        out = []
        for path in self.files():
            chunks = None
            if self.region is not None:
                name, low, high = self.region.split("\t")
                index = read_index(path)
                chunks = None if index is None else index.chunks(name, int(low), int(high))
            out += stretches(path, chunks, self.split)
        return out or [Stretch("", 0, 0)]

    def read(self, partition: Stretch) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        if not partition.path:
            return
        with open_file(partition.path) as file:
            for at, line in stretch_lines(file, partition):
                held.append((at, line.decode("utf-8", "replace")))
                size += len(line)
                if size >= 4 << 20:
                    yield self.batch(partition.path, held)
                    held, size = [], 0
        yield self.batch(partition.path, held)

    @staticmethod
    def batch(path: str, held: list[tuple[int, str]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([path] * len(held), pa.string()), pa.array([x for x, _ in held], pa.int64()), pa.array([x for _, x in held], pa.string())], ["file", "offset", "value"])


class BlockLines(DataSource):
    """Lines of block-compressed files: path, a file or a folder of them; split, the compressed bytes of a partition.

    region, a name, start and end parted by tabs and counted from zero, reads
    only the blocks that a file's index has for it, and all of a file without.
    """

    @classmethod
    def name(cls) -> str:
        return "blocklines"

    def schema(self) -> str:
        return "file string, offset long, value string"

    def reader(self, schema) -> DataSourceReader:
        return BlockLinesReader(dict(self.options))


def read_lines(spark: SparkSession, path: str, region: tuple[str, int, int] | None = None, split: int = SPLIT) -> DataFrame:
    """(file, offset, value): lines by file and virtual offset; region's positions are counted from zero, its end left out."""
    spark.dataSource.register(BlockLines)
    reader = spark.read.format("blocklines").option("split", split)
    if region is not None:
        reader = reader.option("region", "\t".join(map(str, region)))
    return reader.load(path)


def head_lines(path: str) -> list[str]:
    """The comment lines that a file begins with."""
    out = []
    with open_file(path) as file:
        for _, line in lines(file, 0, None):
            if not line.startswith(b"#"):
                break
            out.append(line.decode("utf-8", "replace"))
    return out


def write_call_files(rows: DataFrame, head: list[str], folder: str, kind: bytes = TBI) -> DataFrame:
    """(file, bytes): a block-compressed call file with its index for each name in rows (name, contig, pos, value).

    value is a data line. A file is one task's, so a name should stand for a
    bounded span of a contig; its lines are put in order by contig and position.
    """

    def write(key: tuple, table: pa.Table) -> pa.Table:
        lines = table.sort_by([("contig", "ascending"), ("pos", "ascending"), ("value", "ascending")]).column("value").to_pylist()
        store, base = fs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)
        name, parts = f"{key[0].as_py()}.vcf.gz", indexed_calls(head, lines, kind)
        for ending, data in zip((".tbi" if kind == TBI else ".csi", ""), reversed(parts), strict=True):  # a task that runs again writes the same
            with store.open_output_stream(f"{base}/.{name}{ending}.part", compression=None) as out:
                out.write(data)
            store.move(f"{base}/.{name}{ending}.part", f"{base}/{name}{ending}")
        return pa.table({"file": [f"{folder}/{name}"], "bytes": [len(parts[0])]})

    return rows.groupBy("name").applyInArrow(write, "file string, bytes long")
