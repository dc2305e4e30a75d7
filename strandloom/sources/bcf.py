"""Binary call files: records in blocks, read through the index where there is one."""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from . import blocks

MAGIC = b"BCF\x02"
# The format's types of numbers by code, and a vector's end mark in each.
WHOLE = {1: "<i1", 2: "<i2", 3: "<i4"}
VECTOR_END = {1: -127, 2: -32767, 3: -2147483647}
MISSING = -1


class Head:
    """What the text header tells: the contigs, samples and keys by number, and where the records begin."""

    def __init__(self, text: str):
        self.contigs: dict[int, str] = {}
        self.lengths: dict[str, int] = {}
        self.keys: dict[int, str] = {0: "PASS"}
        self.samples: list[str] = []
        for line in text.split("\n"):
            found = re.match(r"##(contig|FILTER|INFO|FORMAT)=<(.*)>\s*$", line)
            if found:
                value = lambda key: (re.search(rf"(?:^|,){key}=([^,>]*)", found[2]) or [None, None])[1]  # noqa: B023, E731
                name, number = value("ID"), value("IDX")
                held = self.contigs if found[1] == "contig" else self.keys
                if name not in held.values():
                    held[int(number) if number is not None else len(held)] = name
                if found[1] == "contig" and (value("length") or "").isdigit():
                    self.lengths[name] = int(value("length"))
            elif line.startswith("#CHROM"):
                self.samples = line.rstrip("\0\r").split("\t")[9:]


class Stream:
    """Bytes of a block-compressed file from a virtual offset on."""

    def __init__(self, file: pa.NativeFile, start: int):
        self.blocks = blocks.blocks(file, start >> 16)
        self.at, self.text = next(self.blocks, (start >> 16, b""))
        self.place = start & 0xFFFF

    @property
    def offset(self) -> int:
        """Where the next byte is; at a block's end, the next block with text."""
        while self.place >= len(self.text):
            one = next(self.blocks, None)
            if one is None:
                break
            (self.at, self.text), self.place = one, 0
        return self.at << 16 | self.place

    def take(self, count: int) -> bytes:
        out = []
        while count:
            self.offset  # noqa: B018
            piece = self.text[self.place : self.place + count]
            if not piece:
                raise ValueError("the file ends within a record")
            out.append(piece)
            self.place += len(piece)
            count -= len(piece)
        return b"".join(out)


def read_head(path: str) -> tuple[Head, int]:
    """The header, and the virtual offset of the first record."""
    with blocks.open_file(path) as file:
        stream = Stream(file, 0)
        if stream.take(4) != MAGIC:
            raise ValueError(f"not a binary call file of version 2: {path}")
        stream.take(1)
        (length,) = struct.unpack("<I", stream.take(4))
        return Head(stream.take(length).rstrip(b"\0").decode("utf-8", "replace")), stream.offset


def typed(raw: bytes, at: int) -> tuple[int, int, int]:
    """(type, how many, where the values begin) of the typed value at a place."""
    kind, count, at = raw[at] & 15, raw[at] >> 4, at + 1
    if count == 15:
        form = WHOLE[raw[at] & 15]
        count = int(np.frombuffer(raw, form, 1, at + 1)[0])
        at += 1 + np.dtype(form).itemsize
    return kind, count, at


WIDTH = {0: 0, 1: 1, 2: 2, 3: 4, 5: 4, 7: 1}


def text_value(raw: bytes, at: int) -> tuple[str, int]:
    _, count, at = typed(raw, at)
    return raw[at : at + count].decode("utf-8", "replace"), at + count


def record(shared: bytes, own: bytes, head: Head, wanted: np.ndarray) -> tuple[str, int, str, str, list[int]]:
    """(contig, pos, ref, alt, two alleles of each wanted sample); a missing allele is MISSING."""
    contig, pos, _, _, alleles, formats = struct.unpack_from("<iiifII", shared, 0)
    _, at = text_value(shared, 24)
    names = []
    for _ in range(alleles >> 16):
        name, at = text_value(shared, at)
        names.append(name)
    samples, place = formats & 0xFFFFFF, 0
    found = np.full((len(wanted), 2), MISSING, np.int64)
    for _ in range(formats >> 24):
        kind, _, start = typed(own, place)
        key = int(np.frombuffer(own, WHOLE[kind], 1, start)[0])
        kind, count, start = typed(own, start + WIDTH[kind])
        place = start + samples * count * WIDTH[kind]
        if head.keys.get(key) == "GT" and count and kind in WHOLE:
            values = np.frombuffer(own, WHOLE[kind], samples * count, start).reshape(samples, count)[wanted, :2].astype(np.int64)
            values = np.where((values == VECTOR_END[kind]) | (values >> 1 == 0) | (values < 0), MISSING, (values >> 1) - 1)
            found[:, : values.shape[1]] = values
    return head.contigs[contig], pos + 1, names[0] if names else "", ",".join(names[1:]), found.ravel().tolist()


class BcfReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.samples, self.region = options["path"], options["samples"].split("\t"), options.get("region")

    def partitions(self) -> list[InputPartition]:
        """The index's chunks for the region or for each contig; records cannot be found without it, so a file without is one."""
        head, start = read_head(self.path)
        index = blocks.read_index(self.path)
        if index is None:
            with blocks.open_file(self.path) as file:
                return [blocks.Stretch(self.path, start, file.size() << 16)]
        if not index.names:  # such an index numbers the contigs as the header does
            index.names = [head.contigs[i] for i in sorted(head.contigs)][: len(index.bins)]
        if self.region is not None:
            name, low, high = self.region.split("\t")
            found = index.chunks(name, int(low), int(high))
        else:
            found = sorted({c for bins in index.bins for chunks in bins.values() for c in chunks})
        return [blocks.Stretch(self.path, a, b) for a, b in found] or [blocks.Stretch("", 0, 0)]

    def read(self, partition: blocks.Stretch) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        head, _ = read_head(partition.path)
        wanted = np.array([head.samples.index(s) for s in self.samples], np.int64)
        kinds = pa.schema([("offset", pa.int64()), ("contig", pa.string()), ("pos", pa.int64()), ("ref", pa.string()), ("alt", pa.string()), ("alleles", pa.list_(pa.int64()))])
        rows: list[tuple] = []
        with blocks.open_file(partition.path) as file:
            stream = Stream(file, partition.start)
            while (at := stream.offset) < partition.end and stream.place < len(stream.text):
                shared, own = struct.unpack("<II", stream.take(8))
                rows.append((at, *record(stream.take(shared), stream.take(own), head, wanted)))
                if len(rows) >= 2000:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds.types, strict=True)], schema=kinds)
                    rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds.types, strict=True)], schema=kinds)


class Bcf(DataSource):
    """Options: path; samples and region, their parts parted by tabs."""

    @classmethod
    def name(cls) -> str:
        return "bcf"

    def schema(self) -> str:
        return "offset long, contig string, pos long, ref string, alt string, alleles array<long>"

    def reader(self, schema) -> DataSourceReader:
        return BcfReader(dict(self.options))


def read_bcf(spark: SparkSession, path: str, samples: list[str], region: tuple[str, int, int] | None = None) -> DataFrame:
    """calls(record, contig, pos, ref, alt, sample, a0, a1) of the named samples; region's positions as text.read_vcf has them."""
    spark.dataSource.register(Bcf)
    reader = spark.read.format("bcf").option("samples", "\t".join(samples))
    if region is not None:
        reader = reader.option("region", "\t".join(map(str, region)))
    rows = reader.load(path)
    if region is not None:
        rows = rows.filter((F.col("contig") == region[0]) & (F.col("pos") > region[1]) & (F.col("pos") <= region[2]))
    long = rows.select(F.col("offset").alias("record"), "contig", "pos", "ref", "alt", "alleles", F.posexplode(F.array(*map(F.lit, samples))).alias("_i", "sample"))
    allele = lambda k: F.nullif(F.get("alleles", 2 * F.col("_i") + k), F.lit(MISSING)).cast("int")
    return long.select("record", "contig", "pos", "ref", "alt", "sample", allele(0).alias("a0"), allele(1).alias("a1"))
