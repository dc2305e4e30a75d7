"""Tree sequences in key-array stores, as a data source of Spark: spark.read.format("trees").

A store is a header, a directory of named arrays, and the arrays, each aligned
to eight bytes. A partition is a range of a table's rows, or several small files
of a folder; of it only the bytes of the wanted columns are read.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

# The container's format.
MAGIC = b"\x89KAS\r\n\x1a\n"
HEADER, DESCRIPTOR, ALIGNMENT = 64, 64, 8
TYPES = ("i1", "u1", "i2", "u2", "i4", "u4", "i8", "u8", "f4", "f8")

#: A table's columns: Spark's type and the name of the array; strings have an array of offsets beside them.
TABLES = {
    "nodes": {"time": "double", "flags": "long", "population": "long", "individual": "long"},
    "edges": {"left": "double", "right": "double", "parent": "long", "child": "long"},
    "sites": {"position": "double", "ancestral_state": "string"},
    "mutations": {"site": "long", "node": "long", "parent": "long", "time": "double", "derived_state": "string"},
    "individuals": {"flags": "long"},
    "populations": {"metadata": "string"},
    "sequence": {"length": "double"},
}
#: Columns by which a table's rows are sorted.
SORTED = {"sites": "position", "mutations": "site"}
#: Columns of a mutation's site that can be named beside its own.
OF_SITE = {"position": "double", "ancestral_state": "string"}
ROWS, BATCH = 1 << 20, 1 << 16
SMALL = 1 << 22  # bytes of small files that a partition reads together


@dataclass(frozen=True)
class Held:
    """Where an array is, and of what type."""

    kind: str
    start: int
    length: int

    @property
    def width(self) -> int:
        return np.dtype(self.kind).itemsize


def directory(file: pa.NativeFile) -> dict[str, Held]:
    """The arrays of a store by name; the header and the directory are all that is read."""
    file.seek(0)
    head = file.read(HEADER)
    if len(head) < HEADER or head[:8] != MAGIC:
        raise ValueError("not a tree sequence file: it does not begin as a key-array store")
    major, _, items, size = struct.unpack_from("<HHIQ", head, 8)
    if major != 1:
        raise ValueError(f"a key-array store of version {major}, not 1")
    if file.size() < size:
        raise ValueError(f"the file has {file.size()} bytes of {size}")
    table = file.read(items * DESCRIPTOR)
    found, keys = [], []
    for i in range(items):
        kind = table[i * DESCRIPTOR]
        if kind >= len(TYPES):
            raise ValueError(f"an array of unknown type {kind}")
        key, key_length, start, length = struct.unpack_from("<QQQQ", table, i * DESCRIPTOR + 8)
        keys.append((key, key_length))
        found.append(Held("<" + TYPES[kind], start, length))
    if not keys:
        return {}
    first, last = min(a for a, _ in keys), max(a + n for a, n in keys)
    file.seek(first)
    names = file.read(last - first)
    return {names[a - first : a - first + n].decode(): held for (a, n), held in zip(keys, found, strict=True)}


def part(file: pa.NativeFile, held: Held, low: int, high: int) -> np.ndarray:
    """Elements low to high of an array."""
    file.seek(held.start + low * held.width)
    return np.frombuffer(file.read((high - low) * held.width), held.kind)


def array_name(table: str, column: str) -> str:
    return "sequence_length" if table == "sequence" else f"{table}/{column}"


def row_count(arrays: dict[str, Held], table: str) -> int:
    column = next(iter(TABLES[table]))
    held = arrays.get(array_name(table, column) + ("_offset" if TABLES[table][column] == "string" else ""))
    if held is None:
        raise ValueError(f"the file has no {table}")
    return held.length - (TABLES[table][column] == "string")


def column_of(file: pa.NativeFile, arrays: dict[str, Held], table: str, column: str, low: int, high: int) -> pa.Array:
    """Rows low to high of one column; one that a file may lack is null."""
    kind, name = TABLES[table][column], array_name(table, column)
    held = arrays.get(name)
    if kind == "string":
        offset = arrays.get(f"{name}_offset")
        if held is None or offset is None:
            return pa.nulls(high - low, pa.string())
        ends = part(file, offset, low, high + 1).astype(np.int64)
        data = part(file, held, int(ends[0]), int(ends[-1])).tobytes()
        ends = ends - ends[0]
        if data.isascii() and len(data) < 1 << 31:
            return pa.StringArray.from_buffers(high - low, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(data))
        return pa.array([data[a:b].decode("utf-8", "replace") for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)], pa.string())
    arrow = pa.float64() if kind == "double" else pa.int64()
    if held is None:
        return pa.nulls(high - low, arrow)
    values = part(file, held, low, high)
    # an unknown time is a not-a-number of its own
    return pa.array(values.astype(np.float64 if kind == "double" else np.int64), mask=np.isnan(values) if held.kind[1] == "f" else None)


def of_sites(file: pa.NativeFile, arrays: dict[str, Held], column: str, low: int, high: int) -> pa.Array:
    """A column of the sites of mutations low to high: they are sorted by site, so theirs stand together, and are read BATCH at a time."""
    held, n = arrays.get(array_name("mutations", "site")), row_count(arrays, "sites")
    if held is None:
        raise ValueError("the file has no sites of mutations")
    wanted = part(file, held, low, high).astype(np.int64)
    if len(wanted) and not 0 <= wanted.min() <= wanted.max() < n:
        raise ValueError(f"a mutation is at a site that is none of {n}")
    order = np.argsort(wanted, kind="stable")
    places, found = wanted[order], []
    while len(places):
        first = int(places[0])
        here = places[: np.searchsorted(places, first + BATCH)]
        found.append(column_of(file, arrays, "sites", column, first, int(here[-1]) + 1).take(pa.array(here - first)))
        places = places[len(here) :]
    if not found:
        return pa.nulls(0, pa.float64() if OF_SITE[column] == "double" else pa.string())
    return pa.concat_arrays(found).take(pa.array(np.argsort(order, kind="stable")))


def first_at(file: pa.NativeFile, held: Held, value: float) -> int:
    """The first row of a sorted column at or above a value: a few bytes for each halving."""
    low, high = 0, held.length
    while low < high:
        middle = (low + high) // 2
        here = part(file, held, middle, middle + 1)[0]
        low, high = (middle + 1, high) if here < value else (low, middle)
    return low


@dataclass(frozen=True)
class Rows(InputPartition):
    path: str
    low: int
    high: int


@dataclass(frozen=True)
class Files(InputPartition):
    """Files that one task reads whole."""

    paths: tuple[str, ...]


def columns_of(table: str) -> dict[str, str]:
    """The columns of a table that a reader can name, and their types."""
    return {"file": "string", "id": "long"} | TABLES[table] | (OF_SITE if table == "mutations" else {})


class TreesReader(DataSourceReader):
    def __init__(self, options: dict[str, str], schema: StructType):
        self.table, self.rows = options.get("table", "edges"), int(options.get("rows", ROWS))
        self.path, self.columns = options["path"], [f.name for f in schema.fields]
        if absent := sorted(set(self.columns) - columns_of(self.table).keys()):
            raise ValueError(f"{self.table} has no {', '.join(absent)}")
        self.low, self.high = (float(options[x]) if x in options else None for x in ("low", "high"))
        if (self.low, self.high) != (None, None) and self.table not in SORTED:
            raise ValueError(f"{self.table} are not sorted by a column")

    def files(self) -> list[tuple[str, int | None]]:
        """The file, or a folder's files that end in .trees or .ts and how many bytes each has."""
        store, path = fs.FileSystem.from_uri(self.path)
        info = store.get_file_info(path)
        if info.type == fs.FileType.Directory:
            found = store.get_file_info(fs.FileSelector(path))
            return sorted((self.path.rstrip("/") + "/" + x.base_name, x.size) for x in found if x.base_name.endswith((".trees", ".ts")))
        if info.type == fs.FileType.NotFound:
            raise ValueError(f"no such file: {self.path}")
        return [(self.path, None)]

    def ends(self, file: pa.NativeFile, arrays: dict[str, Held]) -> tuple[int, int]:
        """The first row that is wanted, and the one after the last."""
        low, high = 0, row_count(arrays, self.table)
        if self.table in SORTED:
            held = arrays[array_name(self.table, SORTED[self.table])]
            low = low if self.low is None else first_at(file, held, self.low)
            high = high if self.high is None else first_at(file, held, self.high)
        return low, high

    def partitions(self) -> Sequence[InputPartition]:
        """Ranges of the rows of a file; small files of a folder go together, and are not opened here."""
        out, together, size = [], [], 0
        most = min(SMALL, 4 * self.rows)  # a row takes four bytes of a file at least
        for path, own in self.files():
            if own is not None and own <= most:
                if together and size + own > most:
                    out.append(Files(tuple(together)))
                    together, size = [], 0
                together.append(path)
                size += own
                continue
            store, inner = fs.FileSystem.from_uri(path)
            with store.open_input_file(inner) as file:
                low, high = self.ends(file, directory(file))
            out += [Rows(path, a, min(a + self.rows, high)) for a in range(low, high, self.rows)]
        if together:
            out.append(Files(tuple(together)))
        return out or [Rows("", 0, 0)]

    def read(self, partition: Rows | Files) -> Iterator[pa.RecordBatch]:
        if isinstance(partition, Files):
            for path in partition.paths:
                yield from self.batches(path)
        elif partition.path:
            yield from self.batches(partition.path, partition.low, partition.high)

    def batches(self, path: str, first: int = 0, last: int | None = None) -> Iterator[pa.RecordBatch]:
        """The rows of a file from first to last, or all that are wanted."""
        store, inner = fs.FileSystem.from_uri(path)
        with store.open_input_file(inner) as file:
            arrays = directory(file)
            if last is None:
                first, last = self.ends(file, arrays)
            for low in range(first, last, BATCH):
                high = min(low + BATCH, last)
                columns = []
                for name in self.columns:
                    if name == "file":
                        columns.append(pa.repeat(path, high - low))
                    elif name == "id":
                        columns.append(pa.array(np.arange(low, high)))
                    elif name not in TABLES[self.table]:
                        columns.append(of_sites(file, arrays, name, low, high))
                    else:
                        columns.append(column_of(file, arrays, self.table, name, low, high))
                yield pa.RecordBatch.from_arrays(columns, self.columns)


class TreesSource(DataSource):
    """Options: table, one of TABLES, by default edges; rows, how many a partition has at most.

    low and high keep rows of a sorted table from low on and below high, by
    SORTED's column; their ends are found by halving. A schema given to the reader names the columns that are read.
    """

    @classmethod
    def name(cls) -> str:
        return "trees"

    def schema(self) -> str:
        table = self.options.get("table", "edges")
        if table not in TABLES:
            raise ValueError(f"no such table: {table}; there are {', '.join(TABLES)}")
        return ", ".join(["file string", "id long", *(f"{k} {v}" for k, v in TABLES[table].items())])

    def reader(self, schema: StructType) -> DataSourceReader:
        return TreesReader(dict(self.options), schema)


def read_table(spark: SparkSession, path: str, table: str, columns: Sequence[str] | None = None, rows: int = ROWS, low: float | None = None, high: float | None = None) -> DataFrame:
    """One table of a file, or of all files of a folder: (file, id) and its columns, or those that are named; of sorted ones rows from low to below high."""
    spark.dataSource.register(TreesSource)
    reader = spark.read.format("trees").option("table", table).option("rows", rows)
    for name, value in (("low", low), ("high", high)):
        reader = reader if value is None else reader.option(name, repr(float(value)))
    if columns is not None:
        known = columns_of(table)
        if absent := sorted(set(columns) - known.keys()):
            raise ValueError(f"{table} has no {', '.join(absent)}")
        reader = reader.schema(", ".join(f"{c} {known[c]}" for c in columns))
    return reader.load(path)


def edges_of(spark: SparkSession, path: str) -> DataFrame:
    """edges(file, left, right, parent, child)."""
    return read_table(spark, path, "edges", ["file", "left", "right", "parent", "child"])


def mutations_of(spark: SparkSession, path: str) -> DataFrame:
    """mutations(file, pos, id, node, state, ancestral): each mutation beside its site."""
    rows = read_table(spark, path, "mutations", ["file", "id", "node", "derived_state", "position", "ancestral_state"])
    return rows.select("file", F.col("position").alias("pos"), "id", "node", F.col("derived_state").alias("state"), F.col("ancestral_state").alias("ancestral"))


def encoded(arrays: dict[str, np.ndarray]) -> bytes:
    """A store of arrays; names are kept in order, as the format has it."""
    names = sorted(arrays)
    keys = HEADER + DESCRIPTOR * len(names)
    at = keys + sum(len(x.encode()) for x in names)
    descriptors, body, key_at = [], b"", keys
    data_start = -(-at // ALIGNMENT) * ALIGNMENT
    for name in names:
        values = np.ascontiguousarray(arrays[name])
        values = values.astype(values.dtype.newbyteorder("<"))
        body += b"\0" * (-len(body) % ALIGNMENT)
        code = TYPES.index(values.dtype.str[1:])
        descriptors.append(struct.pack("<B7xQQQQ24x", code, key_at, len(name.encode()), data_start + len(body), len(values)))
        key_at += len(name.encode())
        body += values.tobytes()
    head = MAGIC + struct.pack("<HHIQ40x", 1, 0, len(names), data_start + len(body))
    listed = b"".join([head, *descriptors, *(x.encode() for x in names)])
    return listed + b"\0" * (data_start - len(listed)) + body


def ragged(values: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of strings one after another, and their offsets."""
    raw = [x.encode() for x in values]
    return np.frombuffer(b"".join(raw), np.int8), np.cumsum([0, *map(len, raw)]).astype(np.uint32)


def write_files(rows: DataFrame, folder: str) -> DataFrame:
    """(file, bytes): one store for each name in rows, written in a folder that executors share.

    rows is (name, length, kind, a, b, c, d, state, ancestral): kind "edge" has
    left, right, parent and child in a to d, and kind "mutation" its position
    and node in a and b, and its number within the position in c. A file is one
    task's, so a name should stand for a bounded span of a sequence. Nodes are
    numbered as they are given; the older a node, the larger its number.
    """

    def write(key: tuple, table: pa.Table) -> pa.Table:
        name = key[0].as_py()
        of = lambda kind, *order: table.filter(pc.equal(table.column("kind"), kind)).sort_by([(x, "ascending") for x in order])
        edges, muts = of("edge", "c", "d", "a", "b"), of("mutation", "a", "c", "b", "state", "ancestral")
        left, right, parent, child = (edges.column(x).to_numpy() for x in "abcd")
        pos, node = (muts.column(x).to_numpy() for x in "ab")
        places, number = np.unique(pos, return_inverse=True)
        nodes = 1 + int(max([0, *(x.max() for x in (parent, child, node) if len(x))]))
        column = lambda values, kind: np.array(values, kind)
        states, state_ends = ragged(muts.column("state").to_pylist())
        olds, old_ends = ragged(muts.column("ancestral").take(pa.array(np.searchsorted(pos, places, "right") - 1)).to_pylist())
        arrays = {
            "format/name": np.frombuffer(b"tskit.trees", np.int8), "format/version": column([12, 7], "u4"), "sequence_length": column([table.column("length")[0].as_py()], "f8"),
            "nodes/time": np.arange(nodes, dtype="f8"), "nodes/flags": column([0] * nodes, "u4"), "nodes/population": column([-1] * nodes, "i4"), "nodes/individual": column([-1] * nodes, "i4"),
            "edges/left": left, "edges/right": right, "edges/parent": column(parent, "i4"), "edges/child": column(child, "i4"),
            "indexes/edge_insertion_order": np.argsort(left, kind="stable").astype("i4"), "indexes/edge_removal_order": np.argsort(right, kind="stable").astype("i4"),
            "sites/position": column(places, "f8"), "sites/ancestral_state": olds, "sites/ancestral_state_offset": old_ends,
            "mutations/site": column(number, "i4"), "mutations/node": column(node, "i4"), "mutations/parent": column([-1] * len(muts), "i4"),
            "mutations/time": column([np.nan] * len(muts), "f8"), "mutations/derived_state": states, "mutations/derived_state_offset": state_ends,
        }
        raw = encoded(arrays)
        store, base = fs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)
        with store.open_output_stream(f"{base}/{name}.trees.part", compression=None) as out:
            out.write(raw)
        store.move(f"{base}/{name}.trees.part", f"{base}/{name}.trees")  # a task that runs again writes the same file
        return pa.table({"file": [f"{folder}/{name}.trees"], "bytes": [len(raw)]})

    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(parts, "name").groupBy("name").applyInArrow(write, "file string, bytes long")
