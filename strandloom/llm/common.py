"""Shared helpers: scratch tables, prefix sums that survive skew, components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from weakref import WeakKeyDictionary

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_local_scratch: dict[str, str] = {}


def scratch_root(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir.

    Where it is unset, a local master gets a temporary folder of its own; a
    cluster is an error, for its executors would not see a local folder.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _local_scratch:
        _local_scratch[app] = tempfile.mkdtemp(prefix="spark-")
    return _local_scratch[app]


_folders: dict[str, str] = {}


def scratch_folder(spark: SparkSession) -> str:
    """The application's own folder beneath scratch_root(); it is deleted when the driver ends."""
    app = spark.sparkContext.applicationId
    if app not in _folders:
        folder = f"{scratch_root(spark)}/strandloom-{app}"
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        store = path.getFileSystem(spark._jsc.hadoopConfiguration())
        store.mkdirs(path)
        store.deleteOnExit(path)
        _folders[app] = folder
    return _folders[app]


_stored: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it again.

    It cuts the lineage, so that a lost executor costs no recomputation of what
    came before, and lets several branches read one result.
    """
    spark = df.sparkSession
    path = f"{scratch_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _stored[out] = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes the files of tables from materialize() that nothing reads any more."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(_stored.pop(df))
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """While it lasts, a query's shuffle files go when it ends, not when the driver collects its garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def small_arrow_batches(spark: SparkSession) -> None:
    """Bounds what a Python worker holds at once when texts are long."""
    for key, value in (("spark.sql.execution.arrow.maxBytesPerBatch", "8m"), ("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")):
        try:
            spark.conf.set(key, value)
        except Exception as error:  # a setting that this release fixes at start
            if "CANNOT_MODIFY" not in str(error):
                raise


def few(df: DataFrame, most: int = 1 << 20) -> DataFrame:
    """df, to be broadcast if it has `most` rows or fewer; a stored table of short rows, for it is counted."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


#: Groups that a hot key is dealt into; fixed, so that results do not depend on a session's settings.
SALTS = 64


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def prefix_sums(df: DataFrame, keys: Sequence[str], order: Sequence[str], sums: dict[str, Column], salts: int = SALTS) -> DataFrame:
    """Adds, under each name in sums, the exclusive running total of a value within keys.

    The order is (hash of the order columns modulo salts, the order columns), so
    a hot key is spread over salts window groups; the groups' offsets come from
    a second, pre-aggregated pass with one row for each key and salt. keys must
    not be null. df is read twice: give a stored table.
    """
    df = df.withColumn("_salt", F.pmod(F.xxhash64(*order), F.lit(salts)))
    values = {f"_v_{name}": value for name, value in sums.items()}
    df = df.withColumns(values)
    within = Window.partitionBy(*keys, "_salt").orderBy(*order)
    running = within.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    parts = df.groupBy(*keys, "_salt").agg(*[F.sum(v).alias(f"_t{v}") for v in values])
    before = Window.partitionBy(*keys).orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col("_salt").alias("_s"), *[F.coalesce(F.sum(f"_t{v}").over(before), F.lit(0)).alias(f"_o{v}") for v in values])
    here = df.withColumns({f"_r{v}": F.sum(v).over(running) - F.col(v) for v in values})
    on = [F.col(k) == F.col(f"_k_{k}") for k in keys] + [F.col("_salt") == F.col("_s")]
    out = here.join(offsets, on, "left")
    out = out.withColumns({name: F.col(f"_r_v_{name}") + F.coalesce(F.col(f"_o_v_{name}"), F.lit(0)) for name in sums})
    drop = [c for c in out.columns if c.startswith(("_r_v_", "_o_v_", "_v_", "_k_")) or c in ("_s", "_salt")]
    return out.drop(*drop)


def spread_hot(members: DataFrame, keys: Sequence[str], id_col: str, block: int) -> DataFrame:
    """Members of buckets that hold two or more rows, dealt into pairs of blocks.

    A bucket of n rows is cut into ceil(n / block) blocks by the hash of id_col;
    every pair of blocks, a block with itself included, becomes a group of its
    own (keys, _p1, _p2), of about 2 * block rows at most. Every pair of members
    with different blocks meets once and those of one block once. members is
    read twice: give a stored table. Sorted by group within partitions.
    """
    sizes = members.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    named = sizes.select(*[F.col(k).alias(f"_k_{k}") for k in keys], "_n")
    met = members.join(named, [F.col(k) == F.col(f"_k_{k}") for k in keys]).drop(*[f"_k_{k}" for k in keys])
    blocks = F.ceil(F.col("_n") / F.lit(float(block))).cast("int")
    met = met.withColumn("_side", F.pmod(F.xxhash64(F.col(id_col)), blocks).cast("int"))
    met = met.withColumn("_other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    met = met.withColumn("_p1", F.least("_side", "_other")).withColumn("_p2", F.greatest("_side", "_other")).drop("_n", "_other")
    group = [*keys, "_p1", "_p2"]
    return met.repartition(partitions(members.sparkSession), *group).sortWithinPartitions(*group)


def runs(batches: Iterator[pa.RecordBatch], keys: Sequence[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole groups from sorted batches, with the groups' bounds."""
    rest: pa.Table | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        table = table if rest is None else pa.concat_tables([rest, table])
        cut = _bounds(table, keys)
        if len(cut) > 2:
            yield table.slice(0, cut[-2]), cut[:-1]
        rest = table.slice(cut[-2])
    if rest is not None and rest.num_rows:
        yield rest, np.array([0, rest.num_rows])


def _bounds(table: pa.Table, keys: Sequence[str]) -> np.ndarray:
    change = np.zeros(table.num_rows, bool)
    change[0] = True
    for key in keys:
        column = table.column(key).to_numpy()
        change[1:] |= column[1:] != column[:-1]
    return np.append(np.flatnonzero(change), table.num_rows)


def first_linked(linked: np.ndarray) -> np.ndarray:
    """For each node of a boolean adjacency matrix, the first node of its component."""
    label = np.full(len(linked), -1)
    for seed in range(len(linked)):
        if label[seed] >= 0:
            continue
        label[seed] = seed
        found = np.array([seed])
        while len(found):
            found = np.flatnonzero(linked[found].any(axis=0) & (label < 0))
            label[found] = seed
    return label


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of edges (a, b), root the smallest node reachable.

    Each round hooks every node to its smallest neighbour, jumps twice along
    those hooks and contracts the edges, until none is left. The rounds' maps
    are stored tables, joined at the end; nothing is gathered on the driver.
    """
    pair = lambda x, y: (F.least(x, y).alias("a"), F.greatest(x, y).alias("b"))
    left = materialize(edges.filter("a <> b").select(*pair("a", "b")).distinct(), "edges")
    maps: list[DataFrame] = []
    while not left.isEmpty():
        both = left.union(left.select("b", "a"))
        hook = materialize(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("_m")).select("node", F.least("node", "_m").alias("root")), "hooks")
        step = hook
        for _ in range(2):
            again = step.select(F.col("node").alias("_n"), F.col("root").alias("_r"))
            step = step.join(again, F.col("root") == F.col("_n"), "left").select("node", F.coalesce("_r", "root").alias("root"))
            step = materialize(step, "jumps")
        maps.append(step)
        one, two = (step.select(F.col("node").alias(f"_n{i}"), F.col("root").alias(f"_r{i}")) for i in (1, 2))
        moved = left.join(one, F.col("a") == F.col("_n1")).join(two, F.col("b") == F.col("_n2"))
        left = materialize(moved.select(*pair("_r1", "_r2")).filter("a <> b").distinct(), "edges")
    if not maps:
        return left.select(F.col("a").alias("node"), F.col("b").alias("root"))
    out = maps[0]
    for later in maps[1:]:
        later = later.select(F.col("node").alias("_n"), F.col("root").alias("_r"))
        out = out.join(later, F.col("root") == F.col("_n"), "left").select("node", F.coalesce("_r", "root").alias("root"))
    return out
