"""Where files go that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_folders: dict[str, str] = {}


def _own_folder(spark: SparkSession) -> str:
    """The application's folder beneath the one that spark.checkpoint.dir names, gone with it; a temporary one where that is unset and the master local."""
    app, master = spark.sparkContext.applicationId, spark.sparkContext.master
    if app not in _folders:
        root = spark.conf.get("spark.checkpoint.dir", None)
        if not root and (not master.startswith("local") or master.startswith("local-cluster")):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = f"{(root or tempfile.mkdtemp(prefix='spark-')).rstrip('/')}/strandloom-files-{app}"
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        store = path.getFileSystem(spark._jsc.hadoopConfiguration())
        store.mkdirs(path)
        store.deleteOnExit(path)  # when the driver ends
        _folders[app] = folder
    return _folders[app]


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder's path that driver and executors share."""
    return f"{_own_folder(spark)}/{name}-{uuid.uuid4().hex}"


def kept(df: DataFrame, name: str) -> DataFrame:
    """df as written to a shared folder: what comes after may read it more than once, and a lost executor costs none of it."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
