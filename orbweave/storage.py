"""Where jobs read their tables and leave intermediate ones."""

from __future__ import annotations

import contextlib
import tempfile
import uuid

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession

_recorders: list[list[str]] = []


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of a data folder (any path that Spark can read)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_path(spark: SparkSession, label: str) -> str:
    """A fresh path in the folder that driver and executors share.

    The cluster names it in ``spark.checkpoint.dir``; only where that is unset and all runs on this machine (tests) is a
    local temporary folder used.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="orbweave-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/orbweave/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex[:12]}"


def open_folder(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI of the shared folder, and the path in it."""
    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage is cut and lost executors cost nothing."""
    spark = df.sparkSession
    path = shared_path(spark, label)
    df.write.parquet(path)
    for paths in _recorders:
        paths.append(path)
    return spark.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def recording():
    """The paths of the tables that are materialised inside the block, for ``release``."""
    paths: list[str] = []
    _recorders.append(paths)
    try:
        yield paths
    finally:
        _recorders.remove(paths)


def release(spark: SparkSession, paths: list[str]) -> None:
    """Delete materialised tables; to be called once all that was made of them has been written."""
    for path in paths:
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    paths.clear()
