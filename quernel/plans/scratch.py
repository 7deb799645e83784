"""Tables written in the middle of a plan.

A written table cuts the lineage, gives a stable input to operators that read it more than once, and survives the
loss of executors. All of them go to the folder that the session names in ``spark.checkpoint.dir``, which every
executor can reach. Where no folder is named, a temporary one is used, but only in local mode.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local_root: str | None = None


def _root(spark: SparkSession) -> str:
    global _local_root
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    sc = spark.sparkContext
    if sc.getCheckpointDir():
        return sc.getCheckpointDir().rstrip("/")
    if not sc.master.startswith("local[") and sc.master != "local":
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    if _local_root is None:
        _local_root = tempfile.mkdtemp(prefix="quernel-")
        atexit.register(shutil.rmtree, _local_root, ignore_errors=True)
    return f"file://{_local_root}"


_folders: list[str] = []


def _file_system(spark: SparkSession, path: str):
    hadoop_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), hadoop_path


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder, with its scheme. It lasts until ``clean``, or until the driver ends."""
    fs, folder = _file_system(spark, f"{_root(spark)}/quernel-{uuid.uuid4().hex}")
    fs.mkdirs(folder)
    fs.deleteOnExit(folder)
    qualified = fs.makeQualified(folder).toString()
    _folders.append(qualified)
    return f"{qualified}/{name}"


def clean(spark: SparkSession) -> None:
    """Remove all that this session has written so far; call it when no result that is still to be read needs it."""
    while _folders:
        fs, folder = _file_system(spark, _folders.pop())
        fs.delete(folder, True)


def materialize(df: DataFrame, name: str, **options: object) -> DataFrame:
    """Write ``df`` as parquet to the shared folder and return the written table."""
    path = new_path(df.sparkSession, name)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def open_filesystem(uri: str):
    """(pyarrow filesystem, path) of a URI of the shared folder, for use inside tasks."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)
