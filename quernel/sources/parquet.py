"""Parquet tables, whose schema is read from a footer once and then kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

#: Schema by path and its time of change; a changed file or folder is read again.
_schemas: dict[tuple[str, int], T.StructType] = {}


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    """``spark.read.parquet(path)`` without a job for the schema of a path that was read before."""
    hadoop_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(hadoop_path):
        return spark.read.parquet(path)  # a pattern, or Spark's own error
    key = (fs.makeQualified(hadoop_path).toString(), fs.getFileStatus(hadoop_path).getModificationTime())
    schema = _schemas.get(key)
    if schema is None:
        df = spark.read.parquet(path)
        _schemas[key] = df.schema
        return df
    return spark.read.schema(schema).parquet(path)
