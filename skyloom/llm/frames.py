"""Small helpers that several operators share."""

from __future__ import annotations

import ctypes
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from skyloom.session import cut, shared_dir


def checkpointed(df: DataFrame) -> DataFrame:
    """df, with its lineage cut by a reliable checkpoint in the shared folder."""
    return cut(df)


def temporary(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; what is there when the driver ends is deleted then."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}")
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    files.mkdirs(folder)
    files.deleteOnExit(folder)
    return f"{folder.toString()}/data"


def delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def written(df: DataFrame, name: str) -> DataFrame:
    """df, written once as Parquet to the shared folder and read again: columnar and compressed, for large intermediates."""
    spark = df.sparkSession
    path = temporary(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def trimmed(function):
    """function, a worker's task of one group, giving the memory that it freed back to the system when it is done: workers
    live on between stages, and what one keeps for later another lacks."""

    def one(table):
        out = function(table)
        give_back()
        return out

    def two(left, right):
        out = function(left, right)
        give_back()
        return out

    return one if function.__code__.co_argcount == 1 else two  # Spark reads how many arguments there are


def give_back() -> None:
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # not this C library
        pass
