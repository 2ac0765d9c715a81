"""Columnar input tables."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


@lru_cache(maxsize=256)
def _schema(spark: SparkSession, path: str, changed: int) -> StructType:
    return spark.read.parquet(path).schema


def written_at(spark: SparkSession, path: str) -> int:
    """When the table was last written."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(place).getModificationTime()


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table by name. Its schema is read from the files once per session and write, so a plan that uses
    a table in several places starts no job for it."""
    path = f"{folder}/{name}.parquet"
    return spark.read.schema(_schema(spark, path, written_at(spark, path))).parquet(path)
