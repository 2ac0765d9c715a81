"""Input tables, and intermediate tables written to the folder that the cluster shares."""

from __future__ import annotations

import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path below ``spark.checkpoint.dir``.

    Only a session on this machine that names no such folder (tests, local trials) gets a temporary one.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = f"{tempfile.gettempdir()}/llm-shared"
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


SHUFFLES_GO = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def settle(frame: DataFrame, name: str) -> DataFrame:
    """The frame written to the shared folder and read again: cuts lineage, survives lost executors.

    What the write shuffled is of no use afterwards and is removed as it ends, not when the driver next happens to
    collect its garbage.
    """
    spark = frame.sparkSession
    path, before = shared_path(spark, name), spark.conf.get(SHUFFLES_GO, "false")
    spark.conf.set(SHUFFLES_GO, "true")
    try:
        frame.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(SHUFFLES_GO, before)
    return spark.read.schema(frame.schema).parquet(path)


BATCH_ROWS = 1000  # rows that Spark hands to a Python worker at once, where the session has not chosen a number


def workers_import(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver has it, and take whole texts in batches of bounded size.

    A cluster whose executors do not see that folder gets the package by ``--py-files`` as usual. Spark's default
    of 10,000 rows a batch is meant for numbers: as texts, a batch is held several times over on both sides.
    """
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    root, known = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment.get("PYTHONPATH", "")
    if root not in known.split(":"):
        spark.sparkContext.environment["PYTHONPATH"] = f"{root}:{known}".rstrip(":")


def map_arrow(frame: DataFrame, function, schema: StructType | str) -> DataFrame:
    workers_import(frame.sparkSession)
    return frame.mapInArrow(function, schema)
