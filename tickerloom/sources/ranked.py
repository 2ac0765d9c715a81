"""Tables written in the order that a top-k reads them, so that it opens no more files than it needs.

Rows are spread over runs by ranges of (key, order) and each run is a directory of its own. A small table beside
them counts the rows of each key in each run. Runs follow each other in the order of the whole table, so a run holds
none of the first k rows of a key if the runs before it already hold k; Spark prunes such directories while it runs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def write_ranked(frame: DataFrame, path: str, key: str, order: list[Column], runs: int | None = None) -> None:
    """Writes the rows in runs of about equal size, a key of any number of rows over as many runs as it takes.

    ``runs`` defaults to the session's shuffle partitions. The order must be total within a key.
    """
    spread = [key, *order]
    ranged = frame.repartitionByRange(runs, *spread) if runs else frame.repartitionByRange(*spread)
    placed = ranged.withColumn("run", F.spark_partition_id()).sortWithinPartitions("run", *spread)
    placed.write.partitionBy("run").parquet(f"{path}/rows")
    frame.limit(0).write.parquet(f"{path}/columns")
    _rows(frame.sparkSession, path).groupBy(key, "run").agg(F.count("*").alias("rows")).coalesce(1).write.parquet(f"{path}/counts")


def _rows(spark: SparkSession, path: str) -> DataFrame:
    """The written rows with their run; an empty table has columns but no runs."""
    return spark.read.schema(spark.read.parquet(f"{path}/columns").schema.add("run", "integer")).parquet(f"{path}/rows")


def first_rows(spark: SparkSession, path: str, key: str, order: list[Column], limit: int) -> DataFrame:
    """The first ``limit`` rows of every key with their ``position``, read from the runs that can hold them.

    The runs to read are one number each and never more than the table has runs, which is what is broadcast.
    """
    before = F.sum("rows").over(Window.partitionBy(key).orderBy("run").rowsBetween(Window.unboundedPreceding, -1))
    counts = spark.read.parquet(f"{path}/counts").withColumn("before", F.coalesce(before, F.lit(0)))
    wanted = counts.filter(F.col("before") < limit).select("run").distinct()
    found = _rows(spark, path).join(F.broadcast(wanted), "run", "left_semi").drop("run")
    position = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return found.withColumn("position", position).filter(F.col("position") <= limit)
