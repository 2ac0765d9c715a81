"""Append-only store of good macro observations, partitioned by market, and its latest-wins view."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

STORE_SCHEMA = (
    "indicator string, value double, observation_date string, source string,"
    " is_policy_rate boolean, cached_at timestamp_ntz, market_code string"
)


def save_good_observations(observations: DataFrame, path: str, batch: int = 0) -> None:
    """Keep observations that hold a value as one batch of the store; a batch written again replaces itself."""
    names = [f.split(" ")[0] for f in STORE_SCHEMA.split(", ")]
    (
        observations.filter(F.col("value").isNotNull())
        .select(*names)
        .write.mode("overwrite")
        .partitionBy("market_code")
        .parquet(f"{path}/batch={batch}")
    )


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """The stored rows; an absent store reads as empty, a damaged file fails the read."""
    try:
        return spark.read.schema(STORE_SCHEMA).parquet(path).drop("batch")
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return spark.createDataFrame([], STORE_SCHEMA)


def good_obs_latest(stored: DataFrame) -> DataFrame:
    """Last good observation per market and indicator, flagged as cached. Spark limits each partition
    to its newest row per group before the shuffle, so a long history of one indicator stays put."""
    newest = Window.partitionBy("market_code", "indicator").orderBy(F.col("cached_at").desc())
    return (
        stored.withColumn("position", F.row_number().over(newest))
        .filter(F.col("position") == 1)
        .drop("position")
        .withColumn("is_cached", F.lit(True))
    )
