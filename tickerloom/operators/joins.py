"""Many-to-one lookups that stay balanced when one key holds a large share of the left side."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def salted_lookup(
    left: DataFrame,
    right: DataFrame,
    keys: list[str],
    spread_by: list[str],
    salts: int | None = None,
    how: str = "left",
) -> DataFrame:
    """Join ``left`` to a lookup ``right`` with few rows per key.

    Left rows of one key spread over ``salts`` partitions by a hash of ``spread_by`` (deterministic, so
    a recomputed task agrees with its first run); each lookup row is repeated once per salt. The number of
    salts follows the session's shuffle partitions, which are sized to the data, unless a long lookup asks
    for fewer. When the lookup is small, Spark's own size check turns this into a broadcast join and no left
    row moves.
    """
    if salts is None:
        salts = max(8, int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")) // 4)
    salted_left = left.withColumn(
        "_salt", F.pmod(F.xxhash64(*spread_by), F.lit(salts)).cast("int")
    )
    salted_right = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return salted_left.join(salted_right, [*keys, "_salt"], how).drop("_salt")
