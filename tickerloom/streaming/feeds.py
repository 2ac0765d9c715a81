"""Structured Streaming feeds: daily bars from a trade stream, good observations into the store."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tickerloom.sources.store import save_good_observations


def daily_bars(trades: DataFrame, lateness: str = "1 day") -> DataFrame:
    """Daily bars of a trade stream (``symbol, ts, price, quantity, seq``), emitted once a day is closed
    by the watermark. State holds one row per symbol and open day, whatever the trade rate."""
    return (
        trades.withColumn("ts", F.col("ts").cast("timestamp"))
        .withWatermark("ts", lateness)
        .groupBy("symbol", F.window("ts", "1 day").alias("day"))
        .agg(
            F.min_by("price", "seq").alias("open"),
            F.max("price").alias("high"),
            F.min("price").alias("low"),
            F.max_by("price", "seq").alias("close"),
            F.sum("quantity").alias("volume"),
        )
        .selectExpr("symbol", "date(day.start) as date", "open", "high", "low", "close", "volume")
    )


# A snapshot of this market is kept whole or not at all, and what makes it whole.
WHOLE_SNAPSHOTS = {"US": ["policy_rate", "inflation", "gdp_growth", "unemployment"]}
FETCHED = "array<struct<indicator: string, value: double, observation_date: string, source: string, is_policy_rate: boolean>>"


def latest_good(fetches: DataFrame) -> DataFrame:
    """Last good observation per market and indicator of a stream of fetches (``market_code, cached_at, observations``).

    The state is one row per market and indicator, whatever the stream's length, and keeps an observation through any
    outage after it. Of equal times the greater row stays, so the order of arrival does not matter and neither does
    a fetch that comes again. The plan is built-in aggregation only, so state lives and is updated in the JVM.
    """
    found = "transform(filter(observations, o -> o.value is not null), o -> o.indicator)"
    whole = " and ".join(
        f"(market_code <> '{market}' or size(array_except(array({', '.join(map(repr, names))}), {found})) = 0)"
        for market, names in WHOLE_SNAPSHOTS.items()
    )
    good = fetches.filter(whole).selectExpr("market_code", "cached_at", "inline(observations)").filter("value is not null")
    newest = F.max(F.struct("cached_at", "observation_date", "value", "source", "is_policy_rate"))
    return good.groupBy("market_code", "indicator").agg(newest.alias("newest")).select("market_code", "indicator", "newest.*")


def keep_latest_good(fetches: DataFrame, store_path: str, checkpoint: str) -> StreamingQuery:
    """Writes the state's changed rows to the store after each micro-batch, under the batch's number."""

    def write(batch: DataFrame, number: int) -> None:
        save_good_observations(batch, store_path, number)

    return (
        latest_good(fetches)
        .writeStream.outputMode("update")
        .foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def keep_good_observations(observations: DataFrame, store_path: str, checkpoint: str) -> StreamingQuery:
    """Keep each micro-batch's good observations as a batch of the store under its own number: a batch
    replayed after a failure replaces itself."""

    def append(batch: DataFrame, number: int) -> None:
        save_good_observations(batch, store_path, number)

    return (
        observations.writeStream.foreachBatch(append)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
