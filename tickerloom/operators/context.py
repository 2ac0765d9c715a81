"""Market context: snapshots of index, currency, commodity, volatility and bond series."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickerloom.functions.markets import detect_market
from tickerloom.functions.numeric import named, rounded
from tickerloom.operators.historical import return_aggregates, return_values
from tickerloom.operators.bars import per_symbol

# Return name -> number of bars back.
SNAPSHOT_RETURNS = {"one_week_return": 5, "one_month_return": 21, "three_month_return": 63}

# Groups of a context's series.
GROUPS = ["indices", "currencies", "commodities", "volatility", "bond_yield"]


def series_snapshot(numbered: DataFrame) -> DataFrame:
    """Latest value (4 places), its date and recent returns per series (``symbol``)."""
    raw = per_symbol(
        numbered, {"last_date": "max(date)", **return_aggregates(list(SNAPSHOT_RETURNS.values()))}
    )
    return raw.selectExpr(
        "symbol",
        f"{rounded('close_0', 4)} as latest_value",
        "date_format(last_date, 'yyyy-MM-dd') as data_date",
        *named(return_values(SNAPSHOT_RETURNS)),
    )


def market_context(
    symbols: DataFrame, market_series: DataFrame, markets: DataFrame, snapshots: DataFrame
) -> DataFrame:
    """One row per symbol and series of its market; a series without data keeps null figures.

    Only snapshots of the configured series are kept (an inner broadcast join with the literal list),
    so the context of all markets is a couple of dozen rows and is itself broadcast to the symbols.
    """
    wanted = F.broadcast(market_series.select("series_symbol").distinct())
    figures = snapshots.withColumnRenamed("symbol", "series_symbol").join(wanted, "series_symbol")
    per_market = market_series.join(F.broadcast(figures), "series_symbol", "left").join(
        F.broadcast(markets), "market_code"
    )
    return symbols.select("symbol", detect_market(F.col("symbol")).alias("market_code")).join(
        F.broadcast(per_market), "market_code"
    )


def context_maps(context: DataFrame) -> DataFrame:
    """Nested form: one row per symbol with a map of snapshots per series group."""
    snapshot = F.struct(
        "series_symbol", "latest_value", "data_date", "one_week_return", "one_month_return", "three_month_return"
    )
    entry = F.struct("series_name", snapshot.alias("snapshot"))
    return context.groupBy("symbol", "market_code", "country", "currency").agg(
        *[
            F.map_from_entries(
                F.collect_list(F.when(F.col("series_group") == g, entry))
            ).alias(g)
            for g in GROUPS
        ]
    )
