"""Registered queries over bars: building, indicators, history, context."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickerloom.functions import markets
from tickerloom.operators import bars as B
from tickerloom.operators import context, historical, technical
from tickerloom.functions.literals import literal_table
from tickerloom.sources import landed, payloads, views

DATE_TEXT = "yyyy-MM-dd"


def dated(frame: DataFrame, column: str = "date") -> DataFrame:
    return frame.withColumn(column, F.date_format(column, DATE_TEXT))


def _bars(spark: SparkSession, sf: str) -> DataFrame:
    return views.daily_bars(views.trades(spark, sf))


def _numbered(spark: SparkSession, sf: str) -> DataFrame:
    return B.numbered(_bars(spark, sf))


def recent_bars(spark: SparkSession, sf: str, period: str = "2y") -> DataFrame:
    return views.daily_bars(B.bars_period(views.trades(spark, sf), period, views.AS_OF))


def bars_from_trades(spark, sf):
    return dated(_bars(spark, sf))


def bars_clean(spark, sf):
    return dated(B.bars_clean(views.raw_bars(spark, sf)), "ts")


def bars_from_chart_json(spark, sf):
    """Bars to landed chart payloads and back: missing closes drop, a column of wrong length is null."""
    landing = payloads.chart_payloads(_bars(spark, sf))
    bars = B.bars_clean(landed.bars_from_chart_json(landing, "payload"), in_place=True)
    return dated(bars.withColumnRenamed("ts", "date"))


def bars_period(spark, sf):
    return dated(recent_bars(spark, sf))


def bars_with_fallback(spark, sf):
    bars = _bars(spark, sf)
    return dated(
        B.bars_with_fallback(
            bars.filter(f"{views.KEY_OF_SYMBOL} % 3 <> 1"),
            bars.filter(f"{views.KEY_OF_SYMBOL} % 4 <> 2"),
            ("primary", "chart"),
        )
    )


def latest_snapshot(spark, sf):
    return B.latest_snapshot(recent_bars(spark, sf, "10d"))


def sma(spark, sf):
    averages = technical.moving_averages(_numbered(spark, sf))
    return averages.select("symbol", "sma_20", "sma_50", "sma_200")


def ema(spark, sf):
    return technical.moving_averages(_numbered(spark, sf)).select("symbol", "ema_12", "ema_26")


def ema_series(spark, sf):
    return dated(technical.ema_series(_bars(spark, sf), technical.FAST_SPAN))


def rsi(spark, sf):
    return technical.rsi(_numbered(spark, sf))


def macd(spark, sf):
    return technical.macd(_numbered(spark, sf))


def bollinger(spark, sf):
    return technical.bollinger(_numbered(spark, sf))


def atr(spark, sf):
    return technical.atr(_numbered(spark, sf))


def volume_analysis(spark, sf):
    return technical.volume_analysis(_numbered(spark, sf))


def technical_analysis(spark, sf):
    return technical.technical_analysis(_numbered(spark, sf))


def technical_signal(spark, sf):
    return technical_analysis(spark, sf).select(
        "symbol", "signal", "bullish_points", "bearish_points", "net_score"
    )


def daily_returns(spark, sf):
    return dated(historical.daily_returns(_numbered(spark, sf)))


def period_returns(spark, sf):
    return historical.period_returns(_numbered(spark, sf))


def volatility(spark, sf):
    return historical.volatility(_numbered(spark, sf))


def max_drawdown(spark, sf):
    return historical.max_drawdown(_numbered(spark, sf))


def price_range(spark, sf):
    return historical.price_range(_bars(spark, sf))


def historical_analysis(spark, sf):
    return historical.historical_analysis(_numbered(spark, sf))


def series_snapshot(spark, sf):
    return context.series_snapshot(_numbered(spark, sf))


def market_context(spark, sf):
    """Context rows; companies 0, 1, 2, ... stand in for the configured series, one has no data."""
    names = sorted({row[3] for row in markets.MARKET_SERIES})
    proxies = literal_table(
        spark,
        [(name, n) for n, name in enumerate(names) if name != "GC=F"],
        "series_symbol string, company_key bigint",
    ).selectExpr("series_symbol", f"{views.symbol_of('company_key')} as symbol")
    # Only trades of the few configured series go on to be aggregated and shuffled.
    trades = views.trades(spark, sf).join(F.broadcast(proxies), "symbol").drop("symbol")
    bars = B.bars_from_trades(trades.withColumnRenamed("series_symbol", "symbol"))
    snapshots = context.series_snapshot(B.numbered(bars))
    return context.market_context(
        views.companies(spark, sf), markets.market_series(spark), markets.markets(spark), snapshots
    )


def market_context_maps(spark, sf):
    """The nested context, opened again: one row per symbol, group and series."""
    nested = context.context_maps(market_context(spark, sf))
    groups = ", ".join(f"struct('{g}' as series_group, {g} as series)" for g in context.GROUPS)
    grouped = nested.selectExpr("symbol", "market_code", "country", "currency", f"inline(array({groups}))")
    opened = grouped.select("symbol", "market_code", "country", "currency", "series_group", F.explode("series").alias("series_name", "s"))
    return opened.select("*", "s.*").drop("s")


def symbol_market(spark, sf):
    return views.companies(spark, sf).select(
        "symbol", markets.detect_market(F.col("symbol")).alias("market_code")
    )


QUERIES = {
    f.__name__: f
    for f in (
        bars_from_trades,
        bars_clean,
        bars_from_chart_json,
        bars_period,
        bars_with_fallback,
        latest_snapshot,
        sma,
        ema,
        ema_series,
        rsi,
        macd,
        bollinger,
        atr,
        volume_analysis,
        technical_analysis,
        technical_signal,
        daily_returns,
        period_returns,
        volatility,
        max_drawdown,
        price_range,
        historical_analysis,
        series_snapshot,
        market_context,
        market_context_maps,
        symbol_market,
    )
}
