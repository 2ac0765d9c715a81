"""Technical indicators of the latest bar, as conditional aggregates over :func:`bars.numbered` rows.

An exponential average with a fixed span is a weighted sum: a close of age ``k`` weighs
``alpha * (1 - alpha)^k`` and the first close of the series ``(1 - alpha)^k``. The signal line is an
average of an average, whose weights have a closed form too. So EMA and MACD need neither an ordered
fold nor a collected array, and combine before the shuffle like any sum.

Indicators are SQL expressions: ``*_aggregates`` make raw sums and means per symbol, ``*_values`` turn
those into the published, rounded figures.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickerloom.functions.numeric import named, rounded
from tickerloom.operators.bars import per_symbol
from tickerloom.operators.linked import decayed_sums, placed_in_order

MIN_BARS = 50
FAST_SPAN, SLOW_SPAN, SIGNAL_SPAN = 12, 26, 9
MOVING_AVERAGES = ["sma_20", "sma_50", "sma_200", "ema_12", "ema_26"]


def _recent(value: str, n: int) -> str:
    return f"case when age < {n} then {value} end"


def _full(n: int, value: str, aggregate: str) -> str:
    """The aggregate, or null unless the last ``n`` bars all hold a value."""
    return f"case when count({_recent(value, n)}) = {n} then {aggregate} end"


def _mean(value: str, n: int) -> str:
    return _full(n, value, f"avg({_recent(value, n)})")


def _ema(span: int) -> str:
    alpha = 2.0 / (span + 1)
    return f"sum(close * power({1 - alpha!r}D, age) * case when bar_no = 1 then 1D else {alpha!r}D end)"


def _signal() -> str:
    """Signal line: EMA of (fast EMA - slow EMA), by the closed form of the double weighting."""
    s = 2.0 / (SIGNAL_SPAN + 1)

    def ramp(span: int) -> tuple[float, str]:
        alpha = 2.0 / (span + 1)
        gap = (1 - alpha) - (1 - s)
        return alpha, f"(power({1 - alpha!r}D, age + 1) - power({1 - s!r}D, age + 1)) * {s / gap!r}D"

    (alpha_fast, fast), (alpha_slow, slow) = ramp(FAST_SPAN), ramp(SLOW_SPAN)
    return (
        f"sum(close * case when bar_no = 1 then {fast} - {slow}"
        f" else {alpha_fast!r}D * {fast} - {alpha_slow!r}D * {slow} end)"
    )


def moving_average_aggregates() -> dict[str, str]:
    return {
        **{f"raw_sma_{n}": _mean("close", n) for n in (20, 50, 200)},
        "raw_ema_12": _ema(FAST_SPAN),
        "raw_ema_26": _ema(SLOW_SPAN),
    }


def moving_average_values() -> dict[str, str]:
    return {n: rounded(f"raw_{n}", 2) for n in MOVING_AVERAGES}


def rsi_aggregates(period: int = 14) -> dict[str, str]:
    """Mean gain and loss; the first bar has no change and counts for neither."""
    change = "close - previous_close"
    return {
        "avg_gain": _mean(f"case when {change} > 0 then {change} when {change} <= 0 then 0D end", period),
        "avg_loss": _mean(f"case when {change} < 0 then -({change}) when {change} >= 0 then 0D end", period),
    }


def rsi_values() -> dict[str, str]:
    """0 loss with a gain is 100; no movement at all is undefined and scores no point."""
    value = (
        "case when avg_loss = 0 and avg_gain > 0 then 100D"
        " else 100 - 100 / (1 + try_divide(avg_gain, avg_loss)) end"
    )
    return {"rsi": rounded(value, 2)}


def macd_aggregates() -> dict[str, str]:
    return {"raw_ema_12": _ema(FAST_SPAN), "raw_ema_26": _ema(SLOW_SPAN), "raw_signal": _signal()}


def macd_values() -> dict[str, str]:
    return {
        "macd": rounded("raw_ema_12 - raw_ema_26", 2),
        "macd_signal": rounded("raw_signal", 2),
        "macd_histogram": rounded("raw_ema_12 - raw_ema_26 - raw_signal", 2),
    }


def bollinger_aggregates(period: int = 20) -> dict[str, str]:
    return {
        "raw_middle": _mean("close", period),
        "raw_deviation": _full(period, "close", f"stddev_samp({_recent('close', period)})"),
    }


def bollinger_values() -> dict[str, str]:
    return {
        "bollinger_upper": rounded("raw_middle + 2 * raw_deviation", 2),
        "bollinger_middle": rounded("raw_middle", 2),
        "bollinger_lower": rounded("raw_middle - 2 * raw_deviation", 2),
    }


def atr_aggregates(period: int = 14) -> dict[str, str]:
    true_range = "greatest(high - low, abs(high - previous_close), abs(low - previous_close))"
    return {"raw_atr": _mean(true_range, period)}


def atr_values() -> dict[str, str]:
    return {"atr": rounded("raw_atr", 2)}


def volume_aggregates() -> dict[str, str]:
    return {"raw_volume": f"max({_recent('volume', 1)})", "raw_volume_mean": _mean("volume", 20)}


def volume_values() -> dict[str, str]:
    """Whole current and mean volume (truncated) and their ratio; a zero mean has no ratio."""
    return {
        "current_volume": "cast(raw_volume as bigint)",
        "volume_ma_20": "cast(raw_volume_mean as bigint)",
        "relative_volume": rounded("try_divide(raw_volume, raw_volume_mean)", 2),
    }


def _indicator(numbered: DataFrame, aggregates: dict[str, str], values: dict[str, str]) -> DataFrame:
    return per_symbol(numbered, aggregates).selectExpr("symbol", *named(values))


def moving_averages(numbered: DataFrame) -> DataFrame:
    return _indicator(numbered, moving_average_aggregates(), moving_average_values())


def rsi(numbered: DataFrame) -> DataFrame:
    return _indicator(numbered, rsi_aggregates(), rsi_values())


def macd(numbered: DataFrame) -> DataFrame:
    return _indicator(numbered, macd_aggregates(), macd_values())


def bollinger(numbered: DataFrame) -> DataFrame:
    return _indicator(numbered, bollinger_aggregates(), bollinger_values())


def atr(numbered: DataFrame) -> DataFrame:
    return _indicator(numbered, atr_aggregates(), atr_values())


def volume_analysis(numbered: DataFrame) -> DataFrame:
    return _indicator(numbered, volume_aggregates(), volume_values())


def aggregates() -> dict[str, str]:
    """All aggregates of the module, to be combined with others in one pass over the bars."""
    return {
        "bars": "count(*)",
        "raw_price": f"max({_recent('close', 1)})",
        "volumes_20": f"count({_recent('volume', 20)})",
        **moving_average_aggregates(),
        **rsi_aggregates(),
        **macd_aggregates(),
        **bollinger_aggregates(),
        **atr_aggregates(),
        **volume_aggregates(),
    }


def values() -> dict[str, str]:
    """Published figures from the raw aggregates."""
    return {
        "current_price": rounded("raw_price", 2),
        **moving_average_values(),
        **rsi_values(),
        **macd_values(),
        **bollinger_values(),
        **atr_values(),
        **volume_values(),
    }


# Enough history, and no volume missing among the last 20 bars.
IS_USABLE = f"(bars >= {MIN_BARS} and volumes_20 = 20)"
# Rule points, compared on the published (rounded) figures.
_ABOVE = [f"int(coalesce(current_price > {c}, false))" for c in MOVING_AVERAGES[:3]]
_NOT_ABOVE = [f"int(coalesce(current_price <= {c}, false))" for c in MOVING_AVERAGES[:3]]
BULLISH_POINTS = " + ".join(
    [
        *_ABOVE,
        "int(coalesce(rsi < 30, false))",
        "int(coalesce(macd > macd_signal, false))",
        "int(coalesce(current_price < bollinger_lower, false))",
    ]
)
BEARISH_POINTS = " + ".join(
    [
        *_NOT_ABOVE,
        "int(coalesce(rsi > 70, false))",
        "int(not coalesce(macd > macd_signal, false))",
        "int(coalesce(current_price > bollinger_upper, false))",
    ]
)


def technical_signal(indicators: DataFrame) -> DataFrame:
    """Rule points, net score and signal."""
    return (
        indicators.selectExpr(
            "*", f"{BULLISH_POINTS} as bullish_points", f"{BEARISH_POINTS} as bearish_points"
        )
        .selectExpr("*", "bullish_points - bearish_points as net_score")
        .selectExpr(
            "*",
            "case when net_score >= 2 then 'BULLISH' when net_score <= -2 then 'BEARISH'"
            " else 'NEUTRAL' end as signal",
        )
    )


def from_aggregates(raw: DataFrame) -> DataFrame:
    """Module rows from the raw aggregates; symbols with too little history drop out."""
    return technical_signal(raw.filter(IS_USABLE).selectExpr("symbol", *named(values())))


def technical_analysis(numbered: DataFrame) -> DataFrame:
    return from_aggregates(per_symbol(numbered, aggregates()))


def ema_series(bars: DataFrame, span: int) -> DataFrame:
    """The whole EMA series of each symbol, of any length.

    The recursion is an affine map of the state for each bar, so it is a segmented scan (:func:`linked.decayed_sums`): bars
    are sorted by range and numbered by partition, and no task holds more than a segment of a series. It starts
    with the first close; a bar without a close keeps the state. Intermediate tables are written: this runs jobs.
    """
    weight = 2 / (span + 1)
    rows = placed_in_order(bars.select("symbol", "date", "close"), "symbol", [F.col("date")], "ema-bars")
    in_run = Window.partitionBy("symbol", "run")
    closes = rows.withColumn("known", F.count("close").over(in_run.orderBy("position").rowsBetween(Window.unboundedPreceding, 0)))
    counts = rows.groupBy("symbol", "run").agg(F.count("close").alias("n"))
    earlier = (F.sum("n").over(Window.partitionBy("symbol").orderBy("run")) - F.col("n")).alias("earlier")
    numbered = closes.join(counts.select("symbol", "run", earlier), ["symbol", "run"]).withColumn("index", F.col("earlier") + F.col("known") - 1)
    step = F.when(F.col("index") == 0, F.col("close")).otherwise(F.col("close") * weight)
    started = numbered.filter("index >= 0").select("symbol", "date", "position", "index", step.alias("step"))
    series = decayed_sums(started, "symbol", "index", "position", "step", 1 - weight)
    early = numbered.filter("index < 0").selectExpr("symbol", "date", "cast(null as double) as ema")
    return series.selectExpr("symbol", "date", f"{rounded('decayed', 4)} as ema").union(early)
