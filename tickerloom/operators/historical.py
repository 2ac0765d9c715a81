"""Returns, volatility, drawdown and price range per symbol, as SQL expressions over numbered bars."""

from __future__ import annotations

from pyspark.sql import DataFrame

from tickerloom.functions.numeric import named, rounded
from tickerloom.operators.bars import per_symbol

# Return name -> number of bars back; trading days per year.
RETURN_BARS = {
    "one_week_return": 5,
    "one_month_return": 21,
    "three_month_return": 63,
    "six_month_return": 126,
    "one_year_return": 252,
}
TRADING_DAYS = 252

DAILY_RETURN = "try_divide(close, previous_close) - 1"
VOLATILITY = f"stddev_samp({DAILY_RETURN}) * sqrt({TRADING_DAYS}) * 100"
DRAWDOWN = "min(try_divide(close - running_max, running_max)) * 100"


def daily_returns(numbered: DataFrame) -> DataFrame:
    """One row per bar after the first."""
    return numbered.filter("previous_close is not null").selectExpr(
        "symbol", "date", f"{rounded(DAILY_RETURN, 4)} as daily_return"
    )


def return_aggregates(ages: list[int]) -> dict[str, str]:
    return {f"close_{n}": f"max(case when age = {n} then close end)" for n in (0, *ages)}


def return_values(bars_back: dict[str, int]) -> dict[str, str]:
    """A return is null when the series is too short or the old price is zero."""
    return {
        name: rounded(f"try_divide(close_0 - close_{n}, close_{n}) * 100", 2)
        for name, n in bars_back.items()
    }


def aggregates() -> dict[str, str]:
    return {
        **return_aggregates(list(RETURN_BARS.values())),
        "raw_volatility": VOLATILITY,
        "raw_drawdown": DRAWDOWN,
        "raw_high": "max(high)",
        "raw_low": "min(low)",
    }


def values() -> dict[str, str]:
    """Published figures from the raw aggregates."""
    return {
        "current_price": rounded("close_0", 2),
        **return_values(RETURN_BARS),
        "annualized_volatility": rounded("raw_volatility", 2),
        "maximum_drawdown": rounded("raw_drawdown", 2),
        "period_high": rounded("raw_high", 2),
        "period_low": rounded("raw_low", 2),
    }


def _only(numbered: DataFrame, *names: str) -> DataFrame:
    """Selected figures; Catalyst prunes the aggregates they do not use."""
    figures = values()
    return per_symbol(numbered, aggregates()).selectExpr(
        "symbol", *named({n: figures[n] for n in names})
    )


def period_returns(numbered: DataFrame) -> DataFrame:
    return _only(numbered, "current_price", *RETURN_BARS)


def volatility(numbered: DataFrame) -> DataFrame:
    return _only(numbered, "annualized_volatility")


def max_drawdown(numbered: DataFrame) -> DataFrame:
    return _only(numbered, "maximum_drawdown")


def price_range(bars: DataFrame) -> DataFrame:
    raw = per_symbol(bars, {"raw_high": "max(high)", "raw_low": "min(low)"})
    figures = values()
    return raw.selectExpr("symbol", *named({n: figures[n] for n in ("period_high", "period_low")}))


def historical_analysis(numbered: DataFrame) -> DataFrame:
    return per_symbol(numbered, aggregates()).selectExpr("symbol", *named(values()))
