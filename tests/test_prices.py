"""Indicators against pandas, and series at the edges."""

import datetime
import math

import numpy as np
import pandas as pd
import pytest

from tickerloom.operators import bars as B
from tickerloom.operators import historical, technical

SCHEMA = "symbol string, date date, open double, high double, low double, close double, volume double"


def frame_of(spark, series):
    rows = []
    for symbol, closes in series.items():
        for i, c in enumerate(closes):
            day = datetime.date(2020, 1, 1) + datetime.timedelta(days=i)
            rows.append((symbol, day, c, c + 1 + i % 3, c - 1 - i % 2, c, float(100 + i % 7)))
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def walks():
    rng = np.random.default_rng(3)
    return {f"S{n}": (100 + rng.normal(0, 1, n).cumsum()).round(2).tolist() for n in (50, 60, 199, 200, 253, 700)}


@pytest.fixture(scope="module")
def technical_rows(spark, walks):
    return {r.symbol: r for r in technical.technical_analysis(B.numbered(frame_of(spark, walks))).collect()}


def near(got, expected):
    if expected is None or (isinstance(expected, float) and math.isnan(expected)):
        return got is None
    return abs(got - expected) <= 0.0051


def test_indicators_match_pandas(walks, technical_rows):
    for symbol, closes in walks.items():
        c, row = pd.Series(closes), technical_rows[symbol]
        i = np.arange(len(c))
        high, low = c + 1 + i % 3, c - 1 - i % 2
        for n in (20, 50, 200):
            assert near(row[f"sma_{n}"], c.rolling(n).mean().iloc[-1])
        fast, slow = (c.ewm(span=s, adjust=False).mean() for s in (12, 26))
        signal = (fast - slow).ewm(span=9, adjust=False).mean()
        assert near(row.ema_12, fast.iloc[-1]) and near(row.ema_26, slow.iloc[-1])
        assert near(row.macd, (fast - slow).iloc[-1]) and near(row.macd_signal, signal.iloc[-1])
        assert near(row.macd_histogram, (fast - slow - signal).iloc[-1])
        delta = c.diff()
        rs = delta.clip(lower=0).rolling(14).mean() / (-delta.clip(upper=0)).rolling(14).mean()
        assert near(row.rsi, (100 - 100 / (1 + rs)).iloc[-1])
        assert near(row.bollinger_upper, (c.rolling(20).mean() + 2 * c.rolling(20).std()).iloc[-1])
        ranges = pd.concat([high - low, (high - c.shift()).abs(), (low - c.shift()).abs()], axis=1).max(axis=1)
        assert near(row.atr, ranges.rolling(14).mean().iloc[-1])


def test_history_matches_pandas(spark, walks):
    rows = {r.symbol: r for r in historical.historical_analysis(B.numbered(frame_of(spark, walks))).collect()}
    for symbol, closes in walks.items():
        c, row = pd.Series(closes), rows[symbol]
        for name, n in historical.RETURN_BARS.items():
            old = c.iloc[-n - 1] if len(c) > n else None
            assert near(row[name], None if old is None else (c.iloc[-1] - old) / old * 100)
        assert near(row.annualized_volatility, c.pct_change().std() * math.sqrt(252) * 100)
        assert near(row.maximum_drawdown, ((c - c.cummax()) / c.cummax()).min() * 100)


def test_ema_series_matches_pandas(spark, walks):
    got = technical.ema_series(frame_of(spark, walks), 12).filter("symbol = 'S253'").orderBy("date").collect()
    expected = pd.Series(walks["S253"]).ewm(span=12, adjust=False).mean().tolist()
    assert np.allclose([r.ema for r in got], expected, atol=1e-4)


def test_short_series_are_unavailable(spark):
    lengths = {f"L{n}": [100.0 + i for i in range(n)] for n in (1, 19, 49, 50)}
    numbered = B.numbered(frame_of(spark, lengths))
    assert [r.symbol for r in technical.technical_analysis(numbered).collect()] == ["L50"]
    averages = {r.symbol: r for r in technical.moving_averages(numbered).collect()}
    assert averages["L19"].sma_20 is None and averages["L49"].sma_20 is not None
    one = historical.historical_analysis(numbered).filter("symbol = 'L1'").first()
    assert one.annualized_volatility is None and one.maximum_drawdown == 0.0


def test_constant_and_rising_prices(spark):
    rows = {
        r.symbol: r
        for r in technical.technical_analysis(
            B.numbered(frame_of(spark, {"FLAT": [100.0] * 60, "UP": [100.0 + i for i in range(60)]}))
        ).collect()
    }
    assert rows["FLAT"].rsi is None and rows["FLAT"].net_score == -3
    assert rows["UP"].rsi == 100.0


def test_missing_volume_makes_the_module_unavailable_and_zero_volume_has_no_ratio(spark):
    base = frame_of(spark, {"N": [100.0 + i for i in range(60)]})
    missing = base.selectExpr("* except (volume)", "if(date = date'2020-02-20', null, volume) as volume")
    assert technical.technical_analysis(B.numbered(missing)).count() == 0
    old = base.selectExpr("* except (volume)", "if(date = date'2020-01-05', null, volume) as volume")
    assert technical.technical_analysis(B.numbered(old)).count() == 1
    zero = base.selectExpr("* except (volume)", "0D as volume")
    assert technical.volume_analysis(B.numbered(zero)).first().relative_volume is None


def test_zero_old_price_gives_no_return(spark):
    row = historical.historical_analysis(B.numbered(frame_of(spark, {"Z": [0.0, 1.0, 2.0, 3.0, 4.0, 5.0]}))).first()
    assert row.one_week_return is None


def test_cleaning(spark):
    raw = spark.sql(
        """select * from values ('A', 1, 1, 1D, 1D, 1D, 5D, 1D), ('A', 1, 3, 1D, 1D, 1D, 7D, cast(null as double)),
        ('A', 1, 9, 1D, 1D, 1D, cast(null as double), 1D), ('A', 2, 2, 1D, 1D, 1D, 8D, 1D)
        as t(symbol, ts, seq, open, high, low, close, volume)"""
    )
    got = B.bars_clean(raw).orderBy("ts").collect()
    assert [(r.ts, r.close, r.volume) for r in got] == [(1, 7.0, None), (2, 8.0, 1.0)]
    with pytest.raises(ValueError, match="volume"):
        B.bars_clean(raw.drop("volume"))


@pytest.mark.parametrize(
    "period,start",
    [("2y", "2001-12-30"), ("10d", "2003-12-22"), ("2wk", "2003-12-18"), (" 6MO ", "2003-06-29"),
     ("ytd", "2004-01-01"), ("max", "1970-01-01")],
)
def test_periods(period, start):
    as_of = "2004-01-01"
    assert B.period_start(period, as_of).isoformat() == start


def test_unknown_period_is_an_error():
    with pytest.raises(ValueError, match="Unsupported period"):
        B.period_start("2 years", "2004-01-01")
