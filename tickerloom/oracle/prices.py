"""Oracles for bars, technical, historical and context queries."""

from __future__ import annotations

from tickerloom.functions.markets import MARKET_SERIES, MARKETS
from tickerloom.oracle.views import AS_OF, detect, r

RETURNS = [
    ("one_week_return", 5),
    ("one_month_return", 21),
    ("three_month_return", 63),
    ("six_month_return", 126),
    ("one_year_return", 252),
]


def _bars_of(source: str) -> str:
    return f"""
select symbol, cast(ts as date) as date, arg_min(price, seq) as open, max(price) as high,
  min(price) as low, arg_max(price, seq) as close, sum(quantity) as volume
from {source} group by 1, 2"""


def _windows(bars: str) -> str:
    return f"""
select *, row_number() over w as bar_no, lag(close) over w as previous_close,
  max(close) over (partition by symbol order by date rows unbounded preceding) as running_max,
  count(*) over (partition by symbol) as bar_count
from {bars} window w as (partition by symbol order by date)"""


def _rolling(value: str, n: int) -> str:
    w = f"over (partition by symbol order by date rows {n - 1} preceding)"
    return f"case when count({value}) {w} = {n} then avg({value}) {w} end"


def _technical(windows: str) -> str:
    """Indicators by sliding windows and ordered folds, last row per symbol."""
    w20 = "over (partition by symbol order by date rows 19 preceding)"
    fold = """list_reduce(list({'c': close, 'f': close, 's': close, 'g': 0.0::double} order by date),
      lambda e, x: {'c': x.c, 'f': 2.0::double/13*x.c + 11.0::double/13*e.f,
        's': 2.0::double/27*x.c + 25.0::double/27*e.s,
        'g': 0.2::double*((2.0::double/13*x.c + 11.0::double/13*e.f)
          - (2.0::double/27*x.c + 25.0::double/27*e.s)) + 0.8::double*e.g})"""
    return f"""
select l.symbol, {r("l.close", 2)} as current_price, l.bar_count, l.volumes_20,
  {r("sma_20", 2)} as sma_20, {r("sma_50", 2)} as sma_50, {r("sma_200", 2)} as sma_200,
  {r("e.f", 2)} as ema_12, {r("e.s", 2)} as ema_26,
  {r("case when loss = 0 and gain > 0 then 100 when loss > 0 then 100 - 100 / (1 + gain / loss) end", 2)}
    as rsi,
  {r("e.f - e.s", 2)} as macd, {r("e.g", 2)} as macd_signal, {r("e.f - e.s - e.g", 2)} as macd_histogram,
  {r("sma_20 + 2 * dev", 2)} as bollinger_upper, {r("sma_20", 2)} as bollinger_middle,
  {r("sma_20 - 2 * dev", 2)} as bollinger_lower, {r("atr", 2)} as atr,
  cast(trunc(volume) as bigint) as current_volume, cast(trunc(volume_mean) as bigint) as volume_ma_20,
  {r("volume / nullif(volume_mean, 0)", 2)} as relative_volume
from (
  select *, {_rolling("close", 20)} as sma_20, {_rolling("close", 50)} as sma_50,
    {_rolling("close", 200)} as sma_200, {_rolling("up", 14)} as gain, {_rolling("down", 14)} as loss,
    case when count(close) {w20} = 20 then stddev_samp(close) {w20} end as dev,
    {_rolling("tr", 14)} as atr, {_rolling("volume", 20)} as volume_mean,
    count(volume) {w20} as volumes_20
  from (select *, case when previous_close is not null then greatest(close - previous_close, 0) end as up,
      case when previous_close is not null then greatest(previous_close - close, 0) end as down,
      greatest(high - low, abs(high - previous_close), abs(low - previous_close)) as tr from {windows})) l
join (select symbol, {fold} as e from {windows} group by symbol) f on f.symbol = l.symbol
where l.bar_no = l.bar_count"""


def _signal(indicators: str) -> str:
    up = " + ".join(
        f"case when current_price > {c} then 1 else 0 end" for c in ("sma_20", "sma_50", "sma_200")
    )
    down = " + ".join(
        f"case when current_price <= {c} then 1 else 0 end" for c in ("sma_20", "sma_50", "sma_200")
    )
    return f"""
select *, bullish_points - bearish_points as net_score,
  case when bullish_points - bearish_points >= 2 then 'BULLISH'
    when bullish_points - bearish_points <= -2 then 'BEARISH' else 'NEUTRAL' end as signal
from (select * exclude (bar_count, volumes_20),
  {up} + case when rsi < 30 then 1 else 0 end + case when macd > macd_signal then 1 else 0 end
    + case when current_price < bollinger_lower then 1 else 0 end as bullish_points,
  {down} + case when rsi > 70 then 1 else 0 end + case when macd > macd_signal then 0 else 1 end
    + case when current_price > bollinger_upper then 1 else 0 end as bearish_points
  from {indicators} where bar_count >= 50 and volumes_20 = 20)"""


def _historical(windows: str) -> str:
    old = ", ".join(
        f"{r(f'(close - lag(close, {n}) over w) / nullif(lag(close, {n}) over w, 0) * 100', 2)} as {name}"
        for name, n in RETURNS
    )
    return f"""
select l.symbol, {r("close", 2)} as current_price, {", ".join(name for name, _ in RETURNS)},
  {r("volatility", 2)} as annualized_volatility, {r("drawdown", 2)} as maximum_drawdown,
  {r("period_high", 2)} as period_high, {r("period_low", 2)} as period_low
from (select *, {old} from {windows} window w as (partition by symbol order by date)) l
join (select symbol, stddev_samp(close / previous_close - 1) * sqrt(252) * 100 as volatility,
    min((close - running_max) / running_max) * 100 as drawdown, max(high) as period_high,
    min(low) as period_low from {windows} group by symbol) a on a.symbol = l.symbol
where l.bar_no = l.bar_count"""


SERIES_ROWS = ", ".join(str(row) for row in MARKET_SERIES)
MARKET_ROWS = ", ".join(str(row) for row in MARKETS)

CTES = {
    "bars": _bars_of("trades"),
    "trades_2y": f"select * from trades where ts >= timestamp '{AS_OF}' - interval 732 day"
    f" and ts <= timestamp '{AS_OF}'",
    "bars_2y": _bars_of("trades_2y"),
    "bars_windows": _windows("bars"),
    "bars_windows_2y": _windows("bars_2y"),
    "technical_rows": _technical("bars_windows"),
    "technical_module": _signal("technical_rows"),
    "technical_rows_2y": _technical("bars_windows_2y"),
    "technical_module_2y": _signal("technical_rows_2y"),
    "historical_module": _historical("bars_windows"),
    "historical_module_2y": _historical("bars_windows_2y"),
    "bars_cleaned": """
select symbol, ts, open, high, low, close, volume from (
  select *, row_number() over (partition by symbol, ts order by seq desc) as k
  from raw_bars where close is not null) where k = 1""",
    "two_provider_bars": """
select *, min(priority) over (partition by symbol) as best from (
  select *, 0 as priority, 'primary' as data_source, false as is_fallback from bars
    where cast(regexp_extract(symbol, '^S([0-9]+)', 1) as bigint) % 3 <> 1
  union all
  select *, 1, 'chart', true from bars where cast(regexp_extract(symbol, '^S([0-9]+)', 1) as bigint) % 4 <> 2)""",
    "series_figures": f"""
select symbol, {r("close", 4)} as latest_value, strftime(date, '%Y-%m-%d') as data_date,
  one_week_return, one_month_return, three_month_return
from (select *, {", ".join(
        f"{r(f'(close - lag(close, {n}) over w) / nullif(lag(close, {n}) over w, 0) * 100', 2)} as {name}"
        for name, n in RETURNS[:3])}
  from bars_windows window w as (partition by symbol order by date))
where bar_no = bar_count""",
    "market_series_rows": f"""
select * from (values {SERIES_ROWS}) t(market_code, series_group, series_name, series_symbol)""",
    "market_rows": f"select * from (values {MARKET_ROWS}) t(market_code, country, currency)",
    "series_proxies": """
select series_symbol, s.symbol from (
  select series_symbol, row_number() over (order by series_symbol) - 1 as n
  from (select distinct series_symbol from market_series_rows))
join companies s on company_key = n where series_symbol <> 'GC=F'""",
    "market_context_rows": f"""
select c.symbol, c.market_code, m.country, m.currency, series_group, series_name, m2.series_symbol,
  latest_value, data_date, one_week_return, one_month_return, three_month_return
from (select symbol, {detect("symbol")} as market_code from companies) c
join market_rows m on m.market_code = c.market_code
join market_series_rows m2 on m2.market_code = c.market_code
left join series_proxies p on p.series_symbol = m2.series_symbol
left join series_figures f on f.symbol = p.symbol""",
}

_LAST = "where bar_no = bar_count"
QUERIES = {
    "bars_from_trades": "select * replace (strftime(date, '%Y-%m-%d') as date) from bars",
    "bars_clean": "select * replace (strftime(ts, '%Y-%m-%d') as ts) from bars_cleaned",
    "bars_from_chart_json": """
select symbol, strftime(date, '%Y-%m-%d') as date, open, high, low, close,
  case when cast(regexp_extract(symbol, '^S([0-9]+)', 1) as bigint) % 7 = 3 then null else volume end as volume
from bars where day(date) % 11 <> 0""",
    "bars_period": "select * replace (strftime(date, '%Y-%m-%d') as date) from bars_2y",
    "bars_with_fallback": """
select * exclude (priority, best) replace (strftime(date, '%Y-%m-%d') as date)
from two_provider_bars where priority = best""",
    "latest_snapshot": f"""
select symbol, strftime(date, '%Y-%m-%d') as date, {r("open", 2)} as open, {r("high", 2)} as high,
  {r("low", 2)} as low, {r("close", 2)} as close, cast(trunc(volume) as bigint) as volume
from (select *, row_number() over (partition by symbol order by date desc) as k from bars
  where date >= date '{AS_OF}' - interval 10 day and date <= date '{AS_OF}') where k = 1""",
    "sma": "select symbol, sma_20, sma_50, sma_200 from technical_rows",
    "ema": "select symbol, ema_12, ema_26 from technical_rows",
    "ema_series": f"""
select symbol, strftime(date, '%Y-%m-%d') as date, {r("ema", 4)} as ema from (
  select symbol, date, pow(11.0::double/13, bar_no - 1) * (first(close) over w
    + sum(case when bar_no > 1 then 2.0::double/13 * close * pow(13.0::double/11, bar_no - 1) else 0 end)
      over w) as ema
  from bars_windows window w as (partition by symbol order by date rows unbounded preceding))""",
    "rsi": "select symbol, rsi from technical_rows",
    "macd": "select symbol, macd, macd_signal, macd_histogram from technical_rows",
    "bollinger": "select symbol, bollinger_upper, bollinger_middle, bollinger_lower from technical_rows",
    "atr": "select symbol, atr from technical_rows",
    "volume_analysis": "select symbol, current_volume, volume_ma_20, relative_volume from technical_rows",
    "technical_signal": """
select symbol, signal, bullish_points, bearish_points, net_score from technical_module""",
    "technical_analysis": "select * from technical_module",
    "daily_returns": f"""
select symbol, strftime(date, '%Y-%m-%d') as date, {r("close / previous_close - 1", 4)} as daily_return
from bars_windows where previous_close is not null""",
    "period_returns": f"""
select symbol, current_price, {", ".join(n for n, _ in RETURNS)} from historical_module""",
    "volatility": "select symbol, annualized_volatility from historical_module",
    "max_drawdown": "select symbol, maximum_drawdown from historical_module",
    "price_range": "select symbol, period_high, period_low from historical_module",
    "historical_analysis": "select * from historical_module",
    "series_snapshot": "select * from series_figures",
    "market_context": "select * from market_context_rows",
    "market_context_maps": "select * from market_context_rows",
    "symbol_market": f"select symbol, {detect('symbol')} as market_code from companies",
}
