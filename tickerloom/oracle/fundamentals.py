"""Oracles for statements, quotes and numeric coercion."""

from __future__ import annotations

from tickerloom.oracle.views import AS_OF, num, r
from tickerloom.sources.views import FX_RATES

_CURRENCY = (
    "(case when company_key % 5 = 1 then 'INR' when company_key % 5 = 2 then 'SGD'"
    " when company_key % 5 = 3 then 'AUD' else 'USD' end)"
)
_RATES = ", ".join(f"('{b}', '{q}', date '{d}', {rate}::double)" for b, q, d, rate in FX_RATES)
_RECORD = (
    "symbol, company_name, sector, industry, currency, market_cap, total_revenue, trailing_pe,"
    " forward_pe, price_to_book, profit_margin, return_on_equity, return_on_assets, revenue_growth,"
    " earnings_growth, debt_to_equity, free_cash_flow, data_source, is_fallback"
)


def _pct(numerator: str, denominator: str) -> str:
    return r(f"{numerator} / nullif({denominator}, 0) * 100", 2)


def _growth(latest: str, previous: str) -> str:
    return r(f"(case when {previous} > 0 then {latest} / {previous} - 1 end) * 100", 2)


def _metric(expression: str) -> str:
    return r(f"cast(cast({expression} as decimal(12,2)) as double)", 2)


CTES = {
    "latest_two": """
select symbol, metric, max(case when k = 1 then raw end) as latest,
  max(case when k = 2 then raw end) as previous
from (select *, row_number() over (partition by symbol, metric order by as_of_date desc) as k
  from statements) where k <= 2 group by 1, 2""",
    "wide": """
select symbol,
  max(latest) filter (metric = 'annualTotalRevenue') as revenue,
  max(previous) filter (metric = 'annualTotalRevenue') as previous_revenue,
  max(latest) filter (metric = 'annualNetIncome') as net_income,
  max(previous) filter (metric = 'annualNetIncome') as previous_net_income,
  max(latest) filter (metric = 'annualStockholdersEquity') as equity,
  max(latest) filter (metric = 'annualTotalAssets') as assets,
  max(latest) filter (metric = 'annualTotalDebt') as debt,
  max(latest) filter (metric = 'annualFreeCashFlow') as cash_flow,
  coalesce(max(latest) filter (metric = 'annualDilutedAverageShares'),
    max(latest) filter (metric = 'annualOrdinarySharesNumber')) as shares
from latest_two group by symbol""",
    "first_currency": """
select symbol, arg_min(currency, metric_pos * 100000 + datediff('day', date '1970-01-01', as_of_date))
  as statement_currency from statements group by symbol""",
    "pair_rates": f"""
select base, quote, arg_max(rate, as_of) as rate from (values {_RATES}) t(base, quote, as_of, rate)
where rate <> 0 group by 1, 2""",
    "primary_records": f"""
select * from (
  select symbol, case when company_key % 18 = 2 then null else company_name end as company_name,
    sector, sector || ' - General' as industry, {_CURRENCY} as currency,
    cast(acctbal_cents + 200000 as double) as market_cap,
    cast((company_key + 1) * 12345 as double) as total_revenue,
    {r("company_key % 40 + 0.125", 2)} as trailing_pe,
    {r("case when company_key % 11 <> 0 then company_key % 50 - 5 end", 2)} as forward_pe,
    {r("(company_key % 9) / 4", 2)} as price_to_book,
    {r("(company_key % 30 - 8)::double", 2)} as profit_margin,
    {r("(company_key % 28 - 4)::double", 2)} as return_on_equity,
    {r("(company_key % 20 - 3) / 2", 2)} as return_on_assets,
    {r("(company_key % 36 - 15)::double", 2)} as revenue_growth,
    {r("case when company_key % 10 <> 7 then (company_key % 44 - 20)::double end", 2)} as earnings_growth,
    {r("(company_key % 26) * 10", 2)} as debt_to_equity,
    cast((company_key % 7 - 2) * 1000000 as double) as free_cash_flow,
    'primary' as data_source, false as is_fallback
  from companies where company_key % 3 <> 1) where company_name is not null""",
    "metric_values": f"""
select symbol, company_key,
  case when company_key % 4 = 0 then {_metric("(company_key % 21) / 5")}
    else {_metric("(company_key % 33) / 2")} end as trailing_pe,
  {_metric("(company_key % 12) / 5")} as price_to_book,
  {_metric("(company_key % 40 - 12) / 2")} as profit_margin,
  {_metric("(company_key % 34 - 9) / 2")} as return_on_equity,
  {_metric("(company_key % 10 - 2) / 4")} as return_on_assets,
  {_metric("(company_key % 50 - 22) / 2")} as revenue_growth,
  {_metric("(company_key % 62 - 30) / 2")} as earnings_growth,
  {_metric("(company_key % 30) / 10")} as debt_to_equity
from companies where company_key % 2 = 0 and company_key % 8 <> 0
union all
select symbol, company_key, null, null, null, null, null, null, null, null
from companies where company_key % 8 = 0""",
    "metric_records": f"""
select m.symbol, company_name, sector, sector as industry, {_CURRENCY} as currency,
  {r("(acctbal_cents + 200000)::double / 1000 * 1000000", 2)} as market_cap,
  {r("cast(cast((company_key % 60) / 4 as decimal(12,2)) as double) * (company_key % 90 + 10) * 1000000", 2)}
    as total_revenue,
  trailing_pe, cast(null as double) as forward_pe, price_to_book, profit_margin, return_on_equity,
  return_on_assets, revenue_growth, earnings_growth, debt_to_equity,
  {r("cast(cast((company_key % 15 - 4) / 8 as decimal(12,2)) as double) * (company_key % 90 + 10) * 1000000", 2)}
    as free_cash_flow,
  'metrics' as data_source, true as is_fallback
from metric_values m join companies using (company_key)
where company_key % 8 <> 0 and company_key % 14 <> 0""",
    "direct_inputs": f"""
select c.*, w.* exclude (symbol), statement_currency,
  case when company_key % 6 <> 0 then {_CURRENCY} when company_key % 3 <> 0 then 'USD'
    else statement_currency end as trading_currency,
  case when company_key % 2 = 1 then last_close end as market_price
from companies c join wide w on w.symbol = c.symbol
join first_currency f on f.symbol = c.symbol
left join (select symbol, arg_max(close, date) as last_close from bars
  where date >= date '{AS_OF}' - interval 31 day group by symbol) b on b.symbol = c.symbol
where company_key % 5 <> 4""",
    "direct_converted": f"""
select *, {r("coalesce(cap_quoted, nullif(coalesce(market_price, 0) * coalesce(shares, 0), 0))", 2)} as cap,
  {r("net_income * exchange_rate", 2)} as income_converted,
  {r("equity * exchange_rate", 2)} as equity_converted
from (select i.*, case when company_key % 4 <> 1 then cast(acctbal_cents + 300000 as double) end as cap_quoted,
    case when statement_currency = trading_currency then 1
      else coalesce(d.rate, 1 / v.rate) end as exchange_rate
  from direct_inputs i
  left join pair_rates d on d.base = statement_currency and d.quote = trading_currency
  left join pair_rates v on v.quote = statement_currency and v.base = trading_currency)
where exchange_rate is not null""",
    "direct_records": f"""
select symbol, company_name, sector, sector || ' - Other' as industry, trading_currency as currency,
  cap as market_cap, {r("revenue * exchange_rate", 2)} as total_revenue,
  coalesce({r("case when company_key % 3 <> 0 then company_key % 40 + 0.375 end", 2)},
    {r("cap / nullif(income_converted, 0)", 2)}) as trailing_pe,
  {r("company_key % 50 - 5", 2)} as forward_pe,
  coalesce({r("case when company_key % 2 = 0 then (company_key % 9) / 8 end", 2)},
    {r("cap / nullif(equity_converted, 0)", 2)}) as price_to_book,
  {_pct("net_income", "revenue")} as profit_margin, {_pct("net_income", "equity")} as return_on_equity,
  {_pct("net_income", "assets")} as return_on_assets,
  {_growth("revenue", "previous_revenue")} as revenue_growth,
  {_growth("net_income", "previous_net_income")} as earnings_growth,
  {r("debt / nullif(equity, 0)", 2)} as debt_to_equity,
  {r("cash_flow * exchange_rate", 2)} as free_cash_flow, 'statements' as data_source, true as is_fallback
from direct_converted""",
    "fundamental_records": f"""
select {_RECORD} from (
  select *, row_number() over (partition by symbol order by priority) as k from (
    select {_RECORD}, 0 as priority from primary_records
    union all select {_RECORD}, 1 from metric_records
    union all select {_RECORD}, 2 from direct_records)) where k = 1""",
    "event_numbers": f"""
select *, {num("t")} as number from (
  select *, case event_id % 9 when 0 then 'abc' when 1 then 'NaN' when 2 then 'Infinity' when 3 then ''
    when 4 then '  ' || v || ' ' when 5 then '1e3' when 6 then '-' || v when 7 then v || 'd' else v end as t
  from (select *, cast(cast(value as decimal(18,2)) as varchar) as v from events))""",
}

QUERIES = {
    "statement_series": f"""
select symbol, row_number() over (partition by symbol order by as_of_date) as position, as_of_date,
  {r("raw", 2)} as raw
from (select symbol, strftime(as_of_date, '%Y-%m-%d') as as_of_date, raw from statements
    where metric = 'annualTotalRevenue'
  union all select distinct symbol, '', 1.0::double from statements)""",
    "statement_currency": """
select symbol, arg_min(currency, metric_pos * 100000 + datediff('day', date '1970-01-01', as_of_date))
  as statement_currency from statements where metric_pos > 1 group by symbol""",
    "chart_last_price": """
select symbol, case when k % 2 = 0 then high else close end as last_price,
  case when k % 3 <> 0 then 'USD' end as currency
from (select symbol, cast(regexp_extract(symbol, '^S([0-9]+)', 1) as bigint) as k, arg_max(high, date) as high,
  arg_max(close, date) filter (day(date) % 11 <> 0) as close from bars group by symbol)""",
    "latest_two_statements": f"""
select symbol, metric, {r("latest", 2)} as latest, {r("previous", 2)} as previous from latest_two""",
    "fx_convert": f"""
select symbol, statement_currency, trading_currency, {r("exchange_rate", 6)} as exchange_rate,
  exchange_rate is null as fx_error, {r("raw * exchange_rate", 2)} as revenue
from (select i.symbol, statement_currency, trading_currency, raw,
    case when statement_currency = trading_currency then 1
      else coalesce(d.rate, 1 / v.rate) end as exchange_rate
  from (select c.symbol, statement_currency, latest as raw,
      case when company_key % 6 = 0 then 'USD' else {_CURRENCY} end as trading_currency
    from companies c join first_currency f on f.symbol = c.symbol
    join latest_two t on t.symbol = c.symbol and t.metric = 'annualTotalRevenue') i
  left join pair_rates d on d.base = statement_currency and d.quote = trading_currency
  left join pair_rates v on v.quote = statement_currency and v.base = trading_currency)""",
    "fundamental_from_statements": "select * from direct_records",
    "fundamental_with_fallback": "select * from fundamental_records",
    "first_metric": "select * exclude (company_key) from metric_values",
    "numeric_coerce": f"""
select event_id, number, {r("number", 2)} as number_2dp, {r("number * 100", 2)} as percent,
  {r("number * 1000000", 2)} as units from event_numbers""",
    "safe_ratio": f"""
select event_id, {r("value / nullif(event_id % 7 - 3, 0)", 2)} as ratio,
  {r("value / nullif(event_id % 7 - 3, 0) * 100", 2)} as ratio_pct from events""",
    "growth_pct": f"""
select event_id, {r("(case when event_id % 11 > 3 then value / ((event_id % 11 - 3) * 1.5::double) - 1 end) * 100", 2)}
  as growth_pct from events""",
    "per_share_total": f"""
select event_id, {r("case when user_id % 10 <> 0 then value * (user_id % 100) * 1000000 end", 2)} as total
from events""",
    "clamp": """
select event_id, case when event_id % 13 <> 0 then greatest(-1.0::double, least(1.0::double, (value - 20) / 16))
  end as clamped from events""",
}
