"""The derived market views in DuckDB."""

from __future__ import annotations

from tickerloom.sources.views import AS_OF, BRANDS, LEGAL_FORMS, SECTORS

__all__ = ["AS_OF", "CTES", "market", "num", "r", "symbol"]


def r(value: str, digits: int) -> str:
    """Rounding through a decimal."""
    return f"cast(round(try_cast({value} as decimal(38,6)), {digits}) as double)"


def symbol(key: str) -> str:
    return (
        f"('S' || lpad(cast({key} as varchar), greatest(10, length(cast({key} as varchar)))::int, '0') || case when {key} % 10 = 6 then '.BO'"
        f" when {key} % 5 = 1 then '.NS' when {key} % 5 = 2 then '.SI'"
        f" when {key} % 5 = 3 then '.AX' else '' end)"
    )


def market(key: str) -> str:
    return (
        f"(case when {key} % 5 = 1 then 'IN' when {key} % 5 = 2 then 'SG'"
        f" when {key} % 5 = 3 then 'AU' else 'US' end)"
    )


def detect(sym: str) -> str:
    return (
        f"(case when length(trim({sym})) = 0 then null"
        f" when upper(trim({sym})) like '%.NS' or upper(trim({sym})) like '%.BO' then 'IN'"
        f" when upper(trim({sym})) like '%.SI' then 'SG' when upper(trim({sym})) like '%.AX' then 'AU'"
        f" when {sym} is null then null else 'US' end)"
    )


def num(text: str) -> str:
    """Finite number in a text value, else null."""
    t = f"trim({text}, E' \\t\\r\\n')"
    return (
        f"(case when regexp_full_match({t}, '[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?')"
        f" and isfinite(try_cast({t} as double)) then try_cast({t} as double) end)"
    )


def _list(options: list[str]) -> str:
    return "[" + ", ".join(f"'{o}'" for o in options) + "]"


CTES = {
    "companies": f"""
select s_suppkey as company_key, {symbol("s_suppkey")} as symbol,
  upper(b[1]) || b[2:] as company_name, upper(b[1]) || b[2:] || ' ' || legal_form as legal_name,
  sector, cast(round(s_acctbal * 100) as bigint) as acctbal_cents
from (select *, list_extract({_list(BRANDS)}, cast(s_suppkey % 7 + 1 as int)) as b,
  list_extract({_list(LEGAL_FORMS)}, cast(s_suppkey % 5 + 1 as int)) as legal_form,
  list_extract({_list(SECTORS)}, cast(s_suppkey % 12 + 1 as int)) as sector from supplier)""",
    "trades": f"""
select {symbol("l_suppkey")} as symbol, l_shipdate as ts, price_cents / 100.0::double as price,
  l_quantity as quantity, (l_orderkey * 8 + l_linenumber) * 1048576 + price_cents as seq,
  l_linenumber as line
from (select *, 200000
  + ((l_suppkey // 5) % 5 - 2) * 25 * datediff('day', date '1995-01-01', cast(l_shipdate as date))
  + cast(round(l_extendedprice * 100) as bigint) // (300 * (1 + l_suppkey % 4)) as price_cents
  from lineitem)""",
    "raw_bars": """
select symbol, ts, seq, price as open, price + 1 as high, price - 1 as low,
  case when line < 6 then price end as close, quantity as volume from trades""",
    "statements": f"""
select {symbol("company_key")} as symbol, metric_pos, metric,
  make_date(cast(fiscal_year as int), 12, 31) as as_of_date, raw,
  case when company_key % 4 = 0 then 'USD' when company_key % 5 = 1 then 'INR'
    when company_key % 5 = 2 then 'SGD' when company_key % 5 = 3 then 'AUD' else 'USD' end as currency
from (
  select company_key, fiscal_year, unnest([
    {{'metric_pos': 0, 'metric': 'annualTotalRevenue', 'raw': revenue / 10000}},
    {{'metric_pos': 1, 'metric': 'annualNetIncome', 'raw': income / 1000000}},
    {{'metric_pos': 2, 'metric': 'annualStockholdersEquity',
      'raw': case when company_key % 13 <> 0 then equity end}},
    {{'metric_pos': 3, 'metric': 'annualTotalAssets', 'raw': assets / 100}},
    {{'metric_pos': 4, 'metric': 'annualTotalDebt', 'raw': debt * 6 / 10000}},
    {{'metric_pos': 5, 'metric': 'annualFreeCashFlow',
      'raw': case when company_key % 17 <> 0 then cash / 100000 end}},
    {{'metric_pos': 6, 'metric': 'annualDilutedAverageShares',
      'raw': case when company_key % 3 <> 0 then shares end}},
    {{'metric_pos': 7, 'metric': 'annualOrdinarySharesNumber', 'raw': shares + 1}}], recursive := true)
  from (
    select company_key, fiscal_year, cast(sum(p * (100 - d)) as double) as revenue,
      cast(sum(p * (500 * (company_key % 6 - 1) + 250 - 50 * d)) as double) as income,
      cast(sum(p) as double) as assets, cast(sum(p * t) as double) as debt,
      cast(sum(p * (10 * t - 8 * d)) as double) as cash, sum(l_quantity) as shares,
      cast(2 * cast(round(any_value(s_acctbal) * 100) as bigint) as double) as equity
    from (select l_suppkey as company_key, year(l_shipdate) as fiscal_year,
        cast(round(l_extendedprice * 100) as bigint) as p, cast(round(l_discount * 100) as bigint) as d,
        cast(round(l_tax * 100) as bigint) as t, l_quantity
      from lineitem where l_shipdate < date_trunc('year', timestamp '{AS_OF}'))
    join supplier on s_suppkey = company_key
    group by company_key, fiscal_year))
where raw is not null""",
    "market_orders": f"""
select {market("o_custkey")} as market_code, cast(date_trunc('month', o_orderdate) as date) as month,
  cast(round(o_totalprice * 100) as bigint) as price, o_orderstatus as status
from orders where o_orderdate < date_trunc('month', timestamp '{AS_OF}')""",
    "market_months": """
select market_code, month, cast(sum(price) as double) as price, cast(count(*) as double) as n,
  count_if(status = 'P') as n_p, count_if(status = 'F') as n_f from market_orders group by all""",
    "macro_obs": f"""
select market_code, month as period_date, 'cpi' as indicator,
  {r("100 + 0.25 * datediff('month', date '1995-01-01', month) + price / n / 100 / 25000", 4)} as value
from market_months
union all select market_code, month, 'unemployment', {r("12 * n_p / n", 4)} from market_months
union all select market_code, month, 'policy_rate', {r("10 * n_f / n", 4)} from market_months
union all select market_code, cast(date_trunc('quarter', month) as date), 'gdp_growth',
  {r("40 * (sum(price) / sum(n) / 100 / 250000 - 1) + 2.5", 4)}
from market_months where month < date_trunc('quarter', date '{AS_OF}') group by 1, 2""",
    "customer_series": f"""
select 'C' || o_custkey as series_id, o_custkey as series_key,
  cast(date_trunc('month', o_orderdate) as date) as date,
  {r("cast(sum(cast(round(o_totalprice * 100) as bigint)) as double) / count(*) / 1000000", 4)} as value
from orders group by 1, 2, 3""",
    "news": f"""
select doc_id, {symbol("company_key")} as symbol, title, description, content, source, published_at, url
from (select doc_id, case when doc_id % 3 = 0 then 1 else doc_id // 10 end as company_key,
    case when doc_id % 31 = 0 then E' \\n'
      when doc_id % 23 = 0 then string_split(text, E'\\n')[1] || ' Stocks to Watch'
      else string_split(text, E'\\n')[1] end as title, string_split(text, E'\\n')[2] as description,
    text as content, source,
    strftime(timestamp '2001-01-01' + to_hours(cast((doc_id * 37) % 5000 as int)), '%Y-%m-%dT%H:%M:%SZ')
      as published_at,
    case when doc_id % 29 <> 0 then 'https://n/' || source || '/' || (doc_id % 7) else '' end as url
  from documents where lang = 'en')""",
    "sentiment_labels": """
select doc_id, case when toxic = 1 then 'Negative' when quality = 1 then ' positive ' else 'mixed' end
  as sentiment from labels""",
}
