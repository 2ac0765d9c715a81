"""Oracles for macro series, records, interpretation and the combined scores."""

from __future__ import annotations

from tickerloom.functions.markets import MACRO_PUBLISHERS, SECTOR_WEIGHTS, US_SERIES
from tickerloom.oracle.views import detect, r

_MONTHS = (
    "['January','February','March','April','May','June','July','August','September','October',"
    "'November','December']"
)
_WEIGHTS = ", ".join(
    f"('{s}', {', '.join(f'{x}::double' for x in w)})" for s, *w in SECTOR_WEIGHTS
)
_COMPONENTS = ["inflation", "gdp_growth", "unemployment", "monetary_environment"]


def _case(value: str, bands: list[tuple]) -> str:
    return "case " + " ".join(
        f"else {result}" if bound is None else f"when {value} {op} {bound} then {result}"
        for bound, op, result in bands
    ) + " end"


def _both(value: str, bands: list[tuple]) -> tuple[str, str]:
    return (
        _case(value, [(b, op, f"'{s}'") for b, op, s, _ in bands]),
        _case(value, [(b, op, n) for b, op, _, n in bands]),
    )


def _by_market(value: str, per_market: dict[str, list[tuple]]) -> tuple[str, str]:
    parts = {m: _both(value, bands) for m, bands in per_market.items()}
    return tuple(
        "case " + " ".join(f"when mk = '{m}' then {both[i]}" for m, both in parts.items()) + " end"
        for i in (0, 1)
    )


def _inflation(v: str) -> tuple[str, str]:
    high = (None, None, "high_inflation", -2)
    return _by_market(v, {
        "US": [(0, "<", "deflation", -2), (1.5, "<", "low_inflation", -1), (2.5, "<=", "near_target", 1),
               (3.5, "<=", "elevated_inflation", -1), high],
        "IN": [(0, "<", "deflation", -2), (2, "<", "below_target_range", -1),
               (6, "<=", "within_target_range", 1), (8, "<=", "above_target_range", -1), high],
        "SG": [(0, "<", "deflation", -2), (1, "<", "low_inflation", 0), (3, "<=", "price_stable", 1),
               (5, "<=", "elevated_inflation", -1), high],
        "AU": [(0, "<", "deflation", -2), (2, "<", "below_target_range", -1),
               (3, "<=", "within_target_range", 1), (5, "<=", "above_target_range", -1), high],
    })


def _growth(v: str) -> tuple[str, str]:
    def bands(a, b, c, op):
        return [(a, "<", "significant_contraction", -2), (0, "<", "mild_contraction", -1),
                (b, "<", "weak_growth", 0), (c, op, "moderate_growth", 1),
                (None, None, "strong_growth", 2)]

    return _by_market(v, {
        "US": bands(-1, 1, 3, "<="), "IN": bands(-2, 4, 6, "<"),
        "SG": bands(-1, 0.3, 1, "<="), "AU": bands(-1, 0.3, 0.8, "<="),
    })


def _jobs(v: str) -> tuple[str, str]:
    def bands(a, b, c):
        return [(0, "<", "invalid_value", 0), (a, "<=", "healthy_labour_market", 1),
                (b, "<=", "moderate_unemployment", 0), (c, "<=", "elevated_unemployment", -1),
                (None, None, "high_unemployment", -2)]

    return _by_market(v, {
        "US": bands(4.5, 5.5, 7), "IN": bands(4, 6, 8), "SG": bands(2.5, 3.5, 5), "AU": bands(4.5, 5.5, 7),
    })


def _monetary(rate: str, inflation: str, policy: str) -> tuple[str, str]:
    level = [(1.5, "<=", "low_rate_environment", 1), (3, "<=", "moderate_rate_environment", 0),
             (5, "<=", "high_rate_environment", -1), (None, None, "very_high_rate_environment", -2)]
    real = [(-1, "<", "supportive_rate_environment", 1), (1, "<=", "balanced_rate_environment", 0),
            (2, "<=", "restrictive_rate_environment", -1),
            (None, None, "strongly_restrictive_rate_environment", -2)]
    by_level, by_proxy = _both(rate, level), _both(r(f"{rate} - {inflation}", 2), real)
    head = ("'negative_rate_environment'", "1"), ("'rate_available_inflation_unavailable'", "0")
    return tuple(
        f"case when {rate} < 0 then {head[0][i]} when mk = 'SG' or coalesce({policy}, 0) <> 1"
        f" then {by_level[i]} when {inflation} is null then {head[1][i]} else {by_proxy[i]} end"
        for i in (0, 1)
    )


def _settled(name: str, rate: str, both: tuple[str, str]) -> str:
    known = "coalesce(mk in ('US', 'IN', 'SG', 'AU'), false)"
    return (
        f"case when not {known} then 'unsupported_market' when {rate} is null then 'unavailable'"
        f" else {both[0]} end as {name}_status,"
        f" case when {known} and {rate} is not null then {both[1]} else 0 end as {name}_score"
    )


def _score_sum(weights: dict[str, str]) -> str:
    total = " + ".join(
        f"case when {n}_available then {n}_normalized * {w} else 0 end" for n, w in weights.items()
    )
    weight = _weight_sum(weights)
    return f"coalesce(({total}) / nullif({weight}, 0), 0)"


def _weight_sum(weights: dict[str, str]) -> str:
    return "(" + " + ".join(f"case when {n}_available then {w} else 0 end" for n, w in weights.items()) + ")"


def classify(score: str, high: str, a: float, b: float, names: list[str]) -> str:
    return (
        f"case when {score} >= {high} then '{names[0]}' when {score} >= {a} then '{names[1]}'"
        f" when {score} > -{a} then '{names[2]}' when {score} > -{b} then '{names[3]}'"
        f" else '{names[4]}' end"
    )


MACRO_NAMES = ["favourable", "mildly_favourable", "neutral", "mildly_unfavourable", "unfavourable"]
_GENERAL = dict(zip(_COMPONENTS, ["0.3::double", "0.3::double", "0.2::double", "0.2::double"]))
_SECTOR = {n: f"w_{n}" for n in _COMPONENTS}
_NORMAL = "case {0} when 2 then 1.0 when 1 then 1.0 when -1 then -0.5 when -2 then -1.0 else 0.0 end"
_UNAVAILABLE = "('unavailable', 'unsupported_market', 'invalid_value')"
_OBS = "market_code, indicator, value, observation_date, source, is_policy_rate, is_cached, is_fallback"

CTES = {
    "series_valid": """
select *, row_number() over (partition by series_id order by date desc) as n from customer_series""",
    "annual_figures": """
select 'K' || o_custkey as country_code, 'NY.GDP.MKTP.KD.ZG' as indicator, year(o_orderdate) as year,
  case when (o_custkey + year(o_orderdate)) % 4 <> 0
    then cast(sum(cast(round(o_totalprice * 100) as bigint)) as double) / 10000000 end as value
from orders group by o_custkey, year(o_orderdate)""",
    "agency": """
select 'P' || o_custkey as publisher, k as seq,
  case when k % 3 = 0 then 'CPI' when k % 3 = 1 then 'PLFS' else 'NAS' end as dataset,
  case when o_orderpriority < '4' then 'CPI (General)' else 'CPI (Food)' end as division,
  case when k % 5 <> 0 then 'GDP Growth Rate' else 'GVA Growth Rate' end as indicator,
  case when k % 17 = 0 then 'n/a' else cast(y as varchar) end as year,
  case when k % 19 = 0 then 'Smarch' else monthname(o_orderdate) end as month,
  case when k % 23 = 0 then cast(y as varchar)
    else y || '-' || lpad(cast((y + 1) % 100 as varchar), 2, '0') end as fiscal_year,
  case when k % 29 = 0 then 'Q5' else case when k % 2 = 0 then 'q' else 'Q' end || quarter(o_orderdate) end
    as quarter,
  case when k % 13 = 0 then 'na'
    else (price // 3000000) || '.' || lpad(cast(price % 100 as varchar), 2, '0') end as value
from (select *, o_orderkey as k, year(o_orderdate) as y, cast(round(o_totalprice * 100) as bigint) as price
  from orders)""",
    "agency_months": f"""
select *, cast(year as int) * 12 + list_position({_MONTHS}, month) - 1 as period from agency
where year <> 'n/a' and month <> 'Smarch' and value <> 'na'""",
    "table_cells": """
select *, year(date) * 4 + quarter(date) - 1 as q from customer_series where month(date) <> 5""",
    "stored": """
select market_code, case when indicator = 'cpi' then 'inflation' else indicator end as indicator,
  case when indicator = 'cpi' then cast(round(try_cast((value - 100) / 10 as decimal(38,6)), 4) as double)
    else value end as value,
  strftime(period_date, '%Y-%m-%d') as observation_date, 'official' as source,
  case when market_code <> 'US' then market_code <> 'SG' end as is_policy_rate, period_date as cached_at
from macro_obs where period_date < date_trunc('year', date '2001-11-05')
  and market_code || ':' || indicator not in ('SG:unemployment', 'IN:gdp_growth')""",
    "stored_latest": """
select * exclude (k) from (select *, row_number() over (partition by market_code, indicator
  order by cached_at desc) as k from stored) where k = 1""",
    "live": f"""
select market_code, indicator, value, observation_date, 'official' as source,
  case when market_code <> 'US' then market_code <> 'SG' end as is_policy_rate, false as is_cached,
  false as is_fallback
from (
  select a.market_code, 'inflation' as indicator, {r("(a.value / b.value - 1) * 100", 2)} as value,
    strftime(a.period_date, '%Y-%m-%d') as observation_date
  from (select *, max(period_date) over (partition by market_code) as latest from macro_obs
    where indicator = 'cpi') a
  join macro_obs b on b.indicator = 'cpi' and b.market_code = a.market_code
    and b.period_date = a.period_date - interval 1 year
  where a.period_date = latest
  union all
  select market_code, indicator, value, strftime(period_date, '%Y-%m-%d')
  from (select *, max(period_date) over (partition by market_code, indicator) as latest from macro_obs
    where indicator <> 'cpi') where period_date = latest)
where market_code || ':' || indicator not in
  ('US:gdp_growth', 'IN:gdp_growth', 'SG:unemployment', 'AU:inflation')""",
    "annual_fallback": """
select market_code, indicator, cast(round(try_cast(value as decimal(38,6)), 2) as double) as value,
  cast(year as varchar) as observation_date
from (select *, row_number() over (partition by market_code, indicator order by year desc) as k
  from (select market_code, indicator, year(period_date) as year, max(value) as value from macro_obs
    where indicator <> 'cpi' group by 1, 2, 3)) where k = 1""",
    "tiers": f"""
select {_OBS}, 0 as priority from live
  where market_code <> 'US' or (select count(*) from live where market_code = 'US') = 4
union all
select market_code, indicator, value, observation_date, source, is_policy_rate, true, false, 1
  from stored_latest
  where market_code <> 'US' or (select count(*) from stored_latest where market_code = 'US') = 4
union all
select market_code, indicator, value, observation_date, 'annual', null, false, true, 2 from annual_fallback
  where market_code = 'IN' and indicator <> 'policy_rate'""",
    "picked": f"""
select {_OBS} from (select *, row_number() over (partition by market_code, indicator order by priority) as k
  from tiers) where k = 1""",
    "market_wide": """
select m.market_code, m.market_code as mk, country,
  max(value) filter (indicator = 'inflation') as inflation_rate,
  max(value) filter (indicator = 'policy_rate') as monetary_rate,
  max(value) filter (indicator = 'gdp_growth') as gdp_growth_rate,
  max(value) filter (indicator = 'unemployment') as unemployment_rate,
  max(cast(coalesce(is_policy_rate, true) as int)) filter (indicator = 'policy_rate')
    as monetary_rate_is_policy_rate,
  max(cast(is_cached as int)) filter (indicator = 'inflation') as inflation_is_cached,
  max(cast(is_cached as int)) filter (indicator = 'policy_rate') as policy_rate_is_cached,
  max(cast(is_fallback as int)) filter (indicator = 'gdp_growth') as gdp_is_fallback,
  max(cast(is_cached as int)) filter (indicator = 'unemployment') as unemployment_is_cached
from market_rows m left join picked p on p.market_code = m.market_code group by 1, 2, 3""",
    "company_markets": f"select *, {detect('symbol')} as market_code from companies",
    "market_interpreted": f"""
select *, {_settled("inflation", "inflation_rate", _inflation("inflation_rate"))},
  {_settled("gdp_growth", "gdp_growth_rate", _growth("gdp_growth_rate"))},
  {_settled("unemployment", "unemployment_rate", _jobs("unemployment_rate"))},
  {_settled("monetary_environment", "monetary_rate",
            _monetary("monetary_rate", "inflation_rate", "monetary_rate_is_policy_rate"))}
from market_wide""",
    "market_components": f"""
select *, {", ".join(
        f"{n}_status not in {_UNAVAILABLE} as {n}_available, {_NORMAL.format(n + '_score')}::double as {n}_normalized"
        for n in _COMPONENTS)} from market_interpreted""",
    "market_combined": f"""
select *, {classify("combined_macro_score", "0.5", 0.15, 0.5, MACRO_NAMES)} as classification
from (select *, {r(_score_sum(_GENERAL), 3)} as combined_macro_score, {r(_weight_sum(_GENERAL), 2)} as coverage_ratio,
  {r(" + ".join(
        f"case when {n}_available then {w} * {'case when gdp_is_fallback = 1 then 0.6 else 1 end' if n == 'gdp_growth' else '1'} else 0 end"
        for n, w in _GENERAL.items()), 2)} as confidence_score,
  {", ".join(f"case when {n}_available then {r(f'{n}_normalized * {w}', 3)} end as {n}_contribution"
             for n, w in _GENERAL.items())}
  from market_components)""",
    "sector_weight_rows": f"""
select * from (values {_WEIGHTS})
  t(sector, w_inflation, w_gdp_growth, w_unemployment, w_monetary_environment)""",
    "weighted_companies": f"""
select c.symbol, c.company_key, c.sector, c.market_code,
  {", ".join(f"coalesce(w_{n}, 0.25::double) as w_{n}" for n in _COMPONENTS)},
  w_inflation is null as used_default_weights
from company_markets c left join sector_weight_rows s on s.sector = c.sector""",
    "sector_scores": f"""
select *, {classify("sector_macro_score", "0.5", 0.15, 0.5, MACRO_NAMES)} as sector_classification
from (select symbol, company_key, sector, w.market_code, combined_macro_score, confidence_score, used_default_weights,
    {r(_score_sum(_SECTOR), 3)} as sector_macro_score,
    {r(_weight_sum(_SECTOR), 2)} as available_sector_weight,
    {", ".join(f"case when {n}_available then {r(f'{n}_normalized * {w}', 3)} end as sector_{n}_contribution"
               for n, w in _SECTOR.items())}
  from weighted_companies w join market_combined m on m.market_code = w.market_code)""",
    "interpretation_rows": """
select o_orderkey as row_id, market_code, upper(trim(market_code)) as mk,
  case when o_orderkey % 37 <> 0 then (price % 120) / 10 - 3 end as rate,
  case when o_orderkey % 31 <> 0 then ((price // 120) % 100) / 10 - 2 end as inflation,
  cast(o_orderkey % 4 <> 0 as int) as flag
from (select *, cast(round(o_totalprice * 100) as bigint) as price,
  case o_custkey % 6 when 0 then 'US' when 1 then 'IN' when 2 then 'SG' when 3 then 'AU' when 4 then ' us '
    else 'BR' end as market_code from orders)""",
}

_US_IDS = " ".join(f"when '{i}' then '{s}'" for s, i, *_ in US_SERIES)
_CLASS_SCORES = "(select event_id, round((event_id % 241 - 120) / 100, 2) as score from events)"
QUERIES = {
    "fred_observations": """
select series_id, strftime(date, '%Y-%m-%d') as date, value from series_valid
where n <= 24 and month(date) not in (3, 7)""",
    "fred_latest": f"""
select series_id, {r("value", 4)} as value, strftime(date, '%Y-%m-%d') as observation_date,
  s.indicator, s.name, s.unit, s.frequency
from (select *, row_number() over (partition by sid order by date desc) as v from (
    select case indicator {_US_IDS} end as sid, period_date as date, value,
      row_number() over (partition by indicator order by period_date desc) as n
    from macro_obs where market_code = 'US') where month(date) not in (3, 7)) l
join (values {", ".join(str(row) for row in US_SERIES)}) s(series_id, indicator, name, unit, frequency)
  on s.series_id = l.sid where v = 1""",
    "inflation_yoy": f"""
select a.series_id, {r("(a.value / b.value - 1) * 100", 2)} as value,
  strftime(a.date, '%Y-%m-%d') as observation_date, strftime(b.date, '%Y-%m-%d') as comparison_date,
  {r("a.value", 4)} as latest_cpi, {r("b.value", 4)} as year_ago_cpi
from (select *, max(date) over (partition by series_id) as top from series_valid
  where month(date) not in (3, 7)) a
join series_valid b on b.series_id = a.series_id and b.date = a.date - interval 1 year
where a.date = a.top and b.value <> 0 and month(b.date) not in (3, 7)""",
    "world_bank_latest": f"""
select country_code, indicator, {r("value", 2)} as value, cast(year as varchar) as observation_date,
  'annual' as frequency, true as is_fallback
from (select *, row_number() over (partition by country_code order by year desc) as k
  from annual_figures where value is not null) where k = 1""",
    "mospi_records": "select * from agency where dataset = 'CPI' and division = 'CPI (General)'",
    "mospi_cpi_latest": f"""
select publisher, {r("cast(value as double)", 2)} as value,
  (period // 12) || '-' || lpad(cast(period % 12 + 1 as varchar), 2, '0') as observation_date, month,
  cast(year as bigint) as year
from (select *, row_number() over (partition by publisher order by period desc, seq) as k from agency_months
  where dataset = 'CPI' and division = 'CPI (General)') where k = 1""",
    "mospi_plfs_latest": f"""
select publisher, {r("cast(value as double)", 2)} as value,
  (period // 12) || '-' || lpad(cast(period % 12 + 1 as varchar), 2, '0') as observation_date, month,
  cast(year as bigint) as year
from (select *, row_number() over (partition by publisher order by period desc, seq desc) as k
  from agency_months where dataset = 'PLFS') where k = 1""",
    "mospi_gdp_latest": f"""
select publisher, {r("cast(value as double)", 2)} as value, fiscal_year || '-Q' || q as observation_date,
  fiscal_year, q as quarter
from (select *, row_number() over (partition by publisher order by fiscal_year[1:4], q desc, seq) as k
  from (select *, cast(quarter[2:2] as bigint) as q, max(fiscal_year[1:4] || quarter[2:2])
      over (partition by publisher) as top from agency
    where dataset = 'NAS' and indicator = 'GDP Growth Rate' and length(fiscal_year) = 7
      and quarter <> 'Q5' and value <> 'na')
  where fiscal_year[1:4] || q = top) where k = 1""",
    "singstat_unpivot": f"""
select series_id, 'inflation' as indicator, {r("value", 2)} as value, strftime(date, '%Y-%m') as observation_date
from (select *, row_number() over (partition by series_id order by date desc) as k from table_cells) where k = 1
union all
select series_id, i, {r("value", 2)}, year(date) || '-Q' || quarter(date)
from (select *, row_number() over (partition by series_id order by q desc) as k from table_cells
  where month(date) % 3 = 1), (values ('unemployment'), ('gdp_growth')) n(i) where k = 1""",
    "latest_by_key": """
select market_code, indicator, value, cast(year(period_date) * 12 + month(period_date) - 1 as bigint) as period
from (select *, row_number() over (partition by market_code, indicator order by period_date desc) as k
  from macro_obs) where k = 1""",
    "good_obs_store": "select market_code, indicator, value, observation_date, source from stored",
    "good_obs_latest": """
select market_code, indicator, value, observation_date, true as is_cached from stored_latest""",
    "good_obs_stream": """
select market_code, indicator, value, observation_date, true as is_cached from (
  select *, row_number() over (partition by market_code, indicator order by cached_at desc) as k
  from (select *, count(distinct indicator) over (partition by market_code, cached_at) as found from stored)
  where market_code <> 'US' or found = 4) where k = 1""",
    "interpret_inflation": f"""
select row_id, market_code, rate as inflation_rate, {_settled("inflation", "rate", _inflation("rate"))},
  {r("rate - case mk when 'US' then 2.0::double when 'IN' then 4.0::double when 'SG' then 2.0::double when 'AU' then 2.5::double end", 2)}
    as deviation_from_target from interpretation_rows""",
    "interpret_gdp_growth": f"""
select *, case when gdp_growth_status not in {_UNAVAILABLE}
    then case when gdp_is_fallback = 1 then 'fallback_source' else 'official_source' end end as gdp_data_quality
from (select row_id, market_code, rate as gdp_growth_rate, flag as gdp_is_fallback,
  {_settled("gdp_growth", "rate", _growth("rate"))} from interpretation_rows)""",
    "interpret_unemployment": f"""
select row_id, market_code, rate as unemployment_rate, {_settled("unemployment", "rate", _jobs("rate"))}
from interpretation_rows""",
    "interpret_monetary_rate": f"""
select row_id, market_code, rate as monetary_rate, inflation as inflation_rate,
  flag as monetary_rate_is_policy_rate,
  case when rate >= 0 and mk in ('US', 'IN', 'AU') and flag = 1 then {r("rate - inflation", 2)} end
    as real_rate_proxy,
  {_settled("monetary_environment", "rate", _monetary("rate", "inflation", "flag"))}
from interpretation_rows""",
    "threshold_classify": f"""
select row_id, market_code, rate, indicator,
  case when rate is not null then case indicator when 'inflation' then {_inflation("rate")[0]}
    when 'gdp_growth' then {_growth("rate")[0]} else {_jobs("rate")[0]} end end as band_status,
  case when rate is not null then case indicator when 'inflation' then {_inflation("rate")[1]}
    when 'gdp_growth' then {_growth("rate")[1]} else {_jobs("rate")[1]} end end as band_score
from (select * replace (case when market_code = mk then mk end as mk),
  case row_id % 3 when 0 then 'inflation' when 1 then 'gdp_growth' else 'unemployment' end as indicator
  from interpretation_rows)""",
    "landed_series": """
select series_id, strftime(date, '%Y-%m-%d') as date, value from series_valid
where month(date) not in (3, 7) and cast(series_id[2:] as bigint) % 97 <> 5""",
    "landed_rejects": """
select distinct series_id, 'not valid JSON' as reason, true as has_file from customer_series
where cast(series_id[2:] as bigint) % 97 = 5""",
    "component_normalize": f"""
select event_id, score, {_NORMAL.format("score")}::double as normalized
from (select event_id, cast(event_id % 7 - 3 as int) as score from events)""",
    "classify_macro": f"""
select *, {classify("score", "0.5", 0.15, 0.5, MACRO_NAMES)} as classification from {_CLASS_SCORES}""",
    "classify_sector": f"""
select *, {classify("score", "0.5", 0.15, 0.5, MACRO_NAMES)} as classification from {_CLASS_SCORES}""",
    "classify_intelligence": f"""
select *, {classify("score", "0.5", 0.2, 0.5,
                    ["strongly_favourable", "favourable", "neutral", "cautious", "unfavourable"])}
  as classification from {_CLASS_SCORES}""",
    "indicator_priority": "select * from picked",
    "macro_snapshot": f"""
select c.symbol, c.market_code, country, {", ".join(
        f"max({col}) filter (indicator = '{i}') as {i}_{col}"
        for i in ("policy_rate", "inflation", "gdp_growth", "unemployment")
        for col in ("value", "observation_date", "source"))}
from company_markets c join market_rows m on m.market_code = c.market_code
left join picked p on p.market_code = c.market_code group by 1, 2, 3""",
    "macro_features": """
select symbol, w.* exclude (mk) from company_markets c join market_wide w on w.market_code = c.market_code""",
    "macro_combined": f"""
select symbol, m.market_code, country, combined_macro_score, classification, coverage_ratio,
  confidence_score, {", ".join(f"{n}_{c}" for n in _COMPONENTS
                               for c in ("status", "score", "available", "normalized", "contribution"))}
from company_markets c join market_combined m on m.market_code = c.market_code""",
    "sector_weight_join": f"""
select symbol, sector, used_default_weights, {", ".join(f"w_{n}" for n in _COMPONENTS)}
from weighted_companies""",
    "sector_macro": f"""
select symbol, sector, market_code, combined_macro_score as general_macro_score, sector_macro_score,
  sector_classification as classification, available_sector_weight, used_default_weights,
  confidence_score as macro_confidence_score,
  {", ".join(f"sector_{n}_contribution" for n in _COMPONENTS)} from sector_scores""",
    "symbol_market_config": f"""
select symbol, c.market_code, country, currency, {", ".join(
        f"coalesce(string_agg(series_symbol, ',' order by series_symbol) filter (series_group = '{g}'), '') as {g}"
        for g in ("indices", "currencies", "volatility", "bond_yield", "commodities"))},
  policy_rate_publisher, inflation_publisher, gdp_publisher, unemployment_publisher
from company_markets c join market_rows m on m.market_code = c.market_code
join market_series_rows s on s.market_code = c.market_code
join (values {", ".join(str(row) for row in MACRO_PUBLISHERS)})
  p(market_code, policy_rate_publisher, inflation_publisher, gdp_publisher, unemployment_publisher)
  on p.market_code = c.market_code
group by all""",
}

QUERIES["threshold_classify_table"] = QUERIES["threshold_classify"]
