"""Oracles for the module scores and the combined report."""

from __future__ import annotations

from tickerloom.oracle.macro import classify
from tickerloom.oracle.news import deduplicated, features, scored
from tickerloom.oracle.views import AS_OF, r

_WEIGHTS = {
    "fundamental": "0.3::double",
    "technical": "0.2::double",
    "sentiment": "0.15::double",
    "historical": "0.15::double",
    "sector_macro": "0.2::double",
}
_RETURNS = [
    ("one_month_return", 20, 0.2),
    ("three_month_return", 30, 0.3),
    ("six_month_return", 40, 0.25),
    ("one_year_return", 50, 0.25),
]
_CLASSES = ["strongly_favourable", "favourable", "neutral", "cautious", "unfavourable"]


def _clamp(value: str) -> str:
    return f"greatest(-1.0::double, least(1.0::double, {value}))"


def _scores(name: str, available: str, score: str, quality: str) -> str:
    known = f"coalesce({available}, false)"
    return (
        f"case when {known} then {r(_clamp(score), 3)} else 0 end as {name}_score,"
        f" {known} as {name}_available,"
        f" case when {known} then {r(quality, 2)} else 0 end as {name}_quality"
    )


def _technical() -> str:
    return _scores("technical", "net_score is not null", "net_score / 6", "1.0::double")


def _sentiment() -> str:
    return _scores(
        "sentiment",
        "article_count > 0 and sentiment_score is not null",
        "sentiment_score",
        "least(article_count / 5, 1.0::double)",
    )


_RETURN_TOTAL = "(" + " + ".join(
    f"coalesce({_clamp(f'{n} / {scale}')} * {w}::double * case when {n} is null then 0 else 1 end, 0)"
    for n, scale, w in _RETURNS
) + ")"
_RETURN_WEIGHT = "(" + " + ".join(
    f"case when {n} is null then 0 else {w}::double end" for n, _, w in _RETURNS
) + ")"
_PENALTY = (
    "(case when annualized_volatility > 75 then -0.2::double when annualized_volatility > 50"
    " then -0.1::double else 0 end + case when maximum_drawdown < -50 then -0.2::double"
    " when maximum_drawdown < -30 then -0.1::double else 0 end)"
)


def _historical() -> str:
    return (
        _scores(
            "historical",
            f"{_RETURN_WEIGHT} > 0",
            f"{_RETURN_TOTAL} / nullif({_RETURN_WEIGHT}, 0) + {_PENALTY}",
            _RETURN_WEIGHT,
        )
        + f", case when {_RETURN_WEIGHT} > 0 then {r(_PENALTY, 2)} end as risk_penalty"
    )


def _growth(name: str) -> str:
    return (
        f"case when {name} >= 10 then 1 when {name} > 0 then 0.5 when {name} <= -10 then -1"
        f" when {name} is not null then -0.5 end"
    )


_METRICS = [
    "case when profit_margin >= 10 then 1 when profit_margin > 0 then 0.5"
    " when profit_margin is not null then -1 end",
    "case when return_on_equity >= 15 then 1 when return_on_equity >= 5 then 0.5"
    " when return_on_equity >= 0 then 0 when return_on_equity is not null then -1 end",
    _growth("revenue_growth"),
    _growth("earnings_growth"),
    "case when forward_pe > 0 and forward_pe <= 25 then 1 when forward_pe <= 40 then 0.25"
    " when forward_pe is not null then -0.5 end",
    "case when debt_to_equity <= 100 then 0.5 when debt_to_equity <= 200 then 0"
    " when debt_to_equity is not null then -0.5 end",
    "case when free_cash_flow > 0 then 1 when free_cash_flow is not null then -1 end",
]
_METRIC_LIST = "[" + ", ".join(f"cast({m} as double)" for m in _METRICS) + "]"


def _fundamental() -> str:
    known = f"list_filter({_METRIC_LIST}, lambda x: x is not null)"
    return _scores(
        "fundamental", f"len({known}) > 0", f"list_sum({known}) / nullif(len({known}), 0)", f"len({known}) / 7"
    )


def _sector_macro() -> str:
    return _scores(
        "sector_macro",
        "sector_macro_score is not null and available_sector_weight <> 0",
        "sector_macro_score",
        "coalesce(macro_confidence_score, 0)",
    )


_TOTAL = " + ".join(f"case when {n}_available then {n}_score * {w} else 0 end" for n, w in _WEIGHTS.items())
_WEIGHT = " + ".join(f"case when {n}_available then {w} else 0 end" for n, w in _WEIGHTS.items())
_CONFIDENCE = " + ".join(
    f"case when {n}_available then {n}_quality * {w} else 0 end" for n, w in _WEIGHTS.items()
)
_PARTS = ["score", "available", "quality", "contribution"]

CTES = {
    "record_terms": """
select c.symbol, [lower(coalesce(f.company_name, c.symbol))] as terms
from companies c left join fundamental_records f on f.symbol = c.symbol""",
    "report_scored": scored("news", "record_terms"),
    "report_stories": deduplicated("report_scored"),
    "report_classified": """
select s.symbol, sentiment from report_stories s join predicted p on p.doc_id = s.doc_id
where rank <= 5""",
    "report_sentiment": features("companies", "report_classified"),
    "report_rows": """
select c.symbol, f.* exclude (symbol), c.market_code, h.* exclude (symbol, current_price),
  bar_count, t.* exclude (symbol, current_price), article_count, sentiment_score
from company_markets c
left join fundamental_records f on f.symbol = c.symbol
left join historical_module_2y h on h.symbol = c.symbol
left join (select symbol, count(*) as bar_count from bars_2y group by symbol) b on b.symbol = c.symbol
left join technical_module_2y t on t.symbol = c.symbol
left join report_sentiment s on s.symbol = c.symbol
where bar_count is not null or f.company_name is not null""",
    "report_sectors": """
select symbol, sector_macro_score, available_sector_weight, macro_confidence_score from (
  select q.symbol, {score} as sector_macro_score, {weight} as available_sector_weight,
    confidence_score as macro_confidence_score
  from (select x.symbol, x.market_code, {weights} from report_rows x
    left join sector_weight_rows s on s.sector = x.sector) q
  join market_combined m on m.market_code = q.market_code)""".format(
        score=r(
            "coalesce(("
            + " + ".join(
                f"case when {n}_available then {n}_normalized * w_{n} else 0 end"
                for n in ("inflation", "gdp_growth", "unemployment", "monetary_environment")
            )
            + ") / nullif("
            + " + ".join(
                f"case when {n}_available then w_{n} else 0 end"
                for n in ("inflation", "gdp_growth", "unemployment", "monetary_environment")
            )
            + ", 0), 0)",
            3,
        ),
        weight=r(
            " + ".join(
                f"case when {n}_available then w_{n} else 0 end"
                for n in ("inflation", "gdp_growth", "unemployment", "monetary_environment")
            ),
            2,
        ),
        weights=", ".join(
            f"coalesce(w_{n}, 0.25::double) as w_{n}"
            for n in ("inflation", "gdp_growth", "unemployment", "monetary_environment")
        ),
    ),
    "report_modules": f"""
select * exclude (sentiment_score), {_fundamental()}, {_technical()}, {_sentiment()}, {_historical()},
  {_sector_macro()}
from report_rows join report_sectors using (symbol)""",
    "report_combined": f"""
select *, {classify("intelligence_score", "0.5", 0.2, 0.5, _CLASSES)} as classification
from (select *, coalesce({r(f"({_TOTAL}) / nullif({_WEIGHT}, 0)", 3)}, 0) as intelligence_score,
    {r(_WEIGHT, 2)} as coverage_ratio, {r(_CONFIDENCE, 2)} as confidence_score,
    {", ".join(f"case when {n}_available then {r(f'{n}_score * {w}', 3)} end as {n}_contribution"
               for n, w in _WEIGHTS.items())}
  from report_modules)""",
    "report_error_counts": """
select x.symbol, (bar_count is null)::bigint + (bar_count is not null and annualized_volatility is null)::bigint
  + (bar_count is not null and net_score is null)::bigint + (data_source is null)::bigint
  + (s.sector_macro_score is null)::bigint as error_count
from report_rows x left join report_sectors s on s.symbol = x.symbol""",
    "half_year_bars": f"""
select symbol, count(distinct cast(ts as date)) as n from trades
where ts >= timestamp '{AS_OF}' - interval 186 day and ts <= timestamp '{AS_OF}' group by symbol""",
}

QUERIES = {
    "score_technical": f"""
select symbol, {_technical()} from technical_module""",
    "score_historical": f"select symbol, {_historical()} from historical_module",
    "score_fundamental": f"select symbol, {_fundamental()} from fundamental_records",
    "score_sentiment": f"select symbol, {_sentiment()} from ({features('companies', 'labelled_news')})",
    "score_sector_macro": f"""
select symbol, {_sector_macro()} from (select *, confidence_score as macro_confidence_score from sector_scores)""",
    "intelligence_score": f"""
select symbol, company_name, sector, market_code, intelligence_score, classification, coverage_ratio,
  confidence_score, {", ".join(f"{n}_{c}" for n in _WEIGHTS for c in _PARTS)} from report_combined""",
    "intelligence_rank": """
select symbol, intelligence_score, classification, coverage_ratio from report_combined
order by intelligence_score desc, symbol limit 20""",
    "report_assemble": """
select symbol, company_name, data_source, annualized_volatility, maximum_drawdown, one_month_return,
  net_score, signal, profit_margin, forward_pe, article_count, sentiment_score, sector_macro_score,
  available_sector_weight from report_rows join report_sectors using (symbol)""",
    "report_chart_series": f"""
select symbol, 'module_scores' as chart, label, value from (
  {" union all ".join(f"select symbol, '{n}' as label, {n}_score as value from report_combined" for n in _WEIGHTS)})
union all
select symbol, 'returns', label, value from (
  {" union all ".join(f"select symbol, '{label}' as label, {c} as value from report_combined" for label, c in [
        ("1 Week", "one_week_return"), ("1 Month", "one_month_return"), ("3 Months", "three_month_return"),
        ("6 Months", "six_month_return"), ("1 Year", "one_year_return")])}) where value is not null
union all
select symbol, 'gauge', 'position', {r(f"({_clamp('intelligence_score')} + 1) / 2 * 100", 2)} from report_combined""",
    "report_modules": " union all ".join(
        f"select symbol, company_name, classification, error_count, '{n}' as module, {n}_score as score,"
        f" {n}_available as is_available, {n}_quality as quality_factor, cast({w} as double) as weight,"
        f" {n}_contribution as weighted_contribution from report_combined join report_error_counts using (symbol)"
        for n, w in _WEIGHTS.items()
    ),
    "intelligence_by_request": """
select t.c_custkey, t.search_text,
  case when d.symbol is not null then 'direct' when n.symbol is not null then 'resolved' else 'rejected' end as outcome,
  coalesce(d.symbol, n.symbol) as symbol, case when d.symbol is not null then d.intelligence_score
    else n.intelligence_score end as intelligence_score,
  coalesce(d.classification, n.classification) as classification,
  case when not valid then 'invalid search text' when d.symbol is null and n.symbol is null
    then 'no listed company found' end as reason
from typed_requests t left join request_symbols q on q.c_custkey = t.c_custkey
left join report_combined d on valid and d.symbol = t.typed
left join report_combined n on n.symbol = upper(q.by_name)""",
    "module_errors": """
select symbol, module, reason from (
  select x.symbol, unnest([{'module': 'market_data', 'reason': case when bar_count is null then 'no market data' end},
      {'module': 'historical', 'reason': case when bar_count is not null and annualized_volatility is null
        then 'too few returns' end},
      {'module': 'technical', 'reason': case when bar_count is not null and net_score is null
        then 'too few complete bars' end},
      {'module': 'fundamental', 'reason': case when data_source is null then 'no fundamental data' end},
      {'module': 'sector_macro', 'reason': case when s.sector_macro_score is null then 'no sector weights' end}],
      recursive := true)
  from report_rows x left join report_sectors s on s.symbol = x.symbol) where reason is not null""",
}

QUERIES["report_from_tables"] = QUERIES["report_assemble"]
