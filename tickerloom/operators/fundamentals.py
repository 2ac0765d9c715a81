"""Company fundamentals from three providers, normalized to one record per symbol."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickerloom.functions.numeric import (
    finite,
    first_metric,
    growth_pct,
    millions_to_units,
    named,
    non_empty,
    per_share_total,
    rounded,
    safe_ratio,
    to_number,
    to_percent,
)

RECORD = [
    "symbol",
    "company_name",
    "sector",
    "industry",
    "currency",
    "market_cap",
    "total_revenue",
    "trailing_pe",
    "forward_pe",
    "price_to_book",
    "profit_margin",
    "return_on_equity",
    "return_on_assets",
    "revenue_growth",
    "earnings_growth",
    "debt_to_equity",
    "free_cash_flow",
    "data_source",
    "is_fallback",
]
# Statement series, in reporting order.
STATEMENT_METRICS = [
    "annualTotalRevenue",
    "annualNetIncome",
    "annualStockholdersEquity",
    "annualTotalAssets",
    "annualTotalDebt",
    "annualFreeCashFlow",
    "annualDilutedAverageShares",
    "annualOrdinarySharesNumber",
]
# Record field -> alternative metric names of the metrics provider.
METRIC_NAMES = {
    "trailing_pe": ["peBasicExclExtraTTM", "peExclExtraTTM", "peTTM"],
    "price_to_book": ["pbQuarterly", "pbAnnual"],
    "profit_margin": ["netProfitMarginTTM", "netProfitMarginAnnual"],
    "return_on_equity": ["roeTTM", "roeRfy"],
    "return_on_assets": ["roaTTM", "roaRfy"],
    "revenue_growth": ["revenueGrowthTTMYoy", "revenueGrowthQuarterlyYoy"],
    "earnings_growth": ["epsGrowthTTMYoy", "epsGrowthQuarterlyYoy"],
    "debt_to_equity": ["totalDebt/totalEquityQuarterly", "totalDebt/totalEquityAnnual"],
}
RATED_FIELDS = ["revenue", "net_income", "equity", "assets", "debt", "cash_flow"]


def statement_series(observations: DataFrame, metric: str) -> DataFrame:
    """Finite values of one metric in date order; undated figures come first."""
    in_order = Window.partitionBy("symbol").orderBy("as_of_date", "series_pos", "obs_pos")
    return (
        observations.filter((F.col("metric") == metric) & F.col("raw").isNotNull())
        .withColumn("position", F.row_number().over(in_order))
        .select("symbol", "position", "as_of_date", "raw")
    )


def statement_currency(observations: DataFrame) -> DataFrame:
    """First non-empty currency in series order, then observation order."""
    return (
        observations.filter("currency <> ''")
        .groupBy("symbol")
        .agg(F.expr("min_by(currency, struct(series_pos, obs_pos)) as statement_currency"))
    )


def _by_recency(statements: DataFrame) -> DataFrame:
    """Statement rows with ``position`` 1 for the latest of each symbol and metric.

    Rows are spread by symbol alone, so the per-metric window here and the per-symbol aggregate that
    follows both run on that one exchange.
    """
    newest = Window.partitionBy("symbol", "metric").orderBy(F.col("as_of_date").desc())
    return (
        statements.filter(f"{finite('raw')} is not null")
        .repartition("symbol")
        .withColumn("position", F.row_number().over(newest))
    )


def latest_two_statements(statements: DataFrame) -> DataFrame:
    """Latest and previous value per symbol and metric."""
    return (
        _by_recency(statements)
        .groupBy("symbol", "metric")
        .agg(
            F.expr("max(case when position = 1 then raw end) as latest"),
            F.expr("max(case when position = 2 then raw end) as previous"),
        )
    )


def wide_statements(statements: DataFrame) -> DataFrame:
    """One row per symbol: latest (and previous) figures and the first reported currency, by one
    window and one aggregate on the same exchange."""

    def pick(metric: str, position: int = 1) -> str:
        return f"max(case when metric = '{metric}' and position = {position} then raw end)"

    revenue, income, equity, assets, debt, cash, diluted, ordinary = STATEMENT_METRICS
    figures = {
        "revenue": pick(revenue),
        "previous_revenue": pick(revenue, 2),
        "net_income": pick(income),
        "previous_net_income": pick(income, 2),
        "equity": pick(equity),
        "assets": pick(assets),
        "debt": pick(debt),
        "cash_flow": pick(cash),
        "shares": f"coalesce({pick(diluted)}, {pick(ordinary)})",
        "statement_currency": "min_by(currency, case when currency <> ''"
        " then struct(metric_pos, as_of_date) end)",
    }
    return _by_recency(statements).groupBy("symbol").agg(*[F.expr(t) for t in named(figures)])


def latest_rates(fx_rates: DataFrame) -> DataFrame:
    """Latest usable rate per currency pair (zero and null rates are not usable)."""
    return fx_rates.filter("rate <> 0").groupBy("base", "quote").agg(F.max_by("rate", "as_of").alias("rate"))


def fx_convert(rows: DataFrame, rates: DataFrame) -> DataFrame:
    """Adds ``exchange_rate`` and ``fx_error`` from ``statement_currency`` to ``trading_currency``.

    Equal or missing currencies convert at 1; otherwise the direct pair, else the inverse pair turned
    round. ``rates`` holds one row per pair of world currencies, a bounded table, so it is broadcast.
    """
    pair = ["statement_currency", "trading_currency"]
    direct = rates.toDF(*pair, "direct_rate")
    inverse = rates.toDF(*reversed(pair), "inverse_rate")
    same = (
        "coalesce(statement_currency, '') = '' or coalesce(trading_currency, '') = ''"
        " or statement_currency = trading_currency"
    )
    rate = f"case when {same} then 1D else coalesce(direct_rate, try_divide(1D, inverse_rate)) end"
    return (
        rows.join(F.broadcast(direct), pair, "left")
        .join(F.broadcast(inverse), pair, "left")
        .selectExpr("* except (direct_rate, inverse_rate)", f"{rate} as exchange_rate")
        .selectExpr("*", "exchange_rate is null as fx_error")
    )


def from_primary(quotes: DataFrame) -> DataFrame:
    """Primary provider: ratios become percentages; a row needs a company name."""
    return quotes.selectExpr(
        "symbol",
        f"coalesce({non_empty('long_name')}, {non_empty('short_name')}) as company_name",
        "sector",
        "industry",
        "currency",
        "market_cap",
        "total_revenue",
        *[f"{rounded(c, 2)} as {c}" for c in ("trailing_pe", "forward_pe", "price_to_book")],
        f"{to_percent('profit_margins')} as profit_margin",
        *[
            f"{to_percent(c)} as {c}"
            for c in ("return_on_equity", "return_on_assets", "revenue_growth", "earnings_growth")
        ],
        f"{rounded('debt_to_equity', 2)} as debt_to_equity",
        "free_cash_flow",
        "'primary' as data_source",
        "false as is_fallback",
    ).filter("company_name is not null")


def from_metrics(profiles: DataFrame) -> DataFrame:
    """Metrics provider: named metrics as text; needs a company name and at least one metric."""

    def per_share(name: str) -> str:
        return per_share_total("number", "shares_millions").replace(
            "number", to_number(f"try_element_at(metrics, '{name}')")
        )

    figures = {field: first_metric("metrics", names) for field, names in METRIC_NAMES.items()}
    return profiles.filter("name <> '' and size(metrics) > 0").selectExpr(
        "symbol",
        "name as company_name",
        "industry as sector",
        "industry",
        "currency",
        f"{millions_to_units('market_cap_millions')} as market_cap",
        f"{per_share('revenuePerShareTTM')} as total_revenue",
        "cast(null as double) as forward_pe",
        *named(figures),
        f"{per_share('freeCashFlowPerShareTTM')} as free_cash_flow",
        "'metrics' as data_source",
        "true as is_fallback",
    )


def from_statements(quotes: DataFrame, chart: DataFrame, wide: DataFrame, rates: DataFrame) -> DataFrame:
    """Direct provider: annual statements joined to the listing and chart metadata of the symbol.

    Monetary figures are converted to the trading currency; ratios use the statement currency. A
    symbol without a usable exchange rate, or without any rated statement figure, yields no record.
    """
    trading = (
        f"coalesce({non_empty('quote_currency')}, {non_empty('chart_currency')}, statement_currency)"
    )
    joined = quotes.join(chart, "symbol", "left").join(wide, "symbol")
    converted = fx_convert(joined.selectExpr("*", f"{trading} as trading_currency"), rates).filter(
        f"not fx_error and coalesce({', '.join(RATED_FIELDS)}) is not null"
    )

    def money(name: str) -> str:
        return rounded(f"{name} * exchange_rate", 2)

    computed_cap = rounded("coalesce(market_price, 0D) * coalesce(shares, 0D)", 2)
    priced = converted.selectExpr(
        "*",
        f"coalesce({rounded('market_cap', 2)}, nullif({computed_cap}, 0D)) as cap",
        f"{money('net_income')} as income_converted",
        f"{money('equity')} as equity_converted",
    )
    record = {
        "company_name": f"coalesce({non_empty('long_name')}, short_name)",
        "sector": f"coalesce({non_empty('sector')}, sector_display)",
        "industry": f"coalesce({non_empty('industry')}, industry_display)",
        "currency": "trading_currency",
        "market_cap": "cap",
        "total_revenue": money("revenue"),
        "trailing_pe": f"coalesce({rounded('trailing_pe', 2)}, {safe_ratio('cap', 'income_converted')})",
        "forward_pe": rounded("forward_pe", 2),
        "price_to_book": f"coalesce({rounded('price_to_book', 2)}, {safe_ratio('cap', 'equity_converted')})",
        "profit_margin": safe_ratio("net_income", "revenue", as_percentage=True),
        "return_on_equity": safe_ratio("net_income", "equity", as_percentage=True),
        "return_on_assets": safe_ratio("net_income", "assets", as_percentage=True),
        "revenue_growth": growth_pct("revenue", "previous_revenue"),
        "earnings_growth": growth_pct("net_income", "previous_net_income"),
        "debt_to_equity": safe_ratio("debt", "equity"),
        "free_cash_flow": money("cash_flow"),
        "data_source": "'statements'",
        "is_fallback": "true",
    }
    return priced.selectExpr("symbol", *named(record))


def with_fallback(*records: DataFrame) -> DataFrame:
    """First provider, in the order given, that has a record of the symbol.

    Each provider has one record of a symbol at most, so the records are joined by symbol and the first one
    present is taken whole: nothing is aggregated or sorted by priority.
    """
    joined = None
    for priority, record in enumerate(records):
        tagged = record.selectExpr("symbol", f"struct({', '.join(RECORD[1:])}) as record_{priority}")
        joined = tagged if joined is None else joined.join(tagged, "symbol", "full")
    first = ", ".join(f"record_{priority}" for priority in range(len(records)))
    return joined.selectExpr("symbol", f"inline(array(coalesce({first})))")
