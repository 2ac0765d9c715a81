"""Market-shaped views derived from the driver tables.

Suppliers play listed companies, line items their trades, orders the statistical publications and
documents the news. Keys map to symbols by arithmetic alone, so no raw row is ever joined just to
learn its symbol, and money is summed in whole cents, so sums do not depend on the order of rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tickerloom.functions.literals import literal_table
from tickerloom.functions.markets import SECTOR_WEIGHTS
from tickerloom.functions.numeric import rounded
from tickerloom.operators import observations as O
from tickerloom.operators.bars import bars_from_trades
from tickerloom.operators.fundamentals import STATEMENT_METRICS
from tickerloom.operators.pages import TABLE_CAPTIONS
from tickerloom.sources.tables import table

BRANDS = ["eriner", "attion", "thanea", "thanedble", "anea", "thon", "edthe"]
LEGAL_FORMS = [
    "Holdings Limited",
    "Steel and Power Co",
    "Consultancy Services Ltd",
    "Group plc",
    "Bank of the North",
]
SECTORS = [*(sector for sector, *_ in SECTOR_WEIGHTS), "Conglomerates"]
AS_OF = "2001-11-05"


def period_begin(as_of: str, unit: str) -> Column:
    """First moment of the year, quarter or month that ``as_of`` lies in: what came before it is complete."""
    return F.date_trunc(unit, F.lit(as_of).cast("date")).cast("timestamp_ntz")


def _pick(options: list[str], index: str) -> str:
    listed = ", ".join(f"'{o}'" for o in options)
    return f"element_at(array({listed}), int({index} + 1))"


def cents(amount: str) -> str:
    return f"cast(round({amount} * 100) as bigint)"


def symbol_of(key: str) -> str:
    return (
        f"concat('S', lpad(string({key}), greatest(10, length(string({key}))), '0'), case when {key} % 10 = 6 then '.BO'"
        f" when {key} % 5 = 1 then '.NS' when {key} % 5 = 2 then '.SI' when {key} % 5 = 3 then '.AX'"
        " else '' end)"
    )


def _by_suffix(key: str, india: str, singapore: str, australia: str, other: str) -> str:
    return (
        f"(case when {key} % 5 = 1 then '{india}' when {key} % 5 = 2 then '{singapore}'"
        f" when {key} % 5 = 3 then '{australia}' else '{other}' end)"
    )


def market_of(key: str) -> str:
    return _by_suffix(key, "IN", "SG", "AU", "US")


def trading_currency(key: str) -> str:
    return _by_suffix(key, "INR", "SGD", "AUD", "USD")


KEY_OF_SYMBOL = "bigint(regexp_extract(symbol, '^S([0-9]+)', 1))"


# ---- companies and prices ---------------------------------------------------------------------


def companies(spark: SparkSession, sf: str) -> DataFrame:
    k = "company_key"
    return (
        table(spark, sf, "supplier")
        .selectExpr(
            f"s_suppkey as {k}",
            f"initcap({_pick(BRANDS, 's_suppkey % 7')}) as company_name",
            f"{cents('s_acctbal')} as acctbal_cents",
        )
        .selectExpr(
            k,
            f"{symbol_of(k)} as symbol",
            "company_name",
            f"concat(company_name, ' ', {_pick(LEGAL_FORMS, f'{k} % 5')}) as legal_name",
            f"{_pick(SECTORS, f'{k} % 12')} as sector",
            "acctbal_cents",
        )
    )


def trades(spark: SparkSession, sf: str) -> DataFrame:
    """One row per trade. ``seq`` is the arrival order; equal ``seq`` implies an equal price."""
    price_cents = (
        "200000L + ((l_suppkey div 5) % 5 - 2) * 25 * datediff(l_shipdate, date'1995-01-01')"
        f" + {cents('l_extendedprice')} div (300 * (1 + l_suppkey % 4))"
    )
    return (
        table(spark, sf, "lineitem")
        .selectExpr("*", f"{price_cents} as price_cents")
        .selectExpr(
            "l_suppkey as company_key",
            f"{symbol_of('l_suppkey')} as symbol",
            "l_shipdate as ts",
            "price_cents / 100 as price",
            "l_quantity as quantity",
            "(l_orderkey * 8 + l_linenumber) * 1048576 + price_cents as seq",
            "l_linenumber as line",
        )
    )


def daily_bars(trade_rows: DataFrame) -> DataFrame:
    """Daily bars by symbol, aggregated by the numeric key: the symbol is spelled out per bar only."""
    return bars_from_trades(trade_rows, "company_key").selectExpr(
        f"{symbol_of('company_key')} as symbol", "* except (company_key)"
    )


def raw_bars(spark: SparkSession, sf: str) -> DataFrame:
    """Landed bar rows with repeated timestamps and missing closes."""
    return trades(spark, sf).selectExpr(
        "symbol", "ts", "seq", "price as open", "price + 1 as high", "price - 1 as low",
        "case when line < 6 then price end as close", "quantity as volume",
    )


# ---- fundamentals -----------------------------------------------------------------------------

# Base, quote, date, rate: one pair exists only in inverse form, one only with unusable rates.
FX_RATES = [
    ("USD", "INR", "2001-10-01", 47.5),
    ("USD", "INR", "2001-11-01", 48.25),
    ("USD", "AUD", "2001-11-01", 0.0),
    ("AUD", "USD", "2001-11-01", 0.51),
    ("USD", "SGD", "2001-11-01", 0.0),
]


def fx_rates(spark: SparkSession) -> DataFrame:
    return literal_table(spark, FX_RATES, "base string, quote string, as_of date, rate double")


def statements(spark: SparkSession, sf: str, as_of: str = AS_OF) -> DataFrame:
    """Annual statement figures in long form, of the fiscal years closed by ``as_of``."""
    sums = {
        "revenue": "sum(p * (100 - d))",
        "income": "sum(p * (500 * (company_key % 6 - 1) + 250 - 50 * d))",
        "assets": "sum(p)",
        "debt": "sum(p * t)",
        "cash": "sum(p * (10 * t - 8 * d))",
        "shares": "sum(l_quantity)",
    }
    yearly = (
        table(spark, sf, "lineitem")
        .filter(F.col("l_shipdate") < period_begin(as_of, "year"))
        .selectExpr(
            "l_suppkey as company_key",
            "year(l_shipdate) as fiscal_year",
            f"{cents('l_extendedprice')} as p",
            f"{cents('l_discount')} as d",
            f"{cents('l_tax')} as t",
            "l_quantity",
        )
        .groupBy("company_key", "fiscal_year")
        .agg(*[F.expr(f"{text} as {name}") for name, text in sums.items()])
    )
    equity = table(spark, sf, "supplier").selectExpr(
        "s_suppkey as company_key", f"double(2 * {cents('s_acctbal')}) as equity"
    )
    values = [
        "revenue / 10000",
        "income / 1000000",
        "case when company_key % 13 <> 0 then equity end",
        "assets / 100",
        "debt * 6 / 10000",
        "case when company_key % 17 <> 0 then cash / 100000 end",
        "case when company_key % 3 <> 0 then shares end",
        "shares + 1",
    ]
    stacked = ", ".join(f"{i}, '{name}', {value}" for i, (name, value) in enumerate(zip(STATEMENT_METRICS, values)))
    currency = f"case when company_key % 4 = 0 then 'USD' else {trading_currency('company_key')} end"
    return (
        yearly.join(equity, "company_key")
        .selectExpr(
            "company_key", "fiscal_year", f"stack({len(values)}, {stacked}) as (metric_pos, metric, raw)"
        )
        .filter("raw is not null")
        .selectExpr(
            f"{symbol_of('company_key')} as symbol",
            "metric_pos",
            "metric",
            "make_date(fiscal_year, 12, 31) as as_of_date",
            "raw",
            f"{currency} as currency",
        )
    )


def primary_quotes(spark: SparkSession, sf: str) -> DataFrame:
    """Primary provider records; missing for a third of the companies, unnamed for a few."""
    return (
        companies(spark, sf)
        .withColumnRenamed("company_key", "k")
        .filter("k % 3 <> 1")
        .selectExpr(
            "symbol",
            "case when k % 9 = 2 then '' else company_name end as long_name",
            "case when k % 18 = 2 then '' else company_name end as short_name",
            "sector",
            "concat(sector, ' - General') as industry",
            f"{trading_currency('k')} as currency",
            "double(acctbal_cents + 200000) as market_cap",
            "double((k + 1) * 12345) as total_revenue",
            "k % 40 + 0.125D as trailing_pe",
            "case when k % 11 <> 0 then double(k % 50 - 5) end as forward_pe",
            "(k % 9) / 4 as price_to_book",
            "(k % 30 - 8) / 100 as profit_margins",
            "(k % 28 - 4) / 100 as return_on_equity",
            "(k % 20 - 3) / 200 as return_on_assets",
            "(k % 36 - 15) / 100 as revenue_growth",
            "case when k % 10 <> 7 then (k % 44 - 20) / 100 end as earnings_growth",
            "double((k % 26) * 10) as debt_to_equity",
            "double((k % 7 - 2) * 1000000) as free_cash_flow",
        )
    )


def metric_profiles(spark: SparkSession, sf: str) -> DataFrame:
    """Metrics provider records: figures as text in a map, some not numeric, some maps empty."""

    def text(value: str) -> str:
        return f"string(cast({value} as decimal(12,2)))"

    metrics = {
        "revenuePerShareTTM": text("(k % 60) / 4"),
        "freeCashFlowPerShareTTM": text("(k % 15 - 4) / 8"),
        "peBasicExclExtraTTM": f"case when k % 4 = 0 then 'n/a' else {text('(k % 33) / 2')} end",
        "peTTM": text("(k % 21) / 5"),
        "pbAnnual": text("(k % 12) / 5"),
        "netProfitMarginTTM": text("(k % 40 - 12) / 2"),
        "roeRfy": text("(k % 34 - 9) / 2"),
        "roaTTM": text("(k % 10 - 2) / 4"),
        "revenueGrowthTTMYoy": text("(k % 50 - 22) / 2"),
        "epsGrowthQuarterlyYoy": text("(k % 62 - 30) / 2"),
        "totalDebt/totalEquityQuarterly": text("(k % 30) / 10"),
    }
    entries = ", ".join(f"'{name}', {value}" for name, value in metrics.items())
    return (
        companies(spark, sf)
        .withColumnRenamed("company_key", "k")
        .filter("k % 2 = 0")
        .selectExpr(
            "symbol",
            "case when k % 14 = 0 then '' else company_name end as name",
            "double(k % 90 + 10) as shares_millions",
            "sector as industry",
            f"{trading_currency('k')} as currency",
            "(acctbal_cents + 200000) / 1000 as market_cap_millions",
            f"case when k % 8 = 0 then cast(map() as map<string, string>) else map({entries}) end as metrics",
        )
    )


def listing_quotes(spark: SparkSession, sf: str) -> DataFrame:
    """Listing search records of the direct provider; missing for a fifth of the companies."""
    return (
        companies(spark, sf)
        .withColumnRenamed("company_key", "k")
        .filter("k % 5 <> 4")
        .selectExpr(
            "symbol",
            "case when k % 10 = 3 then '' else company_name end as long_name",
            "company_name as short_name",
            "case when k % 4 = 2 then '' else sector end as sector",
            "sector as sector_display",
            "cast(null as string) as industry",
            "concat(sector, ' - Other') as industry_display",
            f"case when k % 6 = 0 then '' else {trading_currency('k')} end as quote_currency",
            "case when k % 4 <> 1 then double(acctbal_cents + 300000) end as market_cap",
            "case when k % 3 <> 0 then k % 40 + 0.375D end as trailing_pe",
            "double(k % 50 - 5) as forward_pe",
            "case when k % 2 = 0 then (k % 9) / 8 end as price_to_book",
        )
    )


def chart_meta(bars: DataFrame) -> DataFrame:
    """Chart metadata per symbol: market price for every other company, USD unless unknown."""
    return (
        bars.groupBy("symbol")
        .agg(F.max_by("close", "date").alias("close"))
        .selectExpr(
            "symbol",
            f"case when {KEY_OF_SYMBOL} % 2 = 1 then close end as market_price",
            f"case when {KEY_OF_SYMBOL} % 3 <> 0 then 'USD' end as chart_currency",
        )
    )


# ---- macro series -----------------------------------------------------------------------------


def macro_obs(spark: SparkSession, sf: str, as_of: str = AS_OF) -> DataFrame:
    """Published observations per market: monthly CPI index, unemployment and rate, quarterly GDP.

    Months and quarters that are not over at ``as_of`` are not published. Quarterly growth rides on the
    quarter's first month, so one pass over the orders serves all four.
    """
    monthly = (
        table(spark, sf, "orders")
        .filter(F.col("o_orderdate") < period_begin(as_of, "month"))
        .selectExpr(
            f"{market_of('o_custkey')} as market_code",
            "trunc(date(o_orderdate), 'MM') as month",
            f"{cents('o_totalprice')} as price",
            "o_orderstatus as status",
        )
        .groupBy("market_code", "month")
        .agg(
            F.expr("sum(price) as price"),
            F.expr("count(*) as n"),
            F.expr("count_if(status = 'P') as n_p"),
            F.expr("count_if(status = 'F') as n_f"),
        )
    )
    quarter = Window.partitionBy("market_code", F.trunc("month", "quarter"))
    months = monthly.withColumns(
        {
            "quarter_price": F.sum("price").over(quarter),
            "quarter_n": F.sum("n").over(quarter),
            "quarter_month": F.min("month").over(quarter),
        }
    )
    cpi = "100 + 0.25D * months_between(month, date'1995-01-01') + price / n / 100 / 25000"
    gdp = (
        f"case when month = quarter_month and month < trunc(date'{as_of}', 'quarter')"
        " then 40 * (quarter_price / quarter_n / 100 / 250000 - 1) + 2.5D end"
    )
    published = (
        f"stack(4, month, 'cpi', {rounded(cpi, 4)}, month, 'unemployment', {rounded('12 * n_p / n', 4)},"
        f" month, 'policy_rate', {rounded('10 * n_f / n', 4)},"
        f" trunc(month, 'quarter'), 'gdp_growth', {rounded(gdp, 4)}) as (period_date, indicator, value)"
    )
    return months.selectExpr("market_code", published).filter("value is not null")


def customer_series(spark: SparkSession, sf: str) -> DataFrame:
    """A sparse monthly price index per customer: one published series each."""
    return (
        table(spark, sf, "orders")
        .selectExpr(
            "o_custkey as series_key",
            "trunc(date(o_orderdate), 'MM') as date",
            f"{cents('o_totalprice')} as price",
        )
        .groupBy("series_key", "date")
        .agg(F.expr("sum(price) as price"), F.expr("count(*) as n"))
        .selectExpr(
            "concat('C', series_key) as series_id",
            "series_key",
            "date",
            f"{rounded('price / n / 1000000', 4)} as value",
        )
    )


def agency_records(spark: SparkSession, sf: str) -> DataFrame:
    """Statistics-office records as JSON lines: one per order, publisher = customer, all values text."""
    fields = {
        "publisher": "concat('P', o_custkey)",
        "seq": "k",
        "dataset": "case when k % 3 = 0 then 'CPI' when k % 3 = 1 then 'PLFS' else 'NAS' end",
        "division": "case when o_orderpriority < '4' then 'CPI (General)' else 'CPI (Food)' end",
        "indicator": "case when k % 5 <> 0 then 'GDP Growth Rate' else 'GVA Growth Rate' end",
        "year": "case when k % 17 = 0 then 'n/a' else string(y) end",
        "month": "case when k % 19 = 0 then 'Smarch' else date_format(o_orderdate, 'MMMM') end",
        "fiscal_year": "case when k % 23 = 0 then string(y) else format_string('%d-%02d', y, (y + 1) % 100) end",
        "quarter": "case when k % 29 = 0 then 'Q5'"
        " else concat(case when k % 2 = 0 then 'q' else 'Q' end, quarter(o_orderdate)) end",
        "value": "case when k % 13 = 0 then 'na'"
        " else concat(price div 3000000, '.', lpad(string(price % 100), 2, '0')) end",
    }
    record = ", ".join(f"{value} as {name}" for name, value in fields.items())
    return (
        table(spark, sf, "orders")
        .selectExpr(
            "*", "o_orderkey as k", "year(o_orderdate) as y", f"{cents('o_totalprice')} as price"
        )
        .selectExpr(f"to_json(struct({record})) as line")
    )


AGENCY_RECORD_SCHEMA = (
    "publisher string, seq bigint, dataset string, division string, indicator string, year string,"
    " month string, fiscal_year string, quarter string, value string"
)


def annual_observations(spark: SparkSession, sf: str) -> DataFrame:
    """Annual fallback figures per country (customer), some years empty."""
    return (
        table(spark, sf, "orders")
        .selectExpr("o_custkey as c", "year(o_orderdate) as year", f"{cents('o_totalprice')} as price")
        .groupBy("c", "year")
        .agg(F.expr("sum(price) as price"))
        .selectExpr(
            "concat('K', c) as country_code",
            "'NY.GDP.MKTP.KD.ZG' as indicator",
            "year",
            "case when (c + year) % 4 <> 0 then price / 10000000 end as value",
        )
    )


def interpretation_rows(spark: SparkSession, sf: str) -> DataFrame:
    """A rate per order for interpretation, over all bands, with unknown markets and missing values."""
    price = cents("o_totalprice")
    return table(spark, sf, "orders").selectExpr(
        "o_orderkey as row_id",
        "case o_custkey % 6 when 0 then 'US' when 1 then 'IN' when 2 then 'SG' when 3 then 'AU'"
        " when 4 then ' us ' else 'BR' end as market_code",
        f"case when o_orderkey % 37 <> 0 then ({price} % 120) / 10 - 3 end as rate",
        f"case when o_orderkey % 31 <> 0 then (({price} div 120) % 100) / 10 - 2 end as inflation",
        "int(o_orderkey % 4 <> 0) as flag",
    )


_IS_POLICY_RATE = "case when market_code <> 'US' then market_code <> 'SG' end as is_policy_rate"


def stored_observations(spark: SparkSession, sf: str, as_of: str = AS_OF) -> DataFrame:
    """Good observations kept until the year of ``as_of`` (the price index stands for inflation, less 100)."""
    return (
        macro_obs(spark, sf, as_of)
        .filter(F.col("period_date") < period_begin(as_of, "year"))
        .filter("concat(market_code, ':', indicator) not in ('SG:unemployment', 'IN:gdp_growth')")
        .selectExpr(
            "market_code",
            "case when indicator = 'cpi' then 'inflation' else indicator end as indicator",
            f"case when indicator = 'cpi' then {rounded('(value - 100) / 10', 4)} else value end as value",
            "date_format(period_date, 'yyyy-MM-dd') as observation_date",
            "'official' as source",
            _IS_POLICY_RATE,
            "cast(period_date as timestamp_ntz) as cached_at",
        )
    )


def market_observations(spark: SparkSession, sf: str, as_of: str = AS_OF) -> DataFrame:
    """One row per market with its live, stored and fallback observations as arrays.

    Live: the latest value, some are out, and one US outage spoils all of US. Stored: as in
    :func:`stored_observations`, the latest of each. Fallback: the latest annual figure. All from one pass: a
    market's published points (bounded by the calendar) come together once, the rest is computed in the row.
    """
    points = (
        macro_obs(spark, sf, as_of)
        .groupBy("market_code")
        .agg(F.array_sort(F.collect_list(F.struct("indicator", "period_date", "value"))).alias("points"))
    )
    names = {"policy_rate": "policy_rate", "inflation": "cpi", "gdp_growth": "gdp_growth", "unemployment": "unemployment"}
    series = points.selectExpr(
        "market_code", *[f"filter(points, p -> p.indicator = '{source}') as {name}" for name, source in names.items()]
    )
    begin = f"trunc(date'{as_of}', 'YEAR')"
    for name in names:
        series = series.selectExpr(
            "*",
            f"try_element_at({name}, -1) as {name}_last",
            f"try_element_at(filter({name}, p -> p.period_date < {begin}), -1) as {name}_kept",
        )
    policy = _IS_POLICY_RATE.removesuffix(" as is_policy_rate")

    def item(name: str, value: str, date: str, source: str, is_policy_rate: str, when: str) -> str:
        return (
            f"if({when} and {value} is not null, struct('{name}' as indicator, {value} as value,"
            f" {date} as observation_date, '{source}' as source, {is_policy_rate} as is_policy_rate), null)"
        )

    def day(point: str) -> str:
        return f"date_format({point}.period_date, 'yyyy-MM-dd')"

    def allowed(name: str, *markets: str) -> str:
        return f"market_code not in ({', '.join(repr(m) for m in markets)})" if markets else "true"

    base = "get(filter(inflation, p -> p.period_date = add_months(inflation_last.period_date, -12)), 0).value"
    live_out = {"gdp_growth": ["US", "IN"], "unemployment": ["SG"], "inflation": ["AU"]}
    kept_out = {"unemployment": ["SG"], "gdp_growth": ["IN"]}
    live, kept, annual = [], [], []
    for name in names:
        last, stored = f"{name}_last", f"{name}_kept"
        change = f"if({base} <> 0, {rounded(f'({last}.value / {base} - 1) * 100', 2)}, null)"
        value = change if name == "inflation" else rounded(f"{last}.value", 4)
        live.append(item(name, value, day(last), "official", policy, allowed(name, *live_out.get(name, []))))
        value = rounded(f"({stored}.value - 100) / 10", 4) if name == "inflation" else f"{stored}.value"
        kept.append(item(name, value, day(stored), "official", policy, allowed(name, *kept_out.get(name, []))))
        if name != "inflation":
            same_year = f"filter({name}, p -> year(p.period_date) = year({last}.period_date))"
            value = rounded(f"array_max(transform({same_year}, p -> p.value))", 2)
            annual.append(item(name, value, f"string(year({last}.period_date))", "annual", "cast(null as boolean)", "true"))
    lists = (f"array_compact(array({', '.join(items)})) as {tier}" for tier, items in (("live", live), ("cached", kept), ("fallback", annual)))
    return series.selectExpr("market_code", *lists)


# ---- news -------------------------------------------------------------------------------------


def news(spark: SparkSession, sf: str) -> DataFrame:
    """English documents as provider articles; company 1 receives a third of all of them."""
    return (
        table(spark, sf, "documents")
        .filter("lang = 'en'")
        .selectExpr(
            "*",
            "case when doc_id % 3 = 0 then 1L else doc_id div 10 end as company_key",
            "split(text, '\\n') as lines",
        )
        .selectExpr(
            "doc_id",
            f"{symbol_of('company_key')} as symbol",
            "case when doc_id % 31 = 0 then ' \\n' when doc_id % 23 = 0"
            " then concat(lines[0], ' Stocks to Watch') else lines[0] end as title",
            "get(lines, 1) as description",
            "text as content",
            "struct(source as name) as source",
            "date_format(timestamp_ntz'2001-01-01' + make_dt_interval(0, int((doc_id * 37) % 5000)),"
            " \"yyyy-MM-dd'T'HH:mm:ss'Z'\") as published_at",
            "case when doc_id % 29 <> 0 then concat('https://n/', source, '/', doc_id % 7) else '' end as url",
        )
    )


def sentiment_labels(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "labels").selectExpr(
        "doc_id",
        "case when toxic = 1 then 'Negative' when quality = 1 then ' positive ' else 'mixed' end as sentiment",
    )


# ---- landed pages and files -------------------------------------------------------------------


def rate_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Web pages that also state a policy rate and a last-updated date (some lack or garble them)."""
    rate = (
        "case when page_id % 4 = 0 then string(page_id % 13)"
        " else concat(page_id % 13, '.', lpad(string((page_id * 7) % 100), 2, '0')) end"
    )
    date = "date_format(date_add(date'2026-01-01', int(page_id % 300)), 'MMM d, yyyy')"
    return table(spark, sf, "pages").selectExpr(
        "page_id",
        f"""concat(html, case when page_id % 6 = 0 then '<div>Policy Rate</div>'
          else concat('<div>Policy <b>Repo</b>\\n RATE&nbsp;: ', {rate}, ' %</div>') end,
          case when page_id % 7 = 0 then ''
            when page_id % 5 = 0 then '<p>Website last updated date : Foo 45, 2026</p>'
            else concat('<p>Website last updated <i>date</i> : ', {date}, '</p>') end) as html""",
    )


def table_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Web pages that also carry the captioned tables; some lack them or break off."""

    def tenths(value: str) -> str:
        return f"string(cast(({value}) / 10 as decimal(10,1)))"

    row = f"""concat('<TR>\\n<th scope="row" class="row-header">',
      date_format(add_months(date'2025-01-01', m), 'MMM-yy'), '</th><td class="x"><b>',
      case when (page_id + m) % 5 = 0 then '' when (page_id + m) % 9 = 4 then 'na'
        else {tenths("(page_id * 7 + m * 3) % 40 - 10")} end,
      '</b>&nbsp;</td><td>',
      case when (page_id + 2 * m) % 7 = 0 then ' &nbsp;'
        else {tenths("(page_id * 5 + m * 11) % 60 - 15")} end, '</td></TR>')"""
    tables = ", ".join(
        f"'<table><caption>{caption}</caption><tr><th>Month</th></tr>', rows, "
        + ("case when page_id % 8 = 1 then '' else '</table>' end" if name == "gdp_growth" else "'</table>'")
        for name, caption in TABLE_CAPTIONS.items()
    )
    return (
        table(spark, sf, "pages")
        .selectExpr("*", f"array_join(transform(sequence(0, 11), m -> {row}), '') as rows")
        .selectExpr(
            "page_id", f"concat(html, case when page_id % 8 = 0 then '' else concat({tables}) end) as html"
        )
    )


def sora_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Web pages that also carry a rate table whose year and month cells are filled sparsely."""
    day = "date_add(date'2025-11-20', int(i * 4 + page_id % 5))"
    before = "date_add(date'2025-11-20', int(i * 4 - 4 + page_id % 5))"
    row = f"""concat('<tr><td> ',
      case when (page_id + i) % 11 = 7 then 'xx'
        when i = 0 or year({day}) <> year({before}) then string(year({day})) else '' end,
      '</td><td> ',
      case when i = 0 or month({day}) <> month({before}) then date_format({day}, 'MMM') else '&nbsp;' end,
      '</td><td> ', day({day}), '</td><td> ',
      case when (page_id + i) % 13 = 5 then 'soon'
        else date_format(date_add({day}, 1), 'dd MMM yyyy') end, '</td>',
      case when i % 10 = 9 then '' else concat('<td>', case when (page_id + i) % 6 = 2 then ''
        else string(cast(((page_id * 3 + i * 7) % 400) / 100 as decimal(10,2))) end, '</td>') end, '</tr>')"""
    opening = (
        "case when page_id % 9 <> 0 then '<table id=\"ContentPlaceHolder1_soraHeader\">' else '<table>' end"
    )
    return table(spark, sf, "pages").selectExpr(
        "page_id",
        f"concat(html, {opening}, array_join(transform(sequence(0, 23), i -> {row}), '\\n'), '</table>') as html",
    )


def rate_files(spark: SparkSession, sf: str) -> DataFrame:
    """CSV files with a preamble, one per customer: a line per order date (bounded by the calendar)."""
    line = """concat(date_format(date, 'dd-MMM-yyyy'), ',', case when day(date) = 3 then ''
      when day(date) = 4 then 'n/a' else string(cast((price div 10000) / 100 as decimal(10,2))) end, ',x')"""
    files = (
        table(spark, sf, "orders")
        .selectExpr("o_custkey as c", "date(o_orderdate) as date", f"{cents('o_totalprice')} as price")
        .groupBy("c", "date")
        .agg(F.expr("max(price) as price"))
        .groupBy("c")
        .agg(F.expr(f"array_sort(collect_list(struct(date, {line} as line))) as lines"))
    )
    return files.selectExpr(
        "concat('F', c) as file",
        """concat('\\ufeffF1 INTEREST RATES\\r\\n,\\r\\nTitle,"Cash Rate, Target"\\r\\n',
          case when c % 5 = 0 then 'Publication date,soon\\r\\n' else 'Publication date,05-Nov-2001\\r\\n' end,
          case when c % 11 = 0 then '' when c % 7 = 0 then 'Series ID,FIRMOTHER\\r\\n'
            else 'Series ID,FIRMMCRTD\\r\\n' end, array_join(lines.line, '\\r\\n')) as content""",
    )
