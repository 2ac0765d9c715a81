"""Registered queries over statements, quotes and numeric coercion."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickerloom.functions import numeric as N
from tickerloom.operators import bars as B
from tickerloom.operators import fundamentals as FD
from tickerloom.sources import landed, payloads, views
from tickerloom.sources.tables import table


def _observations(spark: SparkSession, sf: str) -> DataFrame:
    landing = payloads.statement_payloads(views.statements(spark, sf))
    return landed.statement_observations(landing, "payload")


def statement_series(spark, sf):
    series = FD.statement_series(_observations(spark, sf), "annualTotalRevenue")
    return series.selectExpr("symbol", "bigint(position) as position", "as_of_date", f"{N.rounded('raw', 2)} as raw")


def statement_currency(spark, sf):
    return FD.statement_currency(_observations(spark, sf))


def chart_last_price(spark, sf):
    landing = payloads.chart_payloads(views.daily_bars(views.trades(spark, sf)))
    return landed.chart_last_price(landing, "payload")


def latest_two_statements(spark, sf):
    two = FD.latest_two_statements(views.statements(spark, sf))
    return two.selectExpr(
        "symbol", "metric", *[f"{N.rounded(c, 2)} as {c}" for c in ("latest", "previous")]
    )


def fx_convert(spark, sf):
    """Latest revenue in the currency each company trades in."""
    statements = views.statements(spark, sf)
    # one aggregate for both: the latest revenue, and the currency of the first figure in metric order, then by date
    is_revenue = "metric = 'annualTotalRevenue'"
    reported = statements.groupBy("symbol").agg(
        F.expr(f"max_by(if({is_revenue}, raw, null), if({is_revenue}, as_of_date, null)) as raw"),
        F.expr(f"count_if({is_revenue}) as revenues"),
        F.expr("min_by(currency, if(currency <> '', bigint(metric_pos) * 1000000 + unix_date(as_of_date), null)) as statement_currency"),
    )
    key = views.KEY_OF_SYMBOL
    currency = f"case when {key} % 6 = 0 then 'USD' else {views.trading_currency(key)} end"
    rows = reported.filter("revenues > 0 and statement_currency is not null").drop("revenues").selectExpr("*", f"{currency} as trading_currency")
    converted = FD.fx_convert(rows, FD.latest_rates(views.fx_rates(spark)))
    return converted.selectExpr(
        "symbol",
        "statement_currency",
        "trading_currency",
        f"{N.rounded('exchange_rate', 6)} as exchange_rate",
        "fx_error",
        f"{N.rounded('raw * exchange_rate', 2)} as revenue",
    )


def direct_records(spark: SparkSession, sf: str, daily: DataFrame | None = None) -> DataFrame:
    """``daily``: daily bars already at hand, else built from the trades of the last month."""
    if daily is None:
        recent = views.daily_bars(B.bars_period(views.trades(spark, sf), "1mo", views.AS_OF))
    else:
        recent = B.bars_period(daily, "1mo", views.AS_OF, "date")
    return FD.from_statements(
        views.listing_quotes(spark, sf),
        views.chart_meta(recent),
        FD.wide_statements(views.statements(spark, sf)),
        FD.latest_rates(views.fx_rates(spark)),
    )


def fundamental_records(spark: SparkSession, sf: str, daily: DataFrame | None = None) -> DataFrame:
    return FD.with_fallback(
        FD.from_primary(views.primary_quotes(spark, sf)),
        FD.from_metrics(views.metric_profiles(spark, sf)),
        direct_records(spark, sf, daily),
    )


def first_metric(spark, sf):
    figures = [f"{N.first_metric('metrics', names)} as {f}" for f, names in FD.METRIC_NAMES.items()]
    return views.metric_profiles(spark, sf).selectExpr("symbol", *figures)


EVENT_TEXT = """
case event_id % 9 when 0 then 'abc' when 1 then 'NaN' when 2 then 'Infinity' when 3 then ''
  when 4 then concat('  ', v, ' ') when 5 then '1e3' when 6 then concat('-', v) when 7 then concat(v, 'd')
  else v end as text
"""


def numeric_coerce(spark, sf):
    return (
        table(spark, sf, "events")
        .selectExpr("event_id", "cast(cast(value as decimal(18,2)) as string) as v")
        .selectExpr("event_id", EVENT_TEXT)
        .selectExpr("event_id", f"{N.to_number('text')} as number")
        .selectExpr(
            "event_id",
            "number",
            f"{N.rounded('number', 2)} as number_2dp",
            f"{N.to_percent('number')} as percent",
            f"{N.millions_to_units('number')} as units",
        )
    )


def safe_ratio(spark, sf):
    base = "double(event_id % 7 - 3)"
    return table(spark, sf, "events").selectExpr(
        "event_id",
        f"{N.safe_ratio('value', base)} as ratio",
        f"{N.safe_ratio('value', base, as_percentage=True)} as ratio_pct",
    )


def growth_pct(spark, sf):
    previous = "((event_id % 11 - 3) * 1.5D)"
    return table(spark, sf, "events").selectExpr(
        "event_id", f"{N.growth_pct('value', previous)} as growth_pct"
    )


def per_share_total(spark, sf):
    shares = "(case when user_id % 10 <> 0 then double(user_id % 100) end)"
    return table(spark, sf, "events").selectExpr(
        "event_id", f"{N.per_share_total('value', shares)} as total"
    )


def clamp(spark, sf):
    value = "(case when event_id % 13 <> 0 then (value - 20) / 16 end)"
    return table(spark, sf, "events").selectExpr("event_id", f"{N.clamp(value)} as clamped")


QUERIES = {
    "statement_series": statement_series,
    "statement_currency": statement_currency,
    "chart_last_price": chart_last_price,
    "latest_two_statements": latest_two_statements,
    "fx_convert": fx_convert,
    "fundamental_from_statements": direct_records,
    "fundamental_with_fallback": fundamental_records,
    "first_metric": first_metric,
    "numeric_coerce": numeric_coerce,
    "safe_ratio": safe_ratio,
    "growth_pct": growth_pct,
    "per_share_total": per_share_total,
    "clamp": clamp,
}
