"""Landed payloads built from the derived views, in the providers' shapes, for the extraction queries.

Arrays are collected only where a group is bounded: bars by the calendar, months of a series, articles
by the provider's page size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PAGE_KEYS = 300


def _key():
    return F.regexp_extract("symbol", "^S([0-9]+)", 1).cast("bigint")


def chart_payloads(bars: DataFrame) -> DataFrame:
    """Chart payload per symbol. Closes are missing every 11th day; some volume arrays are short."""
    row = F.struct(
        F.unix_date("date").cast("bigint").alias("day"),
        "open",
        "high",
        "low",
        F.when(F.dayofmonth("date") % 11 != 0, F.col("close")).alias("close"),
        "volume",
    )
    series = bars.groupBy("symbol").agg(F.array_sort(F.collect_list(row)).alias("rows"))
    volume = F.col("rows.volume")
    quote = F.struct(
        *[F.col(f"rows.{f}").alias(f) for f in ("open", "high", "low", "close")],
        F.when(_key() % 7 == 3, F.slice(volume, 1, F.size(volume) - 1)).otherwise(volume).alias("volume"),
    )
    result = F.struct(
        F.struct(
            F.when(_key() % 2 == 0, F.element_at(F.col("rows.high"), -1)).alias("regularMarketPrice"),
            F.when(_key() % 3 != 0, F.lit("USD")).alias("currency"),
        ).alias("meta"),
        F.transform("rows.day", lambda d: d * 86400).alias("timestamp"),
        F.struct(F.array(quote).alias("quote")).alias("indicators"),
    )
    chart = F.struct(F.struct(F.array(result).alias("result")).alias("chart"))
    return series.select("symbol", F.to_json(chart, {"ignoreNullFields": "false"}).alias("payload"))


def news_payloads(articles: DataFrame) -> DataFrame:
    """Result pages of at most ``PAGE_KEYS`` consecutive documents per symbol; every fifth page failed."""
    page = F.expr(f"doc_id div {PAGE_KEYS}")
    item = F.struct(
        "doc_id",
        F.struct(
            "title",
            "description",
            "content",
            "source",
            F.col("published_at").alias("publishedAt"),
            "url",
        ).alias("article"),
    )
    pages = articles.groupBy("symbol", page.alias("page")).agg(
        F.array_sort(F.collect_list(item), lambda a, b: (a["doc_id"] - b["doc_id"]).cast("int")).alias("items")
    )
    body = F.struct(
        F.when(F.col("page") % 5 == 4, F.lit("error")).otherwise(F.lit("ok")).alias("status"),
        F.col("items.article").alias("articles"),
    )
    return pages.select("symbol", F.to_json(body).alias("payload"))


def observation_payloads(series: DataFrame) -> DataFrame:
    """Observation lists per series, newest first, with placeholder and non-numeric values mixed in."""
    text = (
        F.when(F.month("date") == 3, F.lit("."))
        .when(F.month("date") == 7, F.lit("n/a"))
        .otherwise(F.col("value").cast("string"))
    )
    item = F.struct(F.date_format("date", "yyyy-MM-dd").alias("date"), text.alias("value"))
    return series.groupBy("series_id").agg(
        F.to_json(
            F.struct(F.sort_array(F.collect_list(item), asc=False).alias("observations"))
        ).alias("payload")
    )


def statement_payloads(statements: DataFrame) -> DataFrame:
    """Statement series per symbol; one metric also carries an infinite and an undated figure."""
    obs = F.struct(
        F.date_format("as_of_date", "yyyy-MM-dd").alias("asOfDate"),
        F.when(F.col("metric_pos") > 1, F.col("currency")).alias("currencyCode"),
        F.format_string("%.4f", "raw").alias("raw"),
    )
    per_metric = statements.groupBy("symbol", "metric_pos", "metric").agg(
        F.array_sort(F.collect_list(obs)).alias("observations")
    )
    extra = F.array(
        F.struct(
            F.lit(None).cast("string").alias("asOfDate"),
            F.lit(None).cast("string").alias("currencyCode"),
            F.lit("1.0000").alias("raw"),
        ),
        F.struct(
            F.lit("2000-12-31").alias("asOfDate"),
            F.lit("").alias("currencyCode"),
            F.lit("Infinity").alias("raw"),
        ),
    )
    series = F.struct(
        "metric_pos",
        "metric",
        F.when(F.col("metric_pos") == 0, F.concat(extra, "observations"))
        .otherwise(F.col("observations"))
        .alias("observations"),
    )
    per_symbol = per_metric.groupBy("symbol").agg(F.array_sort(F.collect_list(series)).alias("series"))
    result = F.transform(
        "series", lambda s: F.struct(s["metric"].alias("metric"), s["observations"].alias("observations"))
    )
    return per_symbol.select(
        "symbol", F.to_json(F.struct(F.struct(result.alias("result")).alias("timeseries"))).alias("payload")
    )


def table_payloads(series: DataFrame) -> DataFrame:
    """Wide tables (one row of cells per subject) per series, as a statistics office publishes them."""
    month_key = F.date_format("date", "yyyy MMM")
    quarter_key = F.concat(F.year("date"), F.lit(" "), F.quarter("date"), F.lit("Q"))
    text = F.when(F.month("date") == 5, F.lit("na")).otherwise(F.col("value").cast("string"))
    cells = series.withColumns({"q": F.trunc("date", "quarter")}).groupBy("series_id").agg(
        F.array_sort(F.collect_list(F.struct(month_key.alias("key"), text.alias("value")))).alias("months"),
        F.array_sort(
            F.collect_list(
                F.when(
                    F.month("date") % 3 == 1, F.struct(quarter_key.alias("key"), text.alias("value"))
                )
            )
        ).alias("quarters"),
    )
    none = F.expr("cast(array() as array<struct<key: string, value: string>>)")

    def row(name: str, columns):
        return F.struct(F.lit(name).alias("rowText"), columns.alias("columns"))

    rows = F.array(
        row("Food", none),
        row("All Items", F.col("months")),
        row("All Items", none),
        row("Total Unemployment Rate, (SA)", F.col("quarters")),
        row("GDP At Current Prices", none),
        row(" GDP In Chained (2015) Dollars ", F.col("quarters")),
    )
    return cells.select(
        "series_id", F.to_json(F.struct(F.struct(rows.alias("row")).alias("Data"))).alias("payload")
    )
