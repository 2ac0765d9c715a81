"""Readers of landed provider payloads. Schemas are explicit: nothing is inferred, and a payload that
does not parse yields nulls (then no rows), never a failed job."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickerloom.functions.numeric import finite, to_number

CHART_SCHEMA = """
chart struct<result: array<struct<
  meta: struct<regularMarketPrice: double, currency: string>,
  timestamp: array<bigint>,
  indicators: struct<quote: array<struct<
    open: array<double>, high: array<double>, low: array<double>,
    close: array<double>, volume: array<double>>>>>>>
"""
NEWS_SCHEMA = """
status string,
articles array<struct<
  title: string, description: string, content: string,
  source: struct<name: string>, publishedAt: string, url: string>>
"""
OBSERVATIONS_SCHEMA = "observations array<struct<date: string, value: string>>"
STATEMENTS_SCHEMA = """
timeseries struct<result: array<struct<
  metric: string,
  observations: array<struct<asOfDate: string, currencyCode: string, raw: string>>>>>
"""
TABLE_SCHEMA = """
Data struct<row: array<struct<
  rowText: string, columns: array<struct<key: string, value: string>>>>>
"""
WORLD_BANK_SCHEMA = "array<struct<date: string, value: double>>"


def whole_files(spark: SparkSession, path: str) -> DataFrame:
    """One row per landed file, whatever its format: ``file`` (name without folder) and ``content``.

    Files are split over tasks by size, so many small payloads share a task; each is parsed by the
    readers below.
    """
    return spark.read.text(path, wholetext=True).select(
        F.col("_metadata.file_name").alias("file"), F.col("value").alias("content")
    )


def json_lines(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """Landed files of one JSON record a line: (the records that parse, the rejected ones with file and reason).

    Files are read as they are, line by line and split by size; a damaged record never fails or shifts the others.
    """
    parsed = F.from_json("value", f"{schema}, damaged string", {"columnNameOfCorruptRecord": "damaged"})
    lines = spark.read.text(path).select(F.col("_metadata.file_name").alias("file"), F.col("value").alias("record"), parsed.alias("parsed"))
    rejected = lines.filter("parsed.damaged is not null").select("file", "record", F.lit("not valid JSON").alias("reason"))
    return lines.filter("parsed.damaged is null").select("parsed.*").drop("damaged"), rejected


def bars_from_chart_json(payloads: DataFrame, column: str) -> DataFrame:
    """Parallel arrays to bar rows with ``symbol, ts, seq``; a column whose array does not match the
    timestamps in length is null throughout. Epoch seconds become zone-free UTC timestamps."""
    fields = ["open", "high", "low", "close", "volume"]
    aligned = [f"if(size(quote.{f}) = size(result.timestamp), quote.{f}, null) as {f}_values" for f in fields]
    cells = ", ".join(f"get({f}_values, i) as {f}" for f in fields)
    stamp = "timestamp_ntz'1970-01-01' + make_dt_interval(0, 0, 0, cast(s as decimal(18,6)))"
    return (
        payloads.select("symbol", F.from_json(column, CHART_SCHEMA).alias("parsed"))
        .selectExpr("symbol", "get(parsed.chart.result, 0) as result")
        .selectExpr("symbol", "result", "get(result.indicators.quote, 0) as quote")
        .selectExpr("symbol", "result.timestamp as stamps", *aligned)
        .selectExpr(
            "symbol",
            f"posexplode(transform(stamps, (s, i) -> struct({stamp} as ts, {cells}))) as (seq, bar)",
        )
        .select("symbol", "seq", "bar.*")
    )


def chart_last_price(payloads: DataFrame, column: str) -> DataFrame:
    """Quoted market price, else the last close present, scanning quote blocks from the end."""
    parsed = payloads.select("symbol", F.from_json(column, CHART_SCHEMA).alias("parsed"))
    result = F.get(F.col("parsed.chart.result"), F.lit(0))
    closes = f"filter(flatten(transform(result.indicators.quote, q -> coalesce(q.close, array()))), c -> {finite('c')} is not null)"
    return parsed.select("symbol", result.alias("result")).selectExpr(
        "symbol",
        f"coalesce({finite('result.meta.regularMarketPrice')}, try_element_at({closes}, -1)) as last_price",
        "result.meta.currency as currency",
    )


def news_articles(payloads: DataFrame, column: str) -> DataFrame:
    """Article rows of the payloads whose status is ``ok``."""
    return (
        _parsed(payloads, column, NEWS_SCHEMA, ["symbol"])
        .filter("status = 'ok'")
        .select("symbol", F.inline("articles"))
        .withColumnRenamed("publishedAt", "published_at")
    )


OBSERVATIONS_PER_REQUEST = 24  # fixed value: how many a provider is asked for by default


def series_observations(payloads: DataFrame, column: str, limit: int | None = None) -> DataFrame:
    """Valid observations of each series, newest first; with a limit, those among its ``limit`` newest.

    A limit stands for the provider's page size and counts placeholders too; those, and values that are
    not numbers, drop out afterwards. All inside the row: no shuffle.
    """
    newest = F.sort_array("parsed.observations", asc=False)
    if limit is not None:
        newest = F.slice(newest, 1, limit)
    return (
        payloads.select("series_id", F.from_json(column, OBSERVATIONS_SCHEMA).alias("parsed"))
        .select("series_id", F.inline(newest))
        .transform(valid_observations)
    )


def valid_observations(rows: DataFrame) -> DataFrame:
    """Observations (series_id, date, value as text) whose value is a number."""
    return rows.selectExpr("series_id", "try_cast(date as date) as date", f"{to_number('value')} as value").filter("value is not null")


def _parsed(lines: DataFrame, column: str, schema: str, keep: list[str]) -> DataFrame:
    """Fields of each JSON payload as columns. Parsing sits in a generator, which filters on the fields
    do not pass: a payload is parsed once however many conditions follow."""
    return lines.select(*keep, F.inline(F.array(F.from_json(column, schema))))


def filtered_records(lines: DataFrame, column: str, schema: str, filters: dict[str, str]) -> DataFrame:
    """Landed JSON records whose fields equal the given filter values."""
    records = _parsed(lines, column, schema, [])
    for field, value in filters.items():
        records = records.filter(F.col(field) == value)
    return records


def statement_observations(payloads: DataFrame, column: str) -> DataFrame:
    """Long statement rows with the positions that decide the first reported currency."""
    return (
        payloads.select("symbol", F.from_json(column, STATEMENTS_SCHEMA).alias("parsed"))
        .select("symbol", F.posexplode("parsed.timeseries.result").alias("series_pos", "series"))
        .select(
            "symbol",
            "series_pos",
            F.col("series.metric").alias("metric"),
            F.posexplode("series.observations").alias("obs_pos", "obs"),
        )
        .selectExpr(
            "symbol",
            "series_pos",
            "metric",
            "obs_pos",
            "coalesce(obs.asOfDate, '') as as_of_date",
            "obs.currencyCode as currency",
            f"{to_number('obs.raw')} as raw",
        )
    )


def table_cells(payloads: DataFrame, column: str, wanted: dict[str, str]) -> DataFrame:
    """Cells of the first row each condition on ``row_text`` selects (name -> SQL condition), all in one
    pass over the payload; blanks, ``na`` and values that are not numbers drop out."""
    firsts = ", ".join(
        f"named_struct('indicator', '{name}', 'row', get(filter(parsed.Data.row, row ->"
        f" {condition.replace('row_text', 'row.rowText')}), 0))"
        for name, condition in wanted.items()
    )
    return (
        payloads.select("series_id", F.from_json(column, TABLE_SCHEMA).alias("parsed"))
        .selectExpr("series_id", f"inline(array({firsts}))")
        .selectExpr("series_id", "indicator", "inline(row.columns)")
        .filter("key is not null and value not in ('', 'na', 'NA')")
        .selectExpr("series_id", "indicator", "key", f"{to_number('value')} as value")
        .filter("value is not null")
    )
