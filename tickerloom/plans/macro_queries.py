"""Registered queries over macro series, records, pages, and their interpretation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickerloom.functions import bands, markets
from tickerloom.functions.literals import literal_table
from tickerloom.functions.text import html_cell_text as cell_text
from tickerloom.operators import macro as M
from tickerloom.operators.linked import settled
from tickerloom.operators import observations as O
from tickerloom.operators import pages as P
from tickerloom.operators import sector as S
from tickerloom.session import shared_folder
from tickerloom.sources import landed, payloads, store, views
from tickerloom.sources.tables import table
from tickerloom.streaming import feeds


# ---- published series and records -------------------------------------------------------------


def _series(spark: SparkSession, sf: str, limit: int | None = None) -> DataFrame:
    landing = payloads.observation_payloads(views.customer_series(spark, sf))
    return landed.series_observations(landing, "payload", limit)


def fred_observations(spark, sf):
    return _series(spark, sf, landed.OBSERVATIONS_PER_REQUEST).withColumn("date", F.date_format("date", "yyyy-MM-dd"))


def fred_latest(spark, sf):
    """Newest value of the four US series, described by the series dimension."""
    ids = " ".join(f"when '{indicator}' then '{sid}'" for sid, indicator, *_ in markets.US_SERIES)
    us = (
        views.macro_obs(spark, sf)
        .filter(F.col("market_code") == "US")
        .selectExpr(f"case indicator {ids} end as series_id", "period_date as date", "value")
    )
    observations = landed.series_observations(payloads.observation_payloads(us), "payload")
    return O.series_latest(observations).join(F.broadcast(markets.us_series(spark)), "series_id")


def inflation_yoy(spark, sf):
    return O.inflation_yoy(_series(spark, sf))


def world_bank_latest(spark, sf):
    return O.annual_latest(views.annual_observations(spark, sf))


def _records(spark: SparkSession, sf: str, dataset: str) -> DataFrame:
    return landed.filtered_records(
        views.agency_records(spark, sf), "line", views.AGENCY_RECORD_SCHEMA, {"dataset": dataset}
    )


def mospi_records(spark, sf):
    return landed.filtered_records(
        views.agency_records(spark, sf),
        "line",
        views.AGENCY_RECORD_SCHEMA,
        {"dataset": "CPI", "division": "CPI (General)"},
    )


def mospi_cpi_latest(spark, sf):
    return O.general_price_latest(_records(spark, sf, "CPI"))


def mospi_plfs_latest(spark, sf):
    return O.unemployment_latest(_records(spark, sf, "PLFS"))


def mospi_gdp_latest(spark, sf):
    return O.fiscal_gdp_latest(_records(spark, sf, "NAS"))


# Which row of a statistics table holds an indicator.
TABLE_ROWS = {
    "inflation": "row_text = 'All Items'",
    "unemployment": "row_text = 'Total Unemployment Rate, (SA)'",
    "gdp_growth": "contains(lower(row_text), 'gdp') and contains(lower(row_text), 'chained')",
}


def singstat_unpivot(spark, sf):
    landing = payloads.table_payloads(views.customer_series(spark, sf))
    return O.table_cells_latest(landed.table_cells(landing, "payload", TABLE_ROWS))


def latest_by_key(spark, sf):
    """Latest observation per market and indicator by compound (year, month) key."""
    obs = views.macro_obs(spark, sf).withColumn(
        "period", F.year("period_date") * 12 + F.month("period_date") - 1
    )
    latest = O.latest_by_key(obs, ["market_code", "indicator"], ["value"], "period")
    return latest.withColumn("period", F.col("period").cast("bigint"))


# ---- pages and files --------------------------------------------------------------------------


def html_cell_text(spark, sf):
    return table(spark, sf, "pages").select("page_id", cell_text(F.col("html")).alias("cell_text"))


def page_rate_extract(spark, sf):
    return P.page_rate_extract(views.rate_pages(spark, sf))


def page_table_extract(spark, sf):
    return P.page_table_extract(views.table_pages(spark, sf))


def sora_table_extract(spark, sf):
    return P.sora_table_extract(views.sora_pages(spark, sf))


def forward_fill(spark, sf):
    return P.rate_table_rows(views.sora_pages(spark, sf)).select(
        "page_id", F.col("position").cast("bigint").alias("position"), "year", "month", "day"
    )


def rba_csv_extract(spark, sf):
    return P.rba_csv_extract(views.rate_files(spark, sf))


# ---- store ------------------------------------------------------------------------------------


def good_obs_store(spark, sf):
    """Append to the store in the shared folder, then read it back."""
    path = shared_folder(spark, "good-observations")
    store.save_good_observations(views.stored_observations(spark, sf), path)
    stored = store.read_store(spark, path)
    return stored.select("market_code", "indicator", "value", "observation_date", "source")


def good_obs_latest(spark, sf):
    latest = store.good_obs_latest(views.stored_observations(spark, sf))
    return latest.select("market_code", "indicator", "value", "observation_date", "is_cached")


def good_obs_stream(spark, sf):
    """The same from a stream of fetches, one per market and time, in several micro-batches."""
    path = shared_folder(spark, "fetches")
    row = F.struct("indicator", "value", "observation_date", "source", "is_policy_rate")
    fetches = views.stored_observations(spark, sf).groupBy("market_code", "cached_at").agg(F.collect_list(row).alias("observations"))
    fetches.repartition(3, "cached_at").write.parquet(f"{path}/landed")
    schema = f"market_code string, cached_at timestamp_ntz, observations {feeds.FETCHED}"
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/landed")
    feeds.keep_latest_good(stream, f"{path}/store", f"{path}/state").awaitTermination()
    latest = store.good_obs_latest(store.read_store(spark, f"{path}/store"))
    return latest.select("market_code", "indicator", "value", "observation_date", "is_cached")


# ---- interpretation ---------------------------------------------------------------------------


def _rows(spark: SparkSession, sf: str, **columns: str) -> DataFrame:
    rows = views.interpretation_rows(spark, sf)
    return rows.withColumnsRenamed({source: name for name, source in columns.items()})


def interpret_inflation(spark, sf):
    rows = _rows(spark, sf, inflation_rate="rate").drop("inflation", "flag")
    return M.interpret_inflation(rows)


def interpret_gdp_growth(spark, sf):
    rows = _rows(spark, sf, gdp_growth_rate="rate", gdp_is_fallback="flag").drop("inflation")
    return M.interpret_gdp_growth(rows)


def interpret_unemployment(spark, sf):
    rows = _rows(spark, sf, unemployment_rate="rate").drop("inflation", "flag")
    return M.interpret_unemployment(rows)


def interpret_monetary_rate(spark, sf):
    rows = _rows(
        spark, sf, monetary_rate="rate", inflation_rate="inflation", monetary_rate_is_policy_rate="flag"
    )
    return M.interpret_monetary_rate(rows)


def threshold_classify(spark, sf):
    """Bands by (market, indicator) for a rate per order; the indicator rotates."""
    indicator = "element_at(array('inflation', 'gdp_growth', 'unemployment'), int(row_id % 3 + 1))"
    rows = views.interpretation_rows(spark, sf).selectExpr(
        "row_id", "market_code", "rate", f"{indicator} as indicator"
    )
    return M.threshold_classify(rows, "market_code", "indicator", "rate", "band")


def threshold_classify_table(spark, sf):
    """The same bands, read from a table."""
    bands_table = settled(literal_table(spark, bands.band_rows(), bands.BAND_TABLE), "bands")
    indicator = "element_at(array('inflation', 'gdp_growth', 'unemployment'), int(row_id % 3 + 1)) as indicator"
    rows = views.interpretation_rows(spark, sf).selectExpr("row_id", "market_code", "rate", indicator)
    return M.threshold_classify_table(rows, bands_table, "market_code", "indicator", "rate", "band")


def landed_series(spark, sf):
    """Observations of the series files that parse: payloads written as lines of files, read back and parsed."""
    good, _ = landed.json_lines(spark, landed_series_files(spark, sf), f"series_id string, {landed.OBSERVATIONS_SCHEMA}")
    rows = landed.valid_observations(good.select("series_id", F.inline("observations")))
    return rows.withColumn("date", F.date_format("date", "yyyy-MM-dd"))


def landed_rejects(spark, sf):
    """The records of those files that do not parse, each with a reason."""
    _, rejected = landed.json_lines(spark, landed_series_files(spark, sf), f"series_id string, {landed.OBSERVATIONS_SCHEMA}")
    series = F.regexp_extract("record", '"series_id":"([^"]*)"', 1).alias("series_id")
    return rejected.select(series, "reason", F.col("file").isNotNull().alias("has_file"))


def landed_series_files(spark: SparkSession, sf: str) -> str:
    """A folder of files with one payload a line; of every 97th series the line breaks off."""
    lines = payloads.observation_payloads(views.customer_series(spark, sf)).selectExpr(
        "series_id", """concat('{"series_id":"', series_id, '",', substr(payload, 2)) as line"""
    )
    broken = F.expr("if(bigint(substr(series_id, 2)) % 97 = 5, left(line, length(line) - 9), line)")
    path = shared_folder(spark, "landed-series")
    lines.select(broken.alias("value")).write.text(path)
    return path


def component_normalize(spark, sf):
    scores = table(spark, sf, "events").selectExpr("event_id", "int(event_id % 7 - 3) as score")
    return scores.selectExpr("*", f"{bands.normalized_component('score')} as normalized")


def _classified(spark: SparkSession, sf: str, classes: list[tuple]) -> DataFrame:
    score = "round((event_id % 241 - 120) / 100, 2) as score"
    return (
        table(spark, sf, "events")
        .selectExpr("event_id", score)
        .selectExpr("*", f"{bands.classified('score', classes)} as classification")
    )


def classify_macro(spark, sf):
    return _classified(spark, sf, bands.MACRO_CLASSES)


def classify_sector(spark, sf):
    return _classified(spark, sf, bands.MACRO_CLASSES)


def classify_intelligence(spark, sf):
    return _classified(spark, sf, bands.INTELLIGENCE_CLASSES)


# ---- per market and symbol --------------------------------------------------------------------


def observations(spark: SparkSession, sf: str) -> DataFrame:
    return M.prioritised(views.market_observations(spark, sf))


def features(spark: SparkSession, sf: str) -> DataFrame:
    return M.market_features(markets.markets(spark), observations(spark, sf))


def macro_snapshot(spark, sf):
    return M.macro_snapshot(
        views.companies(spark, sf), markets.markets(spark), observations(spark, sf)
    )


def macro_features(spark, sf):
    return M.by_market(views.companies(spark, sf).select("symbol"), features(spark, sf))


MACRO_COLUMNS = [
    "market_code",
    "country",
    "combined_macro_score",
    "classification",
    "coverage_ratio",
    "confidence_score",
    *[f"{n}_{c}" for n in M.COMPONENTS for c in ("status", "score", "available", "normalized", "contribution")],
]


def macro_combined(spark, sf):
    combined = M.macro_combined(features(spark, sf)).select(*MACRO_COLUMNS)
    return M.by_market(views.companies(spark, sf).select("symbol"), combined)


def sector_weight_join(spark, sf):
    joined = S.sector_weight_join(views.companies(spark, sf).select("symbol", "sector"))
    return joined


def sector_macro(spark, sf):
    combined = M.macro_combined(features(spark, sf))
    companies = views.companies(spark, sf).select("symbol", "sector")
    return S.sector_macro(M.by_market(companies, combined)).select(
        "symbol",
        "sector",
        "market_code",
        F.col("combined_macro_score").alias("general_macro_score"),
        "sector_macro_score",
        F.col("sector_classification").alias("classification"),
        "available_sector_weight",
        "used_default_weights",
        F.col("confidence_score").alias("macro_confidence_score"),
        *[f"sector_{n}_contribution" for n in M.COMPONENTS],
    )


def symbol_market_config(spark, sf):
    """Country, currency, series symbols per group and publishers of each symbol's market."""
    series = markets.market_series(spark)
    grouped = series.groupBy("market_code").agg(
        *[
            F.array_join(
                F.array_sort(F.collect_list(F.when(F.col("series_group") == g, F.col("series_symbol")))), ","
            ).alias(g)
            for g in ("indices", "currencies", "volatility", "bond_yield", "commodities")
        ]
    )
    config = (
        markets.markets(spark)
        .join(grouped, "market_code")
        .join(markets.macro_publishers(spark), "market_code")
    )
    return M.by_market(views.companies(spark, sf).select("symbol"), config)


QUERIES = {
    f.__name__: f
    for f in (
        fred_observations,
        fred_latest,
        inflation_yoy,
        world_bank_latest,
        mospi_records,
        mospi_cpi_latest,
        mospi_plfs_latest,
        mospi_gdp_latest,
        singstat_unpivot,
        latest_by_key,
        html_cell_text,
        page_rate_extract,
        page_table_extract,
        sora_table_extract,
        forward_fill,
        rba_csv_extract,
        good_obs_store,
        good_obs_latest,
        good_obs_stream,
        interpret_inflation,
        interpret_gdp_growth,
        interpret_unemployment,
        interpret_monetary_rate,
        threshold_classify,
        threshold_classify_table,
        landed_series,
        landed_rejects,
        component_normalize,
        classify_macro,
        classify_sector,
        classify_intelligence,
        macro_snapshot,
        macro_features,
        macro_combined,
        sector_weight_join,
        sector_macro,
        symbol_market_config,
    )
}
QUERIES["indicator_priority"] = observations
