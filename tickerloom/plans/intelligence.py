"""The flagship plan: every symbol's five modules joined into one scored report.

Shuffles by symbol only: bars are reduced to daily bars before theirs, news is cut to contenders per
symbol before its own, macro is one row per market and broadcast. The module tables have one row per symbol.
Daily bars, fundamental records and the headline model are written when a report is built, and read from there.
"""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tickerloom.functions import markets
from tickerloom.functions.numeric import named
from tickerloom.functions.text import is_valid_search, stripped
from tickerloom.operators import bars as B
from tickerloom.operators import headlines, historical, macro, news, resolve, scoring, sector, sentiment, technical
from tickerloom.operators.linked import settled
from tickerloom.plans.fundamental_queries import fundamental_records
from tickerloom.plans.macro_queries import features
from tickerloom.session import shared_folder
from tickerloom.sources import views
from tickerloom.sources.tables import written_at


def price_report(bars: DataFrame) -> DataFrame:
    """Historical and technical module of each symbol from one pass over its bars; technical figures
    are null where the history is too short."""
    aggregates = {**technical.aggregates(), **historical.aggregates()}
    raw = B.per_symbol(B.numbered(bars), aggregates)
    figures = {**historical.values(), **technical.values()}
    rows = technical.technical_signal(
        raw.selectExpr("symbol", "bars", f"{technical.IS_USABLE} as usable", *named(figures))
    )
    module = [n for n in technical.values() if n != "current_price"]
    module += ["bullish_points", "bearish_points", "net_score", "signal"]
    return rows.selectExpr(
        f"* except (usable, {', '.join(module)})", *[f"if(usable, {n}, null) as {n}" for n in module]
    )


def with_sector_macro(rows: DataFrame, market_features: DataFrame) -> DataFrame:
    """Adds the macro and sector module; both are broadcast lookups, nothing moves."""
    combined = macro.macro_combined(market_features).withColumnRenamed("classification", "macro_class")
    renamed = combined.withColumnsRenamed(
        {"coverage_ratio": "macro_coverage_ratio", "confidence_score": "macro_confidence_score"}
    )
    return sector.sector_macro(macro.by_market(rows, renamed))


def labelled_headlines(spark: SparkSession, sf: str) -> DataFrame:
    titles = views.news(spark, sf).select("doc_id", F.col("title").alias("headline"))
    return titles.join(views.sentiment_labels(spark, sf), "doc_id")


def _tables_key(spark: SparkSession, sf: str) -> tuple:
    """What a model depends on: this session and when the tables it is fitted on were written."""
    written = [written_at(spark, f"{sf}/{name}.parquet") for name in ("documents", "labels")]
    return (spark.sparkContext.applicationId, sf, *written)


_MODELS: dict[tuple, sentiment.Model] = {}


def headline_model(spark: SparkSession, sf: str) -> sentiment.Model:
    """The classifier of headlines, from all labelled articles: fitted and written once per session and state of the tables."""
    key = _tables_key(spark, sf)
    if key not in _MODELS:
        model = sentiment.train(labelled_headlines(spark, sf))
        _MODELS[key] = sentiment.Model(*(settled(part, f"headline-{name}") for name, part in model._asdict().items()))
    return _MODELS[key]


_PIPELINES: dict[tuple, str] = {}


def headline_pipeline(spark: SparkSession, sf: str) -> PipelineModel:
    """The TF-IDF classifier of headlines, stored once per session and state of the tables, and loaded from there."""
    key = _tables_key(spark, sf)
    if key not in _PIPELINES:
        path = shared_folder(spark, "headline-pipeline")
        headlines.fit(labelled_headlines(spark, sf)).write().save(path)
        _PIPELINES[key] = path
    return PipelineModel.load(_PIPELINES[key])


def classified_news(spark: SparkSession, sf: str, records: DataFrame, symbols: DataFrame, limit: int) -> DataFrame:
    """Top stories of each symbol, each classified by its headline."""
    names = symbols.select("symbol").join(records.select("symbol", "company_name"), "symbol", "left")
    terms = news.company_terms(names, markets.news_overrides(spark))
    return sentiment.predict(headline_model(spark, sf), news.news_topk(views.news(spark, sf), terms, limit))


def report_assemble(
    symbols: DataFrame, prices: DataFrame, fundamentals: DataFrame, sentiments: DataFrame
) -> DataFrame:
    """Left joins by symbol: any module may be missing. Symbols with neither bars nor a name drop."""
    return (
        symbols.select("symbol")
        .join(prices, "symbol", "left")
        .join(fundamentals, "symbol", "left")
        .join(sentiments, "symbol", "left")
        .filter(F.col("bars").isNotNull() | F.col("company_name").isNotNull())
    )


# Reason per failed module; modules that worked have no entry.
MODULE_ERRORS = """
map_filter(map(
  'market_data', if(bars is null, 'no market data', null),
  'historical', if(bars is not null and annualized_volatility is null, 'too few returns', null),
  'technical', if(bars is not null and net_score is null, 'too few complete bars', null),
  'fundamental', if(data_source is null, 'no fundamental data', null),
  'sentiment', if(article_count is null, 'no news data', null),
  'macro', if(combined_macro_score is null, 'no macro data', null),
  'sector_macro', if(combined_macro_score is not null and sector_macro_score is null, 'no sector weights', null)
), (module, reason) -> reason is not null) as errors
"""


def modules(spark: SparkSession, sf: str, period: str = "2y", news_limit: int = 5) -> dict[str, DataFrame]:
    """The tables that a report is joined from, one row per symbol each.

    Daily bars and fundamental records are written first: several modules read them, so the line items are read once for
    bars and once for statements, and the plan of a report stays small.
    """
    symbols = views.companies(spark, sf).select("symbol")
    daily = settled(views.daily_bars(B.bars_period(views.trades(spark, sf), period, views.AS_OF)), "daily-bars")
    # a period shorter than the chart's month cannot serve it
    short = B.period_start(period, views.AS_OF) > B.period_start("1mo", views.AS_OF)
    records = settled(fundamental_records(spark, sf, None if short else daily), "fundamental-records")
    stories = classified_news(spark, sf, records, symbols, news_limit)
    sentiments = sentiment.sentiment_features(symbols, stories).withColumnRenamed("sentiment_score", "headline_score")
    return {"symbols": symbols, "prices": price_report(daily), "fundamentals": records, "sentiments": sentiments}


def assembled(spark: SparkSession, sf: str, period: str = "2y", news_limit: int = 5) -> DataFrame:
    return with_sector_macro(report_assemble(**modules(spark, sf, period, news_limit)), features(spark, sf)).selectExpr("*", MODULE_ERRORS)


def write_modules(spark: SparkSession, sf: str, buckets: int | None = None, period: str = "2y", news_limit: int = 5) -> dict[str, str]:
    """Writes the tables of a report, macro included, bucketed and sorted by symbol; name of module -> name of table.

    All have the same buckets, so reports join them file by file, without an exchange, as often as they are read.
    """
    buckets = buckets or max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    tables = modules(spark, sf, period, news_limit)
    sectors = tables["symbols"].join(tables["fundamentals"].select("symbol", "sector"), "symbol", "left")
    tables["macro"] = with_sector_macro(sectors, features(spark, sf)).drop("sector")
    names = {}
    for module, frame in tables.items():
        path = shared_folder(spark, f"module-{module}")
        names[module] = f"module_{path.rsplit('-', 1)[1]}"
        by_bucket = frame.repartition(buckets, "symbol").write.bucketBy(buckets, "symbol").sortBy("symbol")
        by_bucket.option("path", path).saveAsTable(names[module])
    return names


def from_tables(spark: SparkSession, names: dict[str, str]) -> DataFrame:
    """The report joined from the written tables: merge joins of equal buckets."""
    rows = spark.table(names["symbols"])
    for module in ("prices", "fundamentals", "sentiments", "macro"):
        rows = rows.join(spark.table(names[module]).hint("merge"), "symbol", "left")
    return rows.filter("bars is not null or company_name is not null").selectExpr("*", MODULE_ERRORS)


def by_request(requests: DataFrame, key: str, text: str, best_listings: DataFrame, report: DataFrame) -> DataFrame:
    """One row per request: its report row under the symbol it names, else under the symbol that a search by
    name finds (once), else the reason why there is none. The report has one row per symbol and is built once.
    """
    valid = is_valid_search(F.col(text))
    typed = requests.select(key, text, F.coalesce(valid, F.lit(False)).alias("valid"), F.upper(stripped(F.col(text))).alias("typed"))
    named = resolve.company_queries(typed.filter("valid"), text, [key])
    found = resolve.company_resolve(named, best_listings, key).withColumnRenamed("symbol", "by_name")
    # both symbols of a request look for a report; the typed one wins
    asked = typed.join(found, key, "left").select(
        key, text, "valid", F.posexplode(F.array(F.when(F.col("valid"), F.col("typed")), F.upper("by_name"))).alias("way", "symbol")
    )
    figures = [c for c in report.columns if c != "symbol"]
    reported = asked.join(report.withColumn("reported", F.lit(True)), "symbol", "left")
    first = F.min(F.when(F.col("reported"), F.col("way")))
    picked = lambda c: F.max(F.when(F.col("reported") & (F.col("way") == F.col("first_way")), F.col(c)))
    ways = reported.withColumn("first_way", first.over(Window.partitionBy(key)))
    return (
        ways.groupBy(key, text, "valid", "first_way")
        .agg(*[picked(c).alias(c) for c in ("symbol", *figures)])
        .select(
            key,
            text,
            F.expr("case first_way when 0 then 'direct' when 1 then 'resolved' else 'rejected' end as outcome"),
            "symbol",
            *figures,
            F.expr("case when not valid then 'invalid search text' when first_way is null then 'no listed company found' end as reason"),
        )
    )


def intelligence_report(spark: SparkSession, sf: str, period: str = "2y", news_limit: int = 5) -> DataFrame:
    return scoring.intelligence_score(assembled(spark, sf, period, news_limit))
