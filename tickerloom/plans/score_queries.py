"""Registered queries over news, sentiment, company lookup and scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickerloom.functions import markets
from tickerloom.functions.numeric import rounded
from tickerloom.functions.text import is_valid_search
from tickerloom.operators import bars as B
from tickerloom.operators import headlines, historical, lookup, news, resolve, scoring, sentiment, technical
from tickerloom.plans import intelligence as I
from tickerloom.plans.fundamental_queries import fundamental_records
from tickerloom.plans.macro_queries import features
from tickerloom.session import shared_folder
from tickerloom.sources import landed, payloads, ranked, views
from tickerloom.sources.tables import table


# ---- news -------------------------------------------------------------------------------------


def terms(spark: SparkSession, sf: str) -> DataFrame:
    return news.company_terms(views.companies(spark, sf), markets.news_overrides(spark))


def news_payload(spark, sf):
    articles = landed.news_articles(payloads.news_payloads(views.news(spark, sf)), "payload")
    return articles.select("symbol", "title", "description", "content", F.col("source.name").alias("source"), "published_at", "url")


def term_mentions(spark, sf):
    """All terms in all articles, whatever symbol an article came under."""
    distinct = terms(spark, sf).select(F.explode("terms").alias("term")).select(F.lower("term").alias("term")).distinct()
    return lookup.mentions(views.news(spark, sf).drop("symbol"), distinct)


def headline_filter(spark, sf):
    return news.headline_filter(views.news(spark, sf)).select("symbol", "doc_id", "headline")


def company_search_name(spark, sf):
    return terms(spark, sf).select("symbol", "search_name")


def company_terms(spark, sf):
    return terms(spark, sf).select("symbol", F.explode("terms").alias("term"))


def term_article_join(spark, sf):
    return news.term_article_join(views.news(spark, sf), terms(spark, sf))


def relevance_score(spark, sf):
    scored = news.relevance_score(news.headline_filter(views.news(spark, sf)), terms(spark, sf))
    return news.relevant(scored).select("symbol", "doc_id", "relevance_score")


def candidate_cap(spark, sf):
    return news.candidate_cap(views.news(spark, sf)).select(
        "symbol", "doc_id", F.col("position").cast("bigint").alias("position"), "published_at"
    )


def candidate_cap_ranked(spark, sf):
    """The same result pages from articles that are stored in their order."""
    path = shared_folder(spark, "ranked-articles")
    ranked.write_ranked(views.news(spark, sf), path, "symbol", news.newest_first())
    newest = ranked.first_rows(spark, path, "symbol", news.newest_first(), news.CANDIDATES_PER_SYMBOL)
    return newest.select("symbol", "doc_id", F.col("position").cast("bigint").alias("position"), "published_at")


def _stories(frame: DataFrame) -> DataFrame:
    return frame.withColumns({c: F.col(c).cast("bigint") for c in ("rank", "relevance_score")})


def news_dedup(spark, sf):
    """Every story of each symbol that the greedy pass accepts."""
    scored = news.relevant(news.relevance_score(news.headline_filter(views.news(spark, sf)), terms(spark, sf)))
    return _stories(news.news_dedup_all(scored).select("symbol", "rank", "doc_id", "url", "relevance_score"))


def news_topk(spark, sf):
    return _stories(news.news_topk(views.news(spark, sf), terms(spark, sf)))


# ---- sentiment --------------------------------------------------------------------------------


def sentiment_normalize(spark, sf):
    return views.sentiment_labels(spark, sf).withColumn(
        "sentiment", sentiment.normalize_sentiment(F.col("sentiment"))
    )


def sentiment_features(spark, sf):
    """Features over all labelled news of each company."""
    classified = views.news(spark, sf).select("doc_id", "symbol").join(
        views.sentiment_labels(spark, sf), "doc_id"
    )
    return sentiment.sentiment_features(views.companies(spark, sf), classified)


def sentiment_predict(spark, sf):
    headlines = views.news(spark, sf).select("doc_id", F.col("title").alias("headline"))
    return sentiment.predict(I.headline_model(spark, sf), headlines).select("doc_id", "sentiment")


def headline_classify(spark, sf):
    """Classes of all headlines by the stored TF-IDF classifier."""
    articles = views.news(spark, sf).select("doc_id", F.col("title").alias("headline"))
    return headlines.predict(I.headline_pipeline(spark, sf), articles).select("doc_id", "sentiment")


def headline_idf(spark, sf):
    """The stored classifier's words and their inverse document frequencies."""
    stored = headlines.weights(spark, I.headline_pipeline(spark, sf))
    return stored.selectExpr("word", "headlines", f"{rounded('idf', 6)} as idf")


def company_sentiment(spark, sf):
    """Features over the classified top stories of each company."""
    stories = sentiment.predict(I.headline_model(spark, sf), news_topk(spark, sf))
    return sentiment.sentiment_features(views.companies(spark, sf), stories)


# ---- company lookup ---------------------------------------------------------------------------


def search_input_valid(spark, sf):
    text = f"""
      case c_custkey % 8 when 0 then lower({views.symbol_of('c_custkey')}) when 1 then c_name
        when 2 then concat('  ', c_mktsegment, ' ') when 3 then concat('Tata & Sons (', c_mktsegment, ')')
        when 4 then '-bad' when 5 then '' when 6 then repeat(c_mktsegment, 12) else 'x' end as search_text"""
    texts = table(spark, sf, "customer").selectExpr("c_custkey", text)
    return texts.withColumn("is_valid", is_valid_search(F.col("search_text")))


def _named(spark: SparkSession, sf: str) -> DataFrame:
    return views.companies(spark, sf).selectExpr(
        "company_key", "concat('  ', replace(legal_name, ' ', '  ')) as name"
    )


def listings(spark: SparkSession, sf: str) -> DataFrame:
    """Search results per query text: brand (some brands unlisted), acronym and full name hits."""
    queries = """explode(array(
      if(company_key % 7 < 5, lower(company_name), null),
      if(company_key % 3 = 0, concat(left(legal_name, 1), left(split(legal_name, ' ')[1], 1), 'S'), null),
      if(company_key % 10 = 0, legal_name, null))) as query"""
    return (
        views.companies(spark, sf)
        .selectExpr("company_key as k", "symbol", queries)
        .filter("query is not null")
        .selectExpr(
            "query",
            "k as result_pos",
            "case when k % 16 = 5 then '' when k % 2 = 1 then lower(symbol) else symbol end as symbol",
            "case when k % 12 = 4 then concat(' ', upper(query)) end as display_symbol",
        )
    )


def company_queries(spark, sf):
    rows = resolve.company_queries(_named(spark, sf), "name", ["company_key"])
    return rows.withColumn("query_pos", F.col("query_pos").cast("bigint"))


def symbol_select(spark, sf):
    return resolve.symbol_select(listings(spark, sf))


def company_resolve(spark, sf):
    queries = resolve.company_queries(_named(spark, sf), "name", ["company_key"])
    return resolve.company_resolve(queries, resolve.symbol_select(listings(spark, sf)), "company_key")


def listed_names(spark: SparkSession, sf: str) -> DataFrame:
    """What is listed under which name; some names are short, some symbols missing or in lower case."""
    return views.companies(spark, sf).selectExpr(
        "company_key as listing",
        "case when company_key % 9 = 4 then company_name else legal_name end as name",
        "case when company_key % 16 = 5 then '' when company_key % 2 = 1 then lower(symbol) else symbol end as symbol",
        "case when company_key % 12 = 4 then concat(' ', upper(company_name)) end as display_symbol",
    )


def company_search(spark, sf):
    """Symbol of each company by searching the listings for its name."""
    queries = resolve.company_queries(_named(spark, sf), "name", ["company_key"])
    results = lookup.search_listings(queries.select("query"), listed_names(spark, sf))
    return resolve.company_resolve(queries, resolve.symbol_select(results), "company_key")


def requests(spark: SparkSession, sf: str) -> DataFrame:
    """What users type: symbols in lower case, names with filler words, invalid and unknown texts."""
    brands = views._pick(views.BRANDS, "c_custkey % 7")
    text = f"""
      case c_custkey % 4 when 0 then lower({views.symbol_of('c_custkey')})
        when 1 then concat('  the ', {brands}, '  company ltd') when 2 then '-bad' else c_name end as search_text"""
    return table(spark, sf, "customer").selectExpr("c_custkey", text)


def intelligence_by_request(spark, sf):
    """From a typed text to a report: the text as a symbol, else the symbol found by its name, else a reason."""
    report = I.intelligence_report(spark, sf).select("symbol", "intelligence_score", "classification")
    return I.by_request(requests(spark, sf), "c_custkey", "search_text", resolve.symbol_select(listings(spark, sf)), report)


def symbols_rejected(spark, sf):
    """Requested symbols that have neither bars nor a company name."""
    requests = table(spark, sf, "customer").selectExpr(f"{views.symbol_of('c_custkey')} as symbol")
    traded = B.bars_period(views.trades(spark, sf), "2y", views.AS_OF).select("symbol").distinct()
    named = (
        fundamental_records(spark, sf)
        .filter(F.col("company_name").isNotNull())
        .select("symbol")
    )
    return requests.join(traded, "symbol", "left_anti").join(named, "symbol", "left_anti")


# ---- module scores ----------------------------------------------------------------------------

_SCORE = ("score", "available", "quality")


def _columns(name: str) -> list[str]:
    return [f"{name}_{c}" for c in _SCORE]


def _numbered(spark: SparkSession, sf: str) -> DataFrame:
    return B.numbered(views.daily_bars(views.trades(spark, sf)))


def score_technical(spark, sf):
    rows = scoring.score_technical(technical.technical_analysis(_numbered(spark, sf)))
    return rows.select("symbol", *_columns("technical"))


def score_historical(spark, sf):
    rows = scoring.score_historical(historical.historical_analysis(_numbered(spark, sf)))
    return rows.select("symbol", *_columns("historical"), "risk_penalty")


def score_fundamental(spark, sf):
    rows = scoring.score_fundamental(fundamental_records(spark, sf))
    return rows.select("symbol", *_columns("fundamental"))


def score_sentiment(spark, sf):
    rows = scoring.score_sentiment(
        sentiment_features(spark, sf).withColumnRenamed("sentiment_score", "headline_score")
    )
    return rows.select("symbol", *_columns("sentiment"))


def score_sector_macro(spark, sf):
    rows = I.with_sector_macro(views.companies(spark, sf).select("symbol", "sector"), features(spark, sf))
    return scoring.score_sector_macro(rows).select("symbol", *_columns("sector_macro"))


REPORT = [
    "symbol",
    "company_name",
    "sector",
    "market_code",
    "intelligence_score",
    "classification",
    "coverage_ratio",
    "confidence_score",
    *[f"{n}_{c}" for n in scoring.MODULE_WEIGHTS for c in (*_SCORE, "contribution")],
]


def intelligence_score(spark, sf):
    return I.intelligence_report(spark, sf).select(*REPORT)


def intelligence_rank(spark, sf):
    ranked = scoring.intelligence_rank(I.intelligence_report(spark, sf), 20)
    return ranked.select("symbol", "intelligence_score", "classification", "coverage_ratio")


def report_assemble(spark, sf):
    return _assembled(I.assembled(spark, sf))


def report_from_tables(spark, sf):
    """The same report from written module tables."""
    return _assembled(I.from_tables(spark, I.write_modules(spark, sf)))


def _assembled(report: DataFrame) -> DataFrame:
    return report.select(
        "symbol",
        "company_name",
        "data_source",
        "annualized_volatility",
        "maximum_drawdown",
        "one_month_return",
        "net_score",
        "signal",
        "profit_margin",
        "forward_pe",
        "article_count",
        F.col("headline_score").alias("sentiment_score"),
        "sector_macro_score",
        "available_sector_weight",
    )


def report_modules(spark, sf):
    """The nested report, opened again: one row per symbol and module."""
    nested = scoring.module_scores(I.intelligence_report(spark, sf))
    each = ", ".join(f"struct('{n}' as module, module_scores.{n} as figures)" for n in scoring.MODULE_WEIGHTS)
    return nested.selectExpr(
        "symbol", "company_name", "classification", "cast(size(errors) as bigint) as error_count", f"inline(array({each}))"
    ).select("symbol", "company_name", "classification", "error_count", "module", "figures.*")


def report_chart_series(spark, sf):
    return scoring.report_chart_series(I.intelligence_report(spark, sf))


def module_errors(spark, sf):
    """Failed modules and reasons of the report."""
    rows = I.assembled(spark, sf)
    return rows.select("symbol", F.explode("errors").alias("module", "reason"))


QUERIES = {
    f.__name__: f
    for f in (
        news_payload,
        headline_filter,
        term_mentions,
        company_search_name,
        company_terms,
        term_article_join,
        relevance_score,
        candidate_cap,
        candidate_cap_ranked,
        news_dedup,
        news_topk,
        sentiment_normalize,
        sentiment_features,
        sentiment_predict,
        headline_classify,
        headline_idf,
        company_sentiment,
        search_input_valid,
        company_queries,
        symbol_select,
        company_resolve,
        company_search,
        symbols_rejected,
        score_technical,
        score_historical,
        score_fundamental,
        score_sentiment,
        score_sector_macro,
        intelligence_score,
        intelligence_rank,
        report_assemble,
        report_from_tables,
        report_modules,
        report_chart_series,
        module_errors,
        intelligence_by_request,
    )
}
