"""Known inputs with known results."""

import json

import pytest
from pyspark.sql import functions as F

from tickerloom.functions import markets
from tickerloom.functions.text import html_cell_text
from tickerloom.operators import macro as M
from tickerloom.operators import news, observations, pages, resolve, scoring
from tickerloom.plans import intelligence
from tickerloom.sources import landed, store

FUNDAMENTAL = {
    "profit_margin": 20.0,
    "return_on_equity": 20.0,
    "revenue_growth": 15.0,
    "earnings_growth": 15.0,
    "forward_pe": 20.0,
    "debt_to_equity": 50.0,
    "free_cash_flow": 100.0,
}
HISTORY = {
    "one_month_return": 10.0,
    "three_month_return": 15.0,
    "six_month_return": 20.0,
    "one_year_return": 25.0,
    "annualized_volatility": 20.0,
    "maximum_drawdown": -10.0,
}


def row(spark, values, **nulls):
    """One-row frame; None becomes a double null."""
    columns = ", ".join(
        f"cast({'null' if v is None else repr(v)} as {nulls.get(k, 'string' if isinstance(v, str) else 'double')}) as {k}"
        for k, v in values.items()
    )
    return spark.sql(f"select {columns}")


def test_technical_score(spark):
    got = scoring.score_technical(row(spark, {"net_score": 3})).first()
    assert (got.technical_score, got.technical_available, got.technical_quality) == (0.5, True, 1.0)


def test_sentiment_score(spark):
    got = scoring.score_sentiment(row(spark, {"article_count": 5, "headline_score": 0.6})).first()
    assert (got.sentiment_score, got.sentiment_available, got.sentiment_quality) == (0.6, True, 1.0)


def test_no_articles_is_unavailable(spark):
    got = scoring.score_sentiment(row(spark, {"article_count": 0, "headline_score": 0.0})).first()
    assert (got.sentiment_score, got.sentiment_available) == (0.0, False)


def test_historical_score(spark):
    got = scoring.score_historical(row(spark, HISTORY)).first()
    assert (got.historical_score, got.historical_quality, got.risk_penalty) == (0.5, 1.0, 0.0)


@pytest.mark.parametrize(
    "volatility,drawdown,penalty",
    [(50, -30, 0.0), (50.01, -30, -0.1), (75.01, -30.01, -0.3), (75.01, -50.01, -0.4)],
)
def test_risk_penalty_edges(spark, volatility, drawdown, penalty):
    values = {**HISTORY, "annualized_volatility": volatility, "maximum_drawdown": drawdown}
    assert scoring.score_historical(row(spark, values)).first().risk_penalty == penalty


def test_fundamental_score(spark):
    assert scoring.score_fundamental(row(spark, FUNDAMENTAL)).first().fundamental_score == 0.929


def test_missing_metrics_lower_quality_and_negative_pe_scores_a_quarter(spark):
    values = {k: None for k in FUNDAMENTAL} | {"forward_pe": -3.0}
    got = scoring.score_fundamental(row(spark, values)).first()
    assert (got.fundamental_score, got.fundamental_quality) == (0.25, 0.14)
    none = scoring.score_fundamental(row(spark, {k: None for k in FUNDAMENTAL})).first()
    assert (none.fundamental_score, none.fundamental_available) == (0.0, False)


def test_combined_score(spark):
    report = row(
        spark,
        FUNDAMENTAL
        | HISTORY
        | {
            "symbol": "TEST",
            "company_name": "Test",
            "sector": "Technology",
            "net_score": 3,
            "article_count": 5,
            "headline_score": 0.6,
            "sector_macro_score": 0.5,
            "available_sector_weight": 1,
            "macro_confidence_score": 1,
        },
    ).selectExpr("*", "map() as errors")
    got = scoring.intelligence_score(report).first()
    assert (got.intelligence_score, got.classification) == (0.644, "strongly_favourable")
    assert (got.coverage_ratio, got.confidence_score) == (1.0, 1.0)
    nested = scoring.module_scores(scoring.intelligence_score(report)).first()
    assert nested.module_scores.fundamental.weighted_contribution == 0.279


def test_fiscal_quarter_gdp(spark):
    rows = [
        ("P", 0, "GDP Growth Rate", "2024-25", "Q4", "7.4"),
        ("P", 1, "GDP Growth Rate", "2025-26", "Q4", "7.8"),
        ("P", 2, "GDP Growth Rate", "2025-26", "q3", "8.1"),
        ("P", 3, "GDP Growth Rate", "2025-26", "Q4", "9.9"),
        ("P", 4, "GVA Growth Rate", "2026-27", "Q1", "5.0"),
    ]
    frame = spark.createDataFrame(
        rows, "publisher string, seq bigint, indicator string, fiscal_year string, quarter string, value string"
    )
    got = observations.fiscal_gdp_latest(frame).first()
    assert (got.value, got.observation_date) == (7.8, "2025-26-Q4")


def test_policy_rate_page(spark):
    html = (
        "<html><body><div>Policy <b>Repo</b> Rate : 5.25%</div>"
        "<p>Website last updated date: Aug 14, 2026</p></body></html>"
    )
    frame = spark.createDataFrame([(1, html), (2, "<p>closed</p>")], "page_id int, html string")
    got = {r.page_id: r for r in pages.page_rate_extract(frame).collect()}
    assert (got[1].value, got[1].page_last_updated_date, got[1].error) == (5.25, "2026-08-14", None)
    assert (got[2].value, got[2].error) == (None, "policy rate not found")


def _observation(market, indicator, value, **extra):
    base = {"observation_date": "2026-07-01", "source": "s", "is_policy_rate": None}
    return {**base, "market_code": market, "indicator": indicator, "value": value, **extra}


OBSERVATION_SCHEMA = (
    "market_code string, indicator string, value double, observation_date string, source string,"
    " is_policy_rate boolean, is_cached boolean, is_fallback boolean"
)


def _frame(spark, rows):
    keys = [f.split(" ")[0] for f in OBSERVATION_SCHEMA.split(", ")]
    return spark.createDataFrame([tuple(r.get(k, False) for k in keys) for r in rows], OBSERVATION_SCHEMA)


def test_us_outage_is_served_from_the_store_as_a_whole(spark):
    values = {"policy_rate": 3.63, "inflation": 3.3, "gdp_growth": 1.5, "unemployment": 4.1}
    live = _frame(spark, [_observation("US", i, 9.0) for i in ("policy_rate", "inflation", "gdp_growth")])
    cached = _frame(spark, [_observation("US", i, v) for i, v in values.items()])
    got = M.indicator_priority(live, cached, _frame(spark, [])).collect()
    assert {r.indicator: (r.value, r.is_cached, r.is_fallback) for r in got} == {
        i: (v, True, False) for i, v in values.items()
    }


def test_live_then_cached_then_annual_for_india(spark):
    live = _frame(spark, [_observation("IN", "inflation", 4.0)])
    cached = _frame(spark, [_observation("IN", "gdp_growth", 7.1), _observation("IN", "inflation", 1.0)])
    annual = _frame(
        spark,
        [_observation(m, i, 7.5) for m in ("IN", "SG") for i in ("gdp_growth", "unemployment", "policy_rate")],
    )
    got = M.indicator_priority(live, cached, annual).collect()
    assert {(r.market_code, r.indicator): (r.value, r.is_cached, r.is_fallback) for r in got} == {
        ("IN", "inflation"): (4.0, False, False),
        ("IN", "gdp_growth"): (7.1, True, False),
        ("IN", "unemployment"): (7.5, False, True),
    }


def test_gdp_interpretation(spark):
    frame = spark.sql("select 'IN' as market_code, 7.8D as gdp_growth_rate, 0 as gdp_is_fallback")
    got = M.interpret_gdp_growth(frame).first()
    assert (got.gdp_growth_status, got.gdp_growth_score, got.gdp_data_quality) == (
        "strong_growth",
        2,
        "official_source",
    )


def test_acronym_candidate(spark):
    frame = spark.createDataFrame([("1", "Tata Consultancy  Services Limited")], "id string, name string")
    got = [r["query"] for r in resolve.company_queries(frame, "name", ["id"]).orderBy("query_pos").collect()]
    assert got == ["Tata Consultancy Services Limited", "Tata Consultancy Services", "TCS", "Tata"]


def test_second_candidate_is_used_when_the_first_finds_nothing(spark):
    companies = spark.createDataFrame(
        [("1", "Tata Consultancy Services Limited"), ("2", "No Such Thing")], "id string, name string"
    )
    listings = spark.createDataFrame(
        [
            ("TCS", 0, "TCS", "TCS"),
            ("TCS", 1, "tcs.bo", ""),
            ("TCS", 2, " tcs.ns ", ""),
            ("tata", 0, "TATA.AX", ""),
        ],
        "query string, result_pos int, symbol string, display_symbol string",
    )
    queries = resolve.company_queries(companies, "name", ["id"])
    got = resolve.company_resolve(queries, resolve.symbol_select(listings), "id").collect()
    assert {r.id: r.symbol for r in got} == {"1": "TCS.NS", "2": None}


def test_company_without_a_name_has_no_candidate_and_repeated_rows_give_one_answer(spark):
    companies = spark.createDataFrame([("1", "Beta Ltd"), ("1", "Beta Ltd"), ("2", " "), ("3", None)], "id string, name string")
    listings = spark.createDataFrame([("beta", 0, "BETA", "")], "query string, result_pos int, symbol string, display_symbol string")
    queries = resolve.company_queries(companies, "name", ["id"])
    assert {r.id for r in queries.collect()} == {"1"}
    got = resolve.company_resolve(queries, resolve.symbol_select(listings), "id").collect()
    assert [(r.id, r.symbol) for r in got] == [("1", "BETA")]


@pytest.mark.parametrize("html, want", [("&nbsp;1&amp;2", "1&2"), ("a&lt;b&gt;&quot;&apos;", "a<b>\"'"), ("&amp x &eacute; &#150;", "& x \u00e9 \u2013")])
def test_frequent_and_rare_references_are_decoded_alike(spark, html, want):
    frame = spark.createDataFrame([(html,)], "html string")
    assert frame.select(html_cell_text(F.col("html"))).first()[0] == want


def test_table_runs_from_the_first_caption_to_the_next_end(spark):
    row = '<tr><th class="row-header">{}</th><td>{}</td><td>{}</td></tr>'
    caption = f"<caption>{pages.TABLE_CAPTIONS['inflation']}</caption>"
    texts = {
        1: f"<table>{caption}{row.format('Jan-25', 1, 2)}{row.format('Feb-25', 3, 'na')}</table>{caption}{row.format('Mar-25', 5, 6)}</table>",
        2: f"</table>{caption}{row.format('Jan-25', 1, 2)}",
        3: f"{caption}</table>",
    }
    frame = spark.createDataFrame(list(texts.items()), "page_id long, html string")
    got = {r.page_id: (r.value, r.observation_date, r.error) for r in pages.page_table_extract(frame).filter("indicator = 'inflation'").collect()}
    assert got == {1: (2.0, "2025-01", None), 2: (None, None, "table not found"), 3: (None, None, "no valid observations")}


def test_greedy_dedup_counts_accepted_articles_only(spark):
    rows = [("t1", "u1"), ("t2", "u1"), ("t2", "u2"), ("t1", "u3"), ("t3", "")]
    frame = spark.createDataFrame(
        [("S", 10, i + 1, t, u, i) for i, (t, u) in enumerate(rows)],
        "symbol string, relevance_score int, position int, headline string, url string, doc_id int",
    ).selectExpr("*", "'' as description", "named_struct('name', 'x') as source", "'2026' as published_at")
    got = news.news_dedup(frame).orderBy("rank").collect()
    assert [(r["rank"], r.headline, r.url) for r in got] == [(1, "t1", "u1"), (2, "t2", "u2")]


def test_override_terms_and_symbol_fallback(spark):
    frame = spark.createDataFrame(
        [("RELIANCE.NS", "Other"), ("ABC", "  Abc Corp "), ("XYZ.SI", None), ("EMP", "")],
        "symbol string, company_name string",
    )
    got = {r.symbol: r for r in news.company_terms(frame, markets.news_overrides(spark)).collect()}
    assert got["RELIANCE.NS"].search_name == "Reliance Industries" and "ril" in got["RELIANCE.NS"].terms
    assert (got["ABC"].search_name, got["ABC"].terms) == ("Abc Corp", ["abc corp"])
    assert (got["XYZ.SI"].search_name, got["XYZ.SI"].terms) == ("XYZ.SI", ["xyz.si"])
    assert got["EMP"].search_name == "EMP"


def test_substring_terms_and_relevance_floor(spark):
    articles = spark.createDataFrame(
        [("S", 1, "April outlook", "ril", "x ril"), ("S", 2, "None", "ril", "ril ril"), ("S", 3, "RIL", None, None)],
        "symbol string, doc_id int, title string, description string, content string",
    )
    terms = spark.createDataFrame([("S", ["ril"])], "symbol string, terms array<string>")
    scored = news.relevance_score(articles, terms)
    assert {r.doc_id: r.relevance_score for r in scored.collect()} == {1: 15, 2: 5, 3: 10}
    assert sorted(r.doc_id for r in news.relevant(scored).collect()) == [1, 3]


def test_observation_payload_drops_placeholders_after_the_limit(spark):
    body = {"observations": [{"date": f"2026-0{m}-01", "value": v} for m, v in ((3, "."), (2, "x"), (1, "1.5"))]}
    frame = spark.createDataFrame([("A", json.dumps(body)), ("B", "broken")], "series_id string, payload string")
    got = landed.series_observations(frame, "payload", 3).collect()
    assert [(r.series_id, str(r.date), r.value) for r in got] == [("A", "2026-01-01", 1.5)]
    assert landed.series_observations(frame, "payload", 2).count() == 0


def test_chart_payload_with_short_array_and_missing_blocks(spark):
    body = {
        "chart": {
            "result": [
                {
                    "meta": {},
                    "timestamp": [0, 86400],
                    "indicators": {
                        "quote": [{"open": [1, 2], "high": [1, 2], "low": [1, 2], "close": [5, None], "volume": [1]}]
                    },
                }
            ]
        }
    }
    frame = spark.createDataFrame([("A", json.dumps(body)), ("B", "{}")], "symbol string, payload string")
    got = landed.bars_from_chart_json(frame, "payload").orderBy("seq").collect()
    assert [(r.seq, r.close, r.volume) for r in got] == [(0, 5.0, None), (1, None, None)]
    prices = {r.symbol: r.last_price for r in landed.chart_last_price(frame, "payload").collect()}
    assert prices == {"A": 5.0, "B": None}


def test_store_roundtrip_latest_and_absent(spark, tmp_path):
    path = str(tmp_path / "store")
    assert store.read_store(spark, path).count() == 0
    rows = spark.sql(
        """select * from values ('IN', 'inflation', 4.1D, '2026-06', 's', true, timestamp_ntz'2026-07-01'),
        ('IN', 'inflation', 4.3D, '2026-07', 's', true, timestamp_ntz'2026-08-01'),
        ('AU', 'inflation', cast(null as double), '2026-07', 's', true, timestamp_ntz'2026-08-01')
        as t(market_code, indicator, value, observation_date, source, is_policy_rate, cached_at)"""
    )
    store.save_good_observations(rows.filter("observation_date = '2026-06'"), path)
    store.save_good_observations(rows.filter("observation_date = '2026-07'"), path)
    got = store.good_obs_latest(store.read_store(spark, path)).collect()
    assert [(r.market_code, r.value, r.is_cached) for r in got] == [("IN", 4.3, True)]


def test_module_errors_name_each_failed_module(spark):
    frame = spark.sql(
        "select 40L as bars, cast(null as int) as net_score, cast(null as string) as data_source,"
        " 0.1D as combined_macro_score, 0.2D as annualized_volatility, 0L as article_count, 0.1D as sector_macro_score"
    ).selectExpr(intelligence.MODULE_ERRORS)
    assert set(frame.first().errors) == {"technical", "fundamental"}
    nothing = spark.sql(
        "select 1L as bars, cast(null as int) as net_score, cast(null as string) as data_source, 0D as combined_macro_score,"
        " cast(null as double) as annualized_volatility, cast(null as long) as article_count, cast(null as double) as sector_macro_score"
    ).selectExpr(intelligence.MODULE_ERRORS)
    assert set(nothing.first().errors) == {"historical", "technical", "fundamental", "sentiment", "sector_macro"}


def test_landed_files_are_read_whole(spark, tmp_path):
    chart = {"chart": {"result": [{"timestamp": [86400], "indicators": {"quote": [{"close": [7.5]}]}}]}}
    (tmp_path / "charts").mkdir()
    (tmp_path / "charts" / "ABC.json").write_text(json.dumps(chart, indent=2))
    files = landed.whole_files(spark, str(tmp_path / "charts")).selectExpr(
        "replace(file, '.json', '') as symbol", "content"
    )
    bar = landed.bars_from_chart_json(files, "content").first()
    assert (bar.symbol, str(bar.ts), bar.close, bar.open) == ("ABC", "1970-01-02 00:00:00", 7.5, None)


def test_cash_rate_file(spark, tmp_path):
    lines = [
        "\ufeffF1 RATES",
        '"Title, long",Cash Rate Target',
        "Publication date,05-Aug-2026",
        "Series ID,FIRMMCRTD",
        "01-Jul-2026,3.85",
        "04-Aug-2026,3.60,3.1",
        "05-Aug-2026,",
    ]
    (tmp_path / "f1.csv").write_text("\r\n".join(lines), encoding="utf-8")
    (tmp_path / "other.csv").write_text("Series ID,OTHER\n01-Jul-2026,1.0")
    got = {r.file: r for r in pages.rba_csv_extract(landed.whole_files(spark, str(tmp_path))).collect()}
    row = got["f1.csv"]
    assert (row.value, row.observation_date, row.publication_date) == (3.6, "2026-08-04", "2026-08-05")
    assert (got["other.csv"].value, got["other.csv"].error) == (None, "unexpected series")


def test_shared_folder_is_the_one_the_session_names(spark):
    from tickerloom import shared_folder

    assert shared_folder(spark, "x").startswith(spark.conf.get("spark.checkpoint.dir") + "/x-")


def test_every_kind_of_character_reference(spark):
    import html

    from pyspark.sql.functions import col

    from tickerloom.functions.text import unescaped

    texts = [
        "a &amp; b", "&lt;x&gt; &amp;lt; &#8217;&#x2019;&#X41; &eacute;&ndash;&nbsp;", "&", "&&", "no", "", "tail &amp",
        "&nope; &#; &#xZ; &#128;&#0;&#1114112;&#99999999999999999999;", "&#x1F600; &copy 1 &hearts;", None,
    ]
    frame = spark.createDataFrame([(t,) for t in texts], "t string").select("t", unescaped(col("t")).alias("u"))
    assert all(r.u == (html.unescape(r.t) if r.t is not None else None) for r in frame.collect())
