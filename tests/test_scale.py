"""Plan shapes and skew: what must hold when one key owns a third of the rows."""

import pytest

from tickerloom.operators import bars as B
from tickerloom.operators import joins, news
from tickerloom.plans import price_queries, score_queries
from tickerloom.sources import views
from tickerloom.streaming import feeds


def plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def test_period_filter_and_columns_reach_the_scan(spark, sf):
    text = plan(price_queries.bars_period(spark, sf))
    assert "GreaterThanOrEqual(l_shipdate" in text
    assert "l_comment" not in text and "l_discount" not in text


def test_bars_combine_before_the_shuffle_by_hash(spark, sf):
    text = plan(price_queries.bars_from_trades(spark, sf))
    assert text.count("Exchange hashpartitioning") == 1
    assert text.count("HashAggregate") == 2 and "SortAggregate" not in text


def test_indicators_take_one_more_exchange_only(spark, sf):
    text = plan(price_queries.technical_analysis(spark, sf))
    assert text.count("Exchange hashpartitioning") == 2
    assert "BroadcastNestedLoop" not in text and "CartesianProduct" not in text


def test_candidates_are_limited_before_the_shuffle(spark, sf):
    text = plan(news.candidate_cap(views.news(spark, sf)))
    assert "WindowGroupLimit" in text and "Partial" in text


@pytest.mark.parametrize("name", ["intelligence_score", "company_resolve", "term_article_join"])
def test_no_cross_joins(spark, sf, name):
    text = plan(score_queries.QUERIES[name](spark, sf))
    assert "CartesianProduct" not in text and "BroadcastNestedLoop" not in text


def test_salted_lookup_keeps_every_row_of_a_hot_key(spark):
    left = spark.range(3000).selectExpr("if(id % 3 = 0, 1, id) as k", "id")
    right = spark.range(3000).selectExpr("id as k", "id * 10 as v")
    plain = left.join(right, "k", "left")
    for how in ("left", "inner"):
        salted = joins.salted_lookup(left, right, ["k"], ["id"], how=how)
        assert salted.exceptAll(plain).count() == 0 and salted.count() == 3000


def test_streamed_bars_equal_batch_bars(spark, sf, tmp_path):
    trades = views.trades(spark, sf)
    source = str(tmp_path / "trades")
    trades.write.parquet(source)
    stream = spark.readStream.schema(trades.schema).parquet(source)
    query = (
        feeds.daily_bars(stream).writeStream.outputMode("append").format("memory").queryName("bars")
        .trigger(availableNow=True).start()
    )
    query.awaitTermination(180)
    got, expected = spark.table("bars"), B.bars_from_trades(trades)
    assert got.exceptAll(expected).count() == 0
    # The watermark keeps the last days open; everything older has been emitted.
    assert expected.exceptAll(got).filter("date < date'2001-11-01'").count() == 0


def test_streamed_observations_reach_the_store(spark, tmp_path):
    from tickerloom.sources import store

    source, path = str(tmp_path / "in"), str(tmp_path / "store")
    rows = spark.sql(
        """select * from values ('IN', 'inflation', 4.1D, '2026-06', 's', true, timestamp_ntz'2026-07-01'),
        ('IN', 'inflation', cast(null as double), '2026-07', 's', true, timestamp_ntz'2026-08-01')
        as t(market_code, indicator, value, observation_date, source, is_policy_rate, cached_at)"""
    )
    rows.write.parquet(source)
    stream = spark.readStream.schema(rows.schema).parquet(source)
    for _ in range(2):  # the second run finds nothing new
        feeds.keep_good_observations(stream, path, str(tmp_path / "state")).awaitTermination(120)
    assert [r.value for r in store.read_store(spark, path).collect()] == [4.1]


@pytest.mark.parametrize("limit", [1, 5, 20])
def test_news_of_a_hot_symbol_equals_brute_force(spark, limit):
    """A symbol with most of 3,000 articles: the bounded, folded result is what a plain loop over all gives."""
    rows = [
        ("HOT" if i % 3 else f"S{i % 5}", i, f"acme {i % 40}" if i % 2 else f"other {i % 40}", "acme" if i % 7 else "",
         "acme acme", f"2026-01-{1 + i % 28:02d}T{i % 24:02d}", "" if i % 19 == 0 else f"u{(i * i) % 33}")
        for i in range(3000)
    ]
    frame = spark.createDataFrame(
        rows,
        "symbol string, doc_id int, title string, description string, content string, published_at string, url string",
    ).selectExpr("*", "named_struct('name', 'n') as source")
    terms = frame.select("symbol").distinct().selectExpr("symbol", "array('acme') as terms")
    got = {}
    for r in news.news_topk(frame, terms, limit).orderBy("symbol", "rank").collect():
        got.setdefault(r.symbol, []).append(r.doc_id)
    expected = {}
    for symbol in {r[0] for r in rows}:
        page = sorted((r for r in rows if r[0] == symbol), key=lambda r: r[1])
        page = sorted(page, key=lambda r: r[5], reverse=True)
        scored = [(10 * ("acme" in r[2]) + 4 * ("acme" in r[3]) + 1, r) for r in page]
        titles, urls, kept = set(), set(), []
        for score, r in sorted((s for s in scored if s[0] >= 8), key=lambda s: s[0], reverse=True):
            if r[6] and r[2] not in titles and r[6] not in urls and len(kept) < limit:
                titles.add(r[2])
                urls.add(r[6])
                kept.append(r[1])
        expected[symbol] = kept
    assert got == {s: k for s, k in expected.items() if k}


def test_number_of_stories_is_checked(spark, sf):
    with pytest.raises(ValueError, match="1 to 20"):
        news.news_dedup(spark.range(1), 21)


def test_every_accepted_story_is_given(spark):
    import random

    rng = random.Random(4)
    rows = [("HOT" if k % 3 else "B", k, f"T{rng.randrange(400)}", f"u{rng.randrange(400)}" if k % 50 else " ", f"2026-{rng.randrange(10, 13)}", rng.randrange(8, 14)) for k in range(1500)]
    rows += [("CHAIN", k, f"t{k // 2}", f"u{(k + 1) // 2}", "2026", 60 - k) for k in range(12)]
    frame = spark.createDataFrame(rows, "symbol string, doc_id int, headline string, url string, published_at string, relevance_score int")
    frame = frame.selectExpr("*", "' d ' as description", "named_struct('name', 'n') as source")
    expected, titles, urls = {}, set(), set()
    for r in sorted(sorted(rows, key=lambda r: (r[4], -r[1]), reverse=True), key=lambda r: -r[5]):
        title, url = (r[0], r[2].lower()), (r[0], r[3].strip())
        if url[1] and title not in titles and url not in urls:
            titles.add(title)
            urls.add(url)
            expected.setdefault(r[0], []).append(r[1])
    got = {}
    for r in news.news_dedup_all(frame).orderBy("symbol", "rank").collect():
        got.setdefault(r.symbol, []).append(r.doc_id)
        assert r["rank"] == len(got[r.symbol])
    assert got == expected and len(got["HOT"]) > 100
    assert news.news_dedup_all(frame.filter("false")).collect() == []
    limited = [r.doc_id for r in news.news_dedup(frame.filter("symbol = 'HOT'")).orderBy("rank").collect()]
    assert limited == expected["HOT"][:20]


def test_registered_stories_have_no_limit(spark, tmp_path, monkeypatch):
    from tickerloom.plans import score_queries

    rows = [("ACME", k, f"acme news {k}", f"u{k}") for k in range(60)]
    frame = spark.createDataFrame(rows, "symbol string, doc_id int, title string, url string").selectExpr(
        "*", "'' as description", "'' as content", "'2026' as published_at", "named_struct('name', 'n') as source"
    )
    monkeypatch.setattr(score_queries.views, "news", lambda *_: frame)
    monkeypatch.setattr(score_queries, "terms", lambda *_: spark.sql("select 'ACME' as symbol, array('acme') as terms"))
    assert score_queries.news_dedup(spark, "").count() == 60


def test_symbols_of_long_keys_stay_apart(spark):
    keys = spark.sql("select explode(array(7L, 12345678901L, 12345678902L, 123456789012L)) as k")
    rows = keys.selectExpr("k", f"{views.symbol_of('k')} as symbol").selectExpr("k", f"{views.KEY_OF_SYMBOL} as back", "symbol").collect()
    assert all(r.k == r.back for r in rows) and len({r.symbol for r in rows}) == 4
    assert rows[0].symbol.startswith("S0000000007")


def test_damaged_store_file_fails_and_a_batch_replaces_itself(spark, tmp_path):
    from pathlib import Path

    from tickerloom.sources import store

    path = str(tmp_path / "store")
    rows = spark.sql(
        "select 'IN' as market_code, 'cpi' as indicator, 1.5D as value, '2026-01' as observation_date, 's' as source,"
        " true as is_policy_rate, timestamp_ntz'2026-01-01' as cached_at"
    )
    assert store.read_store(spark, path).count() == 0
    for batch in (0, 0, 1):
        store.save_good_observations(rows, path, batch)
    assert store.read_store(spark, path).count() == 2
    next(Path(path).rglob("*.parquet")).write_bytes(b"broken")
    with pytest.raises(Exception):  # noqa: B017
        store.read_store(spark, path).collect()


def test_rewritten_table_shows_its_new_schema(spark, tmp_path):
    from tickerloom.sources.tables import table

    folder = str(tmp_path)
    spark.sql("select 1 as a").write.parquet(f"{folder}/t.parquet")
    assert table(spark, folder, "t").columns == ["a"]
    import time

    time.sleep(1.1)
    spark.sql("select 1 as b").write.mode("overwrite").parquet(f"{folder}/t.parquet")
    assert table(spark, folder, "t").columns == ["b"]


def test_quotes_and_backslashes_in_literal_tables(spark):
    from tickerloom.functions.literals import literal_table

    values = [("it's",), ("a\\b",), ("\\'",)]
    assert [tuple(r) for r in literal_table(spark, values, "v string").collect()] == values


def test_folds_stay_in_the_row(spark, sf):
    text = plan(price_queries.ema_series(spark, sf))
    assert "Pandas" not in text and "Python" not in text
    from tickerloom.plans import macro_queries

    text = plan(macro_queries.sora_table_extract(spark, sf))
    assert text.count("Scan parquet") == 1 and "Exchange" not in text


@pytest.mark.parametrize("name", ["indicator_priority", "macro_combined", "sector_macro"])
def test_macro_reads_the_orders_once(spark, sf, name):
    from tickerloom.plans.catalog import all_queries

    text = plan(all_queries()[name](spark, sf))
    assert text.count("FileScan parquet [o_custkey") == 1
    assert text.count("Exchange hashpartitioning") <= 3


def test_last_arrivals_as_whole_rows_equal_one_fold_a_column(spark, sf):
    """Bars of chart payloads are not held in hash tables of twelve numbers a row; the result stays."""
    rows = [("S1", k % 5, seq, *[None if (k + c) % 4 == 0 else float(k * 10 + c) for c in range(5)]) for k, seq in enumerate([*range(40), None, None])]
    raw = spark.createDataFrame(rows, "symbol string, ts int, seq long, open double, high double, low double, close double, volume double")
    whole, folded = B.bars_clean(raw, in_place=True), B.bars_clean(raw)
    assert whole.columns == folded.columns and sorted(map(repr, whole.collect())) == sorted(map(repr, folded.collect()))
    text = plan(price_queries.bars_from_chart_json(spark, sf))
    assert "SortAggregate(key=[symbol" in text and "partial_max_by(close#" not in text
