"""Written and indexed forms: components, scans, interval and index joins, stored models, bucketed modules, landed lines."""

import math
import random
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_scale import plan

from tickerloom.functions import bands
from tickerloom.functions.literals import literal_table
from tickerloom.operators import headlines, linked, lookup, macro, news, technical
from tickerloom.plans import intelligence as I
from tickerloom.plans import score_queries
from tickerloom.sources import landed, ranked, store, views
from tickerloom.streaming import feeds


@pytest.fixture
def many_runs(spark):
    """Small range partitions are not put together, as large ones would not be."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def roots(pairs):
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {x: root(x) for x in parent}


def test_components_of_paths_stars_and_chance_links(spark):
    rng = random.Random(2)
    order = rng.sample(range(3000), 3000)
    pairs = list(zip(order, order[1:]))  # one long path in no order
    pairs += [(5000, 5001 + k) for k in range(500)] + [(7000 + rng.randrange(900), 7000 + rng.randrange(900)) for _ in range(400)]
    pairs += [(9000, 9000), (-5, -7), (-7, -5)]
    found = linked.connected_components(spark.createDataFrame(pairs, "a long, b long")).collect()
    expected = roots(p for p in pairs if p[0] != p[1])
    assert {r["node"]: r["component"] for r in found} == expected
    assert linked.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def greedy(rows):
    kept, titles, urls = [], set(), set()
    for symbol, number, title, url, published, score in sorted(rows, key=lambda r: (-r[5], [-ord(c) for c in r[4]], r[1])):
        if (symbol, title) not in titles and (symbol, url) not in urls:
            titles.add((symbol, title))
            urls.add((symbol, url))
            kept.append(number)
    return kept


def test_a_long_chain_of_stories_takes_few_rounds(spark, monkeypatch):
    n, rounds = 10_000, []
    rows = [("CHAIN", k, f"t{k // 2}", f"u{(k + 1) // 2}", "2026", n + 100 - k) for k in range(n)]
    frame = spark.createDataFrame(rows, "symbol string, doc_id int, headline string, url string, published_at string, relevance_score int")
    frame = frame.selectExpr("*", "' d ' as description", "named_struct('name', 'n') as source")
    written = linked.settled
    for module in (linked, news):
        monkeypatch.setattr(module, "settled", lambda f, name: rounds.append(name) or written(f, name))
    found = news.news_dedup_all(frame).orderBy("rank").collect()
    assert [r["doc_id"] for r in found] == greedy(rows) and [r["rank"] for r in found] == list(range(1, n // 2 + 1))
    assert rounds.count("hooks") + rounds.count("news-accepted") <= 20


def folded(closes, span):
    weight, last, out = 2 / (span + 1), None, []
    for c in closes:
        last = last if c is None else c if last is None else last * (1 - weight) + c * weight
        out.append(last)
    return out


@pytest.mark.parametrize("span", [1.5, 12, 5000])
def test_series_of_any_length_equal_the_fold(spark, many_runs, span):
    rng = random.Random(7)
    series = {"LONG": 30_000, "SHORT": 3, "ONE": 1}
    closes = {s: [None if rng.random() < 0.1 else 100 + 50 * rng.random() for _ in range(n)] for s, n in series.items()}
    closes |= {"LATE": [None, None, 5.0, None, 6.0], "NONE": [None, None]}
    rows = [(s, k, c) for s, own in closes.items() for k, c in enumerate(own)]
    random.Random(1).shuffle(rows)
    bars = spark.createDataFrame(rows, "symbol string, date long, close double").repartition(6)
    found = {(r["symbol"], r["date"]): r["ema"] for r in technical.ema_series(bars, span).collect()}
    assert len(found) == len(rows)
    for s, own in closes.items():
        for k, expected in enumerate(folded(own, span)):
            got = found[s, k]
            assert got is None if expected is None else math.isclose(got, expected, abs_tol=1e-4), (s, k)


def test_a_scan_chains_segments_that_still_count(spark):
    rows = spark.range(4000).selectExpr("'x' as k", "id as i", "double(id % 7) as v")
    decay = 0.99999
    found = linked.decayed_sums(rows, "k", "i", "i", "v", decay, longest=32).orderBy("i").collect()
    state = 0.0
    for r in found:
        state = state * decay + r["v"]
        assert math.isclose(r["decayed"], state, rel_tol=1e-9, abs_tol=1e-9)


def test_a_long_series_is_sorted_and_numbered_by_many_tasks(spark, many_runs):
    bars = spark.range(200_000).selectExpr("'HOT' as symbol", "id as date", "double(100 + id % 11) as close")
    placed = linked.placed_in_order(bars, "symbol", [F.col("date")], "t")
    assert placed.select("run").distinct().count() >= 3
    assert placed.filter("position <> date").count() == 0


def test_bands_of_a_table_equal_the_compiled_ones_on_every_edge(spark):
    edges = sorted({b for rules in bands.BANDS.values() for b, *_ in rules if b is not None})
    values = [x for e in edges for x in (e, e - 1e-9, e + 1e-9)] + [-1e12, 1e12, float("nan"), float("inf"), -float("inf"), None, -0.0]
    rows = [(m, i, v) for m in ("US", "IN", "SG", "AU", "BR", None) for i in ("inflation", "gdp_growth", "unemployment", "x") for v in values]
    frame = spark.createDataFrame(rows, "market string, indicator string, v double")
    table = literal_table(spark, bands.band_rows(), bands.BAND_TABLE)
    compiled = macro.threshold_classify(frame, "market", "indicator", "v", "b").collect()
    for width in (1.0, 0.3, 50.0):
        joined = macro.threshold_classify_table(frame, table, "market", "indicator", "v", "b", width)
        assert "NestedLoop" not in plan(joined) and "Cartesian" not in plan(joined)
        assert sorted(map(repr, joined.collect())) == sorted(map(repr, compiled))


def test_mentions_equal_all_pairs(spark):
    rng = random.Random(3)
    words = ["ab", "acme", "acme steel", "é日x", "x", "zz top", "nowhere", "ACME"]
    texts = [" ".join(rng.choice(["acme", "steel", "Ab", "É日X", "zz", "top", "q"]) for _ in range(rng.randrange(6))) for _ in range(300)]
    articles = [(k, t, texts[-k] if k % 3 else None, "acme " * 50 if k % 2 else "") for k, t in enumerate(texts)]
    frame = spark.createDataFrame(articles, "doc_id int, title string, description string, content string")
    terms = spark.createDataFrame([(w,) for w in words], "term string")
    found = lookup.mentions(frame, terms)
    assert "NestedLoop" not in plan(found) and "Cartesian" not in plan(found)
    expected = set()
    for k, *places in articles:
        for w in words:
            hits = tuple(w in (p or "").lower() for p in places)
            if any(hits):
                expected.add((k, w, *hits))
    assert {tuple(r) for r in found.collect()} == expected


def test_only_runs_that_a_term_has_leave_the_articles(spark):
    rng = random.Random(4)
    texts = ["".join(rng.choice("abcdeé日 ") for _ in range(300)) for _ in range(200)] + ["x" * 70_000 + "qué", "日", "q", ""]
    articles = [(k % 150, t, None, t[::-1]) for k, t in enumerate(texts)]  # ids repeat
    frame = spark.createDataFrame(articles, "doc_id int, title string, description string, content string")
    words = ["ab", "日", "q", "é日 ", "qué", "nowhere", "xxxx"]
    found = lookup.mentions(frame, spark.createDataFrame([(w,) for w in words], "term string"))
    assert "regexp_extract_all" not in plan(found) and "array_distinct" not in plan(found)
    hits = [(k, w, w in t, False, w in c) for k, t, _, c in articles for w in words if w in t or w in c]
    assert sorted(map(tuple, found.collect())) == sorted(hits)
    lowered = frame.select("doc_id", F.lower("title").alias("title"))
    bits = lookup.named_bits(lookup.runs(spark.createDataFrame([("qué",)], "term string").select("term", F.col("term").alias("text")), "term", ("text",)))
    counts = lookup.runs(lowered, "doc_id", ("title",), bits, counted=True).groupBy("probe").agg(F.sum("n").alias("n")).collect()
    assert len(counts) == 2 and min(r["n"] for r in counts) == 1  # two runs of three bytes, the first in one text only


def test_listings_are_found_by_all_words_of_a_query(spark):
    names = ["Acme Steel Ltd", "Acme Holdings", "steel & acme", None, "", "Acme"] + [f"Group {k} Ltd" for k in range(50)]
    listed = spark.createDataFrame([(k, n, f"S{k}", None) for k, n in enumerate(names)], "listing long, name string, symbol string, display_symbol string")
    asked = spark.createDataFrame([("acme",), ("ACME steel",), ("Steel Acme",), ("ltd group",), ("missing acme",), ("&",), ("",)], "query string")
    found = lookup.search_listings(asked, listed)
    assert "NestedLoop" not in plan(found) and "Cartesian" not in plan(found)
    got = {}
    for r in found.orderBy("result_pos").collect():
        got.setdefault(r["query"], []).append(r["listing"])
    assert got == {"ACME": [5, 1, 2, 0], "ACME STEEL": [2, 0], "STEEL ACME": [2, 0], "LTD GROUP": list(range(6, 56))}


def test_reports_read_stored_models_records_and_bars(spark, sf):
    I.headline_model(spark, sf)
    before = dict(I._MODELS)
    text = score_queries.intelligence_score(spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert I._MODELS == before
    assert "l_shipdate" not in text and "toxic" not in text and "o_totalprice" in text
    assert plan(score_queries.intelligence_score(spark, sf)).count("Exchange hashpartitioning") <= 20


def test_module_tables_join_without_an_exchange(spark, sf):
    names = I.write_modules(spark, sf, buckets=3)
    report = I.from_tables(spark, names)
    text = plan(report)
    assert "Exchange" not in text and text.count("Scan parquet") == 5 and text.count("SortMergeJoin") == 4
    assert report.count() == I.assembled(spark, sf).count() > 0


def test_the_stored_classifier_beats_the_largest_class_on_held_out_headlines(spark):
    sf = "/root/testdata/sf0.01"
    labelled = I.labelled_headlines(spark, sf)
    rows = headlines.labelled_rows(labelled)
    model = headlines.fit(labelled.filter(~headlines.held_out()))
    share = rows.filter(headlines.held_out()).groupBy("label").count().agg((F.max("count") / F.sum("count"))).first()[0]
    assert headlines.accuracy(model, labelled.filter(headlines.held_out())) >= share - 0.02
    assert headlines.accuracy(model, labelled) > share
    blank = spark.createDataFrame([(1, None), (2, " "), (3, "some words")], "doc_id long, headline string")
    assert [r["sentiment"] for r in headlines.predict(model, blank).orderBy("doc_id").collect()][:2] == ["neutral", "neutral"]


def test_the_classifier_is_stored_once_and_loaded(spark, sf):
    first = I.headline_pipeline(spark, sf)
    paths = dict(I._PIPELINES)
    again = I.headline_pipeline(spark, sf)
    assert I._PIPELINES == paths and again is not first
    assert np.allclose(first.stages[-1].coefficientMatrix.toArray(), again.stages[-1].coefficientMatrix.toArray())
    assert score_queries.headline_classify(spark, sf).count() == views.news(spark, sf).count()


def test_damaged_lines_are_rejected_with_a_reason(spark, tmp_path):
    lines = ['{"a":1,"b":"x"}', '{"a":2', "", "[]", '{"a":"no number"}', '{"b":"é"}']
    (tmp_path / "one.json").write_text("\n".join(lines))
    (tmp_path / "two.json").write_text('{"a":7,"extra":1}\n')
    good, rejected = landed.json_lines(spark, str(tmp_path), "a int, b string")
    assert {(r["a"], r["b"]) for r in good.collect()} >= {(1, "x"), (None, "é"), (7, None)}
    bad = {(r["file"], r["record"]) for r in rejected.collect()}
    assert ("one.json", '{"a":2') in bad and not any(f == "two.json" for f, _ in bad)
    assert good.count() + rejected.count() == 7 and rejected.filter("reason is null").count() == 0


@pytest.mark.parametrize("limit", [1, 7, 100])
def test_a_ranked_table_opens_few_runs(spark, many_runs, tmp_path, limit):
    """A third of the rows is one symbol's; runs that no first row lies in are made unreadable before reading."""
    rows = spark.range(30_000).selectExpr(
        "case when id % 3 = 0 then 'HOT' when id % 501 = 1 then null else concat('S', id % 4) end as symbol",
        "if(id % 97 = 0, null, concat('2026-', id % 13)) as published_at",
        "id as doc_id",
    )
    path = str(tmp_path / "ranked")
    ranked.write_ranked(rows, path, "symbol", news.newest_first(), runs=60)
    found = ranked.first_rows(spark, path, "symbol", news.newest_first(), limit)
    expected = {(r["doc_id"], r["position"]) for r in news.candidate_cap(rows, limit).collect()}
    own = {r["run"] for r in spark.read.parquet(f"{path}/rows").filter(F.col("doc_id").isin([d for d, _ in expected])).select("run").distinct().collect()}
    folders = list((tmp_path / "ranked" / "rows").glob("run=*"))
    assert len(own) < 0.2 * len(folders)
    for folder in folders:
        if int(folder.name.split("=")[1]) not in own:
            for file in folder.glob("*.parquet"):
                file.write_bytes(b"not a table" * 20)
            for file in folder.glob(".*.crc"):
                file.unlink()
    assert {(r["doc_id"], r["position"]) for r in found.collect()} == expected


def test_an_empty_ranked_table(spark, tmp_path):
    rows = spark.createDataFrame([], "symbol string, published_at string, doc_id long, run_name string")
    ranked.write_ranked(rows, str(tmp_path / "none"), "symbol", news.newest_first())
    assert ranked.first_rows(spark, str(tmp_path / "none"), "symbol", news.newest_first(), 3).count() == 0


FETCHES = [  # market, time, values of inflation, gdp_growth, unemployment, policy_rate; None: the source failed
    [("US", 1, 1.0, 2.0, 3.0, 4.0), ("IN", 1, 5.0, None, 7.0, None)],
    [("US", 3, 1.3, None, 3.3, 4.3), ("IN", 3, None, None, None, None)],  # an outage
    [("IN", 2, 5.2, 6.2, None, None), ("US", 2, 1.2, 2.2, 3.2, 4.2)],  # late
    [("IN", 2, 5.2, 6.2, None, None), ("US", 2, 1.2, 2.2, 3.2, None), ("SG", 9, None, None, None, None)],  # again
]
NAMES = ["inflation", "gdp_growth", "unemployment", "policy_rate"]


def test_the_last_good_observation_survives_outages_and_replays(spark, tmp_path):
    source, path = tmp_path / "landed", str(tmp_path / "store")
    schema = f"market_code string, cached_at timestamp_ntz, observations {feeds.FETCHED}"
    expected, whole = {}, lambda values: None not in values
    for number, batch in enumerate(FETCHES):
        rows = [
            (m, datetime(2026, 1, day), [(n, v, f"2026-01-0{day}", "s", None) for n, v in zip(NAMES, values)])
            for m, day, *values in batch
        ]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(source))
        for m, day, *values in batch:
            for n, v in zip(NAMES, values):
                if v is not None and (m != "US" or whole(values)) and day >= expected.get((m, n), (0,))[0]:
                    expected[m, n] = (day, v)
        for checkpoint in ("state", "state", f"lost-{number}"):  # goes on, finds nothing new, begins anew
            stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(source))
            feeds.keep_latest_good(stream, path, str(tmp_path / checkpoint)).awaitTermination(120)
            latest = store.good_obs_latest(store.read_store(spark, path)).collect()
            assert {(r["market_code"], r["indicator"]): (r["cached_at"].day, r["value"]) for r in latest} == expected
    assert expected["US", "gdp_growth"] == (2, 2.2) and expected["IN", "unemployment"] == (1, 7.0)
