"""Every registered query against DuckDB over the whole tables."""

import pytest
from compare import difference, duck

from tickerloom.oracle import oracle_queries
from tickerloom.plans.catalog import all_queries

QUERIES, ORACLES = all_queries(), oracle_queries()


@pytest.fixture(scope="module")
def connection(sf):
    return duck(sf)


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
    assert set(QUERIES) - set(ORACLES) == {"headline_classify"}  # a trained classifier: tests/test_stores.py


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_oracle(spark, sf, connection, name):
    assert difference(QUERIES[name](spark, sf), connection, ORACLES[name]) is None


def test_model_labels_every_headline(spark, sf):
    rows = QUERIES["sentiment_predict"](spark, sf).groupBy("sentiment").count().collect()
    assert {r["sentiment"] for r in rows} <= {"positive", "neutral", "negative"}
    assert sum(r["count"] for r in rows) > 0


def test_company_sentiment_covers_every_symbol(spark, sf):
    frame = QUERIES["company_sentiment"](spark, sf)
    assert frame.count() == QUERIES["symbol_market"](spark, sf).count()
    assert frame.filter("article_count > 0").count() > 0


def test_flagship_entry_schema(spark, sf):
    import __spark_entry__ as contract

    frame = contract.entry(spark)
    assert frame.columns[0] == "symbol" and frame.count() == 10


def test_requests_are_direct_resolved_or_rejected(spark, sf):
    rows = QUERIES["intelligence_by_request"](spark, sf).groupBy("outcome").count().collect()
    assert {r["outcome"] for r in rows if r["count"] > 0} == {"direct", "resolved", "rejected"}
