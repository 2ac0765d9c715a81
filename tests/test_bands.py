"""Band edges from both sides, for every framework."""

import pytest

from tickerloom.functions import bands
from tickerloom.operators import macro as M

EPS = 1e-6


def _expected(rules, value):
    for bound, op, status, score in rules:
        if bound is None or (value <= bound if op == bands.LE else value < bound):
            return status, score


CASES = [
    (market, indicator, value)
    for (market, indicator), rules in bands.BANDS.items()
    for bound, *_ in rules
    if bound is not None
    for value in (bound - EPS, bound, bound + EPS)
]


def test_all_edges(spark):
    frame = spark.createDataFrame(CASES, "market_code string, indicator string, rate double")
    got = M.threshold_classify(frame, "market_code", "indicator", "rate", "band").collect()
    assert len(got) == len(CASES)
    for r in got:
        assert (r.band_status, r.band_score) == _expected(bands.BANDS[(r.market_code, r.indicator)], r.rate), r


# market, rate, inflation, is policy rate -> status, score
MONETARY = [
    ("US", -0.1, 2.0, 1, "negative_rate_environment", 1),
    ("SG", -0.1, 2.0, 0, "negative_rate_environment", 1),
    ("SG", 1.5, 2.0, 1, "low_rate_environment", 1),
    ("SG", 3.0, None, 0, "moderate_rate_environment", 0),
    ("AU", 5.0, 2.0, 0, "high_rate_environment", -1),
    ("AU", 5.01, 2.0, None, "very_high_rate_environment", -2),
    ("AU", 5.0, None, 1, "rate_available_inflation_unavailable", 0),
    ("IN", 3.0, 4.01, 1, "supportive_rate_environment", 1),
    ("IN", 3.0, 4.0, 1, "balanced_rate_environment", 0),
    ("IN", 5.0, 4.0, 1, "balanced_rate_environment", 0),
    ("IN", 6.0, 4.0, 1, "restrictive_rate_environment", -1),
    ("US", 6.01, 4.0, 1, "strongly_restrictive_rate_environment", -2),
    ("US", None, 4.0, 1, "unavailable", 0),
    ("BR", 3.0, 4.0, 1, "unsupported_market", 0),
    (None, 3.0, 4.0, 1, "unsupported_market", 0),
]


def test_monetary_branches(spark):
    frame = spark.createDataFrame(
        [(i, *case[:4]) for i, case in enumerate(MONETARY)],
        "i int, market_code string, monetary_rate double, inflation_rate double, monetary_rate_is_policy_rate int",
    )
    got = M.interpret_monetary_rate(frame).orderBy("i").collect()
    assert [(r.monetary_environment_status, r.monetary_environment_score) for r in got] == [
        case[4:] for case in MONETARY
    ]


@pytest.mark.parametrize(
    "classes,edges",
    [
        (bands.INTELLIGENCE_CLASSES, [0.5, 0.499, 0.2, 0.199, -0.199, -0.2, -0.499, -0.5]),
        (bands.MACRO_CLASSES, [0.5, 0.499, 0.15, 0.149, -0.149, -0.15, -0.499, -0.5]),
    ],
)
def test_score_classes(spark, classes, edges):
    names = [name for *_, name in classes]
    frame = spark.createDataFrame([(i, s) for i, s in enumerate([*edges, None])], "i int, score double")
    got = frame.selectExpr("i", f"{bands.classified('score', classes)} as c").orderBy("i").collect()
    assert [r.c for r in got] == [names[0], names[1], names[1], names[2], names[2], names[3], names[3], names[4], None]


def test_missing_components_leave_the_mean(spark):
    frame = spark.sql(
        "select 'IN' as market_code, 'India' as country, 4.0D as inflation_rate, cast(null as double) as"
        " monetary_rate, 7.0D as gdp_growth_rate, -1.0D as unemployment_rate, 1 as monetary_rate_is_policy_rate,"
        " 0 as inflation_is_cached, 0 as policy_rate_is_cached, 1 as gdp_is_fallback, 0 as unemployment_is_cached"
    )
    got = M.macro_combined(frame).first()
    assert (got.combined_macro_score, got.coverage_ratio, got.confidence_score) == (1.0, 0.6, 0.48)
    assert (got.unemployment_status, got.unemployment_available) == ("invalid_value", False)
    assert got.classification == "favourable"
