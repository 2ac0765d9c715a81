"""Threshold bands and score classes.

A band list is read top to bottom: the first upper bound that holds wins, ``None`` is the rest.
"""

from __future__ import annotations

LT, LE = "<", "<="


def _target_range(lower: float, upper: float) -> list[tuple]:
    return [
        (0.0, LT, "deflation", -2),
        (lower, LT, "below_target_range", -1),
        (upper, LE, "within_target_range", 1),
        (upper + 2, LE, "above_target_range", -1),
        (None, None, "high_inflation", -2),
    ]


def _growth(deep: float, weak: float, strong: float, strong_op: str) -> list[tuple]:
    return [
        (deep, LT, "significant_contraction", -2),
        (0.0, LT, "mild_contraction", -1),
        (weak, LT, "weak_growth", 0),
        (strong, strong_op, "moderate_growth", 1),
        (None, None, "strong_growth", 2),
    ]


def _jobless(healthy: float, moderate: float, elevated: float) -> list[tuple]:
    return [
        (0.0, LT, "invalid_value", 0),
        (healthy, LE, "healthy_labour_market", 1),
        (moderate, LE, "moderate_unemployment", 0),
        (elevated, LE, "elevated_unemployment", -1),
        (None, None, "high_unemployment", -2),
    ]


# Country frameworks.
BANDS = {
    ("US", "inflation"): [
        (0.0, LT, "deflation", -2),
        (1.5, LT, "low_inflation", -1),
        (2.5, LE, "near_target", 1),
        (3.5, LE, "elevated_inflation", -1),
        (None, None, "high_inflation", -2),
    ],
    ("IN", "inflation"): _target_range(2.0, 6.0),
    ("SG", "inflation"): [
        (0.0, LT, "deflation", -2),
        (1.0, LT, "low_inflation", 0),
        (3.0, LE, "price_stable", 1),
        (5.0, LE, "elevated_inflation", -1),
        (None, None, "high_inflation", -2),
    ],
    ("AU", "inflation"): _target_range(2.0, 3.0),
    ("US", "gdp_growth"): _growth(-1.0, 1.0, 3.0, LE),
    ("IN", "gdp_growth"): _growth(-2.0, 4.0, 6.0, LT),
    ("SG", "gdp_growth"): _growth(-1.0, 0.3, 1.0, LE),
    ("AU", "gdp_growth"): _growth(-1.0, 0.3, 0.8, LE),
    ("US", "unemployment"): _jobless(4.5, 5.5, 7.0),
    ("IN", "unemployment"): _jobless(4.0, 6.0, 8.0),
    ("SG", "unemployment"): _jobless(2.5, 3.5, 5.0),
    ("AU", "unemployment"): _jobless(4.5, 5.5, 7.0),
}
REFERENCE_RATE_BANDS = [
    (1.5, LE, "low_rate_environment", 1),
    (3.0, LE, "moderate_rate_environment", 0),
    (5.0, LE, "high_rate_environment", -1),
    (None, None, "very_high_rate_environment", -2),
]
REAL_RATE_BANDS = [
    (-1.0, LT, "supportive_rate_environment", 1),
    (1.0, LE, "balanced_rate_environment", 0),
    (2.0, LE, "restrictive_rate_environment", -1),
    (None, None, "strongly_restrictive_rate_environment", -2),
]
# Market -> inflation target (a reference rate for SG).
INFLATION_TARGETS = [("US", 2.0), ("IN", 4.0), ("SG", 2.0), ("AU", 2.5)]
UNAVAILABLE_STATUSES = ["unavailable", "unsupported_market", "invalid_value"]

# Overall classes, highest first; (bound, is the bound included, class).
INTELLIGENCE_CLASSES = [
    (0.50, True, "strongly_favourable"),
    (0.20, True, "favourable"),
    (-0.20, False, "neutral"),
    (-0.50, False, "cautious"),
    (None, None, "unfavourable"),
]
MACRO_CLASSES = [
    (0.50, True, "favourable"),
    (0.15, True, "mildly_favourable"),
    (-0.15, False, "neutral"),
    (-0.50, False, "mildly_unfavourable"),
    (None, None, "unfavourable"),
]


BAND_TABLE = "market string, indicator string, lower double, lower_in boolean, upper double, upper_in boolean, status string, score int"


def band_rows() -> list[tuple]:
    """The bands as intervals: an end that one band leaves out, its neighbour takes in; a missing end is unbounded."""
    rows = []
    for (market, indicator), rules in BANDS.items():
        lower, lower_in = None, False
        for bound, op, status, score in rules:
            rows.append((market, indicator, lower, lower_in, bound, op == LE, status, score))
            lower, lower_in = bound, op == LT
    return rows


def _band_case(value: str, rules: list[tuple]) -> str:
    cases = " ".join(
        f"else struct('{status}' as status, {score} as score)"
        if bound is None
        else f"when {value} {op} {bound}D then struct('{status}' as status, {score} as score)"
        for bound, op, status, score in rules
    )
    return f"case {cases} end"


def band_of(value: str, market: str, indicator: str) -> str:
    """``struct<status, score>`` of the band of (market, indicator) that holds the value, null if none.

    The bands are a fixed table, so the lookup is an expression evaluated inside the row: nothing is
    joined or broadcast, whatever the number of rows.
    """
    cases = " ".join(
        f"when {market} = '{m}' and {indicator} = '{i}' then {_band_case(value, rules)}"
        for (m, i), rules in BANDS.items()
    )
    return f"case when {value} is null then null {cases} end"


def reference_rate_band(value: str) -> str:
    return f"case when {value} is not null then {_band_case(value, REFERENCE_RATE_BANDS)} end"


def real_rate_band(value: str) -> str:
    return f"case when {value} is not null then {_band_case(value, REAL_RATE_BANDS)} end"


def inflation_target(market: str) -> str:
    cases = " ".join(f"when '{m}' then {target}D" for m, target in INFLATION_TARGETS)
    return f"case {market} {cases} end"


def classified(score: str, classes: list[tuple]) -> str:
    """Class of a score, by the first bound that holds; null stays null."""
    cases = " ".join(
        f"when {score} is not null then '{name}'"
        if bound is None
        else f"when {score} {'>=' if included else '>'} {bound}D then '{name}'"
        for bound, included, name in classes
    )
    return f"(case {cases} end)"


def normalized_component(score: str) -> str:
    """Framework scores -2..2 on the -1..+1 scale; anything else is neutral."""
    return f"(case {score} when 2 then 1D when 1 then 1D when -1 then -0.5D when -2 then -1D else 0D end)"
