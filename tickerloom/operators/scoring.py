"""Module scores in [-1, +1] and their combination into one score per symbol, as row-wise SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickerloom.functions.bands import INTELLIGENCE_CLASSES, classified
from tickerloom.functions.numeric import clamp, named, rounded

# Module weights; return -> (scale, weight); band scores of the fundamental metrics.
MODULE_WEIGHTS = {
    "fundamental": 0.30,
    "technical": 0.20,
    "sentiment": 0.15,
    "historical": 0.15,
    "sector_macro": 0.20,
}
RETURN_SCALES = {
    "one_month_return": (20.0, 0.20),
    "three_month_return": (30.0, 0.30),
    "six_month_return": (40.0, 0.25),
    "one_year_return": (50.0, 0.25),
}
_GROWTH_BANDS = "when {0} >= 10 then 1D when {0} > 0 then 0.5D when {0} <= -10 then -1D when {0} is not null then -0.5D"
# A negative forward P/E falls into the "up to 40" band, as that rule is stated.
METRIC_BANDS = {
    "profit_margin": "when {0} >= 10 then 1D when {0} > 0 then 0.5D when {0} is not null then -1D",
    "return_on_equity": "when {0} >= 15 then 1D when {0} >= 5 then 0.5D when {0} >= 0 then 0D"
    " when {0} is not null then -1D",
    "revenue_growth": _GROWTH_BANDS,
    "earnings_growth": _GROWTH_BANDS,
    "forward_pe": "when {0} > 0 and {0} <= 25 then 1D when {0} <= 40 then 0.25D"
    " when {0} is not null then -0.5D",
    "debt_to_equity": "when {0} <= 100 then 0.5D when {0} <= 200 then 0D when {0} is not null then -0.5D",
    "free_cash_flow": "when {0} > 0 then 1D when {0} is not null then -1D",
}


def _module(name: str, available: str, score: str, quality: str) -> list[str]:
    """Score, availability and quality columns; an unavailable module scores 0 with quality 0."""
    known = f"coalesce({available}, false)"
    return [
        f"case when {known} then {rounded(clamp(f'({score})'), 3)} else 0D end as {name}_score",
        f"{known} as {name}_available",
        f"case when {known} then {rounded(quality, 2)} else 0D end as {name}_quality",
    ]


def technical_columns() -> list[str]:
    return _module("technical", "net_score is not null", "net_score / 6", "1D")


def sentiment_columns() -> list[str]:
    """From ``article_count`` and ``headline_score`` (the sentiment score of the headlines)."""
    return _module(
        "sentiment",
        "article_count > 0 and headline_score is not null",
        "headline_score",
        "least(article_count / 5, 1D)",
    )


def historical_columns() -> list[str]:
    """Scaled returns weighted over those available, less a penalty for volatility and drawdown."""
    total = " + ".join(
        f"coalesce({clamp(f'({n} / {scale}D)')} * {w}D, 0D)" for n, (scale, w) in RETURN_SCALES.items()
    )
    weight = " + ".join(
        f"case when {n} is null then 0D else {w}D end" for n, (_, w) in RETURN_SCALES.items()
    )
    penalty = (
        "(case when annualized_volatility > 75 then -0.2D when annualized_volatility > 50 then -0.1D"
        " else 0D end + case when maximum_drawdown < -50 then -0.2D"
        " when maximum_drawdown < -30 then -0.1D else 0D end)"
    )
    return [
        *_module(
            "historical", f"({weight}) > 0", f"try_divide({total}, {weight}) + {penalty}", f"({weight})"
        ),
        f"case when ({weight}) > 0 then {rounded(penalty, 2)} end as risk_penalty",
    ]


def fundamental_columns() -> list[str]:
    """Mean of the banded metrics present; quality is the share of metrics present."""
    metrics = ", ".join(f"case {bands.format(name)} end" for name, bands in METRIC_BANDS.items())
    known = f"filter(array({metrics}), x -> x is not null)"
    total = f"aggregate({known}, 0D, (a, x) -> a + x)"
    return _module(
        "fundamental",
        f"size({known}) > 0",
        f"try_divide({total}, size({known}))",
        f"size({known}) / {len(METRIC_BANDS)}",
    )


def sector_macro_columns() -> list[str]:
    return _module(
        "sector_macro",
        "sector_macro_score is not null and available_sector_weight <> 0",
        "sector_macro_score",
        "coalesce(macro_confidence_score, 0D)",
    )


def _scored(rows: DataFrame, columns: list[str]) -> DataFrame:
    return rows.selectExpr("*", *columns)


def score_technical(rows: DataFrame) -> DataFrame:
    return _scored(rows, technical_columns())


def score_sentiment(rows: DataFrame) -> DataFrame:
    return _scored(rows, sentiment_columns())


def score_historical(rows: DataFrame) -> DataFrame:
    return _scored(rows, historical_columns())


def score_fundamental(rows: DataFrame) -> DataFrame:
    return _scored(rows, fundamental_columns())


def score_sector_macro(rows: DataFrame) -> DataFrame:
    """The module score takes the name, and the place, of the sector score it is made from."""
    return rows.selectExpr("* except (sector_macro_score)", *sector_macro_columns())


def combine(rows: DataFrame) -> DataFrame:
    """Weighted mean over the available modules; coverage and confidence are plain weight sums."""

    def over_available(value: str) -> str:
        return "(" + " + ".join(
            f"case when {n}_available then {value.format(name=n)} * {w}D else 0D end"
            for n, w in MODULE_WEIGHTS.items()
        ) + ")"

    total, weight = over_available("{name}_score"), over_available("1D")
    score = f"coalesce({rounded(f'try_divide({total}, {weight})', 3)}, 0D)"
    return rows.selectExpr(
        "*",
        f"{score} as intelligence_score",
        f"{rounded(weight, 2)} as coverage_ratio",
        f"{rounded(over_available('{name}_quality'), 2)} as confidence_score",
        *[
            f"case when {n}_available then {rounded(f'{n}_score * {w}D', 3)} end as {n}_contribution"
            for n, w in MODULE_WEIGHTS.items()
        ],
    ).selectExpr("*", f"{classified('intelligence_score', INTELLIGENCE_CLASSES)} as classification")


def intelligence_score(report: DataFrame) -> DataFrame:
    """All five module scores and their combination, inside the row."""
    return combine(
        report.selectExpr(
            "* except (sector_macro_score)",
            *fundamental_columns(),
            *technical_columns(),
            *sentiment_columns(),
            *historical_columns(),
            *sector_macro_columns(),
        )
    )


def intelligence_rank(scored: DataFrame, k: int) -> DataFrame:
    """Top ``k`` symbols by score: each task keeps its own top ``k``, nothing is sorted in full."""
    return scored.orderBy(F.col("intelligence_score").desc(), "symbol").limit(k)


def module_scores(scored: DataFrame) -> DataFrame:
    """Nested form: one row per symbol with a struct per module, as a report presents it."""
    modules = {
        n: f"struct({n}_score as score, {n}_available as is_available, {n}_quality as quality_factor,"
        f" {w}D as weight, {n}_contribution as weighted_contribution)"
        for n, w in MODULE_WEIGHTS.items()
    }
    return scored.selectExpr(
        "symbol",
        "company_name",
        "sector",
        "intelligence_score",
        "classification",
        "coverage_ratio",
        "confidence_score",
        f"struct({', '.join(named(modules))}) as module_scores",
        "errors",
    )


def report_chart_series(scored: DataFrame) -> DataFrame:
    """Chart points per symbol: module scores (0 when unavailable), known returns, gauge position."""
    # Labels of the returns chart.
    labels = {
        "1 Week": "one_week_return",
        "1 Month": "one_month_return",
        "3 Months": "three_month_return",
        "6 Months": "six_month_return",
        "1 Year": "one_year_return",
    }
    gauge = rounded(f"({clamp('intelligence_score')} + 1) / 2 * 100", 2)
    points = [("module_scores", n, f"{n}_score") for n in MODULE_WEIGHTS]
    points += [("returns", label, column) for label, column in labels.items()]
    points += [("gauge", "position", gauge)]
    stacked = ", ".join(f"'{chart}', '{label}', {value}" for chart, label, value in points)
    return scored.selectExpr(
        "symbol", f"stack({len(points)}, {stacked}) as (chart, label, value)"
    ).filter("value is not null")
