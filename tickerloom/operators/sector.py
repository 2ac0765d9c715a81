"""Sector view of the macro reading: the same components under sector weights."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickerloom.functions.bands import MACRO_CLASSES, classified
from tickerloom.functions.markets import DEFAULT_SECTOR_WEIGHT, sector_weights
from tickerloom.functions.numeric import named, rounded
from tickerloom.operators.macro import COMPONENTS, contributions, weighted_components


def sector_weight_join(companies: DataFrame) -> DataFrame:
    """Adds the weights of ``sector``; unknown sectors get equal weights and ``used_default_weights``."""
    weights = ", ".join(f"w_{n}" for n in COMPONENTS)
    joined = companies.join(F.broadcast(sector_weights(companies.sparkSession)), "sector", "left")
    return joined.selectExpr(
        f"* except ({weights})",
        "w_inflation is null as used_default_weights",
        *[f"coalesce(w_{n}, {DEFAULT_SECTOR_WEIGHT}D) as w_{n}" for n in COMPONENTS],
    )


def sector_macro(companies_with_macro: DataFrame) -> DataFrame:
    """From rows with ``sector`` and the macro component columns: sector score, weight, class."""
    weights = {n: f"w_{n}" for n in COMPONENTS}
    score, weight = weighted_components(weights)
    columns = {
        "sector_macro_score": rounded(score, 3),
        "available_sector_weight": rounded(weight, 2),
        **contributions(weights, "sector_"),
    }
    # The sector classes share the bounds and names of the macro classes.
    return (
        sector_weight_join(companies_with_macro)
        .selectExpr("*", *named(columns))
        .selectExpr("*", f"{classified('sector_macro_score', MACRO_CLASSES)} as sector_classification")
    )
