"""All registered queries by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tickerloom.plans import fundamental_queries, macro_queries, price_queries, score_queries


def all_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    registered: dict[str, Callable] = {}
    for module in (price_queries, fundamental_queries, macro_queries, score_queries):
        registered.update(module.QUERIES)
    return registered
