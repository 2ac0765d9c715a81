"""Company name to listed symbol."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickerloom.functions.text import collapsed
from tickerloom.operators.joins import salted_lookup

# Words that do not identify a company; preferred symbol suffixes, best first.
IGNORED_WORDS = [
    "and",
    "co",
    "company",
    "corp",
    "corporation",
    "group",
    "holding",
    "holdings",
    "inc",
    "incorporated",
    "limited",
    "ltd",
    "of",
    "plc",
    "the",
]
PREFERRED_SUFFIXES = [".NS", ".SI", ".AX"]
PLACES = 1 << 40  # positions of a search result lie below; they are unique within a query


def company_queries(companies: DataFrame, name: str, keep: list[str]) -> DataFrame:
    """Search candidates per company, in order: the name, the name without filler words, its acronym,
    its first word; without repeats (ignoring case)."""
    cleaned = collapsed(F.col(name))
    words = F.filter(
        F.regexp_extract_all(cleaned, F.lit("[A-Za-z0-9]+"), F.lit(0)),
        lambda w: ~F.lower(w).isin(IGNORED_WORDS),
    )
    staged = companies.select(*keep, cleaned.alias("_name"), words.alias("_words"))
    acronym = F.array_join(F.transform("_words", lambda w: F.substring(w, 1, 1)), "")
    candidates = F.array(
        F.col("_name"),
        F.array_join("_words", " "),
        F.when(F.size("_words") > 1, acronym).otherwise(F.lit("")),
        F.coalesce(F.try_element_at("_words", F.lit(1)), F.lit("")),
    )

    def is_new(candidate: Column, index: Column) -> Column:
        upper = F.transform("_candidates", lambda c: F.upper(c))
        return (candidate != "") & (F.array_position(upper, F.upper(candidate)) == index + 1)

    return (
        staged.withColumn("_candidates", candidates)
        .withColumn("_unique", F.filter("_candidates", is_new))
        # the outer form: an inner one makes Spark work out every candidate once more to filter by their number
        .select(*keep, F.posexplode_outer("_unique").alias("query_pos", "query"))
        .filter(F.col("query").isNotNull())
    )


def symbol_select(listings: DataFrame) -> DataFrame:
    """Best symbol per query among its search results (``query, result_pos, symbol, display_symbol``).

    A preferred suffix outranks an exact match, which outranks the first non-empty result. The choice
    depends on the query alone, so results are reduced to one row per query before any company is
    joined: companies that share a query never multiply with its results.
    """
    symbol = F.upper(F.trim(F.coalesce("symbol", F.lit(""))))
    display = F.upper(F.trim(F.coalesce("display_symbol", F.lit(""))))
    query = F.upper("query")
    rank = F.when(symbol.endswith(PREFERRED_SUFFIXES[0]), F.lit(0))
    for position, suffix in enumerate(PREFERRED_SUFFIXES[1:], start=1):
        rank = rank.when(symbol.endswith(suffix), F.lit(position))
    rank = rank.when((symbol != "") & ((symbol == query) | (display == query)), F.lit(3)).when(
        symbol != "", F.lit(4)
    )
    ranked = listings.select(
        query.alias("query_key"), (rank * PLACES + F.col("result_pos")).alias("place"), symbol.alias("listed")
    ).filter(F.col("place").isNotNull())
    # the place is one number, so the minimum is a hash aggregate; the text is picked afterwards
    best = ranked.groupBy("query_key").agg(F.min("place").alias("place"))
    return ranked.join(best, ["query_key", "place"]).select("query_key", "listed").distinct()


def company_resolve(queries: DataFrame, best_listings: DataFrame, company: str) -> DataFrame:
    """Symbol of the first query with a listing; null when no query has one.

    Hits come first in a company's order, so its first row is the answer, found or not. Spark limits the window
    before its shuffle, so a company moves once, however many queries it has.
    """
    matched = salted_lookup(
        queries.withColumn("query_key", F.upper("query")), best_listings, ["query_key"], [company]
    )
    order = Window.partitionBy(company).orderBy(F.col("listed").isNull(), "query_pos", "listed")
    first = matched.select(company, "listed", F.row_number().over(order).alias("_place")).filter("_place = 1")
    return first.select(company, F.col("listed").alias("symbol"))
