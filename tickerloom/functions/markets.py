"""Markets: detection from a symbol suffix, and the fixed configuration tables as DataFrames.

All tables here are literals of a few rows, so broadcasting them is safe at any data size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickerloom.functions.literals import literal_table

# Symbol suffix -> market.
SUFFIX_MARKETS = [(".NS", "IN"), (".BO", "IN"), (".SI", "SG"), (".AX", "AU")]
DEFAULT_MARKET = "US"

# Market, country, currency.
MARKETS = [
    ("US", "United States", "USD"),
    ("IN", "India", "INR"),
    ("SG", "Singapore", "SGD"),
    ("AU", "Australia", "AUD"),
]

# Market, series group, series name, series symbol.
MARKET_SERIES = [
    ("US", "indices", "broad_market", "^GSPC"),
    ("US", "indices", "technology", "^IXIC"),
    ("US", "currencies", "dollar_index", "DX-Y.NYB"),
    ("US", "volatility", "volatility", "^VIX"),
    ("US", "bond_yield", "bond_yield", "^TNX"),
    ("US", "commodities", "crude_oil", "CL=F"),
    ("US", "commodities", "gold", "GC=F"),
    ("IN", "indices", "broad_market", "^NSEI"),
    ("IN", "indices", "banking", "^NSEBANK"),
    ("IN", "currencies", "usd_local", "INR=X"),
    ("IN", "volatility", "volatility", "^INDIAVIX"),
    ("IN", "commodities", "crude_oil", "CL=F"),
    ("IN", "commodities", "gold", "GC=F"),
    ("SG", "indices", "broad_market", "^STI"),
    ("SG", "currencies", "usd_local", "SGD=X"),
    ("SG", "commodities", "crude_oil", "CL=F"),
    ("SG", "commodities", "gold", "GC=F"),
    ("AU", "indices", "broad_market", "^AXJO"),
    ("AU", "currencies", "usd_local", "AUDUSD=X"),
    ("AU", "commodities", "crude_oil", "CL=F"),
    ("AU", "commodities", "gold", "GC=F"),
]

# Market -> publisher per indicator.
MACRO_PUBLISHERS = [
    ("US", "FRED", "FRED", "FRED", "FRED"),
    ("IN", "RBI", "MOSPI", "MOSPI", "WORLD_BANK"),
    ("SG", "MAS", "SINGSTAT", "SINGSTAT", "SINGSTAT"),
    ("AU", "RBA", "ABS", "ABS", "ABS"),
]

# US series id, indicator, name, unit, frequency.
US_SERIES = [
    ("FEDFUNDS", "policy_rate", "Federal Funds Effective Rate", "percent", "monthly"),
    ("CPIAUCSL", "cpi", "Consumer Price Index for All Urban Consumers", "index", "monthly"),
    ("UNRATE", "unemployment", "Unemployment Rate", "percent", "monthly"),
    ("A191RL1Q225SBEA", "gdp_growth", "Real GDP Growth", "percent", "quarterly"),
]

# Symbol -> preferred search name and matching terms.
NEWS_OVERRIDES = [
    ("TSLA", "Tesla", ["tesla", "tsla"]),
    ("NVDA", "NVIDIA", ["nvidia", "nvda"]),
    (
        "RELIANCE.NS",
        "Reliance Industries",
        ["reliance industries", "reliance retail", "reliance jio", "ril"],
    ),
    ("INFY.NS", "Infosys", ["infosys", "infy"]),
    ("D05.SI", "DBS Group", ["dbs group", "dbs bank"]),
    (
        "CBA.AX",
        "Commonwealth Bank",
        ["commonwealth bank", "commonwealth bank of australia", "cba"],
    ),
    ("S63.SI", "ST Engineering", ["st engineering", "singapore technologies engineering"]),
]

# Sector -> weight of inflation, GDP growth, unemployment, monetary environment.
SECTOR_WEIGHTS = [
    ("Technology", 0.15, 0.30, 0.15, 0.40),
    ("Financial Services", 0.15, 0.30, 0.20, 0.35),
    ("Energy", 0.10, 0.45, 0.15, 0.30),
    ("Basic Materials", 0.15, 0.45, 0.15, 0.25),
    ("Consumer Cyclical", 0.20, 0.35, 0.30, 0.15),
    ("Consumer Defensive", 0.35, 0.20, 0.25, 0.20),
    ("Real Estate", 0.15, 0.20, 0.15, 0.50),
    ("Utilities", 0.20, 0.15, 0.15, 0.50),
    ("Healthcare", 0.25, 0.20, 0.30, 0.25),
    ("Industrials", 0.15, 0.40, 0.25, 0.20),
    ("Communication Services", 0.20, 0.30, 0.20, 0.30),
]
DEFAULT_SECTOR_WEIGHT = 0.25


def detect_market(symbol: Column) -> Column:
    """Market of a symbol by its suffix; unknown suffixes are US, empty input is null."""
    cleaned = F.upper(F.trim(symbol))
    market = F.when(F.length(cleaned) == 0, F.lit(None).cast("string"))
    for suffix, code in SUFFIX_MARKETS:
        market = market.when(cleaned.endswith(suffix), F.lit(code))
    return market.when(cleaned.isNotNull(), F.lit(DEFAULT_MARKET))


def markets(spark: SparkSession) -> DataFrame:
    return literal_table(spark, MARKETS, "market_code string, country string, currency string")


def market_series(spark: SparkSession) -> DataFrame:
    return literal_table(
        spark,
        MARKET_SERIES,
        "market_code string, series_group string, series_name string, series_symbol string",
    )


def macro_publishers(spark: SparkSession) -> DataFrame:
    return literal_table(
        spark,
        MACRO_PUBLISHERS,
        "market_code string, policy_rate_publisher string, inflation_publisher string,"
        " gdp_publisher string, unemployment_publisher string",
    )


def us_series(spark: SparkSession) -> DataFrame:
    return literal_table(
        spark,
        US_SERIES, "series_id string, indicator string, name string, unit string, frequency string"
    )


def news_overrides(spark: SparkSession) -> DataFrame:
    return literal_table(
        spark,
        NEWS_OVERRIDES, "symbol string, override_name string, override_terms array<string>"
    )


def sector_weights(spark: SparkSession) -> DataFrame:
    return literal_table(
        spark,
        SECTOR_WEIGHTS,
        "sector string, w_inflation double, w_gdp_growth double,"
        " w_unemployment double, w_monetary_environment double",
    )
