"""Country macro readings: source priority, features, interpretation and the combined score."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickerloom.functions.bands import (
    MACRO_CLASSES,
    UNAVAILABLE_STATUSES,
    band_of,
    classified,
    inflation_target,
    normalized_component,
    real_rate_band,
    reference_rate_band,
)
from tickerloom.functions.markets import MARKETS, detect_market
from tickerloom.functions.numeric import named, rounded

INDICATORS = ["policy_rate", "inflation", "gdp_growth", "unemployment"]
COMPONENTS = ["inflation", "gdp_growth", "unemployment", "monetary_environment"]
# Component weights and the quality of a fallback GDP figure.
COMPONENT_WEIGHTS = dict(zip(COMPONENTS, [0.30, 0.30, 0.20, 0.20]))
FALLBACK_GDP_QUALITY = 0.6
OBSERVATION = [
    "market_code",
    "indicator",
    "value",
    "observation_date",
    "source",
    "is_policy_rate",
    "is_cached",
    "is_fallback",
]
_MARKET = "upper(trim(market_code))"
_KNOWN = f"coalesce({_MARKET} in ({', '.join(repr(code) for code, *_ in MARKETS)}), false)"
_UNAVAILABLE = "(" + ", ".join(f"'{s}'" for s in UNAVAILABLE_STATUSES) + ")"


def indicator_priority(live: DataFrame, cached: DataFrame, fallback: DataFrame) -> DataFrame:
    """:func:`prioritised` for observations that come as tables of their own, each with at most one row per
    market and indicator."""
    item = "struct(" + ", ".join(OBSERVATION[1:6]) + ") as item"
    tiers = [f.selectExpr("market_code", f"{k} as tier", item) for k, f in enumerate((live, cached, fallback))]
    lists = [F.expr(f"collect_list(item) filter (where tier = {k}) as {name}") for k, name in enumerate(TIERS)]
    return prioritised(tiers[0].unionByName(tiers[1]).unionByName(tiers[2]).groupBy("market_code").agg(*lists))


TIERS = ["live", "cached", "fallback"]


def prioritised(markets: DataFrame) -> DataFrame:
    """Per market and indicator: live, else the last good observation, else (India, all but the policy
    rate) the annual fallback. The US snapshot is all or nothing: live or cached rows of the US count only
    when all four indicators are there.

    Takes one row per market with an array of observations per tier (a handful each) and chooses inside
    the row: nothing moves.
    """
    chosen = []
    for indicator in INDICATORS:
        first = {t: f"get(filter({t}, o -> o.indicator = '{indicator}'), 0)" for t in TIERS}
        whole = {t: f"(market_code <> 'US' or size({t}) = {len(INDICATORS)})" for t in TIERS[:2]}
        option = lambda t, cached, fallback: (
            f"if({first[t]} is null, null, struct({first[t]} as item, {cached} as is_cached, {fallback} as is_fallback))"
        )
        options = [f"if({whole[t]}, {option(t, str(t == 'cached').lower(), 'false')}, null)" for t in TIERS[:2]]
        if indicator != "policy_rate":
            options.append(f"if(market_code = 'IN', {option('fallback', 'false', 'true')}, null)")
        chosen.append(f"coalesce({', '.join(options)})")
    return markets.selectExpr("market_code", f"inline(array({', '.join(chosen)}))").filter("item is not null").selectExpr(
        "market_code", "item.*", "is_cached", "is_fallback"
    )


def market_features(markets: DataFrame, observations: DataFrame) -> DataFrame:
    """One row per market: the four numeric features and quality flags (null when absent)."""

    def pick(indicator: str, value: str, name: str) -> F.Column:
        return F.expr(f"max(case when indicator = '{indicator}' then {value} end) as {name}")

    wide = observations.groupBy("market_code").agg(
        pick("inflation", "value", "inflation_rate"),
        pick("policy_rate", "value", "monetary_rate"),
        pick("gdp_growth", "value", "gdp_growth_rate"),
        pick("unemployment", "value", "unemployment_rate"),
        pick("policy_rate", "int(coalesce(is_policy_rate, true))", "monetary_rate_is_policy_rate"),
        pick("inflation", "int(is_cached)", "inflation_is_cached"),
        pick("policy_rate", "int(is_cached)", "policy_rate_is_cached"),
        pick("gdp_growth", "int(is_fallback)", "gdp_is_fallback"),
        pick("unemployment", "int(is_cached)", "unemployment_is_cached"),
    )
    return markets.select("market_code", "country").join(wide, "market_code", "left")


def by_market(symbols: DataFrame, market_rows: DataFrame) -> DataFrame:
    """Attach per-market rows to symbols. One row per configured market: always small enough to
    broadcast, and a shuffle join on so few keys would be all skew."""
    keyed = symbols.withColumn("market_code", detect_market(F.col("symbol")))
    return keyed.join(F.broadcast(market_rows), "market_code", "left")


def macro_snapshot(symbols: DataFrame, markets: DataFrame, observations: DataFrame) -> DataFrame:
    """Value, date and source of the four indicators of each symbol's market."""
    picks = [
        F.expr(f"max(case when indicator = '{i}' then {c} end) as {i}_{c}")
        for i in INDICATORS
        for c in ("value", "observation_date", "source")
    ]
    wide = observations.groupBy("market_code").agg(*picks)
    per_market = markets.select("market_code", "country").join(wide, "market_code", "left")
    return by_market(symbols.select("symbol"), per_market)


def threshold_classify(rows: DataFrame, market: str, indicator: str, value: str, prefix: str) -> DataFrame:
    """Adds ``<prefix>_status`` and ``<prefix>_score`` of the band holding ``value``; ``market``,
    ``indicator`` and ``value`` are SQL expressions."""
    return _banded(rows, band_of(value, market, indicator), prefix)


def threshold_classify_table(rows: DataFrame, bands: DataFrame, market: str, indicator: str, value: str, prefix: str, width: float = 1.0) -> DataFrame:
    """:func:`threshold_classify` with the bands as a table (``bands.BAND_TABLE``) of any size: an interval join.

    Every band is listed under the bins of ``width`` that it reaches into, unbounded ends up to one bin beyond the
    outermost finite bound, so a value meets only the bands of its bin by an equi-join, and the interval's own open or
    closed ends decide. Values that are no numbers lie above everything, as in comparisons.
    """
    ends = bands.selectExpr(f"floor(coalesce(lower, upper) / {width}D) as least", f"floor(coalesce(upper, lower) / {width}D) as most")
    edges = ends.select(F.struct((F.min("least") - 1).alias("lo"), (F.max("most") + 1).alias("hi"))).scalar()
    binned = bands.withColumn("edges", edges).selectExpr(
        "market as band_market",
        "indicator as band_indicator",
        "lower",
        "lower_in",
        "upper",
        "upper_in",
        "status",
        "score",
        f"explode(sequence(coalesce(floor(lower / {width}D), edges.lo), coalesce(floor(upper / {width}D), edges.hi))) as bin",
    )
    keyed = rows.withColumn("edges", edges).selectExpr(
        "* except (edges)",
        f"{market} as row_market",
        f"{indicator} as row_indicator",
        f"{value} as row_value",
        f"if(isnan({value}), edges.hi, greatest(edges.lo, least(edges.hi, floor({value} / {width}D)))) as row_bin",
    )
    above = "lower is null or row_value > lower or (lower_in and row_value = lower)"
    below = "upper is null or row_value < upper or (upper_in and row_value = upper)"
    on = f"row_market = band_market and row_indicator = band_indicator and row_bin = bin and ({above}) and ({below})"
    joined = keyed.join(binned, F.expr(on), "left")
    return joined.select(*[F.col(c) for c in rows.columns], F.col("status").alias(f"{prefix}_status"), F.col("score").alias(f"{prefix}_score"))


def _banded(rows: DataFrame, band: str, prefix: str) -> DataFrame:
    return rows.selectExpr("*", f"{band} as matched_band").selectExpr(
        "* except (matched_band)",
        f"matched_band.status as {prefix}_status",
        f"matched_band.score as {prefix}_score",
    )


def _settled(rows: DataFrame, prefix: str, rate: str, status: str, score: str, *extra: str) -> DataFrame:
    """Final status and score: unsupported markets and missing rates get theirs and a zero score."""
    return rows.selectExpr(
        f"* except ({prefix}_status, {prefix}_score)",
        f"case when not {_KNOWN} then 'unsupported_market' when {rate} is null then 'unavailable'"
        f" else {status} end as {prefix}_status",
        f"case when {_KNOWN} and {rate} is not null then coalesce({score}, 0) else 0 end as {prefix}_score",
        *extra,
    )


def _interpreted(rows: DataFrame, indicator: str, rate: str, *extra: str) -> DataFrame:
    banded = threshold_classify(rows, _MARKET, f"'{indicator}'", rate, indicator)
    return _settled(banded, indicator, rate, f"{indicator}_status", f"{indicator}_score", *extra)


def interpret_inflation(rows: DataFrame) -> DataFrame:
    """From ``market_code, inflation_rate``: status, score and deviation from the market's target."""
    deviation = rounded(f"inflation_rate - {inflation_target(_MARKET)}", 2)
    return _interpreted(rows, "inflation", "inflation_rate", f"{deviation} as deviation_from_target")


def interpret_gdp_growth(rows: DataFrame) -> DataFrame:
    """From ``market_code, gdp_growth_rate, gdp_is_fallback``: status, score and data quality."""
    quality = (
        f"case when {_KNOWN} and gdp_growth_rate is not null then"
        " case when gdp_is_fallback = 1 then 'fallback_source' else 'official_source' end end"
    )
    return _interpreted(rows, "gdp_growth", "gdp_growth_rate", f"{quality} as gdp_data_quality")


def interpret_unemployment(rows: DataFrame) -> DataFrame:
    """From ``market_code, unemployment_rate``: status and score; a negative rate is invalid."""
    return _interpreted(rows, "unemployment", "unemployment_rate")


def interpret_monetary_rate(rows: DataFrame) -> DataFrame:
    """From ``market_code, monetary_rate, inflation_rate, monetary_rate_is_policy_rate``.

    A negative rate is supportive as such. Singapore and market rates are judged by level, policy
    rates by the distance to inflation (the real-rate proxy), when inflation is known.
    """
    by_level = f"coalesce({_MARKET} = 'SG' or not coalesce(monetary_rate_is_policy_rate = 1, false), true)"
    proxy = rounded("monetary_rate - inflation_rate", 2)
    name = "monetary_environment"
    staged = rows.selectExpr(
        "*",
        f"case when monetary_rate >= 0 and not {by_level} and {_KNOWN} then {proxy} end as real_rate_proxy",
    )
    band = (
        f"case when {by_level} then {reference_rate_band('monetary_rate')}"
        f" else {real_rate_band('real_rate_proxy')} end"
    )
    no_inflation = f"not {by_level} and inflation_rate is null"
    return _settled(
        _banded(staged, band, name),
        name,
        "monetary_rate",
        f"case when monetary_rate < 0 then 'negative_rate_environment'"
        f" when {no_inflation} then 'rate_available_inflation_unavailable' else {name}_status end",
        f"case when monetary_rate < 0 then 1 when {no_inflation} then 0 else {name}_score end",
    )


def component_scores(features: DataFrame) -> DataFrame:
    """All four interpretations with availability, normalized score and quality per component."""
    rows = interpret_monetary_rate(
        interpret_unemployment(interpret_gdp_growth(interpret_inflation(features)))
    )
    columns = {}
    for name in COMPONENTS:
        available = f"({name}_status not in {_UNAVAILABLE})"
        quality = "1D"
        if name == "gdp_growth":
            quality = f"(case when gdp_is_fallback = 1 then {FALLBACK_GDP_QUALITY}D else 1D end)"
        columns[f"{name}_available"] = available
        columns[f"{name}_normalized"] = normalized_component(f"{name}_score")
        columns[f"{name}_quality"] = f"case when {available} then {quality} else 0D end"
    return rows.selectExpr("*", *named(columns))


def weighted_components(weights: dict[str, str]) -> tuple[str, str]:
    """Weighted mean over the available components (0 when none is) and their total weight."""
    total = " + ".join(
        f"case when {n}_available then {n}_normalized * {w} else 0D end" for n, w in weights.items()
    )
    weight = " + ".join(f"case when {n}_available then {w} else 0D end" for n, w in weights.items())
    return f"coalesce(try_divide({total}, {weight}), 0D)", f"({weight})"


def contributions(weights: dict[str, str], prefix: str = "") -> dict[str, str]:
    return {
        f"{prefix}{n}_contribution": f"case when {n}_available then {rounded(f'{n}_normalized * {w}', 3)} end"
        for n, w in weights.items()
    }


def macro_combined(features: DataFrame) -> DataFrame:
    """Combined macro score per market: weighted mean, coverage, confidence, class, contributions."""
    weights = {name: f"{w}D" for name, w in COMPONENT_WEIGHTS.items()}
    score, coverage = weighted_components(weights)
    confidence = " + ".join(f"{w} * {n}_quality" for n, w in weights.items())
    combined = {
        "combined_macro_score": rounded(score, 3),
        "coverage_ratio": rounded(coverage, 2),
        "confidence_score": rounded(f"({confidence})", 2),
        **contributions(weights),
    }
    return (
        component_scores(features)
        .selectExpr("*", *named(combined))
        .selectExpr("*", f"{classified('combined_macro_score', MACRO_CLASSES)} as classification")
    )
