"""Latest macro observations from published series and records."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickerloom.functions.numeric import rounded, to_number

# Month names in calendar order.
MONTH_NAMES = [
    "January",
    "February",
    "March",
    "April",
    "May",
    "June",
    "July",
    "August",
    "September",
    "October",
    "November",
    "December",
]
_MONTHS = "array(" + ", ".join(f"'{m}'" for m in MONTH_NAMES) + ")"
_YEAR_PATTERN, _QUARTER_PATTERN = "^([0-9]{4})-([0-9]{2})$", "^[Qq]([1-4])$"


def latest_by_key(
    rows: DataFrame,
    keys: list[str],
    values: list[str],
    order: str,
    tie: str | None = None,
    first_wins: bool = True,
) -> DataFrame:
    """The row with the greatest ``order`` per key; among equals the first (or last) by ``tie``.

    Two combinable steps with numeric buffers instead of one over a struct: Spark can hash-aggregate
    both before each shuffle, so no group is ever sorted or held in one task.
    """
    if tie is not None:
        pick = F.min_by if first_wins else F.max_by
        rows = rows.groupBy(*keys, order).agg(*[pick(v, tie).alias(v) for v in values])
    return rows.groupBy(*keys).agg(
        F.max(order).alias(order), *[F.max_by(v, order).alias(v) for v in values]
    )


def series_latest(observations: DataFrame) -> DataFrame:
    """Newest observation per series, 4 places."""
    return latest_by_key(observations, ["series_id"], ["value"], "date").selectExpr(
        "series_id",
        f"{rounded('value', 4)} as value",
        "date_format(date, 'yyyy-MM-dd') as observation_date",
    )


def inflation_yoy(observations: DataFrame) -> DataFrame:
    """Year-on-year change of the newest observation against exactly one year earlier.

    Matching is by date, not by row offset: a gap gives no result. Dates are unique per series, so a
    series is bounded by the calendar and one exchange serves the window and the aggregate.
    """
    newest = F.max("date").over(Window.partitionBy("series_id"))
    return (
        observations.withColumn("latest_date", newest)
        .groupBy("series_id", "latest_date")
        .agg(
            F.expr("max(case when date = latest_date then value end) as latest"),
            F.expr("max(case when date = add_months(latest_date, -12) then value end) as base"),
        )
        .filter("base <> 0")
        .selectExpr(
            "series_id",
            f"{rounded('(latest / base - 1) * 100', 2)} as value",
            "date_format(latest_date, 'yyyy-MM-dd') as observation_date",
            "date_format(add_months(latest_date, -12), 'yyyy-MM-dd') as comparison_date",
            f"{rounded('latest', 4)} as latest_cpi",
            f"{rounded('base', 4)} as year_ago_cpi",
        )
    )


def annual_latest(observations: DataFrame) -> DataFrame:
    """Newest non-empty annual figure per country and indicator: the fallback observation."""
    present = observations.filter("value is not null")
    return latest_by_key(present, ["country_code", "indicator"], ["value"], "year").selectExpr(
        "country_code",
        "indicator",
        f"{rounded('value', 2)} as value",
        "cast(year as string) as observation_date",
        "'annual' as frequency",
        "true as is_fallback",
    )


def monthly_latest(records: DataFrame, first_wins: bool) -> DataFrame:
    """Newest month per publisher; ``first_wins`` decides between records of the same month. Records
    without a usable year, month name or value drop out."""
    year = "case when trim(year) rlike '^[+-]?[0-9]+$' then try_cast(trim(year) as int) end"
    month = f"nullif(int(array_position({_MONTHS}, month)), 0)"
    usable = records.selectExpr(
        "publisher",
        "seq",
        f"{to_number('value')} as value",
        f"({year}) * 12 + {month} - 1 as period",
    ).filter("value is not null and period is not null")
    latest = latest_by_key(usable, ["publisher"], ["value"], "period", "seq", first_wins)
    return latest.selectExpr(
        "publisher",
        f"{rounded('value', 2)} as value",
        "format_string('%d-%02d', period div 12, period % 12 + 1) as observation_date",
        f"element_at({_MONTHS}, int(period % 12 + 1)) as month",
        "period div 12 as year",
    )


def general_price_latest(records: DataFrame) -> DataFrame:
    """Headline inflation: the general division only, first record of a month wins."""
    return monthly_latest(records.filter("division = 'CPI (General)'"), first_wins=True)


def unemployment_latest(records: DataFrame) -> DataFrame:
    """Unemployment: a later record replaces an earlier one of the same month."""
    return monthly_latest(records, first_wins=False)


def fiscal_gdp_latest(records: DataFrame) -> DataFrame:
    """Newest fiscal quarter (``YYYY-YY``, ``Qn``) of the growth indicator; first record wins."""

    def part(column: str, pattern: str, group: int) -> str:
        return f"try_cast(regexp_extract({column}, '{pattern}', {group}) as int)"

    start, quarter = part("fiscal_year", _YEAR_PATTERN, 1), part("quarter", _QUARTER_PATTERN, 1)
    usable = (
        records.filter("indicator = 'GDP Growth Rate'")
        .selectExpr(
            "publisher",
            "seq",
            f"{to_number('value')} as value",
            f"{part('fiscal_year', _YEAR_PATTERN, 2)} as end_year",
            f"{start} * 4 + {quarter} - 1 as period",
        )
        .filter("value is not null and period is not null")
    )
    latest = latest_by_key(usable, ["publisher"], ["value", "end_year"], "period", "seq")
    return latest.selectExpr(
        "publisher",
        f"{rounded('value', 2)} as value",
        "format_string('%d-%02d-Q%d', period div 4, end_year, period % 4 + 1) as observation_date",
        "format_string('%d-%02d', period div 4, end_year) as fiscal_year",
        "bigint(period % 4 + 1) as quarter",
    )


def table_cells_latest(cells: DataFrame) -> DataFrame:
    """Newest cell per table and indicator. A key is a month (``yyyy MMM``) or a quarter (``yyyy nQ``);
    other keys drop out. Months order by year * 12 + month, quarters by year * 4 + quarter."""
    packed = "replace(key, ' ', '')"
    dated = cells.selectExpr(
        "*",
        "try_to_date(key, 'yyyy MMM') as month",
        f"case when {packed} rlike '^[0-9]{{4}}[1-4]' then int(substring({packed}, 1, 4)) * 4"
        f" + int(substring({packed}, 5, 1)) - 1 end as quarter",
    ).selectExpr(
        "series_id",
        "indicator",
        "value",
        "month is not null as is_monthly",
        "coalesce(year(month) * 12 + month(month) - 1, quarter) as period",
    )
    usable = dated.filter("period is not null")
    return latest_by_key(usable, ["series_id", "indicator"], ["value", "is_monthly"], "period").selectExpr(
        "series_id",
        "indicator",
        f"{rounded('value', 2)} as value",
        "if(is_monthly, format_string('%d-%02d', period div 12, period % 12 + 1),"
        " format_string('%d-Q%d', period div 4, period % 4 + 1)) as observation_date",
    )
