"""Price bars: building, cleaning, period selection, provider fallback, latest snapshot."""

from __future__ import annotations

import re
from datetime import date, timedelta

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickerloom.functions.numeric import named, rounded

PRICE_COLUMNS = ["open", "high", "low", "close", "volume"]
# Length of a period unit in days.
PERIOD_UNIT_DAYS = {"d": 1, "wk": 7, "mo": 31, "y": 366}


def bars_from_trades(trades: DataFrame, key: str = "symbol") -> DataFrame:
    """Daily bars per ``key``. Every aggregate is combinable before the shuffle, so one hot symbol-day
    or symbol costs no more than its number of map tasks; a symbol then has at most one bar per
    calendar day. A short numeric key, where there is one, keeps strings out of the raw scan."""
    return trades.groupBy(key, F.col("ts").cast("date").alias("date")).agg(
        F.min_by("price", "seq").alias("open"),
        F.max("price").alias("high"),
        F.min("price").alias("low"),
        F.max_by("price", "seq").alias("close"),
        F.sum("quantity").alias("volume"),
    )


def bars_clean(raw: DataFrame, in_place: bool = False) -> DataFrame:
    """Rows with a close, last arrival per (symbol, ts).

    One ``max_by`` per column keeps the aggregation buffer primitive, so Spark hash-aggregates and
    pre-combines repeated timestamps instead of sorting them. Rows that lie by symbol already are not shuffled again,
    and a task would hold them in two such tables at once, twelve numbers each: ``in_place`` takes the last arrival as
    one row, which Spark sorts (and spills) once.
    """
    missing = [c for c in ["symbol", "ts", "seq", *PRICE_COLUMNS] if c not in raw.columns]
    if missing:
        raise ValueError("Bars are missing columns: " + ", ".join(missing))
    grouped = raw.filter(F.col("close").isNotNull()).groupBy("symbol", "ts")
    if in_place:
        return grouped.agg(F.max_by(F.struct(*PRICE_COLUMNS), "seq").alias("bar")).select("symbol", "ts", "bar.*")
    return grouped.agg(*[F.max_by(c, "seq").alias(c) for c in PRICE_COLUMNS])


def period_start(period: str, as_of: str) -> date:
    """First day of a period such as ``2y``, ``6mo``, ``10d``, ``ytd`` or ``max`` ending at ``as_of``."""
    end, text = date.fromisoformat(as_of), period.strip().lower()
    if text == "max":
        return date(1970, 1, 1)
    if text == "ytd":
        return date(end.year, 1, 1)
    match = re.fullmatch(r"(\d+)(d|wk|mo|y)", text)
    if match is None:
        raise ValueError(f"Unsupported period: {period}")
    return end - timedelta(days=int(match[1]) * PERIOD_UNIT_DAYS[match[2]])


def bars_period(rows: DataFrame, period: str, as_of: str, column: str = "ts") -> DataFrame:
    """Rows of the period: plain bounds on the stored column, so they reach the file scan."""
    kind = dict(rows.dtypes)[column]
    start = F.lit(period_start(period, as_of).isoformat()).cast(kind)
    return rows.filter((F.col(column) >= start) & (F.col(column) <= F.lit(as_of).cast(kind)))


def bars_with_fallback(primary: DataFrame, fallback: DataFrame, source_names: tuple[str, str]) -> DataFrame:
    """Primary provider's cleaned bars where it has any, else the fallback's, tagged with the source."""

    def tagged(bars: DataFrame, priority: int) -> DataFrame:
        return bars.withColumns(
            {
                "priority": F.lit(priority),
                "data_source": F.lit(source_names[priority]),
                "is_fallback": F.lit(priority > 0),
            }
        )

    best = F.min("priority").over(Window.partitionBy("symbol"))
    return (
        tagged(primary, 0)
        .unionByName(tagged(fallback, 1))
        .withColumn("best", best)
        .filter(F.col("priority") == F.col("best"))
        .drop("priority", "best")
    )


def latest_snapshot(bars: DataFrame) -> DataFrame:
    """Latest bar per symbol, prices at 2 places, whole volume, date as text."""
    last = bars.groupBy("symbol").agg(
        F.max("date").alias("date"), *[F.max_by(c, "date").alias(c) for c in PRICE_COLUMNS]
    )
    return last.selectExpr(
        "symbol",
        "date_format(date, 'yyyy-MM-dd') as date",
        *[f"{rounded(c, 2)} as {c}" for c in PRICE_COLUMNS[:4]],
        "cast(volume as bigint) as volume",
    )


def numbered(bars: DataFrame) -> DataFrame:
    """Bars with their age (0 = latest), previous close and running maximum close.

    The shared base of all indicators: one exchange by symbol and one sort. Indicators that only need
    the latest value are then conditional aggregates by age, instead of sliding windows evaluated for
    every bar. A symbol's group is bounded by the calendar (one bar per day).
    """
    in_order = Window.partitionBy("symbol").orderBy("date")
    return bars.withColumns(
        {
            "bar_no": F.row_number().over(in_order),
            "previous_close": F.lag("close").over(in_order),
            "running_max": F.max("close").over(
                in_order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
            ),
            "bar_count": F.count("*").over(Window.partitionBy("symbol")),
        }
    ).withColumn("age", F.col("bar_count") - F.col("bar_no"))


def per_symbol(bars: DataFrame, aggregates: dict[str, str]) -> DataFrame:
    """Named aggregates per symbol, all in one pass."""
    return bars.groupBy("symbol").agg(*[F.expr(text) for text in named(aggregates)])
