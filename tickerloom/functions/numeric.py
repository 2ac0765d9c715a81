"""Null-safe numeric SQL expressions.

Each function takes and returns SQL text for ``selectExpr``/``F.expr``: a figure made of many steps is
one expression to parse instead of dozens of separate column calls, and Catalyst sees the same tree.

Every published figure is rounded through a decimal so that a value such as 2.675 does not depend
on the last bit of a floating-point sum: two engines, or two runs that add the same numbers in a
different order, publish the same figure.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: plain decimal notation with optional exponent; NaN and infinities are not numbers here.
NUMBER_PATTERN = "^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?$"
WHITESPACE = " \\t\\r\\n"


def named(expressions: dict[str, str]) -> list[str]:
    """``name -> expression`` as a select list."""
    return [f"{text} as {name}" for name, text in expressions.items()]


def rounded(value: str, digits: int) -> str:
    """Round half up at ``digits`` places; null for NaN and infinities."""
    return f"cast(round(try_cast({value} as decimal(38,6)), {digits}) as double)"


def finite(value: str) -> str:
    """The value, or null when it is NaN or infinite."""
    return f"(case when not isnan({value}) and abs({value}) < double('Infinity') then {value} end)"


def to_number(text: str) -> str:
    """Finite number held in a text value, else null (never raises under ANSI mode)."""
    trimmed = f"btrim({text}, '{WHITESPACE}')"
    number = f"try_cast({trimmed} as double)"
    return f"(case when {trimmed} rlike '{NUMBER_PATTERN}' and abs({number}) < double('Infinity') then {number} end)"


def number_in(text: Column) -> Column:
    """:func:`to_number` of a column, for use inside lambdas."""
    trimmed = F.btrim(text, F.lit(" \t\r\n"))
    number = trimmed.try_cast("double")
    return F.when(trimmed.rlike(NUMBER_PATTERN) & (F.abs(number) < float("inf")), number)


def to_percent(ratio: str) -> str:
    return rounded(f"{finite(ratio)} * 100", 2)


def millions_to_units(value: str) -> str:
    return rounded(f"{finite(value)} * 1000000", 2)


def safe_ratio(numerator: str, denominator: str, as_percentage: bool = False) -> str:
    ratio = f"try_divide({finite(numerator)}, {finite(denominator)})"
    return rounded(f"{ratio} * 100" if as_percentage else ratio, 2)


def growth_pct(latest: str, previous: str) -> str:
    """Percentage growth; undefined unless the previous value is positive."""
    return rounded(f"(case when {previous} > 0 then {latest} / {previous} - 1 end) * 100", 2)


def per_share_total(per_share: str, shares_millions: str) -> str:
    return rounded(f"{finite(per_share)} * {finite(shares_millions)} * 1000000", 2)


def first_metric(metrics: str, names: Sequence[str]) -> str:
    """First numeric entry among alternative names of a ``map<string,string>``, 2 places."""
    entries = ", ".join(to_number(f"try_element_at({metrics}, '{n}')") for n in names)
    return rounded(f"coalesce({entries}, null)", 2)


def clamp(value: str, low: float = -1.0, high: float = 1.0) -> str:
    """Bound to [low, high]; null stays null (``greatest``/``least`` alone would skip it)."""
    return f"(case when {value} is not null then greatest({low}D, least({high}D, {value})) end)"


def non_empty(text: str) -> str:
    """Null for an empty string, so that ``coalesce`` falls through it."""
    return f"nullif({text}, '')"
