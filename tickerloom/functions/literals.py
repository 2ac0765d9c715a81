"""Fixed configuration rows as local relations (a few rows each, so always cheap to broadcast)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def _sql(value) -> str:
    if value is None:
        return "null"
    if isinstance(value, bool):
        return str(value).lower()
    if isinstance(value, float):
        return f"{value!r}D"
    if isinstance(value, int):
        return str(value)
    if isinstance(value, list):
        return "array(" + ", ".join(_sql(v) for v in value) + ")"
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def literal_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """Rows as ``VALUES`` cast to ``schema`` (``"name type, ..."``): Catalyst sees their true size."""
    fields = [f.strip().split(" ", 1) for f in schema.split(", ")]
    values = ", ".join("(" + ", ".join(_sql(v) for v in row) + ")" for row in rows)
    names = ", ".join(name for name, _ in fields)
    casts = ", ".join(f"cast({name} as {kind}) as {name}" for name, kind in fields)
    return spark.sql(f"select {casts} from values {values} as t({names})")
