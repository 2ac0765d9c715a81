"""DuckDB text with the same meaning as each registered query, for checking results."""

from tickerloom.oracle.compose import oracle_queries

__all__ = ["oracle_queries"]
