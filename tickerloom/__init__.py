"""Bulk equity scoring on Spark: bars, fundamentals, news and macro data in, one score per symbol out."""

from tickerloom.session import build_session, shared_folder

__all__ = ["build_session", "shared_folder"]
