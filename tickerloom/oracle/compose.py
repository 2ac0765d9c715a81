"""Assembles oracle queries from named common table expressions."""

from __future__ import annotations

import re
from functools import cache


@cache
def _library() -> dict[str, str]:
    from tickerloom.oracle import fundamentals, macro, news, pages, prices, scoring, views

    library: dict[str, str] = {}
    for module in (views, prices, macro, pages, fundamentals, news, scoring):
        library.update(module.CTES)
    return library


def _needed(text: str, found: dict[str, str]) -> None:
    for word in dict.fromkeys(re.findall(r"[a-z_][a-z_0-9]*", text)):
        body = _library().get(word)
        if body is not None and word not in found:
            found[word] = ""
            _needed(body, found)
            del found[word]
            found[word] = body


def with_ctes(text: str) -> str:
    """Prefix a query with the expressions it names, dependencies first."""
    found: dict[str, str] = {}
    _needed(text, found)
    if not found:
        return text
    ctes = ",\n".join(f"{name} as ({body})" for name, body in found.items())
    return f"with {ctes}\n{text}"


def oracle_queries() -> dict[str, str]:
    from tickerloom.oracle import fundamentals, macro, news, pages, prices, scoring

    queries: dict[str, str] = {}
    for module in (prices, macro, pages, fundamentals, news, scoring):
        queries.update({key: with_ctes(text) for key, text in module.QUERIES.items()})
    return queries
