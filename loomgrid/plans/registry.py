"""A module's queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable


def registry() -> tuple[dict[str, Callable], dict[str, str], Callable]:
    """Queries by name, SQL by name, and the decorator that adds to both."""
    queries: dict[str, Callable] = {}
    sql: dict[str, str] = {}

    def query(text: str | None = None):
        def add(f: Callable) -> Callable:
            queries[f.__name__] = f
            if text:
                sql[f.__name__] = text
            return f

        return add

    return queries, sql, query
