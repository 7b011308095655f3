"""How queries are registered, with SQL that gives the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable


def registrar() -> tuple[dict, dict, Callable]:
    """Queries by name, their SQL, and a decorator that adds a function to them under its name."""
    queries: dict[str, Callable] = {}
    oracle_sql: dict[str, str] = {}

    def query(sql: str | None = None):
        def add(f: Callable) -> Callable:
            queries[f.__name__] = f
            if sql:
                oracle_sql[f.__name__] = sql
            return f

        return add

    return queries, oracle_sql, query
