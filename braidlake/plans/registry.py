"""The registered queries, each with the same in SQL where SQL can express it."""

from __future__ import annotations

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(text: str | None):
    """Register a function (spark, folder of tables) under its name, with its SQL."""

    def add(f):
        if f.__name__ in QUERIES:
            raise ValueError(f"{f.__name__} is registered twice")
        QUERIES[f.__name__] = f
        if text:
            SQL[f.__name__] = text
        return f

    return add
