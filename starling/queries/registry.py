"""Queries by name; each takes (spark, sf_dir). A query with SQL can be checked against another engine."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def rounded(df, *columns: str, digits: int = 6):
    from pyspark.sql import functions as F

    return df.withColumns({c: F.round(F.col(c), digits) for c in columns})
