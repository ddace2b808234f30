"""Registering a query with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from sensorloom.plans.views import nudged, rounded


def register(queries: dict, sql_of: dict) -> Callable:
    """A decorator that keeps a query under its function's name; doubles are rounded alike here and in the SQL."""

    def query(sql: str | None = None, digits: int = 6) -> Callable:
        def add(fn: Callable) -> Callable:
            queries[fn.__name__] = lambda spark, sf_dir: rounded(fn(spark, sf_dir), digits)
            if sql:
                sql_of[fn.__name__] = nudged(sql)
            return fn

        return add

    return query
