"""A place to name queries: the operator applied to the driver's tables, and equivalent SQL if there is any."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


class Registry:
    def __init__(self):
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def add(self, name: str, sql: str | None = None):
        """Name the decorated function ``name``; ``sql`` gives the same rows in DuckDB."""

        def named(function: Query) -> Query:
            if name in self.queries:
                raise ValueError(f"two queries are named {name}")
            self.queries[name] = function
            if sql is not None:
                self.sql[name] = sql
            return function

        return named
