"""Named queries, each with its SQL twin where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


class Catalog:
    def __init__(self) -> None:
        self.QUERIES: dict[str, Query] = {}
        self.ORACLE: dict[str, str] = {}

    def query(self, sql: str | None = None) -> Callable[[Query], Query]:
        def add(f: Query) -> Query:
            self.QUERIES[f.__name__] = f
            if sql is not None:
                self.ORACLE[f.__name__] = sql
            return f

        return add
