"""Queries over the driver's tables, each with its SQL counterpart where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


class Catalog:
    """Named queries with optional oracle SQL."""

    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def add(self, sql: str | None = None, name: str | None = None):
        def register(fn: Query) -> Query:
            key = name or fn.__name__
            self.queries[key] = fn
            if sql is not None:
                self.sql[key] = sql
            return fn

        return register


def all_queries() -> Catalog:
    from ctxlens.catalog import bodies, chats, corpora, streams, traffic

    whole = Catalog()
    for part in (chats, bodies, traffic, corpora, streams):
        whole.queries.update(part.CATALOG.queries)
        whole.sql.update(part.CATALOG.sql)
    return whole
