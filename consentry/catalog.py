"""All queries over the driver's tables by name, and SQL for each that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
_queries: dict[str, Query] = {}
_sql: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query and its SQL twin."""

    def put(f: Query) -> Query:
        _queries[name] = f
        if sql:
            _sql[name] = sql
        return f

    return put


def _load() -> None:
    from .plans import evaluation, loops, more, names, policies, rest, texts  # noqa: F401  they register their queries


def queries() -> dict[str, Query]:
    _load()
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_sql)
