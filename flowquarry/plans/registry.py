"""Where queries and the SQL for the same rows are registered."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from flowquarry.sources.flows import FLOWS_SQL

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None, flows: bool = True) -> Callable[[Query], Query]:
    """Register a function under its name; ``sql`` may use the flow view, and starts with ``,`` to add expressions."""

    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = f"{FLOWS_SQL} {sql}" if flows else sql
        return f

    return register
