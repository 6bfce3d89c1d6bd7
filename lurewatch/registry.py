"""All registered queries and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None) -> Callable:
    """Registers a query, with SQL for the oracle where SQL can say it."""

    def keep(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = oracle
        return f

    return keep


from .plans import catalogue_queries, identity_queries, message_queries, registry_queries, source_queries, stream_queries, supply_queries, table_queries  # noqa: E402, F401
