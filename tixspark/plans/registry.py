"""Registry of named queries: Spark builder + optional DuckDB oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..functions.numeric import python_round_sql

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None) -> Callable[[QueryFn], QueryFn]:
    def deco(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name!r}")
        QUERIES[name] = fn
        if sql is not None:
            # The reference rounds like Python; so does the oracle.
            ORACLES[name] = python_round_sql(sql)
        return fn

    return deco


def load_all() -> None:
    """Import every plan module so its queries register."""
    from . import audit, dashboard, detail, evaluation, ingest, intelligence, routing, search, text_jobs, vectors  # noqa: F401
    from . import stored, records  # noqa: F401  (use the SQL of the others)
    from ..streaming import feed  # noqa: F401
    from ..streaming import live  # noqa: F401  (uses the SQL of feed)
