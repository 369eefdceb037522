"""Queries on the driver's tables, and the SQL that says the same."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name."""

    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql.strip()
        return f

    return add


from . import airframes, alignment, catalogue, checking, feasible, graphs, plans, reports, signals, slicing, sources, structure  # noqa: E402, F401
