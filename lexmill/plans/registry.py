"""All queries of the core, each with its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lexmill.plans import core, core_sql, problems, problems_sql, round_trips, round_trips_sql
from lexmill.session import ship_package


def _shipped(query: Callable) -> Callable[[SparkSession, str], DataFrame]:
    """The query, the package's Python code sent to the executors first."""

    def run(spark: SparkSession, d: str) -> DataFrame:
        ship_package(spark)
        return query(spark, d)

    run.__doc__ = query.__doc__
    return run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: _shipped(q) for name, q in {**core.QUERIES, **round_trips.QUERIES, **problems.QUERIES}.items()}


def oracle_sql() -> dict[str, str]:
    return {**core_sql.ORACLES, **round_trips_sql.ORACLES, **problems_sql.ORACLES}
