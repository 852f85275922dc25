"""All queries of the core and their DuckDB counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from benchloom.plans import oracle, problems
from benchloom.plans import queries as reference
from benchloom.session import prepare

Query = Callable[[SparkSession, str], DataFrame]


def prepared(query: Query) -> Query:
    """The query on a session with the settings the operators rely on."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return query(prepare(spark), sf_dir)

    run.__name__, run.__doc__ = query.__name__, query.__doc__
    return run


def queries() -> dict[str, Query]:
    return {name: prepared(q) for name, q in (reference.QUERIES | problems.QUERIES).items()}


def oracle_sql() -> dict[str, str]:
    return oracle.SQL | problems.ORACLE_SQL
