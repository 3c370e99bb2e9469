"""Registered queries: a Spark function and, where SQL can say it, the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register under the function's name. A trailing underscore, which keeps a query apart
    from the operator it exercises, is not part of the name."""

    def register(fn: Query) -> Query:
        name = fn.__name__.rstrip("_")
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def rounded(c: Column | str, digits: int = 6) -> Column:
    """Rounded for comparison. The small offset keeps exact decimal ties off the boundary."""
    column = F.col(c) if isinstance(c, str) else c
    return F.round(column.cast("double") + F.lit(1.234 * 10.0 ** -(digits + 2)), digits)


def sql_rounded(expression: str, digits: int = 6) -> str:
    return f"round(CAST({expression} AS DOUBLE) + 1.234e-{digits + 2}, {digits})"


def with_rounded(df: DataFrame, *names: str, digits: int = 6) -> DataFrame:
    return df.withColumns({n: rounded(n, digits) for n in names})
