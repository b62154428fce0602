"""Collects the queries with the SQL each is checked against."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from teleloom.plans.sql_views import SQL_VIEWS

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, views: Sequence[str] = ()) -> Callable[[Query], Query]:
    """Register a query; ``sql`` may use the named telemetry views as tables."""

    def add(function: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = with_views(sql, views)
        return function

    return add


def with_views(sql: str, views: Sequence[str]) -> str:
    ctes = [f"{view} AS (\n{SQL_VIEWS[view]}\n)" for view in views]
    text = sql.strip()
    for head in ("WITH RECURSIVE ", "WITH "):
        if text.startswith(head):
            return head + ",\n".join([*ctes, text[len(head):]])
    return ("WITH " + ",\n".join(ctes) + "\n" if ctes else "") + text


def rounded(df: DataFrame, places: int = 9) -> DataFrame:
    """Round every double column, finer than the exact 8-decimal grid interpolated
    nanoseconds fall on, so engines that add in another order still agree."""
    return df.select(
        *[
            F.round(field.name, places).alias(field.name) if isinstance(field.dataType, T.DoubleType) else field.name
            for field in df.schema.fields
        ]
    )


def joined(df: DataFrame, *columns: str) -> DataFrame:
    """Array columns as comma-separated text."""
    for column in columns:
        df = df.withColumn(column, F.array_join(F.col(column).cast("array<string>"), ","))
    return df
