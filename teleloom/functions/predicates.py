"""The distinct error notions and small numeric rules used by the reads."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ANONYMOUS = "(anonymous)"


def is_error_status() -> Column:
    return F.col("status_code") == "ERROR"


def is_server_error() -> Column:
    """ERROR status or HTTP 5xx: overview, services, routes, map, alert rate."""
    return is_error_status() | (F.col("http_status_code") >= 500)


def is_request_error() -> Column:
    """ERROR status or HTTP 4xx/5xx: errors-only listing and consumer sparklines."""
    return is_error_status() | (F.col("http_status_code") >= 400)


def is_server_span() -> Column:
    return F.col("span_kind") == "SERVER"


def flag(condition: Column) -> Column:
    """1 when the condition holds, else 0 (null counts as 0)."""
    return F.when(condition, F.lit(1).cast("bigint")).otherwise(F.lit(0).cast("bigint"))


def ratio(numerator: Column, denominator: Column) -> Column:
    """numerator / denominator, 0 when there is nothing to divide by."""
    return F.when(denominator > 0, numerator.cast("double") / denominator.cast("double")).otherwise(F.lit(0.0))


def finite_or_zero(value: Column) -> Column:
    value = value.cast("double")
    bad = value.isNull() | F.isnan(value) | (F.abs(value) == F.lit(float("inf")))
    return F.when(bad, F.lit(0.0)).otherwise(value)


def display_consumer(consumer: Column) -> Column:
    return F.when(consumer == "", F.lit(ANONYMOUS)).otherwise(consumer)


def stored_consumer(consumer: str) -> str:
    return "" if consumer == ANONYMOUS else consumer


def bounded(limit: int | None, default: int) -> int | None:
    """A requested row limit: None means all rows, a non-positive number the default."""
    return default if limit is not None and limit <= 0 else limit
