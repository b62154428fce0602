"""Epoch arithmetic on nanosecond columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NS_PER_S = 1_000_000_000
MAX_PAST_NS = 3600 * NS_PER_S
MAX_FUTURE_NS = 300 * NS_PER_S


def int_div(value: Column, by: int | Column) -> Column:
    """64-bit integer quotient."""
    divisor = F.lit(by).cast("bigint") if isinstance(by, int) else by
    return F.call_function("div", value, divisor)


def bucket_start(value: Column, width: int) -> Column:
    """Start of the fixed-width bucket holding an integer value."""
    return int_div(value, width) * width


def to_seconds(time_ns: Column) -> Column:
    return int_div(time_ns, NS_PER_S)


def to_millis(time_ns: Column) -> Column:
    return int_div(time_ns, 1_000_000)


def to_micros(time_ns: Column) -> Column:
    return int_div(time_ns, 1000)


def bucket_seconds(time_ns: Column, width_s: int) -> Column:
    """Bucket start in epoch seconds for a nanosecond stamp."""
    return bucket_start(to_seconds(time_ns), width_s)


def unix_ns_to_timestamp(time_ns: Column) -> Column:
    """Nanoseconds to a timestamp, truncated to the microsecond Spark stores."""
    return F.timestamp_micros(to_micros(time_ns))


def timestamp_to_unix_ns(ts: Column) -> Column:
    return F.unix_micros(ts) * F.lit(1000).cast("bigint")


def clamp_timestamp(time_ns: Column, as_of_ns: Column) -> Column:
    """Point stamp limited to one hour before and five minutes after the arrival instant."""
    return F.least(F.greatest(time_ns, as_of_ns - MAX_PAST_NS), as_of_ns + MAX_FUTURE_NS)


def clamp_span_window(start_ns: Column, end_ns: Column, as_of_ns: Column) -> tuple[Column, Column]:
    """Move a span whose start lies outside the arrival window, keeping its duration."""
    moved = clamp_timestamp(start_ns, as_of_ns)
    inside = moved == start_ns
    duration = F.greatest(end_ns - start_ns, F.lit(0).cast("bigint"))
    return moved, F.when(inside, end_ns).otherwise(moved + duration)


def duration_ns(start_ns: Column, end_ns: Column) -> Column:
    """Elapsed nanoseconds, never negative."""
    return F.greatest(end_ns - start_ns, F.lit(0).cast("bigint"))
