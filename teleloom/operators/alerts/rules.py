"""Alert rule vocabulary and validation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Signals, operators, severities and limits of a rule.
LATENCY_SIGNALS = {"latency_p50": 0.5, "latency_p90": 0.9, "latency_p99": 0.99}
METRIC_SIGNALS = ["metric_avg", "metric_max"]
SIGNALS = [*LATENCY_SIGNALS, "error_rate", "request_volume", "log_count", *METRIC_SIGNALS]
OPERATORS = ["gt", "gte", "lt", "lte", "eq"]
SEVERITIES = ["info", "warning", "critical"]
SEVERITY_FLOORS = {"TRACE": 1, "DEBUG": 5, "INFO": 9, "WARN": 13, "ERROR": 17, "FATAL": 21}
DEFAULT_FLOOR = 17
MIN_WINDOW_S, MAX_WINDOW_S, MAX_FOR_S = 30, 86_400, 86_400
LEAST_EVALUATED_WINDOW_S = 60


def _blank(column: str) -> Column:
    return F.trim(F.coalesce(column, F.lit(""))) == ""


def validate_rules(rules: DataFrame) -> DataFrame:
    """Adds ``reject_reason``: the first problem of a rule, null for a valid one."""
    needs_metric = F.col("signal_type").isin(METRIC_SIGNALS)
    bad_floor = (
        (F.col("signal_type") == "log_count")
        & ~_blank("signal_param")
        & ~F.upper("signal_param").isin(list(SEVERITY_FLOORS))
    )
    reason = (
        F.when(_blank("rule_name"), "rule_name is required")
        .when(~F.col("signal_type").isin(SIGNALS), "signal_type is not supported")
        .when(needs_metric & _blank("signal_param"), "signal_param must name a metric")
        .when(bad_floor, "signal_param is not a severity")
        .when(~F.col("operator").isin(OPERATORS), "operator is not supported")
        .when(~F.col("severity").isin(SEVERITIES), "severity is not supported")
        .when(~F.col("window_seconds").between(MIN_WINDOW_S, MAX_WINDOW_S), "window_seconds is out of range")
        .when(~F.col("for_seconds").between(0, MAX_FOR_S), "for_seconds is out of range")
    )
    return rules.withColumn("reject_reason", reason)


def severity_floor(name: Column) -> Column:
    """Lowest severity number a log rule counts; ERROR when blank or unknown."""
    out = F.lit(None).cast("int")
    for text, number in SEVERITY_FLOORS.items():
        out = F.when(F.upper(name) == text, number).otherwise(out)
    return F.coalesce(out, F.lit(DEFAULT_FLOOR))


def breached(operator: Column, observed: Column, threshold: Column) -> Column:
    return (
        F.when(operator == "gt", observed > threshold)
        .when(operator == "gte", observed >= threshold)
        .when(operator == "lt", observed < threshold)
        .when(operator == "lte", observed <= threshold)
        .when(operator == "eq", observed == threshold)
        .otherwise(F.lit(False))
    )
