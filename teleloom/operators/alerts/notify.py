"""Notifications of firings, and the lists shown to users."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from teleloom.functions.predicates import bounded
from teleloom.functions.ranking import page, top_n
from teleloom.operators.alerts.rules import LATENCY_SIGNALS
from teleloom.scope import Scope

# Texts of a notification.
SIGNAL_TEXT = {
    "latency_p50": "p50 latency",
    "latency_p90": "p90 latency",
    "latency_p99": "p99 latency",
    "error_rate": "error rate",
    "request_volume": "request volume",
}
OPERATOR_TEXT = {"gt": ">", "gte": "≥", "lt": "<", "lte": "≤", "eq": "="}


def fan_out_notifications(firings: DataFrame, rules: DataFrame, channels: DataFrame) -> DataFrame:
    """One row per firing and enabled channel of its rule, within the tenant."""
    targets = rules.select("rule_id", F.explode("channel_ids").alias("channel_id"))
    enabled = channels.filter("enabled").select("channel_id", "tenant_id", "channel_type")
    return firings.join(targets, "rule_id").join(enabled, ["channel_id", "tenant_id"])


def _texts(column: Column, texts: dict[str, str]) -> Column:
    out = column
    for name, text in texts.items():
        out = F.when(column == name, text).otherwise(out)
    return out


def _grouped(value: Column, digits: int) -> Column:
    """Thousands separators, halves away from zero."""
    return F.format_number(F.round(value, digits), digits)


def format_value(signal: Column, value: Column) -> Column:
    return (
        F.when(signal.isin(list(LATENCY_SIGNALS)), F.concat(_grouped(value, 0), F.lit("ms")))
        .when(signal == "error_rate", F.concat(_grouped(value * 100, 2), F.lit("%")))
        .when(signal == "request_volume", _grouped(value, 0))
        .otherwise(_grouped(value, 2))
    )


def inapp_notifications(deliveries: DataFrame, rules: DataFrame) -> DataFrame:
    """Title and body of in-app deliveries of firings. Resolutions are not notified in the app."""
    about = rules.select("rule_id", "rule_name", "signal_type", "operator", "threshold")
    rows = deliveries.filter(F.col("channel_type") == "inapp").join(about, "rule_id")
    signal = F.col("signal_type")
    title = F.concat_ws(
        " ",
        _texts(signal, SIGNAL_TEXT),
        _texts(F.col("operator"), OPERATOR_TEXT),
        format_value(signal, F.col("threshold")),
    )
    body = F.concat(F.col("rule_name"), F.lit(" - observed "), format_value(signal, F.col("observed")), F.lit("."))
    return rows.select(
        "tenant_id",
        "firing_id",
        "rule_id",
        title.alias("title"),
        body.alias("body"),
        "severity",
        "observed",
        "threshold",
        signal.alias("rule_signal"),
        F.col("fired_s").alias("posted_s"),
        F.lit(None).cast("bigint").alias("acknowledged_s"),
    )


def list_firings(
    firings: DataFrame,
    rules: DataFrame,
    tenant_id: object | None = None,
    active_only: bool = False,
    page_no: int = 1,
    page_size: int | None = 50,
) -> DataFrame:
    """A page of firings with their rules, newest first, and the tenant's total; all without a page size."""
    df = Scope(tenant_id).apply(firings)
    if active_only:
        df = df.filter(F.col("resolved_s").isNull())
    rows = df.join(rules.select("rule_id", "rule_name", "signal_type"), "rule_id").select(
        "tenant_id", "firing_id", "rule_id", "rule_name", "signal_type", "fired_s", "resolved_s", "observed", "severity"
    )
    order = [F.col("fired_s").desc(), F.col("firing_id")]
    return page(rows, ["tenant_id"], order, page_no, bounded(page_size, 50))


def list_notifications(
    notifications: DataFrame, tenant_id: object | None = None, unread_only: bool = False, limit: int | None = 50
) -> DataFrame:
    """Newest in-app notifications."""
    scope = Scope(tenant_id)
    df = scope.apply(notifications)
    if unread_only:
        df = df.filter(F.col("acknowledged_s").isNull())
    return top_n(df, scope, [F.col("posted_s").desc(), F.col("firing_id")], bounded(limit, 50))
