"""Consumer and error-page reads over the hourly rollups.

Inputs are state rows of ``CONSUMER_HOURLY`` or ``STATUS_HOURLY``; the time range applies to the
bucket start, so a partly covered first hour is left out.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from teleloom.functions.predicates import ANONYMOUS, bounded, display_consumer, ratio, stored_consumer
from teleloom.functions.ranking import top_n, top_n_by
from teleloom.functions.timing import bucket_start, int_div
from teleloom.operators.rollups import CONSUMER_HOURLY, MAX, MIN, STATUS_HOURLY, SUM, latency_ms, merge
from teleloom.scope import Scope

HOUR_S = 3600
P3 = {"p50_ms": 0.5, "p90_ms": 0.9, "p99_ms": 0.99}
P2 = {"p50_ms": 0.5, "p99_ms": 0.99}
ROUTE = ["service_name", "http_route"]


def _consumer_states(states: DataFrame, scope: Scope, consumer: str | None, service: str | None = None) -> DataFrame:
    df = scope.apply_bucket(states, "bucket_s")
    if consumer is not None:
        df = df.filter(F.col("consumer_id") == stored_consumer(consumer))
    if service is not None:
        df = df.filter(F.col("service_name") == service)
    return df


def _error_rate() -> Column:
    return ratio(F.col("error_count"), F.col("request_count")).alias("error_rate")


def list_consumers(
    states: DataFrame, scope: Scope = Scope(), service: str | None = None, limit: int | None = 100
) -> DataFrame:
    """Most active consumers with volume, errors, latency, routes used and hours seen."""
    keys = ["tenant_id", "consumer_id"]
    seen = [("first_seen_s", MIN), ("last_seen_s", MAX)]
    df = _consumer_states(states, scope, None, service)
    df = df.withColumn("first_seen_s", F.col("bucket_s")).withColumn("last_seen_s", F.col("bucket_s"))
    grouped = merge(CONSUMER_HOURLY, df, keys, seen)
    # Routes by consumer: both sides of the join end up dealt by consumer already.
    used = df.filter(F.col("http_route").isNotNull()).groupBy(*keys, "http_route").agg(F.lit(1).alias("_used"))
    routes = used.groupBy(*keys).agg(F.count("_used").alias("_routes"))
    grouped = grouped.join(routes, keys, "left").withColumn("distinct_routes", F.coalesce("_routes", F.lit(0).cast("bigint")))
    top = top_n(grouped, scope, [F.col("request_count").desc(), F.col("consumer_id")], bounded(limit, 100))
    return top.select(
        "tenant_id",
        display_consumer(F.col("consumer_id")).alias("consumer_id"),
        "request_count",
        "error_count",
        _error_rate(),
        "client_error_count",
        "server_error_count",
        *latency_ms(P3),
        "distinct_routes",
        "first_seen_s",
        "last_seen_s",
    )


def consumer_timeseries(
    states: DataFrame, scope: Scope = Scope(), consumer: str | None = None, bucket_s: int = HOUR_S
) -> DataFrame:
    """Volume, errors and latency per consumer and bucket (an hour at least)."""
    width = max(HOUR_S, bucket_s)
    df = _consumer_states(states, scope, consumer).withColumn("bucket_s", bucket_start(F.col("bucket_s"), width))
    merged = merge(CONSUMER_HOURLY, df, ["tenant_id", "consumer_id", "bucket_s"])
    return merged.select(
        "tenant_id",
        display_consumer(F.col("consumer_id")).alias("consumer_id"),
        "bucket_s",
        "request_count",
        "error_count",
        "client_error_count",
        "server_error_count",
        *latency_ms(P3),
    ).orderBy("tenant_id", "consumer_id", "bucket_s")


def _busiest_routes(df: DataFrame, limit: int | None) -> DataFrame:
    order = [F.col("request_count").desc(), *[F.col(c) for c in ROUTE]]
    return top_n_by(df, ["tenant_id", "consumer_id"], order, bounded(limit, 20))


def consumer_top_routes(
    states: DataFrame, scope: Scope = Scope(), consumer: str | None = None, limit: int | None = 20
) -> DataFrame:
    """Busiest routes of a consumer, or of every consumer."""
    merged = merge(
        CONSUMER_HOURLY, _consumer_states(states, scope, consumer), ["tenant_id", "consumer_id", *ROUTE]
    )
    return _busiest_routes(merged, limit).select(
        "tenant_id",
        display_consumer(F.col("consumer_id")).alias("consumer_id"),
        *ROUTE,
        "request_count",
        "error_count",
        _error_rate(),
        *latency_ms(P3),
    )


def consumer_routes_sparkline(
    states: DataFrame, scope: Scope, consumer: str | None = None, limit: int | None = 20
) -> DataFrame:
    """Busiest routes with request counts per hour of the range; hours outside are left out."""
    hours = max(1, math.ceil(scope.seconds_long / HOUR_S))
    first_hour = scope.start_s // HOUR_S * HOUR_S
    keys = ["tenant_id", "consumer_id", *ROUTE]
    df = _consumer_states(states, scope, consumer)
    slot = int_div(F.col("bucket_s") - first_hour, HOUR_S).cast("int")
    # Hours of the busiest routes only; the range bounds their number.
    busiest = _busiest_routes(merge(CONSUMER_HOURLY, df, keys), limit)
    hourly = df.groupBy(*keys, slot.alias("slot")).agg(F.sum("request_count").alias("n")).groupBy(*keys)
    by_hour = hourly.agg(F.map_from_entries(F.collect_list(F.struct("slot", "n"))).alias("_by_hour"))
    per_route = busiest.join(by_hour, keys)
    spark_line = F.transform(
        F.sequence(F.lit(0), F.lit(hours - 1)),
        lambda i: F.coalesce(F.try_element_at(F.col("_by_hour"), i), F.lit(0).cast("bigint")),
    )
    return per_route.select(
        "tenant_id",
        display_consumer(F.col("consumer_id")).alias("consumer_id"),
        *ROUTE,
        "request_count",
        "error_count",
        _error_rate(),
        *latency_ms(P2),
        spark_line.alias("hourly_requests"),
    )


# ---------------------------------------------------------------------------- errors page


def route_status_breakdown(
    states: DataFrame, scope: Scope = Scope(), service: str | None = None, limit: int | None = 50
) -> DataFrame:
    """Status classes per route, the routes with most failed requests first."""
    df = scope.apply_bucket(states, "bucket_s")
    if service is not None:
        df = df.filter(F.col("service_name") == service)
    code = F.col("http_status_code")
    classes = {
        "status_2xx": code.between(200, 299),
        "status_3xx": code.between(300, 399),
        "status_4xx": code.between(400, 499),
        "status_5xx": code >= 500,
    }
    for name, inside in classes.items():
        df = df.withColumn(name, F.when(inside, F.col("request_count")).otherwise(F.lit(0).cast("bigint")))
    grouped = merge(STATUS_HOURLY, df, ["tenant_id", *ROUTE], [(name, SUM) for name in classes])
    grouped = grouped.filter(F.col("request_count") > 0)
    failed = F.col("status_4xx") + F.col("status_5xx")
    order = [failed.desc(), F.col("request_count").desc(), *[F.col(c) for c in ROUTE]]
    return top_n(grouped, scope, order, bounded(limit, 50)).select(
        "tenant_id",
        *ROUTE,
        "request_count",
        "status_2xx",
        "status_3xx",
        "status_4xx",
        "status_5xx",
        ratio(failed, F.col("request_count")).alias("error_rate"),
        *latency_ms(P2),
    )


def route_status_codes(
    states: DataFrame, scope: Scope = Scope(), service: str | None = None, route: str | None = None
) -> DataFrame:
    """Exact status codes of a route, or of every route."""
    df = scope.apply_bucket(states, "bucket_s")
    if service is not None:
        df = df.filter(F.col("service_name") == service)
    if route is not None:
        df = df.filter(F.col("http_route") == route)
    keys = ["tenant_id", *ROUTE]
    merged = merge(STATUS_HOURLY, df, [*keys, "http_status_code"])
    return merged.select(*keys, "http_status_code", "request_count", *latency_ms(P2)).orderBy(
        *keys, F.col("request_count").desc(), "http_status_code"
    )


# ---------------------------------------------------------------------------- page summaries


def consumer_totals(listed: DataFrame) -> DataFrame:
    """Totals over a consumer list and the share of anonymous requests."""
    anonymous = F.when(F.col("consumer_id") == ANONYMOUS, F.col("request_count")).otherwise(0)
    return listed.groupBy("tenant_id").agg(
        F.count(F.lit(1)).alias("consumers"),
        F.sum("request_count").alias("requests"),
        F.sum("error_count").alias("errors"),
        ratio(F.sum(anonymous), F.sum("request_count")).alias("anonymous_share"),
    )


SORT_COLUMNS = {"req": "request_count", "err": "error_count", "errRate": "error_rate", "p99": "p99_ms"}


def consumer_search_sort(listed: DataFrame, text: str = "", sort: str = "req") -> DataFrame:
    """Filter a consumer list by text and order it; an unknown order means by requests."""
    needle = text.strip().lower()
    if needle:
        listed = listed.filter(F.contains(F.lower("consumer_id"), F.lit(needle)))
    return listed.orderBy("tenant_id", F.col(SORT_COLUMNS.get(sort, "request_count")).desc(), "consumer_id")


def consumer_status_stack(timeseries: DataFrame) -> DataFrame:
    """Successful, 4xx and 5xx requests per bucket, plus the totals of the whole range."""
    both = F.col("client_error_count") + F.col("server_error_count")
    keys = ["tenant_id", "consumer_id"]
    totals = timeseries.groupBy(*keys).agg(
        F.sum("request_count").alias("total_requests"),
        F.sum("error_count").alias("total_errors"),
        F.sum("client_error_count").alias("total_4xx"),
        F.sum("server_error_count").alias("total_5xx"),
    )
    stack = timeseries.select(
        *keys,
        "bucket_s",
        F.greatest(F.lit(0).cast("bigint"), F.col("request_count") - both).alias("success"),
        F.col("client_error_count").alias("status_4xx"),
        F.col("server_error_count").alias("status_5xx"),
    )
    return stack.join(totals, keys)


def errors_totals(breakdown: DataFrame) -> DataFrame:
    """Totals over a route breakdown and its worst route."""
    failed = F.col("status_4xx") + F.col("status_5xx")
    by_name = F.struct(F.col("service_name"), F.col("http_route"))
    badness = F.struct((-failed).alias("f"), (-F.col("request_count")).alias("r"), by_name.alias("n"))
    grouped = breakdown.groupBy("tenant_id").agg(
        F.sum("request_count").alias("requests"),
        F.sum("status_4xx").alias("status_4xx"),
        F.sum("status_5xx").alias("status_5xx"),
        F.min(badness).alias("_worst"),
    )
    return grouped.select(
        "tenant_id",
        "requests",
        "status_4xx",
        "status_5xx",
        ratio(failed, F.col("requests")).alias("error_rate"),
        F.col("_worst.n.service_name").alias("worst_service"),
        F.col("_worst.n.http_route").alias("worst_route"),
    )
