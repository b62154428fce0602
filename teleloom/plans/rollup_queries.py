"""Rollup tables and reads over them.

Latency states are checked through the values read from them: the middle of the magnitude slice that the
nearest rank lies in, by the same rule in SQL.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from teleloom.operators import rollups
from teleloom.plans.registry import joined, query, rounded
from teleloom.plans.span_queries import MONTH
from teleloom.sources import views

P3 = {"p50_ms": 0.5, "p90_ms": 0.9, "p99_ms": 0.99}


def disc(p: float, name: str) -> str:
    """Middle of the slice of the smallest value with at least this share of values up to it."""
    number = f"quantile_disc(CAST(floor(ln(1 + duration_ns) * {rollups.SLICES_PER_E}) AS BIGINT), {p})"
    return f"round(floor(exp(({number} + 0.5) / {rollups.SLICES_PER_E}) - 0.5) / 1e6, 9) AS {name}"


DISC3 = f"{disc(0.5, 'p50_ms')}, {disc(0.9, 'p90_ms')}, {disc(0.99, 'p99_ms')}"
MINUTE = "// 1000000000 // 60 * 60"
HOUR = "// 1000000000 // 3600 * 3600"


def _with_latency(states):
    return rounded(states.select("*", *rollups.latency_ms(P3)).drop("latency_counts"))


@query(
    "rollup_spans_minutely",
    f"""SELECT tenant_id, start_time_unix_ns {MINUTE} AS bucket_s, service_name, span_kind, count(*) AS request_count,
               count(*) FILTER (status_code = 'ERROR') AS error_count, {DISC3}
        FROM spans GROUP BY 1, 2, 3, 4""",
    ["spans"],
)
def _(spark, sf):
    return _with_latency(rollups.partials(rollups.SPANS_MINUTELY, views.spans(spark, sf)))


CONSUMER_SQL = f"""SELECT tenant_id, start_time_unix_ns {HOUR} AS bucket_s, consumer_id, service_name, http_route,
       count(*) AS request_count, count(*) FILTER (status_code = 'ERROR') AS error_count,
       count(*) FILTER (http_status_code BETWEEN 400 AND 499) AS client_error_count,
       count(*) FILTER (http_status_code >= 500) AS server_error_count, {DISC3},
       CAST(0 AS BIGINT) AS bytes_in, CAST(0 AS BIGINT) AS bytes_out
FROM spans WHERE span_kind = 'SERVER' GROUP BY 1, 2, 3, 4, 5"""


@query("rollup_consumer_hourly", CONSUMER_SQL, ["spans"])
def _(spark, sf):
    return _with_latency(rollups.partials(rollups.CONSUMER_HOURLY, views.spans(spark, sf)))


@query(
    "rollup_status_hourly",
    f"""SELECT tenant_id, start_time_unix_ns {HOUR} AS bucket_s, service_name, http_route, http_status_code,
               count(*) AS request_count, {DISC3}
        FROM spans WHERE span_kind = 'SERVER' AND http_status_code > 0 GROUP BY 1, 2, 3, 4, 5""",
    ["spans"],
)
def _(spark, sf):
    return _with_latency(rollups.partials(rollups.STATUS_HOURLY, views.spans(spark, sf)))


@query(
    "rollup_logs_minutely",
    f"""SELECT tenant_id, time_unix_ns {MINUTE} AS bucket_s, service_name, severity_text, count(*) AS log_count
        FROM logs GROUP BY 1, 2, 3, 4""",
    ["logs"],
)
def _(spark, sf):
    return rollups.partials(rollups.LOGS_MINUTELY, views.logs(spark, sf))


@query(
    "rollup_metrics_minutely",
    f"""SELECT tenant_id, time_unix_ns {MINUTE} AS bucket_s, service_name, metric_name, metric_kind,
               'flag,status' AS attrs_keys, attr_flag || ',' || attr_status AS attrs_values,
               arg_max(coalesce(value_double, value_int, 0), struct_pack(t := time_unix_ns,
                       v := coalesce(value_double, value_int, 0))) AS value_last,
               max(coalesce(value_double, value_int, 0)) AS value_max,
               min(coalesce(value_double, value_int, 0)) AS value_min, count(*) AS point_count
        FROM metric_points WHERE metric_kind <> 'HISTOGRAM' GROUP BY 1, 2, 3, 4, 5, 6, 7""",
    ["metric_points"],
)
def _(spark, sf):
    states = rollups.partials(rollups.METRICS_MINUTELY, views.metric_points(spark, sf))
    return joined(states.withColumn("value_last", F.col("value_last.value")).drop("attrs_hash"), "attrs_keys", "attrs_values")


@query(
    "merge_rollup",
    f"""SELECT tenant_id, consumer_id, count(*) AS request_count,
               count(*) FILTER (status_code = 'ERROR') AS error_count,
               count(*) FILTER (http_status_code BETWEEN 400 AND 499) AS client_error_count,
               count(*) FILTER (http_status_code >= 500) AS server_error_count, {DISC3},
               CAST(0 AS BIGINT) AS bytes_in, CAST(0 AS BIGINT) AS bytes_out
        FROM spans WHERE span_kind = 'SERVER' GROUP BY 1, 2""",
    ["spans"],
)
def _(spark, sf):
    states = rollups.partials(rollups.CONSUMER_HOURLY, views.spans(spark, sf))
    return _with_latency(rollups.merge(rollups.CONSUMER_HOURLY, states, ["tenant_id", "consumer_id"]))


@query(
    "rollup_latency_from_minutely",
    f"""SELECT tenant_id, start_time_unix_ns {HOUR} AS bucket_s, count(*) AS request_count,
               count(*) FILTER (status_code = 'ERROR') AS error_count, {DISC3}
        FROM spans GROUP BY 1, 2""",
    ["spans"],
)
def _(spark, sf):
    states = rollups.partials(rollups.SPANS_MINUTELY, views.spans(spark, sf))
    return rounded(rollups.latency_from_minutely(states, MONTH, bucket_s=3600))


@query("compact_rollup", CONSUMER_SQL, ["spans"])
def _(spark, sf):
    # Two batches leave two state rows for many keys; compaction merges them to the grain again.
    rows = views.spans(spark, sf)
    first = rollups.partials(rollups.CONSUMER_HOURLY, rows.filter("http_method = 'GET'"))
    second = rollups.partials(rollups.CONSUMER_HOURLY, rows.filter("http_method <> 'GET'"))
    return _with_latency(rollups.merge(rollups.CONSUMER_HOURLY, first.unionByName(second)))
