"""Log and metric queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from teleloom.operators import logs, metrics, rollups
from teleloom.plans.registry import query, rounded
from teleloom.plans.rollup_queries import MINUTE
from teleloom.sources import views

DAY = "// 1000000000 // 60 * 60 // 86400 * 86400"


@query(
    "list_logs",
    """SELECT tenant_id, time_unix_ns, service_name, severity_text, trace_id, body,
              min(time_unix_ns) OVER (PARTITION BY tenant_id) // 1000000 AS next_cursor_ms
       FROM (SELECT *, row_number() OVER (PARTITION BY tenant_id ORDER BY time_unix_ns DESC, trace_id || span_id DESC) AS rn
             FROM logs WHERE severity_number >= 13 AND contains(lower(body), 'the')) WHERE rn <= 100""",
    ["logs"],
)
def _(spark, sf):
    rows = logs.list_logs(views.logs(spark, sf), min_severity=13, body="THE")
    return rows.select(
        "tenant_id", "time_unix_ns", "service_name", "severity_text", "trace_id", "body", "next_cursor_ms"
    )


_FATAL = "wanted AS (SELECT DISTINCT tenant_id, trace_id FROM logs WHERE severity_text = 'FATAL' AND trace_id <> '')"


@query(
    "logs_for_trace",
    f"""WITH {_FATAL} SELECT l.tenant_id, l.trace_id, l.span_id, time_unix_ns, severity_text
        FROM logs l JOIN wanted w ON l.tenant_id = w.tenant_id AND l.trace_id = w.trace_id""",
    ["logs"],
)
def _(spark, sf):
    rows = views.logs(spark, sf)
    wanted = rows.filter("severity_text = 'FATAL' AND trace_id <> ''")
    found = logs.logs_for_traces(rows, wanted)
    return found.select("tenant_id", "trace_id", "span_id", "time_unix_ns", "severity_text")


@query(
    "logs_for_trace_by_id",
    """WITH busiest AS (SELECT tenant_id AS tn, trace_id AS tr FROM logs WHERE trace_id <> '' GROUP BY 1, 2
                        ORDER BY count(*) DESC, tenant_id, trace_id LIMIT 1)
       SELECT tenant_id, trace_id, span_id, time_unix_ns, severity_text FROM logs, busiest
       WHERE tenant_id = tn AND trace_id = tr""",
    ["logs"],
)
def _(spark, sf):
    # The trace with most records in the whole table, all of them.
    rows = views.logs(spark, sf)
    counts = rows.filter("trace_id <> ''").groupBy("tenant_id", "trace_id").count()
    key = counts.orderBy(F.desc("count"), "tenant_id", "trace_id").first()
    found = logs.logs_for_trace(rows, key["tenant_id"], key["trace_id"], limit=None)
    return found.select("tenant_id", "trace_id", "span_id", "time_unix_ns", "severity_text")


@query(
    "correlate_logs_spans",
    """WITH n AS (SELECT tenant_id, trace_id, span_id, count(*) AS span_count, min(start_time_unix_ns) AS trace_start_ns
                  FROM spans WHERE trace_id <> '' GROUP BY 1, 2, 3)
       SELECT l.tenant_id, l.time_unix_ns, l.trace_id, l.span_id, l.severity_text, n.span_count, n.trace_start_ns
       FROM logs l LEFT JOIN n ON l.tenant_id = n.tenant_id AND l.trace_id = n.trace_id AND l.span_id = n.span_id
                             AND l.trace_id <> ''""",
    ["logs", "spans"],
)
def _(spark, sf):
    found = logs.correlate_logs_traces(views.logs(spark, sf), views.spans(spark, sf), by_span=True)
    return found.select("tenant_id", "time_unix_ns", "trace_id", "span_id", "severity_text", "span_count", "trace_start_ns")


_VOLUME = f"""SELECT tenant_id, time_unix_ns {DAY} AS bucket_s, severity_text, count(*) AS log_count
  FROM logs GROUP BY 1, 2, 3"""


def _log_states(spark, sf):
    return rollups.partials(rollups.LOGS_MINUTELY, views.logs(spark, sf))


@query("log_volume_timeseries", _VOLUME, ["logs"])
def _(spark, sf):
    return logs.log_volume_timeseries(_log_states(spark, sf), bucket_s=86400)


@query(
    "log_volume_pivot",
    f"""SELECT tenant_id, bucket_s,
               CAST(coalesce(sum(log_count) FILTER (severity_text = 'TRACE'), 0) AS BIGINT) AS "TRACE",
               CAST(coalesce(sum(log_count) FILTER (severity_text = 'DEBUG'), 0) AS BIGINT) AS "DEBUG",
               CAST(coalesce(sum(log_count) FILTER (severity_text = 'INFO'), 0) AS BIGINT) AS "INFO",
               CAST(coalesce(sum(log_count) FILTER (severity_text = 'WARN'), 0) AS BIGINT) AS "WARN",
               CAST(coalesce(sum(log_count) FILTER (severity_text = 'ERROR'), 0) AS BIGINT) AS "ERROR",
               CAST(coalesce(sum(log_count) FILTER (severity_text = 'FATAL'), 0) AS BIGINT) AS "FATAL", CAST(0 AS BIGINT) AS other
        FROM ({_VOLUME}) GROUP BY 1, 2""",
    ["logs"],
)
def _(spark, sf):
    return logs.log_volume_pivot(logs.log_volume_timeseries(_log_states(spark, sf), bucket_s=86400))


@query(
    "log_view",
    "SELECT tenant_id, time_unix_ns, trace_id, span_id, body, lang AS attr_lang, source AS attr_source FROM logs",
    ["logs"],
)
def _(spark, sf):
    shown = logs.log_view(views.logs(spark, sf))
    return shown.select(
        "tenant_id", "time_unix_ns", "trace_id", "span_id", "body",
        F.col("attributes")["lang"].alias("attr_lang"), F.col("attributes")["source"].alias("attr_source"),
    )


@query(
    "correlate_logs_traces",
    """WITH t AS (SELECT tenant_id, trace_id, count(*) AS span_count, min(start_time_unix_ns) AS trace_start_ns,
                         CAST(max(CAST(status_code = 'ERROR' AS INT)) AS BIGINT) AS trace_failed
                  FROM spans GROUP BY 1, 2)
       SELECT l.tenant_id, l.time_unix_ns, l.severity_text, l.trace_id, span_count, trace_start_ns, trace_failed
       FROM logs l LEFT JOIN t ON l.tenant_id = t.tenant_id AND l.trace_id = t.trace_id AND l.trace_id <> ''""",
    ["logs", "spans"],
)
def _(spark, sf):
    rows = logs.correlate_logs_traces(views.logs(spark, sf), views.spans(spark, sf))
    return rows.select(
        "tenant_id", "time_unix_ns", "severity_text", "trace_id", "span_count", "trace_start_ns",
        F.col("trace_failed").cast("bigint").alias("trace_failed"),
    )


@query(
    "list_metrics",
    """SELECT * EXCLUDE rn FROM (
         SELECT *, row_number() OVER (PARTITION BY tenant_id ORDER BY last_seen_ns DESC, metric_name, service_name) AS rn
         FROM (SELECT tenant_id, metric_name,
                      arg_max(metric_kind, struct_pack(t := time_unix_ns, k := metric_kind)) AS metric_kind,
                      any_value(metric_unit) AS metric_unit, service_name, max(time_unix_ns) AS last_seen_ns,
                      count(*) AS point_count
               FROM metric_points GROUP BY tenant_id, metric_name, service_name)) WHERE rn <= 500""",
    ["metric_points"],
)
def _(spark, sf):
    return metrics.list_metrics(views.metric_points(spark, sf))


_SERIES = f"""SELECT tenant_id, metric_name, time_unix_ns {DAY} AS bucket_s,
  'flag=' || attr_flag || ',status=' || attr_status AS series_key,
  round(arg_max(coalesce(value_double, value_int, 0), struct_pack(t := time_unix_ns,
                v := coalesce(value_double, value_int, 0))), 9) AS value_last,
  round(max(coalesce(value_double, value_int, 0)), 9) AS value_max,
  round(min(coalesce(value_double, value_int, 0)), 9) AS value_min
  FROM metric_points WHERE metric_kind <> 'HISTOGRAM' GROUP BY 1, 2, 3, 4"""


def _metric_states(spark, sf):
    return rollups.partials(rollups.METRICS_MINUTELY, views.metric_points(spark, sf))


@query("metric_series", _SERIES, ["metric_points"])
def _(spark, sf):
    return rounded(metrics.metric_series(_metric_states(spark, sf), bucket_s=86400))


@query(
    "metric_series_pivot",
    f"""SELECT tenant_id, metric_name, series_key,
               string_agg(CAST(bucket_s AS VARCHAR) || '=' || CAST(CAST(round(value_last * 100) AS BIGINT) AS VARCHAR),
                          ',' ORDER BY bucket_s) AS points
        FROM ({_SERIES}) GROUP BY 1, 2, 3""",
    ["metric_points"],
)
def _(spark, sf):
    pivoted = metrics.metric_series_pivot(metrics.metric_series(_metric_states(spark, sf), bucket_s=86400))
    text = F.transform(
        "points", lambda p: F.concat(p["bucket_s"], F.lit("="), F.round(p["value_last"] * 100).cast("bigint"))
    )
    return pivoted.withColumn("points", F.array_join(text, ","))
