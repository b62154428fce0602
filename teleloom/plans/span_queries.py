"""Span, trace and service-map queries over the whole span view."""

from __future__ import annotations

from pyspark.sql import functions as F

from teleloom.operators import rollups, service_map, spans, traces
from teleloom.plans.registry import ORACLES, joined, query, rounded
from teleloom.scope import Scope
from teleloom.sources import views

# 2024-01-01 .. 2024-02-01 UTC holds every event.
START_S, END_S = 1_704_067_200, 1_706_745_600
MONTH = Scope.seconds(START_S, END_S)

_ERR5 = "(status_code = 'ERROR' OR http_status_code >= 500)"
_ERR4 = "(status_code = 'ERROR' OR http_status_code >= 400)"


def _q(p: float, name: str) -> str:
    return f"round(quantile_cont(duration_ns, {p}) / 1e6, 9) AS {name}"


_P3 = f"{_q(0.5, 'p50_ms')}, {_q(0.9, 'p90_ms')}, {_q(0.99, 'p99_ms')}"


@query(
    "overview",
    f"""SELECT tenant_id, count(*) AS total_spans, count(*) FILTER ({_ERR5}) AS error_spans,
               round(count(*) FILTER ({_ERR5}) / count(*), 9) AS error_rate, {_P3},
               count(DISTINCT service_name) AS services
        FROM spans GROUP BY tenant_id""",
    ["spans"],
)
def _(spark, sf):
    return rounded(spans.overview(views.spans(spark, sf), MONTH))


@query(
    "list_spans",
    """SELECT tenant_id, trace_id, span_id, service_name, span_kind, start_time_unix_ns, duration_ns, status_code,
              http_status_code, min(start_time_unix_ns) OVER (PARTITION BY tenant_id) AS next_cursor_ns
       FROM (SELECT *, row_number() OVER (PARTITION BY tenant_id ORDER BY start_time_unix_ns DESC, span_id DESC) AS rn
             FROM spans) WHERE rn <= 50""",
    ["spans"],
)
def _(spark, sf):
    return spans.list_spans(views.spans(spark, sf)).select(
        "tenant_id", "trace_id", "span_id", "service_name", "span_kind", "start_time_unix_ns", "duration_ns",
        "status_code", "http_status_code", "next_cursor_ns",
    )


@query(
    "list_spans_filtered",
    f"""SELECT tenant_id, span_id, start_time_unix_ns, http_status_code, next_cursor_ns
        FROM (SELECT *, min(start_time_unix_ns) OVER (PARTITION BY tenant_id) AS next_cursor_ns FROM (
              SELECT *, row_number() OVER (PARTITION BY tenant_id ORDER BY start_time_unix_ns DESC, span_id DESC) AS rn
              FROM spans WHERE span_kind = 'SERVER' AND http_route = '/api/error' AND consumer_id = '' AND {_ERR4}
                AND start_time_unix_ns >= 1704067200000000000 AND start_time_unix_ns <= 1706745600000000000
                AND start_time_unix_ns < 1706054400000000000) WHERE rn <= 5000)""",
    ["spans"],
)
def _(spark, sf):
    rows = spans.list_spans(
        views.spans(spark, sf), MONTH, kind="SERVER", route="/api/error", consumer="(anonymous)", errors_only=True,
        cursor_ns=1_706_054_400_000_000_000, limit=5000,
    )
    return rows.select("tenant_id", "span_id", "start_time_unix_ns", "http_status_code", "next_cursor_ns")


@query(
    "get_trace",
    """WITH slowest AS (SELECT tenant_id, max_by(trace_id, struct_pack(d := duration_ns, t := trace_id)) AS trace_id
                        FROM spans GROUP BY tenant_id)
       SELECT s.tenant_id, s.trace_id, span_id, parent_span_id, service_name, start_time_unix_ns, duration_ns
       FROM spans s JOIN slowest w ON s.tenant_id = w.tenant_id AND s.trace_id = w.trace_id""",
    ["spans"],
)
def _(spark, sf):
    rows = views.spans(spark, sf)
    slowest = rows.groupBy("tenant_id").agg(F.max_by("trace_id", F.struct("duration_ns", "trace_id")).alias("trace_id"))
    return traces.get_traces(rows, slowest).select(
        "tenant_id", "trace_id", "span_id", "parent_span_id", "service_name", "start_time_unix_ns", "duration_ns"
    )


@query(
    "get_trace_by_id",
    """WITH slowest AS (SELECT max_by(struct_pack(tn := tenant_id, tr := trace_id), struct_pack(d := duration_ns, t := trace_id)) AS k
                        FROM spans)
       SELECT tenant_id, trace_id, span_id, parent_span_id, start_time_unix_ns, duration_ns
       FROM spans, slowest WHERE tenant_id = slowest.k.tn AND trace_id = slowest.k.tr""",
    ["spans"],
)
def _(spark, sf):
    # The trace of the slowest span of the whole table.
    rows = views.spans(spark, sf)
    key = rows.agg(F.max_by(F.struct("tenant_id", "trace_id"), F.struct("duration_ns", "trace_id")).alias("k")).first()["k"]
    return traces.get_trace(rows, key["tenant_id"], key["trace_id"].upper()).select(
        "tenant_id", "trace_id", "span_id", "parent_span_id", "start_time_unix_ns", "duration_ns"
    )


@query(
    "span_view",
    """SELECT tenant_id, span_id, duration_ns, event_type AS attr_event_type, CAST(k AS VARCHAR) AS attr_k,
              CASE WHEN event_type = 'error' THEN 'exception@' || CAST(start_time_unix_ns AS VARCHAR) ||
                   CASE WHEN i = 0 THEN '{"exception.type":"failure"}' ELSE '{}' END ELSE '' END AS events
       FROM spans""",
    ["spans"],
)
def _(spark, sf):
    shown = traces.span_view(views.spans(spark, sf))
    text = F.transform("events", lambda e: F.concat(e["name"], F.lit("@"), e["time_unix_ns"], e["attrs_json"]))
    return shown.select(
        "tenant_id", "span_id", "duration_ns",
        F.col("attributes")["event.type"].alias("attr_event_type"),
        F.col("attributes")["k"].alias("attr_k"),
        F.array_join(text, ",").alias("events"),
    )


@query(
    "list_services",
    f"""SELECT tenant_id, service_name,
               max_by(service_version, struct_pack(t := start_time_unix_ns, v := service_version)) AS service_version,
               count(*) AS span_count, count(*) FILTER ({_ERR5}) AS error_count,
               round(count(*) FILTER ({_ERR5}) / count(*), 9) AS error_rate, {_P3},
               max(start_time_unix_ns) AS last_seen_ns
        FROM spans GROUP BY tenant_id, service_name""",
    ["spans"],
)
def _(spark, sf):
    return rounded(spans.list_services(views.spans(spark, sf), MONTH))


@query(
    "latency_timeseries",
    f"""SELECT tenant_id, start_time_unix_ns // 1000000000 // 3600 * 3600 AS bucket_s, count(*) AS span_count,
               count(*) FILTER ({_ERR5}) AS error_count, {_P3}
        FROM spans GROUP BY 1, 2""",
    ["spans"],
)
def _(spark, sf):
    return rounded(spans.latency_timeseries(views.spans(spark, sf), MONTH, bucket_s=3600))


@query(
    "top_routes",
    f"""SELECT * EXCLUDE rn FROM (
          SELECT *, row_number() OVER (PARTITION BY tenant_id ORDER BY span_count DESC, service_name, span_name,
                                       http_method, http_route) AS rn
          FROM (SELECT tenant_id, service_name, span_name, http_method, http_route, count(*) AS span_count,
                       count(*) FILTER ({_ERR5}) AS error_count, {_P3}
                FROM spans GROUP BY 1, 2, 3, 4, 5)) WHERE rn <= 20""",
    ["spans"],
)
def _(spark, sf):
    return rounded(spans.top_routes(views.spans(spark, sf), MONTH))


@query(
    "database_overview",
    f"""SELECT tenant_id, count(*) AS total_queries, count(*) FILTER (status_code = 'ERROR') AS error_queries,
               round(count(*) FILTER (status_code = 'ERROR') / count(*), 9) AS error_rate, {_P3},
               round(CAST(sum(duration_ns) AS DOUBLE) / 1e6, 9) AS total_db_ms,
               count(DISTINCT db_system) AS distinct_systems
        FROM spans WHERE db_system <> '' GROUP BY tenant_id""",
    ["spans"],
)
def _(spark, sf):
    return rounded(spans.database_overview(views.spans(spark, sf), MONTH))


@query(
    "top_queries",
    f"""SELECT * EXCLUDE rn FROM (
          SELECT *, row_number() OVER (PARTITION BY tenant_id ORDER BY query_count DESC, db_system, query_template) AS rn
          FROM (SELECT tenant_id, db_system, substring(db_statement, 1, 200) AS query_template,
                       count(*) AS query_count, count(*) FILTER (status_code = 'ERROR') AS error_count, {_P3},
                       round(CAST(sum(duration_ns) AS DOUBLE) / 1e6, 9) AS total_ms
                FROM spans WHERE db_system <> '' AND db_statement <> '' GROUP BY 1, 2, 3)) WHERE rn <= 20""",
    ["spans"],
)
def _(spark, sf):
    return rounded(spans.top_queries(views.spans(spark, sf), MONTH))


@query(
    "db_system_breakdown",
    f"""SELECT tenant_id, db_system, count(*) AS query_count, {_q(0.5, 'p50_ms')}, {_q(0.99, 'p99_ms')}
        FROM spans WHERE db_system <> '' GROUP BY 1, 2""",
    ["spans"],
)
def _(spark, sf):
    return rounded(spans.db_system_breakdown(views.spans(spark, sf), MONTH))


def _sparkline_sql(key: str, failed: str, where: str, shown: str, keep: str) -> str:
    # 30 slices of 89280 s; the end of the range folds into the last slice.
    return f"""WITH slots AS (
      SELECT tenant_id, {key}, least(29, (start_time_unix_ns // 1000000000 - {START_S}) // 89280) AS slot,
             count(*) AS c, count(*) FILTER ({failed}) AS e
      FROM spans WHERE {where} GROUP BY 1, 2, 3),
    totals AS (SELECT tenant_id, {key}, CAST(sum(c) AS BIGINT) AS total FROM slots GROUP BY 1, 2),
    kept AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY tenant_id ORDER BY total DESC, {key}) AS rn
                            FROM totals) WHERE {keep}),
    grid AS (SELECT tenant_id, {key}, total, unnest(range(30)) AS slot FROM kept)
    SELECT g.tenant_id, {shown} AS {key}, string_agg(CAST(coalesce(c, 0) AS VARCHAR), ',' ORDER BY g.slot) AS counts,
           string_agg(CAST(coalesce(e, 0) AS VARCHAR), ',' ORDER BY g.slot) AS errors, g.total
    FROM grid g LEFT JOIN slots s ON g.tenant_id = s.tenant_id AND g.{key} = s.{key} AND g.slot = s.slot
    GROUP BY g.tenant_id, g.{key}, g.total"""


@query("service_sparklines", _sparkline_sql("service_name", _ERR5, "true", "g.service_name", "true"), ["spans"])
def _(spark, sf):
    return joined(spans.service_sparklines(views.spans(spark, sf), MONTH), "counts", "errors")


@query(
    "consumer_sparklines",
    _sparkline_sql(
        "consumer_id", _ERR4, "span_kind = 'SERVER'",
        "CASE WHEN g.consumer_id = '' THEN '(anonymous)' ELSE g.consumer_id END", "rn <= 200",
    ),
    ["spans"],
)
def _(spark, sf):
    return joined(spans.consumer_sparklines(views.spans(spark, sf), MONTH), "counts", "errors")


@query(
    "route_summary",
    f"""WITH s AS (SELECT * FROM spans WHERE span_kind = 'SERVER'),
        m AS (SELECT tenant_id, service_name, http_route,
                     max_by(http_method, struct_pack(n := n, m := http_method)) AS http_method
              FROM (SELECT tenant_id, service_name, http_route, http_method, count(*) AS n FROM s GROUP BY 1, 2, 3, 4)
              GROUP BY 1, 2, 3)
        SELECT s.tenant_id, s.service_name, s.http_route, count(*) AS total, count(*) FILTER ({_ERR5}) AS errors,
               any_value(m.http_method) AS http_method, round(count(*) FILTER ({_ERR5}) / count(*), 9) AS error_rate,
               {_q(0.5, 'p50_ms')}, {_q(0.75, 'p75_ms')}, {_q(0.95, 'p95_ms')}, {_q(0.99, 'p99_ms')},
               round(count(*) / ({END_S - START_S} / 60.0), 9) AS requests_per_minute
        FROM s JOIN m ON s.tenant_id = m.tenant_id AND s.service_name = m.service_name AND s.http_route = m.http_route
        GROUP BY 1, 2, 3""",
    ["spans"],
)
def _(spark, sf):
    return rounded(spans.route_summary(views.spans(spark, sf), MONTH))


@query(
    "route_timeseries",
    f"""SELECT tenant_id, service_name, http_route, start_time_unix_ns // 1000000000 // 86400 * 86400 AS bucket_s,
               count(*) AS span_count, count(*) FILTER ({_ERR5}) AS error_count, {_P3}
        FROM spans WHERE span_kind = 'SERVER' GROUP BY 1, 2, 3, 4""",
    ["spans"],
)
def _(spark, sf):
    return rounded(spans.route_timeseries(views.spans(spark, sf), MONTH, bucket_s=86400))


@query(
    "route_latency_histogram",
    """SELECT tenant_id, service_name, http_route, power, span_count, pow(2.0, power) AS lower_ms,
              pow(2.0, power + 1) AS upper_ms
       FROM (SELECT tenant_id, service_name, http_route,
                    CAST(greatest(-4, least(14, floor(log2(greatest(duration_ns / 1000000.0, 0.0001))))) AS INT) AS power,
                    count(*) AS span_count
             FROM spans WHERE span_kind = 'SERVER' GROUP BY 1, 2, 3, 4)""",
    ["spans"],
)
def _(spark, sf):
    return spans.route_latency_histogram(views.spans(spark, sf), MONTH)


@query(
    "search_spans",
    """SELECT tenant_id, span_id, service_name, http_status_code FROM spans
       WHERE upper(http_method) <> 'OPTIONS' AND (status_code = 'ERROR' OR http_status_code >= 400)
         AND (contains(lower(http_route), 'error where') OR contains(lower(span_name), 'error where')
              OR contains(lower(http_url), 'error where') OR contains(lower(service_name), 'error where')
              OR contains(lower(consumer_id), 'error where') OR contains(lower(db_statement), 'error where'))""",
    ["spans"],
)
def _(spark, sf):
    found = spans.search_spans(views.spans(spark, sf), " ERROR where ", errors_only=True)
    return found.select("tenant_id", "span_id", "service_name", "http_status_code")


_SAMPLE = """sample AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY tenant_id ORDER BY start_time_unix_ns DESC, span_id DESC) AS rn
                 FROM spans) WHERE rn <= 1000)"""


@query(
    "span_sample_kpis",
    f"""WITH {_SAMPLE},
        ranked AS (SELECT *, row_number() OVER (PARTITION BY tenant_id ORDER BY duration_ns) - 1 AS pos,
                          count(*) OVER (PARTITION BY tenant_id) AS n FROM sample)
        SELECT tenant_id, count(*) AS span_count, count(*) FILTER ({_ERR5}) AS error_count,
               round(count(*) FILTER ({_ERR5}) / count(*), 9) AS error_rate,
               round(max(CASE WHEN pos = least(n - 1, floor(n * 0.5)) THEN duration_ns / 1e6 END), 9) AS p50_ms,
               round(max(CASE WHEN pos = least(n - 1, floor(n * 0.95)) THEN duration_ns / 1e6 END), 9) AS p95_ms,
               round(max(duration_ns) / 1e6, 9) AS slowest_ms
        FROM ranked GROUP BY tenant_id""",
    ["spans"],
)
def _(spark, sf):
    return rounded(spans.span_sample_kpis(spans.list_spans(views.spans(spark, sf), limit=1000)))


@query(
    "volume_strip",
    f"""WITH t AS (SELECT tenant_id, start_time_unix_ns // 1000000 AS ms, {_ERR5} AS bad FROM spans),
        f AS (SELECT tenant_id, min(ms) AS lo, greatest(1, max(ms) - min(ms)) AS width FROM t GROUP BY 1),
        c AS (SELECT t.tenant_id, CAST(least(59, floor((ms - lo) / width * 60)) AS INT) AS bin, count(*) AS n,
                     count(*) FILTER (bad) AS e FROM t JOIN f ON t.tenant_id = f.tenant_id GROUP BY 1, 2),
        g AS (SELECT *, CAST(unnest(range(60)) AS INT) AS bin FROM f)
        SELECT g.tenant_id, g.bin, round(lo + (g.bin + 0.5) * width / 60, 4) AS center_ms,
               coalesce(n, 0) AS span_count, coalesce(e, 0) AS error_count
        FROM g LEFT JOIN c ON g.tenant_id = c.tenant_id AND g.bin = c.bin""",
    ["spans"],
)
def _(spark, sf):
    return rounded(spans.volume_strip(views.spans(spark, sf)), 4)


@query(
    "operation_label",
    """SELECT tenant_id, label_badge, label, count(*) AS span_count FROM (
         SELECT tenant_id,
                CASE WHEN db_system <> '' THEN upper(db_system) ELSE http_method END AS label_badge,
                CASE WHEN db_system <> '' THEN db_statement WHEN http_route <> '' THEN http_route
                     ELSE 'api-' || CAST(k % 4 AS VARCHAR) || '.example.com:8080/v1/' || event_type END AS label
         FROM spans) GROUP BY 1, 2, 3""",
    ["spans"],
)
def _(spark, sf):
    labelled = spans.operation_label(views.spans(spark, sf))
    return labelled.groupBy("tenant_id", "label_badge", "label").agg(F.count(F.lit(1)).alias("span_count"))


# ---------------------------------------------------------------------------- traces


@query(
    "trace_summary",
    """SELECT tenant_id, trace_id, count(*) AS span_count, min(start_time_unix_ns) AS start_ns,
              max(end_time_unix_ns) AS end_ns, greatest(1, max(end_time_unix_ns) - min(start_time_unix_ns)) AS total_ns,
              array_to_string(list_sort(list_distinct(list(service_name))), ',') AS services,
              count(*) FILTER (db_system <> '') AS db_spans,
              count(*) FILTER (span_kind = 'CLIENT' AND db_system = '') AS http_client_spans,
              coalesce(min_by(span_id, start_time_unix_ns) FILTER (span_kind = 'SERVER' AND parent_span_id = ''),
                       min_by(span_id, start_time_unix_ns) FILTER (span_kind = 'SERVER')) AS root_span_id,
              max_by(span_id, struct_pack(d := duration_ns, t := -start_time_unix_ns, s := span_id)) AS slowest_span_id,
              max(duration_ns) AS slowest_duration_ns
       FROM spans GROUP BY 1, 2""",
    ["spans"],
)
def _(spark, sf):
    return joined(traces.trace_summary(views.spans(spark, sf)), "services")


@query(
    "trace_waterfall",
    f"""WITH e AS (SELECT tenant_id, trace_id, min(start_time_unix_ns) AS t0,
                          greatest(1, max(end_time_unix_ns) - min(start_time_unix_ns)) AS whole FROM spans GROUP BY 1, 2)
        SELECT s.tenant_id, s.trace_id, span_id, start_time_unix_ns,
               round((start_time_unix_ns - t0) / whole, 9) AS offset_fraction,
               round(greatest(0.005, duration_ns / whole), 9) AS width_fraction,
               CAST({_ERR5} AS BIGINT) AS is_error
        FROM spans s JOIN e ON s.tenant_id = e.tenant_id AND s.trace_id = e.trace_id""",
    ["spans"],
)
def _(spark, sf):
    return rounded(traces.trace_waterfall(views.spans(spark, sf)))


# ---------------------------------------------------------------------------- service map


@query(
    "service_map_nodes",
    f"""SELECT tenant_id, service_name, count(*) AS calls, count(*) FILTER ({_ERR5}) AS errors, {_q(0.5, 'p50_ms')}
        FROM spans WHERE service_name <> '' GROUP BY 1, 2""",
    ["spans"],
)
def _(spark, sf):
    return rounded(service_map.service_nodes(views.spans(spark, sf), MONTH))


_SVC_EDGES = f"""
  SELECT c.tenant_id, p.service_name AS source, c.service_name AS target, count(*) AS calls,
         count(*) FILTER (c.status_code = 'ERROR' OR c.http_status_code >= 500) AS errors,
         avg(c.duration_ns) / 1e6 AS avg_ms
  FROM spans c JOIN spans p ON p.tenant_id = c.tenant_id AND p.trace_id = c.trace_id AND p.span_id = c.parent_span_id
  WHERE c.parent_span_id <> '' AND p.service_name <> '' AND c.service_name <> '' AND p.service_name <> c.service_name
  GROUP BY 1, 2, 3"""
_DB_EDGES = """
  SELECT tenant_id, service_name, db_system, count(*) AS calls, count(*) FILTER (status_code = 'ERROR') AS errors,
         avg(duration_ns) / 1e6 AS avg_ms
  FROM spans WHERE db_system <> '' AND service_name <> '' GROUP BY 1, 2, 3"""
_EXT_EDGES = f"""
  SELECT tenant_id, service_name, regexp_extract(http_url, '^[a-z]+://([^/:]+)', 1) AS host, count(*) AS calls,
         count(*) FILTER ({_ERR5}) AS errors, avg(duration_ns) / 1e6 AS avg_ms
  FROM spans WHERE span_kind = 'CLIENT' AND db_system = '' AND http_url <> '' AND service_name <> ''
  GROUP BY 1, 2, 3"""
_GRAPH = f"svc AS ({_SVC_EDGES}), db AS ({_DB_EDGES}), ext AS ({_EXT_EDGES})"
_ALL_EDGES = """
  SELECT tenant_id, 'svc:' || source AS source_id, 'svc:' || target AS target_id, 'service' AS target_kind,
         target AS target_label, calls, errors, round(avg_ms, 9) AS avg_ms FROM svc
  UNION ALL SELECT tenant_id, 'svc:' || service_name, 'db:' || db_system, 'database', db_system, calls, errors,
         round(avg_ms, 9) FROM db
  UNION ALL SELECT tenant_id, 'svc:' || service_name, 'ext:' || host, 'external', host, calls, errors,
         round(avg_ms, 9) FROM ext"""
_ALL_NODES = f"""
  SELECT tenant_id, 'svc:' || service_name AS node_id, service_name AS label, 'service' AS kind, count(*) AS calls,
         count(*) FILTER ({_ERR5}) AS errors, {_q(0.5, 'latency_ms')} FROM spans GROUP BY 1, 2, 3, 4
  UNION ALL SELECT tenant_id, 'db:' || db_system, db_system, 'database', CAST(sum(calls) AS BIGINT),
         CAST(sum(errors) AS BIGINT), round(sum(avg_ms * calls) / sum(calls), 9) FROM db GROUP BY 1, 2, 3
  UNION ALL SELECT tenant_id, 'ext:' || host, host, 'external', CAST(sum(calls) AS BIGINT),
         CAST(sum(errors) AS BIGINT), round(sum(avg_ms * calls) / sum(calls), 9) FROM ext GROUP BY 1, 2, 3"""


@query("service_map_service_edges", f"SELECT * REPLACE (round(avg_ms, 9) AS avg_ms) FROM ({_SVC_EDGES})", ["spans"])
def _(spark, sf):
    return rounded(service_map.service_edges(views.spans(spark, sf), MONTH))


@query("service_map_db_edges", f"SELECT * REPLACE (round(avg_ms, 9) AS avg_ms) FROM ({_DB_EDGES})", ["spans"])
def _(spark, sf):
    return rounded(service_map.database_edges(views.spans(spark, sf), MONTH))


@query("service_map_external_edges", f"SELECT * REPLACE (round(avg_ms, 9) AS avg_ms) FROM ({_EXT_EDGES})", ["spans"])
def _(spark, sf):
    return rounded(service_map.external_edges(views.spans(spark, sf), MONTH))


@query("service_map_edges", f"WITH {_GRAPH} {_ALL_EDGES}", ["spans"])
def _(spark, sf):
    return rounded(service_map.service_map_edges(views.spans(spark, sf), MONTH))


@query("service_map", f"WITH {_GRAPH} {_ALL_NODES}", ["spans"])
def _(spark, sf):
    return rounded(service_map.service_map_nodes(views.spans(spark, sf), MONTH))


@query(
    "service_map_totals",
    f"""WITH {_GRAPH}, nodes AS ({_ALL_NODES}), edges AS ({_ALL_EDGES}),
        e AS (SELECT tenant_id, count(*) AS edges FROM edges GROUP BY 1)
        SELECT n.tenant_id, count(*) FILTER (kind = 'service') AS services,
               count(*) FILTER (kind = 'database') AS databases, count(*) FILTER (kind = 'external') AS external,
               any_value(e.edges) AS edges
        FROM nodes n LEFT JOIN e ON n.tenant_id = e.tenant_id GROUP BY 1""",
    ["spans"],
)
def _(spark, sf):
    return service_map.service_map_totals(views.spans(spark, sf), MONTH)


# Kept states: the latency of services is read from magnitude slices, by the same rule in SQL.
_SLICE = f"quantile_disc(CAST(floor(ln(1 + duration_ns) * {rollups.SLICES_PER_E}) AS BIGINT), 0.5)"
_MIDDLE = f"round(floor(exp(({_SLICE} + 0.5) / {rollups.SLICES_PER_E}) - 0.5) / 1e6, 9) AS latency_ms"


def _map_states(spark, sf):
    return rollups.partials(rollups.SERVICE_MAP_MINUTELY, service_map.calls(views.spans(spark, sf)))


@query("service_map_edges_from_states", f"WITH {_GRAPH} {_ALL_EDGES}", ["spans"])
def _(spark, sf):
    return rounded(service_map.edges_from_states(_map_states(spark, sf), MONTH))


@query("service_map_from_states", f"WITH {_GRAPH} {_ALL_NODES.replace(_q(0.5, 'latency_ms'), _MIDDLE)}", ["spans"])
def _(spark, sf):
    return rounded(service_map.nodes_from_states(_map_states(spark, sf), MONTH))


@query("service_map_totals_from_states", ORACLES["service_map_totals"])
def _(spark, sf):
    return service_map.totals_from_states(_map_states(spark, sf), MONTH)
