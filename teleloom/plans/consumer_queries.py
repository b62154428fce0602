"""Consumer and errors-page queries, read from the hourly rollups."""

from __future__ import annotations

from teleloom.operators import consumers, rollups
from teleloom.plans.registry import joined, query, rounded
from teleloom.plans.rollup_queries import DISC3, HOUR, disc
from teleloom.plans.span_queries import END_S, MONTH, START_S
from teleloom.sources import views

_SERVER = "s AS (SELECT * FROM spans WHERE span_kind = 'SERVER')"
_SHOWN = "CASE WHEN consumer_id = '' THEN '(anonymous)' ELSE consumer_id END AS consumer_id"
_COUNTS = """count(*) AS request_count, count(*) FILTER (status_code = 'ERROR') AS error_count"""
_RATE = "round(count(*) FILTER (status_code = 'ERROR') / count(*), 9) AS error_rate"
_CLASSES = """count(*) FILTER (http_status_code BETWEEN 400 AND 499) AS client_error_count,
  count(*) FILTER (http_status_code >= 500) AS server_error_count"""


def _consumer_states(spark, sf):
    return rollups.as_states(rollups.CONSUMER_HOURLY, views.spans(spark, sf))


def _status_states(spark, sf):
    return rollups.as_states(rollups.STATUS_HOURLY, views.spans(spark, sf))


_LIST = f"""list AS (SELECT tenant_id, {_SHOWN}, * EXCLUDE (tenant_id, consumer_id, rn) FROM (
  SELECT *, row_number() OVER (PARTITION BY tenant_id ORDER BY request_count DESC, consumer_id) AS rn FROM (
    SELECT tenant_id, consumer_id, {_COUNTS}, {_RATE}, {_CLASSES}, {DISC3},
           count(DISTINCT http_route) AS distinct_routes, min(start_time_unix_ns {HOUR}) AS first_seen_s,
           max(start_time_unix_ns {HOUR}) AS last_seen_s
    FROM s GROUP BY 1, 2)) WHERE rn <= 100)"""


@query("list_consumers", f"WITH {_SERVER}, {_LIST} SELECT * FROM list", ["spans"])
def _(spark, sf):
    return rounded(consumers.list_consumers(_consumer_states(spark, sf), MONTH))


_SERIES = f"""series AS (SELECT tenant_id, {_SHOWN}, start_time_unix_ns // 1000000000 // 86400 * 86400 AS bucket_s,
  {_COUNTS}, {_CLASSES}, {DISC3} FROM s GROUP BY ALL)"""


@query("consumer_timeseries", f"WITH {_SERVER}, {_SERIES} SELECT * FROM series", ["spans"])
def _(spark, sf):
    return rounded(consumers.consumer_timeseries(_consumer_states(spark, sf), MONTH, bucket_s=86400))


@query(
    "consumer_top_routes",
    f"""WITH {_SERVER} SELECT {_SHOWN}, * EXCLUDE (consumer_id, rn) FROM (
          SELECT *, row_number() OVER (PARTITION BY tenant_id, consumer_id
                                       ORDER BY request_count DESC, service_name, http_route) AS rn
          FROM (SELECT tenant_id, consumer_id, service_name, http_route, {_COUNTS}, {_RATE}, {DISC3}
                FROM s GROUP BY 1, 2, 3, 4)) WHERE rn <= 20""",
    ["spans"],
)
def _(spark, sf):
    return rounded(consumers.consumer_top_routes(_consumer_states(spark, sf), MONTH))


@query(
    "consumer_routes_sparkline",
    f"""WITH {_SERVER},
        top AS (SELECT * FROM (
          SELECT *, row_number() OVER (PARTITION BY tenant_id, consumer_id
                                       ORDER BY request_count DESC, service_name, http_route) AS rn
          FROM (SELECT tenant_id, consumer_id, service_name, http_route, {_COUNTS}, {_RATE},
                       {disc(0.5, 'p50_ms')}, {disc(0.99, 'p99_ms')}
                FROM s GROUP BY 1, 2, 3, 4)) WHERE rn <= 20),
        hours AS (SELECT tenant_id, consumer_id, service_name, http_route,
                         (start_time_unix_ns // 1000000000 - {START_S}) // 3600 AS slot, count(*) AS n
                  FROM s GROUP BY ALL),
        grid AS (SELECT *, unnest(range({(END_S - START_S) // 3600})) AS slot FROM top)
        SELECT g.tenant_id, CASE WHEN g.consumer_id = '' THEN '(anonymous)' ELSE g.consumer_id END AS consumer_id,
               g.service_name, g.http_route, g.request_count, g.error_count, g.error_rate, g.p50_ms, g.p99_ms,
               string_agg(CAST(coalesce(h.n, 0) AS VARCHAR), ',' ORDER BY g.slot) AS hourly_requests
        FROM grid g LEFT JOIN hours h ON h.tenant_id = g.tenant_id AND h.consumer_id = g.consumer_id
          AND h.service_name = g.service_name AND h.http_route = g.http_route AND h.slot = g.slot
        GROUP BY g.tenant_id, g.consumer_id, g.service_name, g.http_route, g.request_count, g.error_count,
                 g.error_rate, g.p50_ms, g.p99_ms""",
    ["spans"],
)
def _(spark, sf):
    lines = consumers.consumer_routes_sparkline(_consumer_states(spark, sf), MONTH)
    return joined(rounded(lines), "hourly_requests")


_BREAKDOWN = f"""breakdown AS (SELECT * EXCLUDE rn FROM (
  SELECT *, row_number() OVER (PARTITION BY tenant_id ORDER BY status_4xx + status_5xx DESC, request_count DESC,
                               service_name, http_route) AS rn FROM (
    SELECT tenant_id, service_name, http_route, count(*) AS request_count,
           count(*) FILTER (http_status_code BETWEEN 200 AND 299) AS status_2xx,
           count(*) FILTER (http_status_code BETWEEN 300 AND 399) AS status_3xx,
           count(*) FILTER (http_status_code BETWEEN 400 AND 499) AS status_4xx,
           count(*) FILTER (http_status_code >= 500) AS status_5xx,
           round(count(*) FILTER (http_status_code >= 400) / count(*), 9) AS error_rate,
           {disc(0.5, 'p50_ms')}, {disc(0.99, 'p99_ms')}
    FROM s WHERE http_status_code > 0 GROUP BY 1, 2, 3)) WHERE rn <= 50)"""


@query("route_status_breakdown", f"WITH {_SERVER}, {_BREAKDOWN} SELECT * FROM breakdown", ["spans"])
def _(spark, sf):
    return rounded(consumers.route_status_breakdown(_status_states(spark, sf), MONTH))


@query(
    "route_status_codes",
    f"""WITH {_SERVER} SELECT tenant_id, service_name, http_route, http_status_code, count(*) AS request_count,
               {disc(0.5, 'p50_ms')}, {disc(0.99, 'p99_ms')}
        FROM s WHERE http_status_code > 0 GROUP BY 1, 2, 3, 4""",
    ["spans"],
)
def _(spark, sf):
    return rounded(consumers.route_status_codes(_status_states(spark, sf), MONTH))


@query(
    "consumer_totals",
    f"""WITH {_SERVER}, {_LIST} SELECT tenant_id, count(*) AS consumers, CAST(sum(request_count) AS BIGINT) AS requests,
               CAST(sum(error_count) AS BIGINT) AS errors,
               round(coalesce(sum(request_count) FILTER (consumer_id = '(anonymous)'), 0) / sum(request_count), 9)
                 AS anonymous_share
        FROM list GROUP BY 1""",
    ["spans"],
)
def _(spark, sf):
    return rounded(consumers.consumer_totals(consumers.list_consumers(_consumer_states(spark, sf), MONTH)))


@query(
    "consumer_search_sort",
    f"""WITH {_SERVER}, {_LIST} SELECT tenant_id, consumer_id, request_count, error_rate, p99_ms FROM list
        WHERE contains(lower(consumer_id), 'user-1')""",
    ["spans"],
)
def _(spark, sf):
    listed = consumers.list_consumers(_consumer_states(spark, sf), MONTH)
    found = consumers.consumer_search_sort(listed, " USER-1", "p99")
    return rounded(found.select("tenant_id", "consumer_id", "request_count", "error_rate", "p99_ms"))


@query(
    "consumer_status_stack",
    f"""WITH {_SERVER}, {_SERIES} SELECT tenant_id, consumer_id, bucket_s,
               greatest(0, request_count - client_error_count - server_error_count) AS success,
               client_error_count AS status_4xx, server_error_count AS status_5xx,
               CAST(sum(request_count) OVER w AS BIGINT) AS total_requests,
               CAST(sum(error_count) OVER w AS BIGINT) AS total_errors,
               CAST(sum(client_error_count) OVER w AS BIGINT) AS total_4xx,
               CAST(sum(server_error_count) OVER w AS BIGINT) AS total_5xx
        FROM series WINDOW w AS (PARTITION BY tenant_id, consumer_id)""",
    ["spans"],
)
def _(spark, sf):
    series = consumers.consumer_timeseries(_consumer_states(spark, sf), MONTH, bucket_s=86400)
    return consumers.consumer_status_stack(series)


@query(
    "errors_totals",
    f"""WITH {_SERVER}, {_BREAKDOWN} SELECT tenant_id, CAST(sum(request_count) AS BIGINT) AS requests,
               CAST(sum(status_4xx) AS BIGINT) AS status_4xx, CAST(sum(status_5xx) AS BIGINT) AS status_5xx,
               round(sum(status_4xx + status_5xx) / sum(request_count), 9) AS error_rate,
               first(service_name ORDER BY status_4xx + status_5xx DESC, request_count DESC, service_name, http_route)
                 AS worst_service,
               first(http_route ORDER BY status_4xx + status_5xx DESC, request_count DESC, service_name, http_route)
                 AS worst_route
        FROM breakdown GROUP BY 1""",
    ["spans"],
)
def _(spark, sf):
    return rounded(consumers.errors_totals(consumers.route_status_breakdown(_status_states(spark, sf), MONTH)))
