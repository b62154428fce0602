"""Alerting queries: all rules over hourly ticks of the whole month."""

from __future__ import annotations

from pyspark.sql import functions as F

from teleloom.operators.alerts import notify, rules, signals, state
from teleloom.operators.alerts.signals import Ticks
from teleloom.plans.registry import query, rounded
from teleloom.plans.span_queries import END_S, START_S
from teleloom.sources import views

HOURLY = Ticks(START_S, END_S, 3600)
# Metric points carry shipping dates: ticks at 04:00 of every day from 1992 to 1999.
METRIC_FIRST_S, METRIC_LAST_S = 694_238_400, 915_163_200
DAILY = Ticks(METRIC_FIRST_S, METRIC_LAST_S, 86_400)

_LIVE = "live AS (SELECT *, greatest(60, window_seconds) AS w FROM alert_rules WHERE enabled)"
_TICKS = f"ticks AS (SELECT unnest(range({START_S}, {END_S} + 1, 3600)) AS tick_s)"
_METRIC_TICKS = f"ticks AS (SELECT unnest(range({METRIC_FIRST_S}, {METRIC_LAST_S} + 1, 86400)) AS tick_s)"


def _in_window(time: str) -> str:
    return f"{time} BETWEEN (tick_s - w) * 1000000000 AND tick_s * 1000000000"


_SPAN_FACTS = f"""FROM live r CROSS JOIN ticks t JOIN spans s ON s.tenant_id = r.tenant_id AND s.span_kind = 'SERVER'
  AND (r.service_filter = '' OR s.service_name = r.service_filter) AND {_in_window('s.start_time_unix_ns')}"""
_LATENCY = f"""SELECT rule_id, tick_s,
  round(CASE any_value(signal_type) WHEN 'latency_p50' THEN quantile_cont(duration_ns, 0.5)
        WHEN 'latency_p90' THEN quantile_cont(duration_ns, 0.9) ELSE quantile_cont(duration_ns, 0.99) END / 1e6, 9)
    AS observed
  {_SPAN_FACTS} WHERE signal_type LIKE 'latency%' GROUP BY 1, 2"""
_ERROR_RATE = f"""SELECT rule_id, tick_s,
  round(count(*) FILTER (status_code = 'ERROR' OR http_status_code >= 500) / count(*), 9) AS observed
  {_SPAN_FACTS} WHERE signal_type = 'error_rate' GROUP BY 1, 2"""
_VOLUME = f"""SELECT rule_id, tick_s, CAST(count(*) AS DOUBLE) AS observed
  {_SPAN_FACTS} WHERE signal_type = 'request_volume' GROUP BY 1, 2"""
_LOG_COUNT = f"""SELECT rule_id, tick_s, CAST(count(*) AS DOUBLE) AS observed
  FROM live r CROSS JOIN ticks t JOIN logs l ON l.tenant_id = r.tenant_id AND l.severity_number >= 13
  AND (r.service_filter = '' OR l.service_name = r.service_filter) AND {_in_window('l.time_unix_ns')}
  WHERE signal_type = 'log_count' GROUP BY 1, 2"""
# For rules of all kinds on the same ticks: all points, with their times moved into the checked month.
MONTH_NS = 31 * 86_400 * 1_000_000_000
_MOVED = f"({START_S}000000000 + m.time_unix_ns % {MONTH_NS})"


# Lifts means that end in a five behind the compared places, whichever way they were added up.
NUDGE = 1e-8


def _metric(time: str, nudge: float = 0.0) -> str:
    return f"""SELECT rule_id, tick_s, round(CASE any_value(signal_type)
    WHEN 'metric_avg' THEN avg(coalesce(value_double, value_int, histogram_sum))
    ELSE max(coalesce(value_double, value_int, histogram_sum)) END + {nudge}, 6) AS observed
  FROM live r CROSS JOIN ticks t JOIN metric_points m ON m.tenant_id = r.tenant_id AND m.metric_name = r.signal_param
  AND (r.service_filter = '' OR m.service_name = r.service_filter) AND {_in_window(time)}
  WHERE signal_type LIKE 'metric%' GROUP BY 1, 2"""


@query("signal_latency", f"WITH {_LIVE}, {_TICKS} {_LATENCY}", ["alert_rules", "spans"])
def _(spark, sf):
    return rounded(signals.signal_latency(views.alert_rules(spark, sf), views.spans(spark, sf), HOURLY))


@query("signal_error_rate", f"WITH {_LIVE}, {_TICKS} {_ERROR_RATE}", ["alert_rules", "spans"])
def _(spark, sf):
    return rounded(signals.signal_error_rate(views.alert_rules(spark, sf), views.spans(spark, sf), HOURLY))


@query("signal_request_volume", f"WITH {_LIVE}, {_TICKS} {_VOLUME}", ["alert_rules", "spans"])
def _(spark, sf):
    return rounded(signals.signal_request_volume(views.alert_rules(spark, sf), views.spans(spark, sf), HOURLY))


@query("signal_log_count", f"WITH {_LIVE}, {_TICKS} {_LOG_COUNT}", ["alert_rules", "logs"])
def _(spark, sf):
    return rounded(signals.signal_log_count(views.alert_rules(spark, sf), views.logs(spark, sf), HOURLY))


@query("signal_metric", f"WITH {_LIVE}, {_METRIC_TICKS} {_metric('m.time_unix_ns')}", ["alert_rules", "metric_points"])
def _(spark, sf):
    return rounded(signals.signal_metric(views.alert_rules(spark, sf), views.metric_points(spark, sf), DAILY), 6)


_VIEWS = ["alert_rules", "spans", "logs", "metric_points"]
_EVALUATED = f"""{_LIVE}, {_TICKS},
seen AS ({_LATENCY} UNION ALL {_ERROR_RATE} UNION ALL {_VOLUME} UNION ALL {_LOG_COUNT} UNION ALL {_metric(_MOVED, NUDGE)}),
evaluated AS MATERIALIZED (
  SELECT r.rule_id, r.tenant_id, t.tick_s, coalesce(s.observed, 0) AS observed,
         CASE operator WHEN 'gt' THEN coalesce(s.observed, 0) > threshold
              WHEN 'gte' THEN coalesce(s.observed, 0) >= threshold WHEN 'lt' THEN coalesce(s.observed, 0) < threshold
              WHEN 'lte' THEN coalesce(s.observed, 0) <= threshold ELSE coalesce(s.observed, 0) = threshold END AS breached
  FROM live r CROSS JOIN ticks t LEFT JOIN seen s ON s.rule_id = r.rule_id AND s.tick_s = t.tick_s)"""


def _rounded(df):
    """Means of metric points, added up in any order, are compared to six places, exact values to nine.

    Every eighth rule of the view, by its id, and the one before it are on metrics.
    """
    for name in ("observed", "resolved_value"):
        if name in df.columns:
            places = F.when(F.col("rule_id") % 8 >= 6, F.round(F.col(name) + NUDGE, 6)).otherwise(F.round(name, 9))
            df = df.withColumn(name, places)
    return df


def _evaluated(spark, sf):
    points = views.metric_points(spark, sf)
    points = points.withColumn("time_unix_ns", F.lit(START_S * 1_000_000_000) + F.pmod("time_unix_ns", F.lit(MONTH_NS)))
    return signals.evaluate_rules(views.alert_rules(spark, sf), views.spans(spark, sf), views.logs(spark, sf), points, HOURLY)


@query(
    "evaluate_rules",
    f"WITH {_EVALUATED} SELECT * REPLACE (CAST(breached AS BIGINT) AS breached) FROM evaluated",
    _VIEWS,
)
def _(spark, sf):
    return _rounded(_evaluated(spark, sf).withColumn("breached", F.col("breached").cast("bigint")))


@query(
    "validate_rules",
    """SELECT rule_id, coalesce(CASE WHEN trim(rule_name) = '' THEN 'rule_name is required'
         WHEN signal_type = 'cpu_heat' THEN 'signal_type is not supported'
         WHEN signal_type IN ('metric_avg', 'metric_max') AND signal_param = '' THEN 'signal_param must name a metric'
         WHEN signal_type = 'log_count' AND signal_param IN ('loud', 'metric.1') THEN 'signal_param is not a severity'
         WHEN operator = 'ne' THEN 'operator is not supported'
         WHEN severity = 'fatal' THEN 'severity is not supported'
         WHEN window_seconds < 30 OR window_seconds > 86400 THEN 'window_seconds is out of range'
         WHEN for_seconds < 0 THEN 'for_seconds is out of range' END, 'valid') AS verdict
       FROM draft_rules""",
    ["draft_rules"],
)
def _(spark, sf):
    checked = rules.validate_rules(views.draft_rules(spark, sf))
    return checked.select("rule_id", F.coalesce("reject_reason", F.lit("valid")).alias("verdict"))


# The state machine replayed tick by tick.
_MACHINE = f"""{_EVALUATED},
numbered AS MATERIALIZED (SELECT e.*, r.for_seconds, row_number() OVER (PARTITION BY e.rule_id ORDER BY tick_s) AS j
             FROM evaluated e JOIN live r ON r.rule_id = e.rule_id),
machine AS (
  SELECT rule_id, CAST(0 AS BIGINT) AS j, CAST(0 AS BIGINT) AS tick_s, CAST(0 AS DOUBLE) AS observed, 'ok' AS before,
         'ok' AS now, CAST(NULL AS BIGINT) AS since FROM live
  UNION ALL
  SELECT m.rule_id, n.j, n.tick_s, n.observed, m.now,
         CASE WHEN NOT n.breached THEN 'ok'
              WHEN m.now = 'ok' AND n.for_seconds > 0 THEN 'pending'
              WHEN m.now = 'pending' AND n.tick_s - m.since < n.for_seconds THEN 'pending'
              ELSE 'firing' END,
         CASE WHEN NOT n.breached THEN NULL WHEN m.now = 'ok' THEN n.tick_s ELSE m.since END
  FROM machine m JOIN numbered n ON n.rule_id = m.rule_id AND n.j = m.j + 1),
changes AS MATERIALIZED (
  SELECT rule_id, tick_s, before AS from_state, now AS to_state,
         CASE WHEN now = 'firing' THEN 'firing' WHEN before = 'firing' THEN 'resolved' ELSE '' END AS kind,
         observed, since AS pending_since_s
  FROM machine WHERE j > 0 AND before <> now)"""


def _changes(spark, sf):
    return state.alert_state_machine(_evaluated(spark, sf), views.alert_rules(spark, sf))


@query("alert_state_machine", f"WITH RECURSIVE {_MACHINE} SELECT * FROM changes", _VIEWS)
def _(spark, sf):
    return _rounded(_changes(spark, sf))


_FIRINGS = f"""{_MACHINE},
firings AS (
  SELECT CAST(c.rule_id AS VARCHAR) || '@' || CAST(c.tick_s AS VARCHAR) AS firing_id, r.tenant_id, c.rule_id,
         c.tick_s AS fired_s, n.tick_s AS resolved_s, c.observed, r.severity, n.observed AS resolved_value
  FROM changes c JOIN live r ON r.rule_id = c.rule_id
  LEFT JOIN changes n ON n.rule_id = c.rule_id AND n.kind = 'resolved'
    AND n.tick_s = (SELECT min(x.tick_s) FROM changes x
                    WHERE x.rule_id = c.rule_id AND x.kind = 'resolved' AND x.tick_s > c.tick_s)
  WHERE c.kind = 'firing')"""


def _firings(spark, sf):
    return state.alert_firings(_changes(spark, sf), views.alert_rules(spark, sf))


@query(
    "alert_firings",
    f"""WITH RECURSIVE {_FIRINGS} SELECT f.*, r.signal_type AS signal, r.threshold FROM firings f
        JOIN live r ON r.rule_id = f.rule_id""",
    _VIEWS,
)
def _(spark, sf):
    field = lambda name: F.get_json_object("payload_json", f"$.{name}")
    rows = (
        _firings(spark, sf)
        .withColumn("resolved_value", field("resolved_value").cast("double"))
        .withColumn("signal", field("signal"))
        .withColumn("threshold", field("threshold").cast("double"))
        .drop("payload_json")
    )
    return _rounded(rows)


_DELIVERIES = f"""{_FIRINGS},
deliveries AS (SELECT f.*, c.channel_id, c.channel_type FROM firings f JOIN channels c ON c.tenant_id = f.tenant_id
               WHERE c.enabled)"""
_CHANNEL_VIEWS = [*_VIEWS, "channels"]


def _deliveries(spark, sf):
    return notify.fan_out_notifications(_firings(spark, sf), views.alert_rules(spark, sf), views.channels(spark, sf))


@query(
    "fan_out_notifications",
    f"WITH RECURSIVE {_DELIVERIES} SELECT firing_id, tenant_id, rule_id, channel_id, channel_type FROM deliveries",
    _CHANNEL_VIEWS,
)
def _(spark, sf):
    return _deliveries(spark, sf).select("firing_id", "tenant_id", "rule_id", "channel_id", "channel_type")


def _shown(value: str) -> str:
    return f"""CASE WHEN signal_type LIKE 'latency%' THEN format('{{:,}}', CAST(round({value}) AS BIGINT)) || 'ms'
      WHEN signal_type = 'error_rate' THEN format('{{:,.2f}}', round({value} * 100, 2)) || '%'
      WHEN signal_type = 'request_volume' THEN format('{{:,}}', CAST(round({value}) AS BIGINT))
      ELSE format('{{:,.2f}}', round({value}, 2)) END"""


_NOTES = f"""{_DELIVERIES},
notes AS (SELECT d.tenant_id, firing_id, d.rule_id,
  CASE signal_type WHEN 'error_rate' THEN 'error rate' WHEN 'request_volume' THEN 'request volume'
       WHEN 'latency_p50' THEN 'p50 latency' WHEN 'latency_p90' THEN 'p90 latency' WHEN 'latency_p99' THEN 'p99 latency'
       ELSE signal_type END || ' ' || CASE operator WHEN 'gt' THEN '>' WHEN 'gte' THEN '≥' WHEN 'lt' THEN '<' WHEN 'lte' THEN '≤' ELSE '=' END || ' ' ||
    {_shown('threshold')} AS title,
  rule_name || ' - observed ' || {_shown('observed')} || '.' AS body, d.severity, fired_s AS posted_s
  FROM deliveries d JOIN live r ON r.rule_id = d.rule_id WHERE channel_type = 'inapp')"""


def _notes(spark, sf):
    return notify.inapp_notifications(_deliveries(spark, sf), views.alert_rules(spark, sf))


_NOTE_COLUMNS = ["tenant_id", "firing_id", "rule_id", "title", "body", "severity", "posted_s"]


@query("inapp_notifications", f"WITH RECURSIVE {_NOTES} SELECT * FROM notes", _CHANNEL_VIEWS)
def _(spark, sf):
    return _notes(spark, sf).select(*_NOTE_COLUMNS)


@query(
    "list_firings",
    f"""WITH RECURSIVE {_FIRINGS}, ranked AS (
          SELECT f.* EXCLUDE resolved_value, r.rule_name, r.signal_type, count(*) OVER (PARTITION BY f.tenant_id) AS total,
                 row_number() OVER (PARTITION BY f.tenant_id ORDER BY fired_s DESC, firing_id) AS rn
          FROM firings f JOIN live r ON r.rule_id = f.rule_id)
        SELECT * EXCLUDE rn FROM ranked WHERE rn BETWEEN 21 AND 40""",
    _VIEWS,
)
def _(spark, sf):
    listed = notify.list_firings(_firings(spark, sf), views.alert_rules(spark, sf), page_no=2, page_size=20)
    return _rounded(listed)


@query(
    "list_notifications",
    f"""WITH RECURSIVE {_NOTES} SELECT * EXCLUDE rn FROM (
          SELECT *, row_number() OVER (PARTITION BY tenant_id ORDER BY posted_s DESC, firing_id) AS rn FROM notes)
        WHERE rn <= 50""",
    _CHANNEL_VIEWS,
)
def _(spark, sf):
    return notify.list_notifications(_notes(spark, sf), unread_only=True).select(*_NOTE_COLUMNS)


@query(
    "rule_state_gc",
    """SELECT rule_id, tenant_id, 'firing' AS last_state FROM alert_rules WHERE enabled""",
    ["alert_rules"],
)
def _(spark, sf):
    known = views.alert_rules(spark, sf)
    stored = known.select("rule_id", "tenant_id", F.lit("firing").alias("last_state"))
    return state.rule_state_gc(stored, known)
