"""Log reads."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from teleloom.functions.attributes import attribute_map
from teleloom.functions.predicates import bounded
from teleloom.functions.ranking import top_n, top_n_by
from teleloom.functions.timing import bucket_start, to_millis
from teleloom.operators.rollups import LOGS_MINUTELY, merge
from teleloom.scope import Scope

TIME = "time_unix_ns"
NS_PER_MS = 1_000_000
# Fixed value: log records shown for one trace by default.
TRACE_LOG_LIMIT = 500
# Severity names.
SEVERITIES = ("TRACE", "DEBUG", "INFO", "WARN", "ERROR", "FATAL")
# Spread of records without a trace id.
NO_KEY_PARTS = 256


def list_logs(
    logs: DataFrame,
    tenant_id: object | None = None,
    from_ms: int | None = None,
    to_ms: int | None = None,
    service: str = "",
    min_severity: int = 0,
    body: str = "",
    trace_id: str | None = None,
    cursor_ms: int | None = None,
    after: tuple[int, str] | None = None,
    limit: int | None = 100,
) -> DataFrame:
    """Newest records first; ``next_cursor_ms`` is the millisecond to pass as the next cursor.

    Millisecond paging can pass over records of the same millisecond. ``after`` = (time_unix_ns,
    trace_id + span_id) of the last row continues exactly.
    """
    df = logs
    # Millisecond bounds as nanosecond ranges, so they reach the Parquet scan.
    if from_ms:
        df = df.filter(F.col(TIME) >= from_ms * NS_PER_MS)
    if to_ms:
        df = df.filter(F.col(TIME) < (to_ms + 1) * NS_PER_MS)
    if cursor_ms:
        df = df.filter(F.col(TIME) < cursor_ms * NS_PER_MS)
    scope = Scope(tenant_id, from_ms * NS_PER_MS if from_ms else None, (to_ms + 1) * NS_PER_MS if to_ms else None)
    df = scope.apply(df, TIME)
    if service:
        df = df.filter(F.col("service_name") == service)
    if min_severity > 0:
        df = df.filter(F.col("severity_number") >= min_severity)
    if body:
        df = df.filter(F.contains(F.lower("body"), F.lit(body.lower())))
    if trace_id is not None:
        df = df.filter(F.col("trace_id") == trace_id.lower())
    ids = F.concat("trace_id", "span_id")
    if after is not None:
        last_ns, last_ids = after
        df = df.filter((F.col(TIME) < last_ns) | ((F.col(TIME) == last_ns) & (ids < last_ids)))
    rows = top_n(df, scope, [F.col(TIME).desc(), ids.desc()], bounded(limit, 100))
    # At most the listed rows of each tenant.
    return rows.withColumn("next_cursor_ms", to_millis(F.min(TIME).over(Window.partitionBy("tenant_id"))))


def logs_for_trace(
    logs: DataFrame, tenant_id: object, trace_id: str, limit: int | None = TRACE_LOG_LIMIT
) -> DataFrame:
    """Oldest records of one trace first; without a limit all of them."""
    wanted = (F.col("tenant_id") == tenant_id) & (F.col("trace_id") == trace_id.lower())
    return top_n(logs.filter(wanted), Scope(tenant_id), [F.col(TIME), F.col("span_id")], bounded(limit, TRACE_LOG_LIMIT))


def logs_for_traces(logs: DataFrame, wanted: DataFrame, limit: int | None = TRACE_LOG_LIMIT) -> DataFrame:
    """The same for every trace listed in ``wanted`` (tenant_id, trace_id), ``limit`` records of each."""
    keys = wanted.select("tenant_id", F.lower("trace_id").alias("trace_id"))
    found = logs.join(keys, ["tenant_id", "trace_id"], "left_semi")
    return top_n_by(found, ["tenant_id", "trace_id"], [F.col(TIME), F.col("span_id")], bounded(limit, TRACE_LOG_LIMIT))


def log_volume_timeseries(
    states: DataFrame, scope: Scope = Scope(), service: str = "", bucket_s: int = 60
) -> DataFrame:
    """Records per bucket and severity from the minutely rollup."""
    df = scope.apply_bucket(states, "bucket_s")
    if service:
        df = df.filter(F.col("service_name") == service)
    df = df.withColumn("bucket_s", bucket_start(F.col("bucket_s"), max(60, bucket_s)))
    keys = ["tenant_id", "bucket_s", "severity_text"]
    return merge(LOGS_MINUTELY, df, keys).orderBy(*keys)


def log_volume_pivot(volume: DataFrame, severities: Sequence[str] = SEVERITIES) -> DataFrame:
    """One column per named severity, 0 where a bucket has none; a blank severity is ``?``.

    Records of a severity without a column are added up in ``other``.
    """
    shown = F.when(F.coalesce("severity_text", F.lit("")) == "", "?").otherwise(F.col("severity_text"))
    counted = lambda inside: F.sum(F.when(inside, F.col("log_count")).otherwise(F.lit(0).cast("bigint")))
    named = [counted(shown == name).alias(name) for name in severities]
    other = counted(~shown.isin(list(severities))).alias("other")
    return volume.groupBy("tenant_id", "bucket_s").agg(*named, other)


def log_view(logs: DataFrame) -> DataFrame:
    """Display form: attributes as a map, ids in lower case."""
    shown = [c for c in logs.columns if c not in ("attrs_keys", "attrs_values", "trace_id", "span_id")]
    return logs.select(
        *shown,
        F.lower("trace_id").alias("trace_id"),
        F.lower("span_id").alias("span_id"),
        attribute_map(F.col("attrs_keys"), F.col("attrs_values")).alias("attributes"),
    )


def correlate_logs_traces(logs: DataFrame, spans: DataFrame, by_span: bool = False) -> DataFrame:
    """Every log record with the trace (or the very span) that produced it.

    By trace the span side is first cut to one row per trace. Records without a trace id find no
    partner; the part number keeps them off a single reducer.
    """
    keys = ["tenant_id", "trace_id", "span_id"] if by_span else ["tenant_id", "trace_id"]
    linked = (
        spans.filter(F.col("trace_id") != "")
        .groupBy(*keys)
        .agg(
            F.count(F.lit(1)).alias("span_count"),
            F.min("start_time_unix_ns").alias("trace_start_ns"),
            F.max(F.col("status_code") == "ERROR").alias("trace_failed"),
        )
        .withColumn("_part", F.lit(0).cast("bigint"))
    )
    part = F.when(F.col("trace_id") == "", F.pmod(F.xxhash64(TIME, "service_name"), F.lit(NO_KEY_PARTS))).otherwise(0)
    return logs.withColumn("_part", part.cast("bigint")).join(linked, [*keys, "_part"], "left").drop("_part")
