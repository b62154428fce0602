"""Whole-trace reads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from teleloom.functions.attributes import attribute_map
from teleloom.functions.predicates import flag, is_server_error, is_server_span
from teleloom.functions.timing import duration_ns

TRACE_KEYS = ["tenant_id", "trace_id"]
START, END = "start_time_unix_ns", "end_time_unix_ns"


def get_trace(spans: DataFrame, tenant_id: object, trace_id: str) -> DataFrame:
    """All spans of one trace in start order; empty when the trace is unknown."""
    wanted = (F.col("tenant_id") == tenant_id) & (F.col("trace_id") == trace_id.lower())
    return spans.filter(wanted).orderBy(START, "span_id")


def get_traces(spans: DataFrame, wanted: DataFrame) -> DataFrame:
    """All spans of the traces listed in ``wanted`` (tenant_id, trace_id)."""
    keys = wanted.select("tenant_id", F.lower("trace_id").alias("trace_id"))
    return spans.join(keys, TRACE_KEYS, "left_semi")


def span_view(spans: DataFrame) -> DataFrame:
    """Display form: attributes as a map, events as structs, duration never negative."""
    events = F.transform(
        F.col("event_names"),
        lambda name, i: F.struct(
            name.alias("name"),
            F.coalesce(F.get("event_times_unix_ns", i), F.lit(0).cast("bigint")).alias("time_unix_ns"),
            F.coalesce(F.get("event_attrs_json", i), F.lit("{}")).alias("attrs_json"),
        ),
    )
    hidden = ["attrs_keys", "attrs_values", "event_names", "event_times_unix_ns", "event_attrs_json", "duration_ns"]
    shown = [c for c in spans.columns if c not in hidden]
    return spans.select(
        *shown,
        duration_ns(F.col(START), F.col(END)).alias("duration_ns"),
        attribute_map(F.col("attrs_keys"), F.col("attrs_values")).alias("attributes"),
        events.alias("events"),
    )


def _when_min(condition: Column, order: Column) -> Column:
    """Aggregate: the smallest ``order`` among rows meeting the condition, null if none."""
    return F.min(F.when(condition, order))


def trace_summary(spans: DataFrame) -> DataFrame:
    """One row per trace: extent, services, call counts, root server span and slowest span.

    Only small structs are kept per trace, so a trace with very many spans combines map-side.
    """
    first = F.struct(F.col(START).alias("ts"), F.col("span_id").alias("span_id"))
    root = is_server_span() & (F.coalesce(F.col("parent_span_id"), F.lit("")) == "")
    no_db = F.col("db_system") == ""
    grouped = spans.groupBy(*TRACE_KEYS).agg(
        F.count(F.lit(1)).alias("span_count"),
        F.min(START).alias("start_ns"),
        F.max(END).alias("end_ns"),
        F.collect_set(F.when(F.col("service_name") != "", F.col("service_name"))).alias("services"),
        F.sum(flag(~no_db)).alias("db_spans"),
        F.sum(flag((F.col("span_kind") == "CLIENT") & no_db)).alias("http_client_spans"),
        _when_min(root, first).alias("_root"),
        _when_min(is_server_span(), first).alias("_server"),
        # Longest duration; the earliest such span wins.
        F.max(F.struct(F.col("duration_ns"), (-F.col(START)).alias("neg_ts"), F.col("span_id"))).alias("_slow"),
    )
    return grouped.select(
        *TRACE_KEYS,
        "span_count",
        "start_ns",
        "end_ns",
        F.greatest(F.lit(1).cast("bigint"), F.col("end_ns") - F.col("start_ns")).alias("total_ns"),
        F.array_sort("services").alias("services"),
        "db_spans",
        "http_client_spans",
        F.coalesce("_root.span_id", "_server.span_id").alias("root_span_id"),
        F.col("_slow.span_id").alias("slowest_span_id"),
        F.col("_slow.duration_ns").alias("slowest_duration_ns"),
    )


# Fixed value: narrowest bar drawn, as a share of the trace.
LEAST_WIDTH = 0.005


def trace_waterfall(spans: DataFrame) -> DataFrame:
    """Offset and width of every span as fractions of its trace."""
    extent = spans.groupBy(*TRACE_KEYS).agg(F.min(START).alias("_t0"), F.max(END).alias("_t1"))
    whole = F.greatest(F.lit(1).cast("bigint"), F.col("_t1") - F.col("_t0"))
    return spans.join(extent, TRACE_KEYS).select(
        *TRACE_KEYS,
        "span_id",
        START,
        ((F.col(START) - F.col("_t0")) / whole).alias("offset_fraction"),
        F.greatest(F.lit(LEAST_WIDTH), F.col("duration_ns") / whole).alias("width_fraction"),
        flag(is_server_error()).alias("is_error"),
    )
