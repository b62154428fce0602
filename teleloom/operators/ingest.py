"""Nested wire batches to wide fact rows.

Works on batch and streaming DataFrames alike: only explodes and expressions. Attributes named after
a vendor, ``<vendor>.agent.version`` and ``<vendor>.consumer.id``, take the prefix as a parameter.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from teleloom.functions.attributes import attributes_hash
from teleloom.functions.timing import clamp_span_window, clamp_timestamp, duration_ns, unix_ns_to_timestamp
from teleloom.functions.wire import (
    PROFILE_KINDS,
    TEMPORALITIES,
    any_value_to_int,
    any_value_to_string,
    by_key,
    default_severity_text,
    first_filled,
    hex_id,
    infer_server_error_status,
    int64,
    json_object,
    keys_of,
    named,
    span_kind,
    span_status,
    text_of,
    texts,
    texts_of,
)
from teleloom.schemas import DISK, HISTOGRAM_POINT, NETWORK, NUMBER_POINT, PROCESS

VENDOR = "telemetry"
# Attributes that become columns.
DB_SYSTEM_KEYS = ["db.system", "db.system.name"]
DB_STATEMENT_KEYS = ["db.statement", "db.query.text"]
SPAN_TEXT_KEYS = {
    "http_method": "http.request.method",
    "http_route": "http.route",
    "http_url": "url.full",
    "http_client_ip": "client.address",
}
HTTP_STATUS_KEY = "http.response.status_code"
SERVICE_KEYS = {
    "service_name": "service.name",
    "service_namespace": "service.namespace",
    "service_version": "service.version",
}
HOST_KEYS = {"host_id": "host.id", "host_name": "host.name", "os_type": "os.type", "os_version": "os.version"}
MAX_HTTP_STATUS = 65_535
MAX_CORES = 65_535


def _arrival(as_of_ns: Column | None) -> Column:
    return int64(F.col("received_unix_ns")) if as_of_ns is None else as_of_ns


def _records(
    batches: DataFrame, resources: str, scopes: str, records: str, resource_keys: dict[str, str], as_of_ns: Column | None,
    with_bytes: bool = True, source: bool = False,
) -> DataFrame:
    """One row per record with its tenant, arrival instant and resource columns.

    Resource attributes are read once per resource, before its records are exploded. With ``source`` the name of
    the scope comes along.
    """
    # An outer explode: the filter Spark derives from an inner one would parse JSON text a second time.
    by_resource = batches.select(
        "tenant_id", _arrival(as_of_ns).alias("_as_of"), F.explode_outer(resources).alias("_resource")
    ).filter(F.col("_resource").isNotNull())
    attributes = by_key(texts(F.col("_resource.resource.attributes"), with_bytes))
    by_scope = by_resource.withColumn("_map", attributes).select(
        "tenant_id",
        "_as_of",
        *[text_of(F.col("_map"), key).alias(name) for name, key in resource_keys.items()],
        F.explode(F.col(f"_resource.{scopes}")).alias("_scope"),
    )
    return by_scope.select(
        "tenant_id",
        "_as_of",
        *resource_keys,
        *([F.coalesce("_scope.scope.name", F.lit("")).alias("source_name")] if source else []),
        F.explode(F.col(f"_scope.{records}")).alias("r"),
    )


def _service_keys(vendor: str) -> dict[str, str]:
    return {**SERVICE_KEYS, "agent_version": f"{vendor}.agent.version"}


def _event_date(time_ns: str) -> Column:
    return F.to_date(unix_ns_to_timestamp(F.col(time_ns))).alias("event_date")


def flatten_spans(batches: DataFrame, as_of_ns: Column | None = None, vendor: str = VENDOR, source: bool = False) -> DataFrame:
    """One row per span. With ``source`` also the name of the scope that recorded it, as ``source_name``."""
    rows = _records(batches, "resource_spans", "scope_spans", "spans", _service_keys(vendor), as_of_ns, source=source)
    start, end = clamp_span_window(int64(F.col("r.start_time_unix_nano")), int64(F.col("r.end_time_unix_nano")), F.col("_as_of"))

    hoisted = {**SPAN_TEXT_KEYS, "consumer_id": f"{vendor}.consumer.id"}
    taken = [*hoisted.values(), HTTP_STATUS_KEY, *DB_SYSTEM_KEYS, *DB_STATEMENT_KEYS]
    # Attributes are told apart by key first, so that only those that stay attributes become texts in a list.
    rows = rows.select(
        "*",
        F.filter("r.attributes", lambda kv: kv["key"].isNotNull()).alias("_named"),
        texts(F.filter("r.attributes", lambda kv: ~F.coalesce(kv["key"], F.lit("")).isin(taken))).alias("_rest"),
    )
    rows = rows.withColumn("_values", F.map_from_arrays("_named.key", "_named.value"))
    value_of = lambda key: F.try_element_at("_values", F.lit(key))
    # The last value under the key mostly is a number; else the last one that is.
    codes = F.filter(
        F.transform(F.filter("_named", lambda kv: kv["key"] == HTTP_STATUS_KEY), lambda kv: any_value_to_int(kv["value"])),
        lambda code: code.isNotNull(),
    )
    last = any_value_to_int(value_of(HTTP_STATUS_KEY))
    status = F.coalesce(last, F.try_element_at(codes, F.lit(-1)), F.lit(0).cast("bigint"))
    databases = texts(F.filter("_named", lambda kv: kv["key"].isin([*DB_SYSTEM_KEYS, *DB_STATEMENT_KEYS])))

    def of_events(rule: Callable[[Column], Column], kind: str) -> Column:
        return F.coalesce(F.transform("r.events", rule), F.array().cast(f"array<{kind}>"))

    wide = rows.select(
        "*",
        start.alias("start_time_unix_ns"),
        end.alias("end_time_unix_ns"),
        span_kind(F.col("r.kind")).alias("span_kind"),
        span_status(F.col("r.status.code")).alias("status_code"),
        *[any_value_to_string(value_of(key)).alias(name) for name, key in hoisted.items()],
        F.greatest(F.lit(0), F.least(F.lit(MAX_HTTP_STATUS), status)).cast("int").alias("http_status_code"),
        databases.alias("_databases"),
    )
    return wide.select(
        "tenant_id",
        _event_date("start_time_unix_ns"),
        hex_id(F.col("r.trace_id")).alias("trace_id"),
        hex_id(F.col("r.span_id")).alias("span_id"),
        hex_id(F.col("r.parent_span_id")).alias("parent_span_id"),
        F.coalesce("r.trace_state", F.lit("")).alias("trace_state"),
        *_service_keys(vendor),
        F.coalesce("r.name", F.lit("")).alias("span_name"),
        "span_kind",
        "start_time_unix_ns",
        "end_time_unix_ns",
        duration_ns(F.col("start_time_unix_ns"), F.col("end_time_unix_ns")).alias("duration_ns"),
        "status_code",
        F.coalesce("r.status.message", F.lit("")).alias("status_message"),
        *SPAN_TEXT_KEYS,
        "http_status_code",
        "consumer_id",
        first_filled(F.col("_databases"), DB_SYSTEM_KEYS).alias("db_system"),
        first_filled(F.col("_databases"), DB_STATEMENT_KEYS).alias("db_statement"),
        F.lit(0).cast("bigint").alias("db_duration_ns"),
        keys_of(F.col("_rest")).alias("attrs_keys"),
        texts_of(F.col("_rest")).alias("attrs_values"),
        of_events(lambda e: F.coalesce(e["name"], F.lit("")), "string").alias("event_names"),
        of_events(lambda e: int64(e["time_unix_nano"]), "bigint").alias("event_times_unix_ns"),
        of_events(lambda e: json_object(texts(e["attributes"])), "string").alias("event_attrs_json"),
        *(["source_name"] if source else []),
    )


def with_inferred_status(spans: DataFrame) -> DataFrame:
    """Server spans that answered 5xx without a status become failed."""
    return spans.withColumn(
        "status_code", infer_server_error_status(F.col("span_kind"), F.col("status_code"), F.col("http_status_code"))
    )


def flatten_logs(batches: DataFrame, as_of_ns: Column | None = None, vendor: str = VENDOR) -> DataFrame:
    """One row per log record. A missing time falls back to the observed time and the other way round."""
    keys = _service_keys(vendor)
    rows = _records(batches, "resource_logs", "scope_logs", "log_records", keys, as_of_ns)
    time, seen = int64(F.col("r.time_unix_nano")), int64(F.col("r.observed_time_unix_nano"))
    number = F.coalesce("r.severity_number", F.lit(0))
    attrs = texts(F.col("r.attributes"))
    rows = rows.withColumn(
        "time_unix_ns", clamp_timestamp(F.when(time == 0, seen).otherwise(time), F.col("_as_of"))
    ).withColumn("observed_time_unix_ns", clamp_timestamp(F.when(seen == 0, time).otherwise(seen), F.col("_as_of")))
    return rows.withColumn("_attrs", attrs).select(
        "tenant_id",
        _event_date("time_unix_ns"),
        "time_unix_ns",
        "observed_time_unix_ns",
        "service_name",
        "service_namespace",
        "agent_version",
        F.greatest(F.lit(0), F.least(F.lit(255), number)).alias("severity_number"),
        default_severity_text(F.col("r.severity_text"), number).alias("severity_text"),
        any_value_to_string(F.col("r.body")).alias("body"),
        hex_id(F.col("r.trace_id"), 32).alias("trace_id"),
        hex_id(F.col("r.span_id"), 16).alias("span_id"),
        keys_of(F.col("_attrs")).alias("attrs_keys"),
        texts_of(F.col("_attrs")).alias("attrs_values"),
    )


def flatten_metrics(batches: DataFrame, as_of_ns: Column | None = None, vendor: str = VENDOR, arrival: bool = False) -> DataFrame:
    """One row per data point of gauges, sums and histograms; attributes sorted by key.

    The points of the three kinds are exploded together, so the batches are read once. With ``arrival`` the
    points also have the instant at which their batch came in, as ``arrival_unix_ns``.
    """
    keys = _service_keys(vendor)
    rows = _records(batches, "resource_metrics", "scope_metrics", "metrics", keys, as_of_ns, with_bytes=False)

    # One array is filled, the other empty, so their elements stand beside nulls of the other shape.
    gauges, sums, histograms = (F.col(f"r.{shape}.data_points") for shape in ("gauge", "sum", "histogram"))
    kind = F.when(gauges.isNotNull(), "GAUGE").when(sums.isNotNull(), "SUM").otherwise("HISTOGRAM")
    numbers = F.coalesce(gauges, sums)
    nothing = F.array()
    pairs = F.arrays_zip(
        F.coalesce(numbers, nothing.cast(f"array<{NUMBER_POINT}>")).alias("n"),
        F.coalesce(F.when(numbers.isNull(), histograms), nothing.cast(f"array<{HISTOGRAM_POINT}>")).alias("h"),
    )
    sum_kind, histogram_kind = (
        named(F.col(f"r.{shape}.aggregation_temporality"), TEMPORALITIES, "UNSPECIFIED") for shape in ("sum", "histogram")
    )
    points = rows.select(
        "tenant_id",
        "_as_of",
        *keys,
        F.col("r.name").alias("metric_name"),
        F.coalesce("r.unit", F.lit("")).alias("metric_unit"),
        kind.alias("metric_kind"),
        F.when(gauges.isNotNull(), "UNSPECIFIED").when(sums.isNotNull(), sum_kind).otherwise(histogram_kind).alias(
            "aggregation_temporality"
        ),
        (gauges.isNull() & sums.isNotNull() & F.coalesce("r.sum.is_monotonic", F.lit(False))).alias("is_monotonic"),
        F.explode(pairs).alias("p"),
    )
    is_histogram = F.col("metric_kind") == "HISTOGRAM"
    of_either = lambda name: F.coalesce(f"p.n.{name}", f"p.h.{name}")
    ordered = F.sort_array(texts(of_either("attributes"), with_bytes=False))
    time, start = int64(of_either("time_unix_nano")), int64(of_either("start_time_unix_nano"))
    flat = points.select(
        "*",
        clamp_timestamp(time, F.col("_as_of")).alias("time_unix_ns"),
        F.when(start == 0, time).otherwise(start).alias("start_time_unix_ns"),
        ordered.alias("_attrs"),
    ).select("*", keys_of(F.col("_attrs")).alias("attrs_keys"), texts_of(F.col("_attrs")).alias("attrs_values"))
    return flat.select(
        "tenant_id",
        _event_date("time_unix_ns"),
        "time_unix_ns",
        "start_time_unix_ns",
        "service_name",
        "service_namespace",
        "agent_version",
        "metric_name",
        "metric_unit",
        "metric_kind",
        "aggregation_temporality",
        "is_monotonic",
        F.col("p.n.as_double").alias("value_double"),
        F.col("p.n.as_int").try_cast("bigint").alias("value_int"),
        F.when(is_histogram, int64(F.col("p.h.count"))).alias("histogram_count"),
        *[F.col(f"p.h.{part}").alias(f"histogram_{part}") for part in ("sum", "min", "max")],
        F.when(F.col("p.h.bucket_counts").isNotNull(), F.transform("p.h.bucket_counts", int64))
        .otherwise(nothing.cast("array<bigint>"))
        .alias("histogram_bucket_counts"),
        F.coalesce("p.h.explicit_bounds", nothing.cast("array<double>")).alias("histogram_bucket_bounds"),
        "attrs_keys",
        "attrs_values",
        attributes_hash(F.col("attrs_keys"), F.col("attrs_values")).alias("attrs_hash"),
        *([F.col("_as_of").alias("arrival_unix_ns")] if arrival else []),
    )


# ---------------------------------------------------------------------------- host snapshots


def _snapshots(batches: DataFrame) -> DataFrame:
    rows = batches.select("tenant_id", F.explode_outer("snapshots").alias("s")).filter(F.col("s").isNotNull())
    rows = rows.withColumn("_map", by_key(texts(F.col("s.resource.attributes"), with_bytes=False)))
    rows = rows.select(
        "tenant_id",
        int64(F.col("s.time_unix_nano")).alias("time_unix_ns"),
        *[text_of(F.col("_map"), key).alias(name) for name, key in HOST_KEYS.items()],
        "s",
    )
    return rows.withColumn("event_date", F.to_date(unix_ns_to_timestamp(F.col("time_unix_ns"))))


def _number(column: str, kind: str = "double") -> Column:
    return F.coalesce(F.col(column), F.lit(0)).cast(kind)


def _cpu_memory_columns() -> list[Column]:
    """Columns of a snapshot's own row beside those of ``_snapshots``; missing CPU or memory parts read as 0."""
    cores = F.greatest(F.lit(0), F.least(F.lit(MAX_CORES), _number("s.cpu.logical_cores", "int")))
    return [
        cores.alias("logical_cores"),
        *[_number(f"s.cpu.load_{m}").alias(f"load_{m}") for m in ("1m", "5m", "15m")],
        *[_number(f"s.cpu.utilization_{p}").alias(f"cpu_util_{p}") for p in ("user", "system", "iowait", "idle")],
        *[
            int64(F.col(f"s.memory.{source}")).alias(target)
            for source, target in (
                ("total_bytes", "mem_total_bytes"),
                ("available_bytes", "mem_available_bytes"),
                ("used_bytes", "mem_used_bytes"),
                ("swap_total_bytes", "swap_total_bytes"),
                ("swap_used_bytes", "swap_used_bytes"),
            )
        ],
    ]


def _texts_and_numbers(part: str, text: list[str], whole: list[str]) -> list[Column]:
    return [
        *[F.coalesce(F.col(f"{part}.{c}"), F.lit("")).alias(c) for c in text],
        *[int64(F.col(f"{part}.{c}")).alias(c) for c in whole],
    ]


def _disk_columns(part: str) -> list[Column]:
    whole = ["total_bytes", "used_bytes", "reads_per_sec", "writes_per_sec", "read_bytes_per_sec", "write_bytes_per_sec"]
    return _texts_and_numbers(part, ["device", "mountpoint"], whole)


def _network_columns(part: str) -> list[Column]:
    whole = [f"{d}_{m}" for m in ("bytes_per_sec", "packets_per_sec", "errors") for d in ("rx", "tx")]
    return _texts_and_numbers(part, ["interface_name"], whole)


def _process_columns(part: str) -> list[Column]:
    return [
        *_texts_and_numbers(part, ["command", "runtime_version", "service_name"], ["rss_bytes"]),
        F.coalesce(F.col(f"{part}.user"), F.lit("")).alias("user_name"),
        _number(f"{part}.pid", "bigint").alias("pid"),
        _number(f"{part}.cpu_utilization").alias("cpu_utilization"),
        _number(f"{part}.thread_count", "int").alias("thread_count"),
        _number(f"{part}.handle_count", "int").alias("handle_count"),
    ]


# Columns that all rows of a snapshot share, and the tables of its parts.
SHARED = ["tenant_id", "event_date", "time_unix_ns", "host_id"]
OWN_KEYS = [name for name in HOST_KEYS if name not in SHARED]
PART_TABLES = {
    "host_disks": ("disks", DISK, _disk_columns),
    "host_networks": ("networks", NETWORK, _network_columns),
    "host_processes": ("processes", PROCESS, _process_columns),
}


def flatten_host_cpu_memory(batches: DataFrame) -> DataFrame:
    """One row per snapshot; missing CPU or memory parts read as 0."""
    return _snapshots(batches).select(*SHARED, *OWN_KEYS, *_cpu_memory_columns())


def _host_parts(batches: DataFrame, table: str) -> DataFrame:
    part, _, columns = PART_TABLES[table]
    return _snapshots(batches).select(*SHARED, F.explode(f"s.{part}").alias("p")).select(*SHARED, *columns("p"))


def flatten_host_disks(batches: DataFrame) -> DataFrame:
    return _host_parts(batches, "host_disks")


def flatten_host_networks(batches: DataFrame) -> DataFrame:
    return _host_parts(batches, "host_networks")


def flatten_host_processes(batches: DataFrame) -> DataFrame:
    return _host_parts(batches, "host_processes")


def flatten_host_snapshots(batches: DataFrame) -> dict[str, DataFrame]:
    """The four fact tables of host snapshots. Persist the batches first when writing all of them."""
    return {
        "host_cpu_memory": flatten_host_cpu_memory(batches),
        "host_disks": flatten_host_disks(batches),
        "host_networks": flatten_host_networks(batches),
        "host_processes": flatten_host_processes(batches),
    }


def host_snapshot_rows(batches: DataFrame) -> DataFrame:
    """The rows of all four tables in one pass over the batches: a column for each table, null where it has no row.

    The first disk, interface and process of a snapshot stand beside its CPU and memory, the second ones
    beside each other, and so on. A part that is null within its list is a row too, as in the tables.
    """
    # An absent list is as an empty one; shorter lists are filled up with nulls, told from rows by their place.
    lists = [
        F.coalesce(f"s.{part}", F.array().cast(f"array<{kind}>")).alias(part) for part, kind, _ in PART_TABLES.values()
    ]
    # Sizes and the snapshot's own row come before the explode, which would repeat whole lists otherwise.
    snapshots = _snapshots(batches).select(
        *SHARED,
        F.struct(*SHARED, *OWN_KEYS, *_cpu_memory_columns()).alias("_own"),
        F.struct(*[F.array_size(f"s.{part}").alias(part) for part, _, _ in PART_TABLES.values()]).alias("_sizes"),
        F.arrays_zip(*lists).alias("_parts"),
    )
    rows = snapshots.select(*SHARED, "_own", "_sizes", F.posexplode_outer("_parts").alias("_place", "p"))
    return rows.select(
        "tenant_id",
        F.when(F.coalesce("_place", F.lit(0)) == 0, F.col("_own")).alias("host_cpu_memory"),
        *[
            F.when(F.col("_place") < F.col(f"_sizes.{part}"), F.struct(*SHARED, *columns(f"p.{part}"))).alias(table)
            for table, (part, _, columns) in PART_TABLES.items()
        ],
    )


def host_snapshot_counts(batches: DataFrame) -> DataFrame:
    """Rows of each of these tables by tenant. All are flattened, with every column, in one pass over the batches."""
    tables = ["host_cpu_memory", *PART_TABLES]
    # The rows can be null, so Spark has to make each of them to count it.
    counts = host_snapshot_rows(batches).groupBy("tenant_id").agg(*[F.count(table).alias(table) for table in tables])
    return counts.unpivot("tenant_id", tables, "table_name", "row_count").filter("row_count > 0")


def flatten_profiles(batches: DataFrame, vendor: str = VENDOR) -> DataFrame:
    """One row per capture, the payload as Base64."""
    rows = _records(batches, "resource_profiles", "scope_profiles", "profiles", _service_keys(vendor), None)
    rows = rows.withColumn("start_time_unix_ns", int64(F.col("r.start_time_unix_nano")))
    rows = rows.withColumn("_attrs", texts(F.col("r.attributes")))
    return rows.select(
        "tenant_id",
        _event_date("start_time_unix_ns"),
        "start_time_unix_ns",
        int64(F.col("r.duration_nano")).alias("duration_nanos"),
        "service_name",
        "service_namespace",
        "agent_version",
        named(F.col("r.kind"), PROFILE_KINDS, "UNSPECIFIED").alias("profile_kind"),
        int64(F.col("r.sample_count")).alias("sample_count"),
        F.coalesce(F.base64("r.pprof"), F.lit("")).alias("pprof_base64"),
        hex_id(F.col("r.trigger_trace_id"), 32).alias("trigger_trace_id"),
        keys_of(F.col("_attrs")).alias("attrs_keys"),
        texts_of(F.col("_attrs")).alias("attrs_values"),
    )
