"""Wire batches made by nesting the telemetry views: input for the flatten jobs.

Batches stay small (one trace, or one service and hour), as senders produce them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from teleloom.functions.timing import bucket_start
from teleloom.sources import views

HOUR_NS = 3600 * 1_000_000_000
VENDOR = "telemetry"


def _value(text: Column | None = None, whole: Column | None = None, number: Column | None = None) -> Column:
    nothing = lambda kind: F.lit(None).cast(kind)
    return F.struct(
        (nothing("string") if text is None else text).alias("string_value"),
        nothing("boolean").alias("bool_value"),
        (nothing("string") if whole is None else whole.cast("string")).alias("int_value"),
        (nothing("double") if number is None else number.cast("double")).alias("double_value"),
        nothing("binary").alias("bytes_value"),
    )


def _kv(key: str, **value: Column) -> Column:
    return F.struct(F.lit(key).alias("key"), _value(**value).alias("value"))


def _as_lines(batches: DataFrame) -> DataFrame:
    """Each batch as one JSON line in ``value``."""
    return batches.select(F.to_json(F.struct(*batches.columns)).alias("value"))


def _list(name: str, texts: Column) -> Column:
    """The start of a JSON object whose first field is a list of JSON texts; its other fields are still to come."""
    return F.concat(F.lit(f'{{"{name}":['), F.array_join(texts, ","), F.lit("],"))


def _line(name: str, texts: Column, *fields: str) -> Column:
    """One batch as a JSON line from the JSON texts of its parts and its own fields.

    Records become text before they are grouped: short strings are shuffled and sorted, not nested rows.
    """
    # With nulls written out the object is never empty, so its fields can follow the comma.
    rest = F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})
    return F.concat(_list(name, texts), F.substr(rest, F.lit(2))).alias("value")


def _of_resource(scopes: str, records: str, texts: Column, resource: Column) -> Column:
    """JSON text of a resource with one scope holding the records."""
    return F.concat(
        F.lit(f'{{"{scopes}":[{{"{records}":['), F.array_join(texts, ","), F.lit(']}],"resource":'), F.to_json(resource), F.lit("}")
    )


def _resource(**attributes: Column) -> Column:
    pairs = [_kv(key.replace("__", "."), text=value) for key, value in attributes.items()]
    return F.struct(F.array(*pairs).alias("attributes"))


def span_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One batch per trace. Some arrive two hours late; routes and database keys come twice."""
    spans = views.spans(spark, sf_dir)
    code = F.col("http_status_code")
    k = F.get("attrs_values", F.lit(1)).cast("int")
    attributes = F.array(
        _kv("http.route", text=F.lit("stale")),
        _kv("http.request.method", text=F.col("http_method")),
        _kv("event.type", text=F.get("attrs_values", F.lit(0))),
        _kv("http.route", text=F.col("http_route")),
        # The status as integer, text or fraction.
        F.when(code == 200, _kv("http.response.status_code", whole=code))
        .when(code == 404, _kv("http.response.status_code", text=code.cast("string")))
        .otherwise(_kv("http.response.status_code", number=code + F.lit(0.7))),
        _kv("url.full", text=F.col("http_url")),
        _kv("db.system", text=F.lit("")),
        _kv("db.system.name", text=F.col("db_system")),
        _kv("db.statement", text=F.col("db_statement")),
        _kv("db.query.text", text=F.lit("ignored when the statement is set")),
        _kv("k", whole=k),
        _kv("ratio", number=k / 4),
        _kv(f"{VENDOR}.consumer.id", text=F.col("consumer_id")),
    )
    events = F.transform(
        "event_names",
        lambda name, i: F.struct(
            F.get("event_times_unix_ns", i).cast("string").alias("time_unix_nano"),
            name.alias("name"),
            F.array(_kv("exception.type", text=F.lit('say "no"'))).alias("attributes"),
        ),
    )
    span = F.struct(
        F.upper("trace_id").alias("trace_id"),
        F.col("span_id"),
        F.col("parent_span_id"),
        F.col("span_name").alias("name"),
        F.when(F.col("span_kind") == "SERVER", 2).otherwise(3).alias("kind"),
        F.col("start_time_unix_ns").cast("string").alias("start_time_unix_nano"),
        F.col("end_time_unix_ns").cast("string").alias("end_time_unix_nano"),
        attributes.alias("attributes"),
        events.alias("events"),
        F.struct(
            F.when(F.col("status_code") == "OK", 1).when(F.col("status_code") == "ERROR", 2).otherwise(0).alias("code")
        ).alias("status"),
    )
    # Shuffled once by trace, while the rows are narrow; both groupings keep that order.
    texts = spans.repartition("tenant_id", "trace_id").select(
        "tenant_id", "trace_id", "service_name", "service_version", "start_time_unix_ns", k.alias("k"), F.to_json(span).alias("span")
    )
    by_service = texts.groupBy("tenant_id", "trace_id", "service_name", "service_version").agg(
        F.collect_list("span").alias("spans"), F.min("start_time_unix_ns").alias("t0"), F.max("k").alias("k")
    )
    resource = _resource(service__name=F.col("service_name"), service__version=F.col("service_version"))
    resource_spans = _of_resource("scope_spans", "spans", F.col("spans"), resource)
    delay = F.when(F.max("k") % 10 == 3, 2 * HOUR_NS).otherwise(60 * 1_000_000_000)
    batches = (
        by_service.select("tenant_id", "trace_id", "t0", "k", resource_spans.alias("resource_spans"))
        .groupBy("tenant_id", "trace_id")
        .agg((F.min("t0") + delay).cast("string").alias("received_unix_ns"), F.collect_list("resource_spans").alias("resource_spans"))
    )
    return batches.select(_line("resource_spans", F.col("resource_spans"), "tenant_id", "received_unix_ns"))


def log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One batch per service and hour; INFO texts and WARN times are left out."""
    logs = views.logs(spark, sf_dir)
    missing_time = F.col("severity_text") == "WARN"
    record = F.struct(
        F.when(missing_time, "0").otherwise(F.col("time_unix_ns").cast("string")).alias("time_unix_nano"),
        F.when(missing_time, F.col("time_unix_ns").cast("string")).alias("observed_time_unix_nano"),
        F.col("severity_number"),
        F.when(F.col("severity_text") == "INFO", "").otherwise(F.col("severity_text")).alias("severity_text"),
        _value(text=F.col("body")).alias("body"),
        F.array(
            _kv("lang", text=F.get("attrs_values", F.lit(0))), _kv("source", text=F.get("attrs_values", F.lit(1)))
        ).alias("attributes"),
        F.when(F.col("trace_id") == "", "abc").otherwise(F.upper("trace_id")).alias("trace_id"),
        F.col("span_id"),
    )
    batches = logs.groupBy("tenant_id", "service_name", bucket_start(F.col("time_unix_ns"), HOUR_NS).alias("hour")).agg(
        F.max("time_unix_ns").cast("string").alias("received_unix_ns"), F.collect_list(record).alias("log_records")
    )
    resource_logs = F.struct(
        _resource(service__name=F.col("service_name")).alias("resource"),
        F.array(F.struct(F.col("log_records"))).alias("scope_logs"),
    )
    return _as_lines(batches.select("tenant_id", "received_unix_ns", F.array(resource_logs).alias("resource_logs")))


def metric_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One batch per service and minute, attributes out of order."""
    points = views.metric_points(spark, sf_dir)
    flag, status = F.get("attrs_values", F.lit(0)), F.get("attrs_values", F.lit(1))
    attributes = F.array(_kv("status", text=status), _kv("flag", text=flag))
    time = F.col("time_unix_ns").cast("string")
    number = F.struct(
        attributes.alias("attributes"),
        F.lit("0").alias("start_time_unix_nano"),
        time.alias("time_unix_nano"),
        F.col("value_double").alias("as_double"),
        F.col("value_int").cast("string").alias("as_int"),
    )
    histogram = F.struct(
        attributes.alias("attributes"),
        time.alias("time_unix_nano"),
        F.lit("3").alias("count"),
        F.col("histogram_sum").alias("sum"),
        F.array(F.lit("1"), F.lit("2")).alias("bucket_counts"),
        F.array(F.lit(0.5)).alias("explicit_bounds"),
    )
    kind = F.col("metric_kind")
    metric = F.struct(
        F.col("metric_name").alias("name"),
        F.col("metric_unit").alias("unit"),
        F.when(kind == "GAUGE", F.struct(F.array(number).alias("data_points"))).alias("gauge"),
        F.when(
            kind == "SUM",
            F.struct(
                F.array(number).alias("data_points"),
                F.lit(2).alias("aggregation_temporality"),
                F.lit(True).alias("is_monotonic"),
            ),
        ).alias("sum"),
        F.when(
            kind == "HISTOGRAM",
            F.struct(F.array(histogram).alias("data_points"), F.lit(1).alias("aggregation_temporality")),
        ).alias("histogram"),
    )
    minute = bucket_start(F.col("time_unix_ns"), 60 * 1_000_000_000).alias("minute")
    batches = (
        points.select("tenant_id", "service_name", minute, "time_unix_ns", F.to_json(metric).alias("metric"))
        .groupBy("tenant_id", "service_name", "minute")
        .agg(F.max("time_unix_ns").cast("string").alias("received_unix_ns"), F.collect_list("metric").alias("metrics"))
    )
    resource_metrics = _of_resource(
        "scope_metrics", "metrics", F.col("metrics"), _resource(service__name=F.col("service_name"))
    )
    return batches.select(_line("resource_metrics", F.array(resource_metrics), "tenant_id", "received_unix_ns"))


def host_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One snapshot per host sample with a disk and an interface, and process snapshots without CPU."""
    keys = ["tenant_id", "host_id", "time_unix_ns"]
    quoted = lambda *names: [F.col(n).cast("string").alias(n) for n in names]
    machine = views.host_cpu_memory(spark, sf_dir).select(
        *keys,
        "host_name",
        F.struct("logical_cores", F.col("cpu_util_user").alias("utilization_user")).alias("cpu"),
        F.struct(
            F.col("mem_total_bytes").cast("string").alias("total_bytes"),
            F.col("mem_used_bytes").cast("string").alias("used_bytes"),
        ).alias("memory"),
    )
    disks = views.host_disks(spark, sf_dir).select(
        *keys,
        F.array(
            F.struct(
                "device",
                *quoted("total_bytes", "used_bytes", "reads_per_sec", "writes_per_sec", "read_bytes_per_sec", "write_bytes_per_sec"),
            )
        ).alias("disks"),
    )
    networks = views.host_networks(spark, sf_dir).select(
        *keys,
        F.array(
            F.struct(
                "interface_name",
                *quoted("rx_bytes_per_sec", "tx_bytes_per_sec", "rx_packets_per_sec", "tx_packets_per_sec"),
            )
        ).alias("networks"),
    )
    process = F.to_json(F.struct("pid", "command", "cpu_utilization", *quoted("rss_bytes"), "thread_count"))
    processes = (
        views.host_processes(spark, sf_dir)
        .select(*keys, process.alias("process"))
        .groupBy(*keys)
        .agg(F.collect_list("process").alias("processes"))
    )
    time = F.col("time_unix_ns").cast("string").alias("time_unix_nano")
    resource = lambda name: _resource(host__id=F.col("host_id"), host__name=name).alias("resource")
    whole = machine.join(disks, keys).join(networks, keys)
    snapshot = F.struct(resource(F.col("host_name")), time, "cpu", "memory", "disks", "networks")
    # A process snapshot names no host.
    nameless = F.to_json(F.struct(resource(F.lit(None).cast("string")), time))
    by_host = F.concat(_list("processes", F.col("processes")), F.substr(nameless, F.lit(2)))
    return _as_lines(whole.select("tenant_id", F.array(snapshot).alias("snapshots"))).unionAll(
        processes.select(_line("snapshots", F.array(by_host), "tenant_id"))
    )


def profile_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    profiles = views.profiles(spark, sf_dir)
    record = F.struct(
        F.col("start_time_unix_ns").cast("string").alias("start_time_unix_nano"),
        F.col("duration_nanos").cast("string").alias("duration_nano"),
        F.when(F.col("profile_kind") == "CPU", 1).when(F.col("profile_kind") == "WALL", 2).otherwise(3).alias("kind"),
        F.col("sample_count").cast("string").alias("sample_count"),
        F.try_to_binary("pprof_base64", F.lit("base64")).alias("pprof"),
        F.lit("ABCDEF").alias("trigger_trace_id"),
    )
    hour = bucket_start(F.col("start_time_unix_ns"), HOUR_NS).alias("hour")
    batches = profiles.groupBy("tenant_id", "service_name", hour).agg(F.collect_list(record).alias("profiles"))
    resource_profiles = F.struct(
        _resource(service__name=F.col("service_name")).alias("resource"),
        F.array(F.struct(F.col("profiles"))).alias("scope_profiles"),
    )
    return _as_lines(batches.select("tenant_id", F.array(resource_profiles).alias("resource_profiles")))


def ingest_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches as sent: tenant, key, arrival instant and a JSON line that is cut short now and then."""
    order = F.col("o_orderkey")
    rows = views.table(spark, sf_dir, "orders").select(
        order.alias("request_id"),
        (F.col("o_custkey") % 5).cast("int").alias("tenant_id"),
        (F.col("o_custkey") % 130).alias("key_id"),
        (F.lit(views.EPOCH_2024_NS) + order * 600_000_000_000).alias("received_unix_ns"),
    )
    line = F.to_json(
        F.struct("tenant_id", "key_id", F.col("received_unix_ns").cast("string").alias("received_unix_ns"))
    )
    broken = F.expr("substring(line, 1, length(line) - 5)")
    return rows.withColumn("line", line).withColumn("line", F.when(F.col("request_id") % 13 == 0, broken).otherwise(F.col("line")))


def request_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Incoming requests with seven ways of naming the caller."""
    case, user = F.col("event_id") % 7, F.col("user_id").cast("string")
    text = F.concat(F.lit('{"sub":"user-'), user, F.lit('","n":"ÿþ?>~"}'))
    number = F.concat(F.lit('{"sub":'), user, F.lit("}"))

    def token(json: Column) -> Column:
        return F.concat(F.lit("h."), F.translate(F.base64(json.cast("binary")), "+/=", "-_"), F.lit(".s"))

    auth = (
        F.when(case == 1, F.concat(F.lit("Bearer "), token(text)))
        .when(case == 2, F.concat(F.lit("Bearer "), token(number)))
        .when(case == 3, F.concat(F.lit("Bearer "), token(F.lit('{"sub":true}'))))
        .when(case == 4, "Bearer a.b")
        .when(case == 5, F.concat(F.lit("bearer "), token(text)))
    )
    forwarded = F.when(case == 6, F.concat(F.lit(" , 10.0.0."), F.col("user_id") % 250, F.lit(", 10.0.0.2"))).when(
        F.col("user_id") % 2 == 0, F.concat(F.lit("10.1.0."), F.col("user_id") % 250)
    )
    partner = F.when(case == 6, F.concat(F.lit("partner-"), user))
    pairs = F.map_filter(
        F.create_map(
            F.lit("authorization"), auth, F.lit("X-Forwarded-For"), forwarded, F.lit("x-api-consumer"), partner
        ),
        lambda _, v: v.isNotNull(),
    )
    claim = F.when(case == 0, F.concat(F.lit("user-"), user)).otherwise(F.lit("  "))
    return views.table(spark, sf_dir, "events").select(
        "event_id",
        pairs.alias("headers"),
        F.concat(F.lit("192.168.0."), F.col("user_id") % 250).alias("remote_ip"),
        case.isin(0, 5).alias("authenticated"),
        F.create_map(F.lit("sub"), claim).alias("claims"),
    )
