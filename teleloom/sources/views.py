"""Telemetry-shaped views over the star-schema test tables.

These give every read operator realistic input without a telemetry generator. All columns use the
fact-table names of ``teleloom.schemas``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from teleloom.functions.timing import timestamp_to_unix_ns
from teleloom.session import prepare

EPOCH_2024_NS = 1_704_067_200_000_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def _mod(column: str, n: int) -> Column:
    return F.col(column) % n


def _name(prefix: str, number: Column) -> Column:
    return F.concat(F.lit(prefix), number.cast("string"))


def _ns(column: str) -> Column:
    return timestamp_to_unix_ns(F.col(column).cast("timestamp"))


def _floor(value: Column) -> Column:
    return F.floor(value).cast("bigint")


def _choose(number: Column, names: list[str]) -> Column:
    out = F.lit(names[-1])
    for i, name in reversed(list(enumerate(names[:-1]))):
        out = F.when(number == i, F.lit(name)).otherwise(out)
    return out


# One expression per column; ``k`` is the number in the event's properties, ``i`` the span's place.
SPAN_COLUMNS = [
    "CAST(event_id % 5 AS INT) AS tenant_id",
    "lpad(string(event_id), 32, '0') AS trace_id",
    "lpad(string(event_id * 4 + i), 16, '0') AS span_id",
    """CASE i WHEN 0 THEN '' WHEN 2 THEN lpad(string(event_id * 4 + 1), 16, '0')
       ELSE lpad(string(event_id * 4), 16, '0') END AS parent_span_id""",
    "concat('svc-', string(CASE i WHEN 2 THEN (event_id + 1 + k % 3) % 5 ELSE event_id % 5 END)) AS service_name",
    "concat('1.', string(k % 3), '.0') AS service_version",
    """CASE i WHEN 1 THEN 'HTTP' WHEN 3 THEN if(k % 2 = 0, 'postgresql', 'redis')
       ELSE concat('/api/', event_type) END AS span_name""",
    "if(i IN (0, 2), 'SERVER', 'CLIENT') AS span_kind",
    "start AS start_time_unix_ns",
    "start + duration AS end_time_unix_ns",
    "duration AS duration_ns",
    "CASE WHEN NOT failed THEN 'OK' WHEN k % 3 = 0 THEN 'ERROR' ELSE 'UNSET' END AS status_code",
    """CASE WHEN i = 3 THEN '' WHEN event_type IN ('purchase', 'signup') THEN 'POST' WHEN k % 25 = 0 THEN 'OPTIONS'
       ELSE 'GET' END AS http_method""",
    """CASE WHEN i = 3 THEN 0 WHEN failed THEN if(k % 2 = 0, 500, 404) WHEN k % 10 = 0 THEN 302 ELSE 200
       END AS http_status_code""",
    "if(i IN (0, 2), concat('/api/', event_type), '') AS http_route",
    "if(i = 1, concat('http://api-', string(k % 4), '.example.com:8080/v1/', event_type), '') AS http_url",
    "CASE WHEN i <> 3 THEN '' WHEN k % 2 = 0 THEN 'postgresql' ELSE 'redis' END AS db_system",
    "if(i = 3, concat('SELECT * FROM ', event_type, ' WHERE k = ', string(k)), '') AS db_statement",
    "if(i = 0 AND user_id % 10 <> 0, concat('user-', string(user_id)), '') AS consumer_id",
    "array('event.type', 'k') AS attrs_keys",
    "array(event_type, string(k)) AS attrs_values",
    "if(failed, array('exception'), CAST(array() AS ARRAY<STRING>)) AS event_names",
    "if(failed, array(start), CAST(array() AS ARRAY<BIGINT>)) AS event_times_unix_ns",
    """if(failed AND i = 0, array('{"exception.type":"failure"}'), CAST(array() AS ARRAY<STRING>)) AS event_attrs_json""",
]


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four spans per event: root server, outbound HTTP client, downstream server, database client."""
    events = table(spark, sf_dir, "events").selectExpr(
        "event_id",
        "user_id",
        "event_type",
        "value",
        "event_type = 'error' AS failed",
        "unix_micros(CAST(ts AS TIMESTAMP)) * 1000 AS t0",
        "CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS k",
    )
    # Exploded in a step of its own, so the properties are read once per event.
    timed = events.selectExpr("*", "explode(array(0, 1, 2, 3)) AS i").selectExpr(
        "*", "t0 + i * 1000000 AS start", "CAST(round(value * 1000000 / (i + 1)) AS BIGINT) AS duration"
    )
    return timed.selectExpr(*SPAN_COLUMNS)


def logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One log record per document, whole text as body."""
    doc = F.col("doc_id")
    return table(spark, sf_dir, "documents").select(
        (doc % 5).cast("int").alias("tenant_id"),
        (F.lit(EPOCH_2024_NS) + doc * 97_000_000_000).alias("time_unix_ns"),
        _name("svc-", doc % 5).alias("service_name"),
        (doc % 6 * 4 + 1).cast("int").alias("severity_number"),
        _choose(doc % 6, ["TRACE", "DEBUG", "INFO", "WARN", "ERROR", "FATAL"]).alias("severity_text"),
        F.col("text").alias("body"),
        F.when(doc % 3 == 0, "").otherwise(F.lpad(doc.cast("string"), 32, "0")).alias("trace_id"),
        F.when(doc % 3 == 0, "").otherwise(F.lpad((doc * 4).cast("string"), 16, "0")).alias("span_id"),
        F.array(F.lit("lang"), F.lit("source")).alias("attrs_keys"),
        F.array("lang", "source").alias("attrs_values"),
    )


def metric_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One data point per order line over eight metric names."""
    which = _mod("l_partkey", 8)
    return table(spark, sf_dir, "lineitem").select(
        _mod("l_orderkey", 5).cast("int").alias("tenant_id"),
        (_ns("l_shipdate") + F.col("l_orderkey") * 1_000_000_000 + F.col("l_linenumber") * 7_000_000_000).alias(
            "time_unix_ns"
        ),
        _name("svc-", _mod("l_suppkey", 5)).alias("service_name"),
        _name("metric.", which).alias("metric_name"),
        F.lit("1").alias("metric_unit"),
        F.when(which < 4, "GAUGE").when(which < 7, "SUM").otherwise("HISTOGRAM").alias("metric_kind"),
        F.when(which < 4, F.col("l_extendedprice")).alias("value_double"),
        F.when(which.between(4, 6), _floor(F.col("l_quantity"))).alias("value_int"),
        F.when(which == 7, F.col("l_extendedprice")).alias("histogram_sum"),
        F.array(F.lit("flag"), F.lit("status")).alias("attrs_keys"),
        F.array("l_returnflag", "l_linestatus").alias("attrs_values"),
    )


def _host_columns() -> list[Column]:
    return [
        _mod("o_custkey", 5).cast("int").alias("tenant_id"),
        _name("host-", _mod("o_custkey", 20)).alias("host_id"),
        (F.lit(EPOCH_2024_NS) + F.col("o_orderkey") * 10_000_000_000).alias("time_unix_ns"),
    ]


def _device() -> Column:
    return F.when(_mod("o_orderkey", 2) == 0, "/dev/sda").otherwise("/dev/sdb").alias("device")


def host_cpu_memory(spark: SparkSession, sf_dir: str) -> DataFrame:
    price = F.col("o_totalprice")
    return table(spark, sf_dir, "orders").select(
        *_host_columns(),
        _name("node-", _mod("o_custkey", 20)).alias("host_name"),
        F.lit("linux").alias("os_type"),
        F.lit("6.1").alias("os_version"),
        F.lit(8).alias("logical_cores"),
        F.round(price / 1000 - F.floor(price / 1000), 4).alias("cpu_util_user"),
        F.lit(17_179_869_184).cast("bigint").alias("mem_total_bytes"),
        (_floor(price) * 10_000 % 17_179_869_184).alias("mem_used_bytes"),
    )


def host_disks(spark: SparkSession, sf_dir: str) -> DataFrame:
    price = F.col("o_totalprice")
    return table(spark, sf_dir, "orders").select(
        *_host_columns(),
        _device(),
        F.lit(1_099_511_627_776).cast("bigint").alias("total_bytes"),
        (_floor(price) * 100_000).alias("used_bytes"),
        _floor(price).alias("read_bytes_per_sec"),
        _floor(price / 3).alias("write_bytes_per_sec"),
        _floor(price / 4096).alias("reads_per_sec"),
        _floor(price / 8192).alias("writes_per_sec"),
    )


def host_networks(spark: SparkSession, sf_dir: str) -> DataFrame:
    price = F.col("o_totalprice")
    return table(spark, sf_dir, "orders").select(
        *_host_columns(),
        _name("eth", _mod("o_orderkey", 3)).alias("interface_name"),
        _floor(price * 2).alias("rx_bytes_per_sec"),
        _floor(price).alias("tx_bytes_per_sec"),
        _floor(price / 1500).alias("rx_packets_per_sec"),
        _floor(price / 3000).alias("tx_packets_per_sec"),
    )


def host_processes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        _mod("l_suppkey", 5).cast("int").alias("tenant_id"),
        _name("host-", _mod("l_suppkey", 20)).alias("host_id"),
        _ns("l_shipdate").alias("time_unix_ns"),
        F.col("l_partkey").alias("pid"),
        _name("proc-", _mod("l_partkey", 50)).alias("command"),
        F.lit("").alias("service_name"),
        F.lit("").alias("runtime_version"),
        F.round(F.col("l_discount") * 10, 4).alias("cpu_utilization"),
        (_floor(F.col("l_quantity")) * 1_048_576).alias("rss_bytes"),
        F.col("l_linenumber").alias("thread_count"),
        F.lit(0).alias("handle_count"),
    )


def disk_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw disk samples; counters fall back now and then as a rebooted host's would."""
    price, order = F.col("o_totalprice"), F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(
        *_host_columns(),
        _device(),
        F.lit("/").alias("mountpoint"),
        F.lit("ext4").alias("fs_type"),
        F.lit(1_099_511_627_776).cast("bigint").alias("total_bytes"),
        (F.lit(1_099_511_627_776) - _floor(price) * 100_000).cast("bigint").alias("free_bytes"),
        (order * 1000 % 5_000_000 + _floor(price) % 1000).alias("reads"),
        (order * 700 % 4_000_000 + _floor(price) % 700).alias("writes"),
        (order * 90_000 % 500_000_000 + _floor(price)).alias("sectors_read"),
        (order * 60_000 % 300_000_000 + _floor(price)).alias("sectors_written"),
    )


def network_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    price, order = F.col("o_totalprice"), F.col("o_orderkey")
    names = ["eth0", "lo", "veth12"]
    return table(spark, sf_dir, "orders").select(
        *_host_columns(),
        _choose(order % 3, names).alias("interface_name"),
        (order * 50_000 % 90_000_000 + _floor(price)).alias("rx_bytes"),
        (order * 30_000 % 70_000_000 + _floor(price)).alias("tx_bytes"),
        (order * 100 % 900_000 + _floor(price) % 100).alias("rx_packets"),
        (order * 90 % 800_000 + _floor(price) % 90).alias("tx_packets"),
        (order % 7).alias("rx_errors"),
        (order % 5).alias("tx_errors"),
    )


def cpu_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cumulative scheduler ticks and memory gauges per host sample."""
    price, order = F.col("o_totalprice"), F.col("o_orderkey")
    cents = _floor(price)
    return table(spark, sf_dir, "orders").select(
        *_host_columns(),
        (order * 40 + cents % 37).alias("user"),
        (order * 2 + cents % 5).alias("nice"),
        (order * 20 + cents % 17).alias("system"),
        (order * 100 + cents % 91).alias("idle"),
        (order * 3 + cents % 7).alias("iowait"),
        (order + cents % 3).alias("irq"),
        (order + cents % 2).alias("softirq"),
        F.lit(0).cast("bigint").alias("steal"),
        F.lit(16_777_216).cast("bigint").alias("mem_total_kb"),
        (cents * 50).alias("mem_available_kb"),
        F.lit(4_194_304).cast("bigint").alias("swap_total_kb"),
        (cents * 10).alias("swap_free_kb"),
    )


def process_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cumulative scheduler ticks per process and snapshot."""
    return table(spark, sf_dir, "lineitem").groupBy(
        _mod("l_suppkey", 5).cast("int").alias("tenant_id"),
        _name("host-", _mod("l_suppkey", 20)).alias("host_id"),
        _ns("l_shipdate").alias("time_unix_ns"),
        _mod("l_partkey", 97).alias("pid"),
    ).agg(
        F.sum(_floor(F.col("l_extendedprice"))).alias("total_ticks"),
        F.sum(_floor(F.col("l_quantity"))).alias("rss_pages"),
        F.max("l_linenumber").alias("thread_count"),
    ).withColumn("logical_cores", F.lit(8))


def stack_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf-first call stacks grouped into captures; one frame in eleven has no name."""
    mid = F.when(_mod("l_partkey", 11) == 0, "").otherwise(_name("g", _mod("l_suppkey", 5)))
    return table(spark, sf_dir, "lineitem").select(
        _mod("l_orderkey", 5).cast("int").alias("tenant_id"),
        F.col("l_orderkey").alias("capture_id"),
        F.col("l_linenumber").alias("sample_id"),
        F.array(_name("f", _mod("l_partkey", 7)), mid, F.lit("main")).alias("stack"),
    )


def profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(
        _mod("o_custkey", 5).cast("int").alias("tenant_id"),
        (F.lit(EPOCH_2024_NS) + order * 60_000_000_000).alias("start_time_unix_ns"),
        _name("svc-", _mod("o_custkey", 5)).alias("service_name"),
        _choose(order % 3, ["CPU", "WALL", "ALLOC"]).alias("profile_kind"),
        (order % 1000 + 10_000_000_000).alias("duration_nanos"),
        _floor(F.col("o_totalprice")).alias("sample_count"),
        F.when(order % 50 == 0, "not base64!")
        .otherwise(F.base64(F.concat(F.lit("pprof-"), order.cast("string")).cast("binary")))
        .alias("pprof_base64"),
        F.lit("").alias("trigger_trace_id"),
        F.lit("1.0").alias("agent_version"),
    )


def tenants(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("r_regionkey")
    return table(spark, sf_dir, "region").select(
        key.alias("tenant_id"),
        F.col("r_name").alias("tenant_name"),
        (7 * (1 + key)).cast("int").alias("data_retention_days"),
        F.when(key == 4, "deleted").when(key == 3, "suspended").otherwise("active").alias("status"),
        (F.lit(EPOCH_2024_NS) - key * 86_400_000_000_000).alias("posted_unix_ns"),
    )


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = table(spark, sf_dir, "nation")
    return (
        table(spark, sf_dir, "customer")
        .join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .select(
            F.col("c_custkey").alias("user_id"),
            F.col("n_regionkey").alias("tenant_id"),
            F.lower("c_name").alias("email"),
            F.when(_mod("c_custkey", 10) == 0, "disabled")
            .when(_mod("c_custkey", 10) == 1, "invited")
            .otherwise("active")
            .alias("status"),
        )
    )


def api_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = table(spark, sf_dir, "nation")
    key = F.col("s_suppkey")
    return (
        table(spark, sf_dir, "supplier")
        .join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
        .select(
            key.alias("key_id"),
            F.col("n_regionkey").alias("tenant_id"),
            F.when(key % 3 == 0, F.lit(EPOCH_2024_NS)).cast("bigint").alias("revoked_unix_ns"),
            F.when(key % 4 == 0, F.lit(EPOCH_2024_NS) + key * 86_400_000_000_000).cast("bigint").alias("expires_unix_ns"),
        )
    )


def audit_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(
        order.alias("audit_id"),
        _mod("o_custkey", 5).cast("int").alias("tenant_id"),
        F.when(order % 7 != 0, F.col("o_custkey")).alias("actor_user_id"),
        _choose(order % 4, ["apikey.created", "apikey.revoked", "invite.created", "tenant.renamed"]).alias("action"),
        _ns("o_orderdate").alias("posted_unix_ns"),
        F.when(order % 7 == 0, "system:dashboard").otherwise("").alias("posted_by"),
    )


def alert_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("n_nationkey")
    signals = [
        "latency_p50", "latency_p90", "latency_p99", "error_rate",
        "request_volume", "log_count", "metric_avg", "metric_max",
    ]
    return table(spark, sf_dir, "nation").select(
        key.alias("rule_id"),
        F.col("n_regionkey").alias("tenant_id"),
        F.col("n_name").alias("rule_name"),
        (key % 9 != 8).alias("enabled"),
        _choose(key % 8, signals).alias("signal_type"),
        F.when(key % 8 == 5, "WARN").when(key % 8 > 5, "metric.1").otherwise("").alias("signal_param"),
        F.when(key % 2 == 0, "").otherwise(_name("svc-", F.col("n_regionkey"))).alias("service_filter"),
        _choose(key % 5, ["gt", "gte", "lt", "lte", "eq"]).alias("operator"),
        key.cast("double").alias("threshold"),
        (3600 * (1 + key % 5)).cast("int").alias("window_seconds"),
        (3600 * (key % 3)).cast("int").alias("for_seconds"),
        _choose(key % 3, ["info", "warning", "critical"]).alias("severity"),
        F.array((F.col("n_regionkey") * 2).cast("bigint"), (F.col("n_regionkey") * 2 + 1).cast("bigint")).alias(
            "channel_ids"
        ),
    )


def draft_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules as submitted by users, many of them faulty."""
    key = F.col("c_custkey")
    signals = [
        "latency_p50", "latency_p90", "latency_p99", "error_rate", "request_volume",
        "log_count", "metric_avg", "metric_max", "cpu_heat",
    ]
    return table(spark, sf_dir, "customer").select(
        key.alias("rule_id"),
        F.when(key % 31 == 0, " ").otherwise(F.col("c_name")).alias("rule_name"),
        _choose(key % 9, signals).alias("signal_type"),
        _choose(key % 5, ["", "warn", "loud", "metric.1", "ERROR"]).alias("signal_param"),
        _choose(key % 7, ["gt", "gte", "lt", "lte", "eq", "gt", "ne"]).alias("operator"),
        _choose(key % 8, ["info", "warning", "critical", "info", "warning", "critical", "info", "fatal"]).alias("severity"),
        F.when(key % 23 == 0, 90_000).otherwise((key % 100) * 10).cast("int").alias("window_seconds"),
        F.when(key % 29 == 0, -5).otherwise((key % 10) * 60).cast("int").alias("for_seconds"),
    )


def channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two notification channels per tenant, the second disabled for odd tenants."""
    key = F.col("r_regionkey")
    both = table(spark, sf_dir, "region").select(key, F.explode(F.array(F.lit(0), F.lit(1))).alias("j"))
    return both.select(
        (key * 2 + F.col("j")).cast("bigint").alias("channel_id"),
        key.alias("tenant_id"),
        F.when(F.col("j") == 0, "inapp").otherwise("webhook").alias("channel_type"),
        (~((F.col("j") == 1) & (key % 2 == 1))).alias("enabled"),
    )
