"""Host reads."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from teleloom.functions.predicates import bounded, finite_or_zero, ratio
from teleloom.functions.ranking import top_n_by
from teleloom.functions.timing import bucket_seconds, int_div
from teleloom.scope import Scope

TIME = "time_unix_ns"
HOST = ["tenant_id", "host_id"]
MIB = 1024 * 1024


def _latest(*columns: str) -> Column:
    """Aggregate: the named columns at the newest sample (largest values on a tie)."""
    return F.max(F.struct(F.col(TIME), *columns))


def _whole_avg(column: str) -> Column:
    """Average of non-negative whole numbers, cut to a whole number."""
    return F.coalesce(int_div(F.sum(column), F.count(column)), F.lit(0).cast("bigint"))


def _bucketed(samples: DataFrame, scope: Scope, host: str | None, bucket_s: int) -> DataFrame:
    df = scope.apply(samples, TIME)
    if host is not None:
        df = df.filter(F.col("host_id") == host)
    return df.withColumn("bucket_s", bucket_seconds(F.col(TIME), bucket_s if bucket_s > 0 else 60))


def list_hosts(samples: DataFrame, scope: Scope = Scope()) -> DataFrame:
    """One row per host with its newest reading. CPU is the user share only."""
    shown = ["host_name", "os_type", "os_version", "logical_cores", "cpu_util_user", "mem_total_bytes", "mem_used_bytes"]
    grouped = (
        scope.apply(samples, TIME)
        .groupBy(*HOST)
        .agg(_latest(*shown).alias("_n"), F.count(F.lit(1)).alias("samples"))
    )
    return grouped.select(
        *HOST,
        *[F.col(f"_n.{c}").alias(c) for c in shown],
        ratio(F.col("_n.mem_used_bytes"), F.col("_n.mem_total_bytes")).alias("mem_utilization"),
        F.col(f"_n.{TIME}").alias("last_seen_ns"),
        "samples",
    ).orderBy("tenant_id", F.col("last_seen_ns").desc(), "host_id")


def host_utilization(samples: DataFrame, scope: Scope = Scope(), host: str | None = None, bucket_s: int = 60) -> DataFrame:
    grouped = (
        _bucketed(samples, scope, host, bucket_s)
        .groupBy(*HOST, "bucket_s")
        .agg(
            finite_or_zero(F.avg("cpu_util_user")).alias("cpu_avg"),
            finite_or_zero(F.max("cpu_util_user")).alias("cpu_max"),
            _whole_avg("mem_used_bytes").alias("mem_used_avg"),
            F.max("mem_used_bytes").alias("mem_used_max"),
            _latest("mem_total_bytes").alias("_n"),
        )
    )
    return grouped.withColumn("mem_total", F.col("_n.mem_total_bytes")).drop("_n").orderBy(*HOST, "bucket_s")


def host_disks(samples: DataFrame, scope: Scope = Scope(), host: str | None = None, bucket_s: int = 60) -> DataFrame:
    keys = [*HOST, "bucket_s", "device"]
    grouped = (
        _bucketed(samples, scope, host, bucket_s)
        .groupBy(*keys)
        .agg(
            _latest("total_bytes", "used_bytes").alias("_n"),
            _whole_avg("read_bytes_per_sec").alias("read_bytes_avg"),
            _whole_avg("write_bytes_per_sec").alias("write_bytes_avg"),
            F.max("read_bytes_per_sec").alias("read_bytes_max"),
            F.max("write_bytes_per_sec").alias("write_bytes_max"),
            _whole_avg("reads_per_sec").alias("read_iops"),
            _whole_avg("writes_per_sec").alias("write_iops"),
        )
    )
    return (
        grouped.withColumn("total_bytes", F.col("_n.total_bytes"))
        .withColumn("used_bytes", F.col("_n.used_bytes"))
        .drop("_n")
        .orderBy(*keys)
    )


def host_networks(samples: DataFrame, scope: Scope = Scope(), host: str | None = None, bucket_s: int = 60) -> DataFrame:
    keys = [*HOST, "bucket_s", "interface_name"]
    return (
        _bucketed(samples, scope, host, bucket_s)
        .groupBy(*keys)
        .agg(
            _whole_avg("rx_bytes_per_sec").alias("rx_bytes_avg"),
            _whole_avg("tx_bytes_per_sec").alias("tx_bytes_avg"),
            F.max("rx_bytes_per_sec").alias("rx_bytes_max"),
            F.max("tx_bytes_per_sec").alias("tx_bytes_max"),
            _whole_avg("rx_packets_per_sec").alias("rx_packets"),
            _whole_avg("tx_packets_per_sec").alias("tx_packets"),
        )
        .orderBy(*keys)
    )


def top_processes(
    processes: DataFrame, tenant_id: object | None = None, host: str | None = None, limit: int | None = 50
) -> DataFrame:
    """Busiest processes of each host's newest snapshot, whatever its age."""
    df = Scope(tenant_id).apply(processes, TIME)
    if host is not None:
        df = df.filter(F.col("host_id") == host)
    age = F.rank().over(Window.partitionBy(*HOST).orderBy(F.col(TIME).desc()))
    newest = df.withColumn("_age", age).filter(F.col("_age") == 1).drop("_age")
    order = [F.col("cpu_utilization").desc(), F.col("pid"), F.col("rss_bytes").desc(), F.col("thread_count").desc()]
    return top_n_by(newest, HOST, order, bounded(limit, 50))


def disk_capacity_latest(disk_points: DataFrame) -> DataFrame:
    """Newest bucket of every device."""
    columns = [c for c in disk_points.columns if c not in (*HOST, "device", "bucket_s")]
    grouped = disk_points.groupBy(*HOST, "device").agg(F.max(F.struct("bucket_s", *columns)).alias("_n"))
    return grouped.select(*HOST, "device", "_n.*").orderBy(*HOST, "device")


def host_series_pivot(points: DataFrame, name: str, values: dict[str, str], names: Sequence[str]) -> DataFrame:
    """Per bucket one MiB/s column for each (named device or interface, measure), 0 where missing.

    ``values`` maps a column suffix to the byte-rate column.
    """
    measures = []
    for wanted in names:
        for suffix, column in values.items():
            rate = F.max(F.when(F.col(name) == wanted, F.col(column)))
            measures.append(F.coalesce(F.round(rate / MIB, 3), F.lit(0.0)).alias(f"{wanted}_{suffix}"))
    return points.groupBy(*HOST, "bucket_s").agg(*measures)


def host_health(hosts: DataFrame) -> DataFrame:
    """CPU and memory status of listed hosts."""

    def status(value: str, warn: float, err: float) -> Column:
        return F.when(F.col(value) >= err, "err").when(F.col(value) >= warn, "warn").otherwise("ok")

    return hosts.withColumn("cpu_status", status("cpu_util_user", 0.7, 0.85)).withColumn(
        "mem_status", status("mem_utilization", 0.75, 0.9)
    )
