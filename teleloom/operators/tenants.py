"""Tenant-level jobs: directory, audit search, service registry, retention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from teleloom.functions.predicates import bounded
from teleloom.functions.ranking import page

DAY_NS = 86_400 * 1_000_000_000
# Spread of rows without a join key.
NO_KEY_PARTS = 256

# Days each table keeps a row.
TABLE_TTL_DAYS = {
    "spans": 30,
    "logs": 14,
    "metric_points": 90,
    "host_cpu_memory": 30,
    "host_disks": 30,
    "host_networks": 30,
    "host_processes": 7,
    "profiles": 14,
    "spans_minutely_rollup": 90,
    "consumer_hourly_rollup": 180,
    "status_hourly_rollup": 180,
    "logs_minutely_rollup": 60,
    "metrics_minutely_rollup": 180,
}
AUDIT_DAYS, NOTIFICATION_DAYS = 90, 7


def tenant_directory(tenants: DataFrame, users: DataFrame, api_keys: DataFrame) -> DataFrame:
    """Tenants that are not deleted, with active users and unrevoked keys."""
    active = users.filter(F.col("status") == "active").groupBy("tenant_id").agg(F.count(F.lit(1)).alias("user_count"))
    live = api_keys.filter(F.col("revoked_unix_ns").isNull()).groupBy("tenant_id").agg(
        F.count(F.lit(1)).alias("api_key_count")
    )
    return (
        tenants.filter(F.col("status") != "deleted")
        .join(active, "tenant_id", "left")
        .join(live, "tenant_id", "left")
        .na.fill(0, ["user_count", "api_key_count"])
        .orderBy(F.col("posted_unix_ns").desc(), "tenant_id")
    )


def audit_log_search(
    audit: DataFrame,
    users: DataFrame,
    tenant_id: object | None = None,
    action: str = "",
    actor: str = "",
    page_no: int = 1,
    page_size: int | None = 50,
) -> DataFrame:
    """One page of the audit log, newest first, with the size of the whole result; all without a page size."""
    df = audit
    if tenant_id is not None:
        df = df.filter(F.col("tenant_id") == tenant_id)
    if action.strip():
        df = df.filter(F.startswith("action", F.lit(action.strip())))
    # Rows without an actor find no user; the part number keeps them off a single reducer.
    part = F.when(F.col("actor_user_id").isNull(), F.pmod(F.xxhash64("audit_id"), F.lit(NO_KEY_PARTS))).otherwise(0)
    people = users.select(
        F.col("user_id").alias("actor_user_id"), F.col("email").alias("actor_email"), F.lit(0).cast("bigint").alias("_part")
    )
    df = df.withColumn("_part", part.cast("bigint")).join(people, ["actor_user_id", "_part"], "left").drop("_part")
    needle = actor.strip().lower()
    if needle:
        by_name = F.contains(F.lower("actor_email"), F.lit(needle)) | F.contains(F.lower("posted_by"), F.lit(needle))
        df = df.filter(by_name)
    return page(df, [], [F.col("posted_unix_ns").desc(), F.col("audit_id").desc()], page_no, bounded(page_size, 50))


REGISTRY = ["service_version", "first_seen_ns", "last_seen_ns"]


def merge_registries(registry: DataFrame, seen: DataFrame) -> DataFrame:
    """One row for each service of either registry: the earliest first sight, the latest last one and its version.

    The same in any order and any number of times, so that late and repeated batches move nothing backwards. Of two
    versions of the same instant the greater one stays.
    """
    renamed = seen.withColumnsRenamed({c: f"_{c}" for c in REGISTRY})
    merged = registry.join(renamed, ["tenant_id", "service_name"], "full")
    last = lambda prefix: F.struct(F.col(f"{prefix}last_seen_ns").alias("ts"), F.col(f"{prefix}service_version").alias("v"))
    own, new = (F.when(F.col(f"{prefix}last_seen_ns").isNotNull(), last(prefix)) for prefix in ("", "_"))
    newest = F.greatest(own, new)
    return merged.select(
        "tenant_id",
        "service_name",
        newest["v"].alias("service_version"),
        F.least("first_seen_ns", "_first_seen_ns").alias("first_seen_ns"),
        newest["ts"].alias("last_seen_ns"),
    )


def upsert_service_registry(spans: DataFrame, registry: DataFrame | None = None) -> DataFrame:
    """Services seen in spans, merged into the previous registry if there is one."""
    newest = F.struct(F.col("start_time_unix_ns").alias("ts"), F.col("service_version").alias("v"))
    seen = spans.groupBy("tenant_id", "service_name").agg(F.max(newest).alias("_n"), F.min("start_time_unix_ns").alias("first_seen_ns"))
    seen = seen.select("tenant_id", "service_name", F.col("_n.v").alias("service_version"), "first_seen_ns", F.col("_n.ts").alias("last_seen_ns"))
    return seen if registry is None else merge_registries(registry, seen)


# ---------------------------------------------------------------------------- retention


def period_end(period: Column) -> Column:
    """Last day covered by a ``yyyyMMdd``, ``yyyy-MM-dd`` or ``yyyyMM`` partition, null for other text."""
    plain = F.when(period.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), F.replace(period, F.lit("-"), F.lit(""))).otherwise(period)
    day = F.try_to_timestamp(F.when(F.length(plain) == 8, plain), F.lit("yyyyMMdd"))
    month = F.try_to_timestamp(F.when(F.length(period) == 6, period), F.lit("yyyyMM"))
    return F.coalesce(F.to_date(day), F.last_day(F.to_date(month)))


def retention_sweep(partitions: DataFrame, tenants: DataFrame, as_of_ns: int) -> DataFrame:
    """Partitions (table_name, tenant_id, period) that ended before their tenant's cutoff.

    Works from partition names alone. Deleted or unknown tenants are left alone; at least one day
    is kept.
    """
    kept = tenants.filter((F.col("status") != "deleted") & F.col("data_retention_days").isNotNull()).select(
        "tenant_id", F.greatest(F.lit(1), F.col("data_retention_days")).alias("_days")
    )
    today = F.to_date(F.timestamp_micros(F.lit(as_of_ns // 1000)))
    ended = partitions.withColumn("period_end", period_end(F.col("period"))).join(kept, "tenant_id")
    return ended.filter(F.col("period_end") < F.date_sub(today, F.col("_days"))).drop("_days")


def ttl_filter(df: DataFrame, table_name: str, time_ns: Column, as_of_ns: int) -> DataFrame:
    """Rows of a table still within its fixed age limit."""
    return df.filter(time_ns >= as_of_ns - TABLE_TTL_DAYS[table_name] * DAY_NS)


def prune_by_age(df: DataFrame, as_of_ns: int, days: int = AUDIT_DAYS, time_col: str = "posted_unix_ns") -> DataFrame:
    """Rows not older than the cutoff."""
    return df.filter(F.col(time_col) >= as_of_ns - days * DAY_NS)
