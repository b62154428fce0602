"""Tenant directory, audit, registry and retention queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from teleloom.functions.timing import unix_ns_to_timestamp
from teleloom.operators import tenants
from teleloom.plans.registry import query
from teleloom.sources import views

# 2024-01-25 00:00 UTC
AS_OF_NS = 1_706_140_800_000_000_000


@query(
    "tenant_directory",
    """SELECT t.*, (SELECT count(*) FROM users u WHERE u.tenant_id = t.tenant_id AND u.status = 'active') AS user_count,
              (SELECT count(*) FROM api_keys k WHERE k.tenant_id = t.tenant_id AND k.revoked_unix_ns IS NULL) AS api_key_count
       FROM tenants t WHERE t.status <> 'deleted'""",
    ["tenants", "users", "api_keys"],
)
def _(spark, sf):
    return tenants.tenant_directory(views.tenants(spark, sf), views.users(spark, sf), views.api_keys(spark, sf))


@query(
    "audit_log_search",
    """SELECT audit_id, tenant_id, actor_user_id, email AS actor_email, action, posted_unix_ns, posted_by,
              count(*) OVER () AS total
       FROM audit_log a LEFT JOIN (SELECT user_id, email FROM users) u ON u.user_id = a.actor_user_id
       WHERE starts_with(action, 'apikey.') AND (contains(lower(email), '00007') OR contains(lower(posted_by), '00007'))
       ORDER BY posted_unix_ns DESC, audit_id DESC LIMIT 50 OFFSET 50""",
    ["audit_log", "users"],
)
def _(spark, sf):
    return tenants.audit_log_search(
        views.audit_log(spark, sf), views.users(spark, sf), action="apikey.", actor="00007", page_no=2
    )


@query(
    "upsert_service_registry",
    """WITH old AS (SELECT tenant_id, service_name, '0.9' AS service_version,
                           CAST(1700000000000000000 AS BIGINT) AS first_seen_ns FROM spans
                    WHERE span_kind = 'CLIENT' GROUP BY 1, 2),
       seen AS (SELECT tenant_id, service_name,
                       max_by(service_version, struct_pack(t := start_time_unix_ns, v := service_version)) AS v,
                       min(start_time_unix_ns) AS lo, max(start_time_unix_ns) AS hi FROM spans GROUP BY 1, 2)
       SELECT coalesce(o.tenant_id, s.tenant_id) AS tenant_id, coalesce(o.service_name, s.service_name) AS service_name,
              coalesce(v, service_version) AS service_version, coalesce(first_seen_ns, lo) AS first_seen_ns,
              hi AS last_seen_ns
       FROM old o FULL JOIN seen s ON o.tenant_id = s.tenant_id AND o.service_name = s.service_name""",
    ["spans"],
)
def _(spark, sf):
    rows = views.spans(spark, sf)
    # The previous snapshot: services that had made outbound calls.
    old = rows.filter("span_kind = 'CLIENT'").groupBy("tenant_id", "service_name").agg(
        F.lit("0.9").alias("service_version"),
        F.lit(1_700_000_000_000_000_000).alias("first_seen_ns"),
        F.lit(1_700_000_000_000_000_000).alias("last_seen_ns"),
    )
    return tenants.upsert_service_registry(rows, old)


@query(
    "retention_sweep",
    """WITH p AS (SELECT DISTINCT 'spans' AS table_name, tenant_id,
                         strftime(make_timestamp(start_time_unix_ns // 1000), '%Y%m%d') AS period FROM spans
                  UNION ALL SELECT DISTINCT 'metrics_minutely_rollup', tenant_id,
                         strftime(make_timestamp(time_unix_ns // 1000), '%Y%m') FROM metric_points),
       e AS (SELECT *, CASE WHEN length(period) = 8 THEN CAST(strptime(period, '%Y%m%d') AS DATE)
                            ELSE last_day(strptime(period, '%Y%m')) END AS period_end FROM p)
       SELECT table_name, e.tenant_id, period, strftime(period_end, '%Y-%m-%d') AS period_end
       FROM e JOIN tenants t ON t.tenant_id = e.tenant_id AND t.status <> 'deleted'
       WHERE period_end < DATE '2024-01-25' - CAST(greatest(1, data_retention_days) AS INT)""",
    ["spans", "metric_points", "tenants"],
)
def _(spark, sf):
    def periods(df, table, time, form):
        period = F.date_format(unix_ns_to_timestamp(F.col(time)), form).alias("period")
        return df.select(F.lit(table).alias("table_name"), "tenant_id", period).distinct()

    listed = periods(views.spans(spark, sf), "spans", "start_time_unix_ns", "yyyyMMdd").unionByName(
        periods(views.metric_points(spark, sf), "metrics_minutely_rollup", "time_unix_ns", "yyyyMM")
    )
    gone = tenants.retention_sweep(listed, views.tenants(spark, sf), AS_OF_NS)
    return gone.withColumn("period_end", F.col("period_end").cast("string"))


@query(
    "ttl_filter",
    """SELECT tenant_id, host_id, count(*) AS kept, min(time_unix_ns) AS oldest_ns FROM host_processes
       WHERE time_unix_ns >= 904608000000000000 - 7 * 86400000000000 GROUP BY 1, 2""",
    ["host_processes"],
)
def _(spark, sf):
    # As of 1998-09-01, within the range of the snapshots.
    kept = tenants.ttl_filter(
        views.host_processes(spark, sf), "host_processes", F.col("time_unix_ns"), 904_608_000_000_000_000
    )
    return kept.groupBy("tenant_id", "host_id").agg(
        F.count(F.lit(1)).alias("kept"), F.min("time_unix_ns").alias("oldest_ns")
    )


@query(
    "prune_by_age",
    """SELECT audit_id, tenant_id, action, posted_unix_ns FROM audit_log
       WHERE posted_unix_ns >= 901929600000000000 - 90 * 86400000000000""",
    ["audit_log"],
)
def _(spark, sf):
    # As of 1998-08-01.
    kept = tenants.prune_by_age(views.audit_log(spark, sf), 901_929_600_000_000_000)
    return kept.select("audit_id", "tenant_id", "action", "posted_unix_ns")
