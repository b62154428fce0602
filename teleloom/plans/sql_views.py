"""The telemetry views of ``teleloom.sources.views``, written independently in SQL for the checks."""

SQL_VIEWS = {
    "spans": """
SELECT CAST(event_id % 5 AS INT) AS tenant_id,
       lpad(CAST(event_id AS VARCHAR), 32, '0') AS trace_id,
       lpad(CAST(event_id * 4 + i AS VARCHAR), 16, '0') AS span_id,
       CASE WHEN i = 0 THEN '' WHEN i = 2 THEN lpad(CAST(event_id * 4 + 1 AS VARCHAR), 16, '0')
            ELSE lpad(CAST(event_id * 4 AS VARCHAR), 16, '0') END AS parent_span_id,
       CASE WHEN i = 2 THEN concat('svc-', CAST((event_id + 1 + k % 3) % 5 AS VARCHAR))
            ELSE concat('svc-', CAST(event_id % 5 AS VARCHAR)) END AS service_name,
       concat('1.', CAST(k % 3 AS VARCHAR), '.0') AS service_version,
       CASE WHEN i IN (0, 2) THEN concat('/api/', event_type) WHEN i = 1 THEN 'HTTP'
            WHEN k % 2 = 0 THEN 'postgresql' ELSE 'redis' END AS span_name,
       CASE WHEN i IN (0, 2) THEN 'SERVER' ELSE 'CLIENT' END AS span_kind,
       t0 + i * 1000000 AS start_time_unix_ns,
       t0 + i * 1000000 + dur AS end_time_unix_ns,
       dur AS duration_ns,
       CASE WHEN event_type = 'error' AND k % 3 = 0 THEN 'ERROR' WHEN event_type = 'error' THEN 'UNSET'
            ELSE 'OK' END AS status_code,
       CASE WHEN i = 3 THEN '' WHEN event_type IN ('purchase', 'signup') THEN 'POST'
            WHEN k % 25 = 0 THEN 'OPTIONS' ELSE 'GET' END AS http_method,
       CASE WHEN i = 3 THEN 0 WHEN event_type = 'error' AND k % 2 = 0 THEN 500 WHEN event_type = 'error' THEN 404
            WHEN k % 10 = 0 THEN 302 ELSE 200 END AS http_status_code,
       CASE WHEN i IN (0, 2) THEN concat('/api/', event_type) ELSE '' END AS http_route,
       CASE WHEN i = 1 THEN concat('http://api-', CAST(k % 4 AS VARCHAR), '.example.com:8080/v1/', event_type)
            ELSE '' END AS http_url,
       CASE WHEN i = 3 THEN CASE WHEN k % 2 = 0 THEN 'postgresql' ELSE 'redis' END ELSE '' END AS db_system,
       CASE WHEN i = 3 THEN concat('SELECT * FROM ', event_type, ' WHERE k = ', CAST(k AS VARCHAR))
            ELSE '' END AS db_statement,
       CASE WHEN i = 0 AND user_id % 10 <> 0 THEN concat('user-', CAST(user_id AS VARCHAR)) ELSE '' END AS consumer_id,
       event_type, k, i
FROM (SELECT b.*, n.i, CAST(round(b.value * 1000000 / (n.i + 1)) AS BIGINT) AS dur
      FROM (SELECT event_id, user_id, event_type, value, epoch_us(ts) * 1000 AS t0,
                   CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS k FROM events) b
      CROSS JOIN (SELECT 0 AS i UNION ALL SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 3) n) y""",
    "logs": """
SELECT CAST(doc_id % 5 AS INT) AS tenant_id,
       1704067200000000000 + doc_id * 97000000000 AS time_unix_ns,
       concat('svc-', CAST(doc_id % 5 AS VARCHAR)) AS service_name,
       CAST(1 + 4 * (doc_id % 6) AS INT) AS severity_number,
       CASE doc_id % 6 WHEN 0 THEN 'TRACE' WHEN 1 THEN 'DEBUG' WHEN 2 THEN 'INFO' WHEN 3 THEN 'WARN'
            WHEN 4 THEN 'ERROR' ELSE 'FATAL' END AS severity_text,
       text AS body,
       CASE WHEN doc_id % 3 = 0 THEN '' ELSE lpad(CAST(doc_id AS VARCHAR), 32, '0') END AS trace_id,
       CASE WHEN doc_id % 3 = 0 THEN '' ELSE lpad(CAST(doc_id * 4 AS VARCHAR), 16, '0') END AS span_id,
       lang, source
FROM documents""",
    "metric_points": """
SELECT CAST(l_orderkey % 5 AS INT) AS tenant_id,
       epoch_us(l_shipdate) * 1000 + l_orderkey * 1000000000 + l_linenumber * 7000000000 AS time_unix_ns,
       concat('svc-', CAST(l_suppkey % 5 AS VARCHAR)) AS service_name,
       concat('metric.', CAST(l_partkey % 8 AS VARCHAR)) AS metric_name,
       '1' AS metric_unit,
       CASE WHEN l_partkey % 8 < 4 THEN 'GAUGE' WHEN l_partkey % 8 < 7 THEN 'SUM' ELSE 'HISTOGRAM' END AS metric_kind,
       CASE WHEN l_partkey % 8 < 4 THEN l_extendedprice END AS value_double,
       CASE WHEN l_partkey % 8 BETWEEN 4 AND 6 THEN CAST(floor(l_quantity) AS BIGINT) END AS value_int,
       CASE WHEN l_partkey % 8 = 7 THEN l_extendedprice END AS histogram_sum,
       l_returnflag AS attr_flag, l_linestatus AS attr_status
FROM lineitem""",
    "host_cpu_memory": """
SELECT CAST(o_custkey % 5 AS INT) AS tenant_id, concat('host-', CAST(o_custkey % 20 AS VARCHAR)) AS host_id,
       concat('node-', CAST(o_custkey % 20 AS VARCHAR)) AS host_name,
       1704067200000000000 + o_orderkey * 10000000000 AS time_unix_ns,
       round((o_totalprice / 1000) - floor(o_totalprice / 1000), 4) AS cpu_util_user,
       CAST(17179869184 AS BIGINT) AS mem_total_bytes,
       CAST(floor(o_totalprice) * 10000 AS BIGINT) % 17179869184 AS mem_used_bytes
FROM orders""",
    "host_disks": """
SELECT CAST(o_custkey % 5 AS INT) AS tenant_id, concat('host-', CAST(o_custkey % 20 AS VARCHAR)) AS host_id,
       CASE o_orderkey % 2 WHEN 0 THEN '/dev/sda' ELSE '/dev/sdb' END AS device,
       1704067200000000000 + o_orderkey * 10000000000 AS time_unix_ns,
       CAST(1099511627776 AS BIGINT) AS total_bytes,
       CAST(floor(o_totalprice) * 100000 AS BIGINT) AS used_bytes,
       CAST(floor(o_totalprice) AS BIGINT) AS read_bytes_per_sec,
       CAST(floor(o_totalprice / 3) AS BIGINT) AS write_bytes_per_sec,
       CAST(floor(o_totalprice / 4096) AS BIGINT) AS reads_per_sec,
       CAST(floor(o_totalprice / 8192) AS BIGINT) AS writes_per_sec
FROM orders""",
    "host_networks": """
SELECT CAST(o_custkey % 5 AS INT) AS tenant_id, concat('host-', CAST(o_custkey % 20 AS VARCHAR)) AS host_id,
       concat('eth', CAST(o_orderkey % 3 AS VARCHAR)) AS interface_name,
       1704067200000000000 + o_orderkey * 10000000000 AS time_unix_ns,
       CAST(floor(o_totalprice * 2) AS BIGINT) AS rx_bytes_per_sec,
       CAST(floor(o_totalprice) AS BIGINT) AS tx_bytes_per_sec,
       CAST(floor(o_totalprice / 1500) AS BIGINT) AS rx_packets_per_sec,
       CAST(floor(o_totalprice / 3000) AS BIGINT) AS tx_packets_per_sec
FROM orders""",
    "host_processes": """
SELECT CAST(l_suppkey % 5 AS INT) AS tenant_id, concat('host-', CAST(l_suppkey % 20 AS VARCHAR)) AS host_id,
       epoch_us(l_shipdate) * 1000 AS time_unix_ns, l_partkey AS pid,
       concat('proc-', CAST(l_partkey % 50 AS VARCHAR)) AS command,
       round(l_discount * 10, 4) AS cpu_utilization,
       CAST(floor(l_quantity) AS BIGINT) * 1048576 AS rss_bytes,
       l_linenumber AS thread_count
FROM lineitem""",
    "disk_counters": """
SELECT CAST(o_custkey % 5 AS INT) AS tenant_id, concat('host-', CAST(o_custkey % 20 AS VARCHAR)) AS host_id,
       1704067200000000000 + o_orderkey * 10000000000 AS time_unix_ns,
       CASE o_orderkey % 2 WHEN 0 THEN '/dev/sda' ELSE '/dev/sdb' END AS device,
       CAST(1099511627776 AS BIGINT) AS total_bytes,
       1099511627776 - CAST(floor(o_totalprice) AS BIGINT) * 100000 AS free_bytes,
       o_orderkey * 1000 % 5000000 + CAST(floor(o_totalprice) AS BIGINT) % 1000 AS reads,
       o_orderkey * 700 % 4000000 + CAST(floor(o_totalprice) AS BIGINT) % 700 AS writes,
       o_orderkey * 90000 % 500000000 + CAST(floor(o_totalprice) AS BIGINT) AS sectors_read,
       o_orderkey * 60000 % 300000000 + CAST(floor(o_totalprice) AS BIGINT) AS sectors_written
FROM orders""",
    "network_counters": """
SELECT CAST(o_custkey % 5 AS INT) AS tenant_id, concat('host-', CAST(o_custkey % 20 AS VARCHAR)) AS host_id,
       1704067200000000000 + o_orderkey * 10000000000 AS time_unix_ns,
       CASE o_orderkey % 3 WHEN 0 THEN 'eth0' WHEN 1 THEN 'lo' ELSE 'veth12' END AS interface_name,
       o_orderkey * 50000 % 90000000 + CAST(floor(o_totalprice) AS BIGINT) AS rx_bytes,
       o_orderkey * 30000 % 70000000 + CAST(floor(o_totalprice) AS BIGINT) AS tx_bytes,
       o_orderkey * 100 % 900000 + CAST(floor(o_totalprice) AS BIGINT) % 100 AS rx_packets,
       o_orderkey * 90 % 800000 + CAST(floor(o_totalprice) AS BIGINT) % 90 AS tx_packets,
       o_orderkey % 7 AS rx_errors, o_orderkey % 5 AS tx_errors
FROM orders""",
    "cpu_counters": """
SELECT CAST(o_custkey % 5 AS INT) AS tenant_id, concat('host-', CAST(o_custkey % 20 AS VARCHAR)) AS host_id,
       1704067200000000000 + o_orderkey * 10000000000 AS time_unix_ns,
       o_orderkey * 40 + c % 37 AS "user", o_orderkey * 2 + c % 5 AS nice, o_orderkey * 20 + c % 17 AS system,
       o_orderkey * 100 + c % 91 AS idle, o_orderkey * 3 + c % 7 AS iowait, o_orderkey + c % 3 AS irq,
       o_orderkey + c % 2 AS softirq, 0 AS steal,
       16777216 AS mem_total_kb, c * 50 AS mem_available_kb, 4194304 AS swap_total_kb, c * 10 AS swap_free_kb
FROM (SELECT *, CAST(floor(o_totalprice) AS BIGINT) AS c FROM orders) o""",
    "process_counters": """
SELECT CAST(l_suppkey % 5 AS INT) AS tenant_id, concat('host-', CAST(l_suppkey % 20 AS VARCHAR)) AS host_id,
       epoch_us(l_shipdate) * 1000 AS time_unix_ns, l_partkey % 97 AS pid,
       CAST(sum(CAST(floor(l_extendedprice) AS BIGINT)) AS BIGINT) AS total_ticks,
       CAST(sum(CAST(floor(l_quantity) AS BIGINT)) AS BIGINT) AS rss_pages,
       max(l_linenumber) AS thread_count, 8 AS logical_cores
FROM lineitem GROUP BY 1, 2, 3, 4""",
    "stack_samples": """
SELECT CAST(l_orderkey % 5 AS INT) AS tenant_id, l_orderkey AS capture_id, l_linenumber AS sample_id,
       concat('f', CAST(l_partkey % 7 AS VARCHAR)) AS leaf,
       CASE WHEN l_partkey % 11 = 0 THEN '' ELSE concat('g', CAST(l_suppkey % 5 AS VARCHAR)) END AS mid,
       'main' AS root
FROM lineitem""",
    "profiles": """
SELECT CAST(o_custkey % 5 AS INT) AS tenant_id, 1704067200000000000 + o_orderkey * 60000000000 AS start_time_unix_ns,
       concat('svc-', CAST(o_custkey % 5 AS VARCHAR)) AS service_name,
       CASE o_orderkey % 3 WHEN 0 THEN 'CPU' WHEN 1 THEN 'WALL' ELSE 'ALLOC' END AS profile_kind,
       10000000000 + o_orderkey % 1000 AS duration_nanos,
       CAST(floor(o_totalprice) AS BIGINT) AS sample_count,
       CASE WHEN o_orderkey % 50 = 0 THEN 'not base64!'
            ELSE to_base64(encode(concat('pprof-', CAST(o_orderkey AS VARCHAR)))) END AS pprof_base64,
       o_orderkey
FROM orders""",
    "tenants": """
SELECT r_regionkey AS tenant_id, r_name AS tenant_name, CAST(7 * (1 + r_regionkey) AS INT) AS data_retention_days,
       CASE r_regionkey WHEN 4 THEN 'deleted' WHEN 3 THEN 'suspended' ELSE 'active' END AS status,
       1704067200000000000 - r_regionkey * 86400000000000 AS posted_unix_ns
FROM region""",
    "users": """
SELECT c_custkey AS user_id, n_regionkey AS tenant_id, lower(c_name) AS email,
       CASE c_custkey % 10 WHEN 0 THEN 'disabled' WHEN 1 THEN 'invited' ELSE 'active' END AS status
FROM customer JOIN nation ON c_nationkey = n_nationkey""",
    "api_keys": """
SELECT s_suppkey AS key_id, n_regionkey AS tenant_id,
       CASE WHEN s_suppkey % 3 = 0 THEN 1704067200000000000 END AS revoked_unix_ns,
       CASE WHEN s_suppkey % 4 = 0 THEN 1704067200000000000 + s_suppkey * 86400000000000 END AS expires_unix_ns
FROM supplier JOIN nation ON s_nationkey = n_nationkey""",
    "audit_log": """
SELECT o_orderkey AS audit_id, CAST(o_custkey % 5 AS INT) AS tenant_id,
       CASE WHEN o_orderkey % 7 <> 0 THEN o_custkey END AS actor_user_id,
       CASE o_orderkey % 4 WHEN 0 THEN 'apikey.created' WHEN 1 THEN 'apikey.revoked' WHEN 2 THEN 'invite.created'
            ELSE 'tenant.renamed' END AS action,
       epoch_us(o_orderdate) * 1000 AS posted_unix_ns,
       CASE WHEN o_orderkey % 7 = 0 THEN 'system:dashboard' ELSE '' END AS posted_by
FROM orders""",
    "alert_rules": """
SELECT n_nationkey AS rule_id, n_regionkey AS tenant_id, n_name AS rule_name, n_nationkey % 9 <> 8 AS enabled,
       CASE n_nationkey % 8 WHEN 0 THEN 'latency_p50' WHEN 1 THEN 'latency_p90' WHEN 2 THEN 'latency_p99'
            WHEN 3 THEN 'error_rate' WHEN 4 THEN 'request_volume' WHEN 5 THEN 'log_count' WHEN 6 THEN 'metric_avg'
            ELSE 'metric_max' END AS signal_type,
       CASE WHEN n_nationkey % 8 = 5 THEN 'WARN' WHEN n_nationkey % 8 > 5 THEN 'metric.1' ELSE '' END AS signal_param,
       CASE WHEN n_nationkey % 2 = 0 THEN '' ELSE concat('svc-', CAST(n_regionkey AS VARCHAR)) END AS service_filter,
       ['gt', 'gte', 'lt', 'lte', 'eq'][n_nationkey % 5 + 1] AS operator,
       CAST(n_nationkey AS DOUBLE) AS threshold,
       CAST(3600 * (1 + n_nationkey % 5) AS INT) AS window_seconds,
       CAST(3600 * (n_nationkey % 3) AS INT) AS for_seconds,
       CASE n_nationkey % 3 WHEN 0 THEN 'info' WHEN 1 THEN 'warning' ELSE 'critical' END AS severity
FROM nation""",
    "draft_rules": """
SELECT c_custkey AS rule_id, CASE WHEN c_custkey % 31 = 0 THEN ' ' ELSE c_name END AS rule_name,
       ['latency_p50', 'latency_p90', 'latency_p99', 'error_rate', 'request_volume', 'log_count', 'metric_avg',
        'metric_max', 'cpu_heat'][c_custkey % 9 + 1] AS signal_type,
       ['', 'warn', 'loud', 'metric.1', 'ERROR'][c_custkey % 5 + 1] AS signal_param,
       ['gt', 'gte', 'lt', 'lte', 'eq', 'gt', 'ne'][c_custkey % 7 + 1] AS operator,
       ['info', 'warning', 'critical', 'info', 'warning', 'critical', 'info', 'fatal'][c_custkey % 8 + 1] AS severity,
       CASE WHEN c_custkey % 23 = 0 THEN 90000 ELSE c_custkey % 100 * 10 END AS window_seconds,
       CASE WHEN c_custkey % 29 = 0 THEN -5 ELSE c_custkey % 10 * 60 END AS for_seconds
FROM customer""",
    "channels": """
SELECT CAST(r_regionkey * 2 + j AS BIGINT) AS channel_id, r_regionkey AS tenant_id,
       CASE j WHEN 0 THEN 'inapp' ELSE 'webhook' END AS channel_type, NOT (j = 1 AND r_regionkey % 2 = 1) AS enabled
FROM region CROSS JOIN (SELECT 0 AS j UNION ALL SELECT 1)""",
}
