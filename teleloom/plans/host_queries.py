"""Host, counter and profile queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from teleloom.operators import counters, hosts, profiles
from teleloom.plans.registry import joined, query, rounded
from teleloom.sources import views

DAY = "// 1000000000 // 86400 * 86400"


def _newest(column: str, *more: str) -> str:
    fields = ", ".join(f"f{i} := {c}" for i, c in enumerate((column, *more)))
    return f"arg_max({column}, struct_pack(t := time_unix_ns, {fields}))"


_HOSTS = f"""SELECT tenant_id, host_id, any_value(host_name) AS host_name, 'linux' AS os_type, '6.1' AS os_version,
  8 AS logical_cores, round({_newest('cpu_util_user')}, 9) AS cpu_util_user, max(mem_total_bytes) AS mem_total_bytes,
  {_newest('mem_used_bytes')} AS mem_used_bytes,
  round({_newest('mem_used_bytes')} / max(mem_total_bytes), 9) AS mem_utilization,
  max(time_unix_ns) AS last_seen_ns, count(*) AS samples FROM host_cpu_memory GROUP BY 1, 2"""


@query("list_hosts", _HOSTS, ["host_cpu_memory"])
def _(spark, sf):
    return rounded(hosts.list_hosts(views.host_cpu_memory(spark, sf)))


@query(
    "host_health",
    f"""SELECT tenant_id, host_id,
               CASE WHEN cpu_util_user >= 0.85 THEN 'err' WHEN cpu_util_user >= 0.7 THEN 'warn' ELSE 'ok' END AS cpu_status,
               CASE WHEN mem_utilization >= 0.9 THEN 'err' WHEN mem_utilization >= 0.75 THEN 'warn' ELSE 'ok' END AS mem_status
        FROM ({_HOSTS})""",
    ["host_cpu_memory"],
)
def _(spark, sf):
    listed = hosts.host_health(hosts.list_hosts(views.host_cpu_memory(spark, sf)))
    return listed.select("tenant_id", "host_id", "cpu_status", "mem_status")


@query(
    "host_utilization",
    f"""SELECT tenant_id, host_id, time_unix_ns {DAY} AS bucket_s, round(avg(cpu_util_user), 6) AS cpu_avg,
               round(max(cpu_util_user), 6) AS cpu_max,
               CAST(sum(mem_used_bytes) // count(*) AS BIGINT) AS mem_used_avg, max(mem_used_bytes) AS mem_used_max,
               max(mem_total_bytes) AS mem_total
        FROM host_cpu_memory GROUP BY 1, 2, 3""",
    ["host_cpu_memory"],
)
def _(spark, sf):
    return rounded(hosts.host_utilization(views.host_cpu_memory(spark, sf), bucket_s=86400), 6)


def _avg(column: str) -> str:
    return f"CAST(sum({column}) // count(*) AS BIGINT)"


_DISKS = f"""SELECT tenant_id, host_id, time_unix_ns {DAY} AS bucket_s, device, max(total_bytes) AS total_bytes,
  {_newest('used_bytes')} AS used_bytes, {_avg('read_bytes_per_sec')} AS read_bytes_avg,
  {_avg('write_bytes_per_sec')} AS write_bytes_avg, max(read_bytes_per_sec) AS read_bytes_max,
  max(write_bytes_per_sec) AS write_bytes_max, {_avg('reads_per_sec')} AS read_iops,
  {_avg('writes_per_sec')} AS write_iops FROM host_disks GROUP BY 1, 2, 3, 4"""


def _disk_points(spark, sf):
    return hosts.host_disks(views.host_disks(spark, sf), bucket_s=86400)


@query("host_disks", _DISKS, ["host_disks"])
def _(spark, sf):
    return _disk_points(spark, sf)


@query(
    "disk_capacity_latest",
    f"""SELECT * EXCLUDE rn FROM (SELECT *, row_number() OVER (PARTITION BY tenant_id, host_id, device
                                                               ORDER BY bucket_s DESC) AS rn FROM ({_DISKS}))
        WHERE rn = 1""",
    ["host_disks"],
)
def _(spark, sf):
    return hosts.disk_capacity_latest(_disk_points(spark, sf))


@query(
    "host_series_pivot",
    f"""SELECT tenant_id, host_id, bucket_s,
               round(coalesce(max(read_bytes_avg) FILTER (device = '/dev/sda'), 0) / 1048576, 3) AS "/dev/sda_read",
               round(coalesce(max(write_bytes_avg) FILTER (device = '/dev/sda'), 0) / 1048576, 3) AS "/dev/sda_write",
               round(coalesce(max(read_bytes_avg) FILTER (device = '/dev/sdb'), 0) / 1048576, 3) AS "/dev/sdb_read",
               round(coalesce(max(write_bytes_avg) FILTER (device = '/dev/sdb'), 0) / 1048576, 3) AS "/dev/sdb_write"
        FROM ({_DISKS}) GROUP BY 1, 2, 3""",
    ["host_disks"],
)
def _(spark, sf):
    values = {"read": "read_bytes_avg", "write": "write_bytes_avg"}
    return hosts.host_series_pivot(_disk_points(spark, sf), "device", values, ["/dev/sda", "/dev/sdb"])


@query(
    "host_networks",
    f"""SELECT tenant_id, host_id, time_unix_ns {DAY} AS bucket_s, interface_name,
               {_avg('rx_bytes_per_sec')} AS rx_bytes_avg, {_avg('tx_bytes_per_sec')} AS tx_bytes_avg,
               max(rx_bytes_per_sec) AS rx_bytes_max, max(tx_bytes_per_sec) AS tx_bytes_max,
               {_avg('rx_packets_per_sec')} AS rx_packets, {_avg('tx_packets_per_sec')} AS tx_packets
        FROM host_networks GROUP BY 1, 2, 3, 4""",
    ["host_networks"],
)
def _(spark, sf):
    return hosts.host_networks(views.host_networks(spark, sf), bucket_s=86400)


@query(
    "top_processes",
    """SELECT tenant_id, host_id, time_unix_ns, pid, command, round(cpu_utilization, 9) AS cpu_utilization, rss_bytes,
              thread_count
       FROM (SELECT *, row_number() OVER (PARTITION BY tenant_id, host_id
                                          ORDER BY cpu_utilization DESC, pid, rss_bytes DESC, thread_count DESC) AS rn
             FROM (SELECT *, max(time_unix_ns) OVER (PARTITION BY tenant_id, host_id) AS newest FROM host_processes)
             WHERE time_unix_ns = newest) WHERE rn <= 50""",
    ["host_processes"],
)
def _(spark, sf):
    rows = hosts.top_processes(views.host_processes(spark, sf))
    return rounded(
        rows.select(
            "tenant_id", "host_id", "time_unix_ns", "pid", "command", "cpu_utilization", "rss_bytes", "thread_count"
        )
    )


# ---------------------------------------------------------------------------- counters


def _rate_sql(counter: str) -> str:
    return f"""CASE WHEN {counter} > lag({counter}) OVER w
      THEN CAST(floor(({counter} - lag({counter}) OVER w)
                      / greatest(0.001, (time_unix_ns - lag(time_unix_ns) OVER w) / 1e9)) AS BIGINT)
      ELSE 0 END"""


@query(
    "disk_counter_rates",
    f"""SELECT tenant_id, host_id, device, time_unix_ns, greatest(total_bytes - free_bytes, 0) AS used_bytes,
               {_rate_sql('reads')} AS reads_per_sec, {_rate_sql('writes')} AS writes_per_sec,
               {_rate_sql('sectors_read')} * 512 AS read_bytes_per_sec,
               {_rate_sql('sectors_written')} * 512 AS write_bytes_per_sec
        FROM disk_counters WINDOW w AS (PARTITION BY tenant_id, host_id, device ORDER BY time_unix_ns)""",
    ["disk_counters"],
)
def _(spark, sf):
    return counters.disk_counter_rates(views.disk_counters(spark, sf)).drop("mountpoint", "total_bytes")


@query(
    "network_counter_rates",
    f"""SELECT tenant_id, host_id, interface_name, time_unix_ns, {_rate_sql('rx_bytes')} AS rx_bytes_per_sec,
               {_rate_sql('tx_bytes')} AS tx_bytes_per_sec, {_rate_sql('rx_packets')} AS rx_packets_per_sec,
               {_rate_sql('tx_packets')} AS tx_packets_per_sec, rx_errors, tx_errors
        FROM network_counters WHERE interface_name NOT IN ('lo', 'veth12')
        WINDOW w AS (PARTITION BY tenant_id, host_id, interface_name ORDER BY time_unix_ns)""",
    ["network_counters"],
)
def _(spark, sf):
    return counters.network_counter_rates(views.network_counters(spark, sf))


def _share_sql(part: str) -> str:
    return f"""CASE WHEN t_all > lag(t_all) OVER w THEN
      round(greatest(0.0, least(1.0, ({part} - lag({part}) OVER w) / (t_all - lag(t_all) OVER w))), 9) ELSE 0.0 END"""


@query(
    "host_cpu_utilization",
    f"""WITH t AS (SELECT *, t_user + t_system + iowait + idle AS t_all FROM (
          SELECT *, "user" + nice AS t_user, system + irq + softirq + steal AS t_system FROM cpu_counters))
        SELECT tenant_id, host_id, time_unix_ns, {_share_sql('t_user')} AS cpu_util_user,
               {_share_sql('t_system')} AS cpu_util_system, {_share_sql('iowait')} AS cpu_util_iowait,
               {_share_sql('idle')} AS cpu_util_idle
        FROM t WINDOW w AS (PARTITION BY tenant_id, host_id ORDER BY time_unix_ns)""",
    ["cpu_counters"],
)
def _(spark, sf):
    return rounded(counters.host_cpu_utilization(views.cpu_counters(spark, sf)))


@query(
    "host_memory_usage",
    """SELECT tenant_id, host_id, time_unix_ns, CAST(mem_total_kb AS BIGINT) * 1024 AS mem_total_bytes,
              mem_available_kb * 1024 AS mem_available_bytes,
              greatest(mem_total_kb - mem_available_kb, 0) * 1024 AS mem_used_bytes,
              CAST(swap_total_kb AS BIGINT) * 1024 AS swap_total_bytes,
              greatest(swap_total_kb - swap_free_kb, 0) * 1024 AS swap_used_bytes
       FROM cpu_counters""",
    ["cpu_counters"],
)
def _(spark, sf):
    return counters.host_memory_usage(views.cpu_counters(spark, sf))


@query(
    "process_cpu_topn",
    """WITH snaps AS (SELECT tenant_id, host_id, time_unix_ns,
                             lag(time_unix_ns) OVER (PARTITION BY tenant_id, host_id ORDER BY time_unix_ns) AS previous_ns
                      FROM (SELECT DISTINCT tenant_id, host_id, time_unix_ns FROM process_counters)),
       used AS (SELECT c.*, coalesce(CASE WHEN c.total_ticks >= b.total_ticks THEN
                    greatest(0.0, least(1.0, (c.total_ticks - b.total_ticks) / 100
                             / greatest(0.001, (c.time_unix_ns - s.previous_ns) / 1e9) / c.logical_cores)) END, 0.0) AS util
                FROM process_counters c
                JOIN snaps s ON s.tenant_id = c.tenant_id AND s.host_id = c.host_id AND s.time_unix_ns = c.time_unix_ns
                LEFT JOIN process_counters b ON b.tenant_id = c.tenant_id AND b.host_id = c.host_id AND b.pid = c.pid
                  AND b.time_unix_ns = s.previous_ns)
       SELECT tenant_id, host_id, time_unix_ns, pid, round(util, 9) AS cpu_utilization, rss_pages, thread_count
       FROM (SELECT *, row_number() OVER (PARTITION BY tenant_id, host_id, time_unix_ns ORDER BY util DESC, pid) AS rn
             FROM used) WHERE rn <= 50""",
    ["process_counters"],
)
def _(spark, sf):
    return rounded(counters.process_cpu_topn(views.process_counters(spark, sf)))


# ---------------------------------------------------------------------------- profiles

_FRAMES = "CASE WHEN mid = '' THEN [leaf, root] ELSE [leaf, mid, root] END"


@query(
    "fold_stacks",
    f"""WITH f AS (SELECT tenant_id, array_to_string({_FRAMES}, ',') AS stack, count(*) AS sample_count
                   FROM stack_samples GROUP BY 1, 2)
        SELECT *, CAST(sum(sample_count) OVER (PARTITION BY tenant_id) AS BIGINT) AS total_samples FROM f""",
    ["stack_samples"],
)
def _(spark, sf):
    return joined(profiles.fold_stacks(views.stack_samples(spark, sf)), "stack")


@query(
    "frame_dimension",
    f"""SELECT row_number() OVER (ORDER BY substr(md5(name), 1, 3), name) AS frame_id, name
        FROM (SELECT DISTINCT unnest({_FRAMES}) AS name FROM stack_samples)
        UNION ALL SELECT 0, ''""",
    ["stack_samples"],
)
def _(spark, sf):
    return profiles.frame_dimension(views.stack_samples(spark, sf))


@query(
    "profile_top_frames",
    f"""SELECT tenant_id, name, CAST(sum(CAST(name = leaf AS INT)) AS BIGINT) AS self_samples, count(*) AS total_samples
        FROM (SELECT tenant_id, leaf, unnest({_FRAMES}) AS name FROM stack_samples) GROUP BY 1, 2""",
    ["stack_samples"],
)
def _(spark, sf):
    return profiles.profile_top_frames(views.stack_samples(spark, sf))


@query(
    "list_profiles",
    """SELECT tenant_id, start_time_unix_ns, service_name, profile_kind, round(duration_nanos / 1e9, 9) AS duration_s,
              sample_count, length(pprof_base64) AS stored_bytes
       FROM (SELECT *, row_number() OVER (PARTITION BY tenant_id ORDER BY start_time_unix_ns DESC, service_name,
                                          profile_kind) AS rn FROM profiles) WHERE rn <= 100""",
    ["profiles"],
)
def _(spark, sf):
    return rounded(profiles.list_profiles(views.profiles(spark, sf)).drop("trigger_trace_id", "agent_version"))


@query(
    "get_profile_by_key",
    """WITH newest AS (SELECT tenant_id AS tn, service_name AS sv, profile_kind AS kd, start_time_unix_ns AS st
                       FROM profiles WHERE o_orderkey % 50 <> 0
                       ORDER BY start_time_unix_ns DESC, tenant_id, service_name, profile_kind LIMIT 1)
       SELECT tenant_id, service_name, profile_kind, start_time_unix_ns, concat('pprof-', CAST(o_orderkey AS VARCHAR)) AS payload
       FROM profiles, newest WHERE tenant_id = tn AND service_name = sv AND profile_kind = kd AND start_time_unix_ns = st""",
    ["profiles"],
)
def _(spark, sf):
    # The newest capture of the whole table that has a payload.
    rows = views.profiles(spark, sf)
    order = [F.desc("start_time_unix_ns"), "tenant_id", "service_name", "profile_kind"]
    key = rows.filter("pprof_base64 <> ''").orderBy(*order).first()
    found = profiles.get_profile(rows, key["tenant_id"], key["service_name"], key["profile_kind"], key["start_time_unix_ns"])
    return found.select(
        "tenant_id", "service_name", "profile_kind", "start_time_unix_ns", F.decode("pprof", "UTF-8").alias("payload")
    )


@query(
    "get_profile",
    """SELECT tenant_id, service_name, profile_kind, start_time_unix_ns,
              CASE WHEN o_orderkey % 50 = 0 THEN '' ELSE concat('pprof-', CAST(o_orderkey AS VARCHAR)) END AS payload
       FROM profiles""",
    ["profiles"],
)
def _(spark, sf):
    rows = profiles.decoded(views.profiles(spark, sf))
    return rows.select(
        "tenant_id", "service_name", "profile_kind", "start_time_unix_ns", F.decode("pprof", "UTF-8").alias("payload")
    )
