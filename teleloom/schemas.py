"""Schemas of the nested wire batches.

On disk a batch is one JSON line: ids are lower-case hex text, 64-bit integers are quoted (so they are
read as text and cast) and byte strings are Base64. ``received_unix_ns`` is the arrival instant the
timestamps are clamped against.
"""

from __future__ import annotations

ANY_VALUE = "struct<string_value:string,bool_value:boolean,int_value:string,double_value:double,bytes_value:binary>"
KV = f"array<struct<key:string,value:{ANY_VALUE}>>"
RESOURCE = f"struct<attributes:{KV}>"
SCOPE = "struct<name:string,version:string>"
ENVELOPE = "tenant_id int, key_id bigint, received_unix_ns string"

SPAN = (
    "struct<trace_id:string,span_id:string,trace_state:string,parent_span_id:string,name:string,kind:int,"
    f"start_time_unix_nano:string,end_time_unix_nano:string,attributes:{KV},"
    f"events:array<struct<time_unix_nano:string,name:string,attributes:{KV}>>,"
    "status:struct<message:string,code:int>>"
)
SPAN_BATCH = (
    f"{ENVELOPE}, resource_spans array<struct<resource:{RESOURCE},"
    f"scope_spans:array<struct<scope:{SCOPE},spans:array<{SPAN}>>>>>"
)

LOG_RECORD = (
    "struct<time_unix_nano:string,observed_time_unix_nano:string,severity_number:int,severity_text:string,"
    f"body:{ANY_VALUE},attributes:{KV},trace_id:string,span_id:string>"
)
LOG_BATCH = (
    f"{ENVELOPE}, resource_logs array<struct<resource:{RESOURCE},"
    f"scope_logs:array<struct<log_records:array<{LOG_RECORD}>>>>>"
)

NUMBER_POINT = (
    f"struct<attributes:{KV},start_time_unix_nano:string,time_unix_nano:string,as_double:double,as_int:string>"
)
HISTOGRAM_POINT = (
    f"struct<attributes:{KV},start_time_unix_nano:string,time_unix_nano:string,count:string,sum:double,min:double,"
    "max:double,bucket_counts:array<string>,explicit_bounds:array<double>>"
)
METRIC = (
    "struct<name:string,description:string,unit:string,"
    f"gauge:struct<data_points:array<{NUMBER_POINT}>>,"
    f"sum:struct<data_points:array<{NUMBER_POINT}>,aggregation_temporality:int,is_monotonic:boolean>,"
    f"histogram:struct<data_points:array<{HISTOGRAM_POINT}>,aggregation_temporality:int>>"
)
METRIC_BATCH = (
    f"{ENVELOPE}, resource_metrics array<struct<resource:{RESOURCE},"
    f"scope_metrics:array<struct<metrics:array<{METRIC}>>>>>"
)

CPU = (
    "struct<logical_cores:int,load_1m:double,load_5m:double,load_15m:double,utilization_user:double,"
    "utilization_system:double,utilization_iowait:double,utilization_idle:double>"
)
MEMORY = (
    "struct<total_bytes:string,available_bytes:string,used_bytes:string,swap_total_bytes:string,swap_used_bytes:string>"
)
DISK = (
    "struct<device:string,mountpoint:string,total_bytes:string,used_bytes:string,reads_per_sec:string,"
    "writes_per_sec:string,read_bytes_per_sec:string,write_bytes_per_sec:string>"
)
NETWORK = (
    "struct<interface_name:string,rx_bytes_per_sec:string,tx_bytes_per_sec:string,rx_packets_per_sec:string,"
    "tx_packets_per_sec:string,rx_errors:string,tx_errors:string>"
)
PROCESS = (
    "struct<pid:bigint,command:string,user:string,runtime_version:string,service_name:string,cpu_utilization:double,"
    "rss_bytes:string,thread_count:int,handle_count:int>"
)
HOST_BATCH = (
    f"{ENVELOPE}, snapshots array<struct<resource:{RESOURCE},time_unix_nano:string,cpu:{CPU},memory:{MEMORY},"
    f"disks:array<{DISK}>,networks:array<{NETWORK}>,processes:array<{PROCESS}>>>"
)

PROFILE = (
    "struct<start_time_unix_nano:string,duration_nano:string,kind:int,sample_count:string,pprof:binary,"
    f"trigger_trace_id:string,attributes:{KV}>"
)
PROFILE_BATCH = (
    f"{ENVELOPE}, resource_profiles array<struct<resource:{RESOURCE},"
    f"scope_profiles:array<struct<profiles:array<{PROFILE}>>>>>"
)

BATCHES = {
    "spans": SPAN_BATCH,
    "logs": LOG_BATCH,
    "metrics": METRIC_BATCH,
    "host": HOST_BATCH,
    "profiles": PROFILE_BATCH,
}
