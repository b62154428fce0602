"""Host samples from raw operating-system counters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from teleloom.functions.history import with_previous
from teleloom.functions.ranking import top_n_by

TIME = "time_unix_ns"
HOST = ["tenant_id", "host_id"]
LEAST_ELAPSED_S = 0.001

# Fixed values of the host sampling rules.
SECTOR_BYTES = 512
TICKS_PER_SECOND = 100
REAL_FILE_SYSTEMS = ["ext2", "ext3", "ext4", "xfs", "btrfs", "zfs", "f2fs", "reiserfs", "jfs", "vfat", "exfat", "ntfs"]
SKIPPED_INTERFACES = ["lo", "veth", "docker", "br-", "virbr", "cni", "flannel", "kube", "cali", "tap"]
TOP_PROCESSES = 50


def _share(value: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), value))


def _elapsed() -> Column:
    return F.greatest(F.lit(LEAST_ELAPSED_S), (F.col(TIME) - F.col(f"previous.{TIME}")) / 1e9)


def _rate(counter: str) -> Column:
    """Whole units per second since the previous sample; 0 at first sight or after a reset."""
    now, before = F.col(counter), F.col(f"previous.{counter}")
    rate = F.floor((now - before) / _elapsed()).cast("bigint")
    return F.when(now > before, rate).otherwise(F.lit(0).cast("bigint"))


def host_cpu_utilization(samples: DataFrame, pair: Callable[..., DataFrame] = with_previous) -> DataFrame:
    """Shares of CPU time between consecutive samples of a host, from cumulative scheduler ticks.

    ``pair`` finds the preceding sample; ``streaming.host_rates`` has one for streams.
    """
    groups = {
        "user": F.col("user") + F.col("nice"),
        "system": F.col("system") + F.col("irq") + F.col("softirq") + F.col("steal"),
        "iowait": F.col("iowait"),
        "idle": F.col("idle"),
    }
    ticks = samples.select(*HOST, TIME, *[expr.alias(f"t_{name}") for name, expr in groups.items()])
    names = [f"t_{name}" for name in groups]
    ticks = ticks.withColumn("t_all", sum((F.col(n) for n in names[1:]), F.col(names[0])))
    paired = pair(ticks, HOST, TIME, [*names, "t_all"])
    whole = F.col("t_all") - F.col("previous.t_all")

    def share(name: str) -> Column:
        part = F.col(f"t_{name}") - F.col(f"previous.t_{name}")
        return F.when(whole > 0, _share(part / whole)).otherwise(F.lit(0.0)).alias(f"cpu_util_{name}")

    return paired.select(*HOST, TIME, *[share(name) for name in groups])


def _excess(total: Column, rest: Column) -> Column:
    return F.greatest(total - rest, F.lit(0).cast("bigint"))


def host_memory_usage(samples: DataFrame) -> DataFrame:
    """Memory and swap in bytes from kilobyte gauges; used is never negative."""
    kb = lambda name: F.col(name) * 1024
    return samples.select(
        *HOST,
        TIME,
        kb("mem_total_kb").alias("mem_total_bytes"),
        kb("mem_available_kb").alias("mem_available_bytes"),
        _excess(kb("mem_total_kb"), kb("mem_available_kb")).alias("mem_used_bytes"),
        kb("swap_total_kb").alias("swap_total_bytes"),
        _excess(kb("swap_total_kb"), kb("swap_free_kb")).alias("swap_used_bytes"),
    )


DISK_COUNTERS = ["reads", "writes", "sectors_read", "sectors_written"]
NETWORK_COUNTERS = ["rx_bytes", "tx_bytes", "rx_packets", "tx_packets"]


def real_disks(samples: DataFrame) -> DataFrame:
    """Samples of block devices with a file system of their own."""
    return samples.filter(F.col("fs_type").isin(REAL_FILE_SYSTEMS) & F.startswith("device", F.lit("/dev/")))


def disk_counter_rates(samples: DataFrame) -> DataFrame:
    """Per-second disk activity of real block devices; the first mount of a device counts.

    "First" is by the mount's name, as samples carry no mount order. A device whose first mount is empty
    is left out, whatever its other mounts hold. Byte rates come from the whole-sector rate.
    """
    one_mount = top_n_by(real_disks(samples), [*HOST, "device", TIME], [F.col("mountpoint")], 1).filter(F.col("total_bytes") > 0)
    return disk_rates(with_previous(one_mount, [*HOST, "device"], TIME, [TIME, *DISK_COUNTERS]))


def disk_rates(paired: DataFrame) -> DataFrame:
    """Rates of samples with their ``previous`` ones."""
    return paired.select(
        *HOST,
        "device",
        "mountpoint",
        TIME,
        "total_bytes",
        _excess(F.col("total_bytes"), F.col("free_bytes")).alias("used_bytes"),
        _rate("reads").alias("reads_per_sec"),
        _rate("writes").alias("writes_per_sec"),
        (_rate("sectors_read") * SECTOR_BYTES).alias("read_bytes_per_sec"),
        (_rate("sectors_written") * SECTOR_BYTES).alias("write_bytes_per_sec"),
    )


def network_counter_rates(samples: DataFrame, pair: Callable[..., DataFrame] = with_previous) -> DataFrame:
    """Per-second traffic of physical interfaces; error counters stay cumulative. ``pair`` as for the CPU."""
    skipped = F.lit(False)
    for prefix in SKIPPED_INTERFACES:
        skipped = skipped | F.startswith("interface_name", F.lit(prefix))
    kept = samples.filter(~skipped & (F.col("interface_name") != ""))
    counters = NETWORK_COUNTERS
    paired = pair(kept, [*HOST, "interface_name"], TIME, [TIME, *counters])
    return paired.select(
        *HOST,
        "interface_name",
        TIME,
        *[_rate(c).alias(f"{c}_per_sec") for c in counters],
        "rx_errors",
        "tx_errors",
    )


def process_cpu_topn(samples: DataFrame, top: int = TOP_PROCESSES) -> DataFrame:
    """Busiest processes of every host snapshot.

    A process counts from the host's preceding snapshot only; one missing there, or whose counter
    went back, shows 0.
    """
    snapshots = with_previous(samples.select(*HOST, TIME).distinct(), HOST, TIME, [TIME])
    snapshots = snapshots.select(*HOST, TIME, F.col(f"previous.{TIME}").alias("previous_ns"))
    rows = with_previous(samples, [*HOST, "pid"], TIME, [TIME, "total_ticks"]).join(snapshots, [*HOST, TIME])
    elapsed = F.greatest(F.lit(LEAST_ELAPSED_S), (F.col(TIME) - F.col("previous_ns")) / 1e9)
    ticks = F.col("total_ticks") - F.col("previous.total_ticks")
    busy = ticks / TICKS_PER_SECOND / elapsed / F.col("logical_cores")
    known = (F.col(f"previous.{TIME}") == F.col("previous_ns")) & (ticks >= 0)
    rows = rows.withColumn("cpu_utilization", F.when(known, _share(busy)).otherwise(F.lit(0.0)))
    top_rows = top_n_by(rows, [*HOST, TIME], [F.col("cpu_utilization").desc(), F.col("pid")], top)
    return top_rows.select(*HOST, TIME, "pid", "cpu_utilization", "rss_pages", "thread_count")
