"""Partitioned Parquet fact and rollup tables.

    <root>/<table>/tenant_id=../event_date=../batch_id=<n>/      rows of one batch

Batches, single appends and compactions share this layout, so that a partition is one folder: readers prune
it, compaction rewrites it and retention removes it without touching others.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from teleloom.functions.timing import unix_ns_to_timestamp

# Sort order within the files of a (tenant, day) partition.
SORT_KEYS = {
    "spans": ["service_name", "span_kind", "start_time_unix_ns", "trace_id"],
    "logs": ["service_name", "severity_number", "time_unix_ns"],
    "metric_points": ["service_name", "metric_name", "attrs_hash", "time_unix_ns"],
    "host_cpu_memory": ["host_id", "time_unix_ns"],
    "host_disks": ["host_id", "device", "time_unix_ns"],
    "host_networks": ["host_id", "interface_name", "time_unix_ns"],
    "host_processes": ["host_id", "service_name", "pid", "time_unix_ns"],
    "profiles": ["service_name", "profile_kind", "start_time_unix_ns"],
}
# Columns looked up by value, given a Parquet bloom filter.
BLOOM_COLUMNS = {
    "spans": ["trace_id", "service_name", "http_route", "consumer_id"],
    "logs": ["trace_id", "service_name"],
    "profiles": ["service_name", "trigger_trace_id"],
}
TIME_COLUMNS = {"spans": "start_time_unix_ns", "profiles": "start_time_unix_ns"}
PARTITION = ["tenant_id", "event_date"]
BATCH = "batch_id"
# Batch number of rows that were appended outside a stream.
APPENDED = -1
STAGING = "_compacting"


def _writer(df: DataFrame, table: str):
    writer = df.write.option("compression", "zstd")
    for column in BLOOM_COLUMNS.get(table, []):
        writer = writer.option(f"parquet.bloom.filter.enabled#{column}", "true")
    return writer


def arranged(df: DataFrame, table: str) -> DataFrame:
    """Rows laid out for writing: by partition and in key order.

    The rebalance hint lets Spark split a partition that is too large for one file and merge small
    ones, so one huge tenant does not end up in a single task.
    """
    if "event_date" not in df.columns:
        time = TIME_COLUMNS.get(table, "time_unix_ns")
        df = df.withColumn("event_date", F.to_date(unix_ns_to_timestamp(F.col(time))))
    balanced = df.hint("rebalance", *[F.col(c) for c in PARTITION])
    return balanced.sortWithinPartitions(*PARTITION, *SORT_KEYS[table])


def write_partitioned(df: DataFrame, root: str, table: str) -> None:
    """Append rows to a fact table."""
    rows = arranged(df, table).withColumn(BATCH, F.lit(APPENDED).cast("bigint"))
    _writer(rows, table).mode("append").partitionBy(*PARTITION, BATCH).parquet(f"{root}/{table}")


def write_batch(df: DataFrame, root: str, table: str, batch_id: int) -> None:
    """Write one micro-batch under its id; writing the same id again replaces it."""
    rows = arranged(df, table).withColumn(BATCH, F.lit(batch_id).cast("bigint"))
    replace_partitions(_writer(rows, table), f"{root}/{table}", [*PARTITION, BATCH])


def replace_partitions(writer, path: str, partition: Sequence[str]) -> None:
    """Write rows, replacing just the partitions that they are in."""
    writer.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partition).parquet(path)


def read_table(spark: SparkSession, root: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{root}/{table}")


# ---------------------------------------------------------------------------- folders


def _folder(spark: SparkSession, path: str):
    """File system and path object of a folder; it may be in any store that Spark reads."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def _folders(spark: SparkSession, path: str, names: Sequence[str]) -> list[tuple[str, ...]]:
    """Values of all partition folders below a path; names are metadata, no file is opened."""
    fs, at = _folder(spark, "/".join([path, *[f"{n}=*" for n in names]]))
    found = [str(status.getPath()) for status in (fs.globStatus(at) or []) if status.isDirectory()]
    return sorted(tuple(part.split("=", 1)[1] for part in p.split("/")[-len(names) :]) for p in found)


def _place(names: Sequence[str], values: Sequence[str]) -> str:
    return "/".join(f"{n}={v}" for n, v in zip(names, values, strict=True))


def list_partitions(spark: SparkSession, root: str, table: str, partition: Sequence[str] = PARTITION) -> DataFrame:
    """(table_name, tenant_id, period) of every partition folder of a table."""
    found = [(table, int(tenant), period) for tenant, period in _folders(spark, f"{root}/{table}", partition)]
    return spark.createDataFrame(found, "table_name string, tenant_id int, period string")


def batches_by_partition(spark: SparkSession, path: str, partition: Sequence[str]) -> dict[tuple[str, ...], list[int]]:
    """Batch ids below each partition folder, in order."""
    found = defaultdict(list)
    for *place, batch in _folders(spark, path, [*partition, BATCH]):
        found[tuple(place)].append(int(batch))
    return {place: sorted(ids) for place, ids in found.items()}


def remove_batch(spark: SparkSession, path: str, partition: Sequence[str], place: Sequence[str], batch_id: int) -> None:
    """Remove one batch of one partition."""
    fs, at = _folder(spark, f"{path}/{_place([*partition, BATCH], [*place, str(batch_id)])}")
    fs.delete(at, True)


def batch_ids(spark: SparkSession, path: str) -> list[int]:
    """Ids of the batch folders right below a path, in order."""
    return sorted(int(found) for (found,) in _folders(spark, path, [BATCH]))


def remove_batches(spark: SparkSession, path: str, upto: int) -> None:
    """Remove the batch folders right below a path up to an id."""
    for found in batch_ids(spark, path):
        if found <= upto:
            fs, at = _folder(spark, f"{path}/{BATCH}={found}")
            fs.delete(at, True)


def remove_partitions(spark: SparkSession, root: str, gone: DataFrame, partition: Sequence[str] = PARTITION) -> int:
    """Remove the folders of the listed partitions (table_name, tenant_id, period); gives how many there were.

    One name per tenant and period: they are streamed, and each folder goes with one call.
    """
    removed = 0
    for row in gone.select("table_name", "tenant_id", "period").distinct().toLocalIterator():
        place = _place(partition, (row["tenant_id"], row["period"]))
        fs, at = _folder(spark, f"{root}/{row['table_name']}/{place}")
        removed += bool(fs.delete(at, True))
    return removed


def compact(
    spark: SparkSession,
    root: str,
    table: str,
    upto: int,
    partition: Sequence[str] = PARTITION,
    rewrite: Callable[[DataFrame], DataFrame] | None = None,
) -> int:
    """Rewrite the partitions with several batches up to ``upto`` as one each; gives how many.

    Only these partitions are read. ``upto`` must be a batch that will not be written again. The new files
    are complete in a hidden folder before old ones go; a compaction that was cut off is finished by the
    next one. A reader that lists files during the exchange should list again.
    """
    path = f"{root}/{table}"
    _finish(spark, path, partition)
    batches = defaultdict(list)
    for *place, batch in _folders(spark, path, [*partition, BATCH]):
        if int(batch) <= upto:
            batches[tuple(place)].append(batch)
    several = {place: ids for place, ids in batches.items() if len(ids) > 1}
    if not several:
        return 0
    paths = [f"{path}/{_place([*partition, BATCH], [*place, b])}" for place, ids in several.items() for b in ids]
    rows = spark.read.option("basePath", path).parquet(*paths).drop(BATCH)
    rows = arranged(rows, table) if rewrite is None else rewrite(rows)
    merged = rows.withColumn(BATCH, F.lit(-2 - upto).cast("bigint"))
    _writer(merged, table).mode("overwrite").partitionBy(*partition, BATCH).parquet(f"{path}/{STAGING}")
    _finish(spark, path, partition)
    return len(several)


def _finish(spark: SparkSession, path: str, partition: Sequence[str]) -> None:
    """Put complete compacted partitions in the place of their batches; drop incomplete ones."""
    fs, staging = _folder(spark, f"{path}/{STAGING}")
    if not fs.exists(staging):
        return
    if fs.exists(_folder(spark, f"{path}/{STAGING}/_SUCCESS")[1]):
        names = [*partition, BATCH]
        for *place, new in _folders(spark, f"{path}/{STAGING}", names):
            upto = -2 - int(new)
            for *_, old in _folders(spark, f"{path}/{_place(partition, place)}", [BATCH]):
                if int(old) <= upto:
                    fs.delete(_folder(spark, f"{path}/{_place(names, [*place, old])}")[1], True)
            target = _place(names, [*place, new])
            fs.rename(_folder(spark, f"{path}/{STAGING}/{target}")[1], _folder(spark, f"{path}/{target}")[1])
    fs.delete(staging, True)
