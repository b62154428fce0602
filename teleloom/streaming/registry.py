"""The service registry kept up to date from a stream of spans.

    <root>/bucket=<k>/batch_id=<n>/      services of one bucket after batch n

A batch rewrites only the buckets of the services it saw. Merging is monotone (``tenants.merge_registries``), and a
batch that is run again starts from the version before it, so that late and replayed batches move nothing back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from teleloom.operators import tenants
from teleloom.session import ensure_checkpoint_dir
from teleloom.sources import tables

BUCKETS = 64
SCHEMA = "tenant_id int, service_name string, service_version string, first_seen_ns bigint, last_seen_ns bigint"
PARTITION = ["bucket"]
# Versions of a bucket that stay for replays.
VERSIONS = 2


def _read(spark: SparkSession, root: str, versions: dict[str, int]) -> DataFrame:
    paths = [f"{root}/bucket={bucket}/{tables.BATCH}={batch}" for bucket, batch in versions.items()]
    return spark.read.schema(SCHEMA).parquet(*paths) if paths else spark.createDataFrame([], SCHEMA)


def read_registry(spark: SparkSession, root: str) -> DataFrame:
    """All services, from the newest version of every bucket."""
    found = tables.batches_by_partition(spark, root, PARTITION)
    return _read(spark, root, {bucket: ids[-1] for (bucket,), ids in found.items()})


def store_registry(spans: DataFrame, root: str, batch_id: int, buckets: int = BUCKETS) -> None:
    """Merge the services of one micro-batch into the registry. ``buckets`` must stay the same for a registry."""
    spark = spans.sparkSession
    ensure_checkpoint_dir(spark)
    named = spans.filter(F.col("tenant_id").isNotNull() & F.col("service_name").isNotNull())
    seen = tenants.upsert_service_registry(named)
    bucket = F.pmod(F.xxhash64("tenant_id", "service_name"), F.lit(buckets)).cast("int")
    seen = seen.checkpoint(eager=True)
    touched = {str(r["bucket"]) for r in seen.select(bucket.alias("bucket")).distinct().collect()}  # at most ``buckets``
    found = tables.batches_by_partition(spark, root, PARTITION)
    before = {b: [i for i in ids if i < batch_id] for (b,), ids in found.items() if b in touched}
    old = _read(spark, root, {b: ids[-1] for b, ids in before.items() if ids})
    merged = tenants.merge_registries(old, seen).withColumn("bucket", bucket).withColumn(tables.BATCH, F.lit(batch_id).cast("bigint"))
    rows = merged.repartition("bucket")
    tables.replace_partitions(rows.write.option("compression", "zstd"), root, [*PARTITION, tables.BATCH])
    for b, ids in before.items():
        for gone in ids[: -(VERSIONS - 1)]:
            tables.remove_batch(spark, root, PARTITION, [b], gone)


def registry_stream(spans: DataFrame, root: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Keep the registry up to date from a stream of spans; ``trigger`` as for ``DataStreamWriter.trigger``."""
    writer = spans.writeStream.foreachBatch(lambda df, batch_id: store_registry(df, root, batch_id))
    return writer.option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
