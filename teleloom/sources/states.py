"""Rollup state tables on plain Parquet.

    <root>/<rollup>/tenant_id=../bucket_month=../batch_id=<n>/      state rows of one batch

A batch written again replaces its own rows, so that a replayed batch does not count twice. Compaction merges
the batches of a month and leaves other months as they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from teleloom.operators.rollups import Rollup, merge, partials
from teleloom.sources import tables

PARTITION = ["tenant_id", "bucket_month"]


def _arranged(states: DataFrame, rollup: Rollup) -> DataFrame:
    month = F.date_format(F.timestamp_seconds(F.col("bucket_s")), "yyyyMM")
    rows = states.withColumn("bucket_month", month).hint("rebalance", *[F.col(c) for c in PARTITION])
    return rows.sortWithinPartitions(*PARTITION, *[k for k in rollup.keys if not k.startswith("attrs_")], "bucket_s")


def write_states(facts: DataFrame, rollup: Rollup, root: str, batch_id: int) -> None:
    """Aggregate one batch of facts and store its state rows under the batch id."""
    rows = _arranged(partials(rollup, facts), rollup).withColumn(tables.BATCH, F.lit(batch_id).cast("bigint"))
    writer = rows.write.option("compression", "zstd")
    tables.replace_partitions(writer, f"{root}/{rollup.name}", [*PARTITION, tables.BATCH])


def read_states(spark: SparkSession, rollup: Rollup, root: str, upto: int | None = None) -> DataFrame:
    """All state rows, unmerged, or those of the batches up to one."""
    rows = spark.read.parquet(f"{root}/{rollup.name}")
    if upto is not None:
        rows = rows.filter(F.col(tables.BATCH) <= upto)
    return rows.drop(tables.BATCH)


def compact(spark: SparkSession, rollup: Rollup, root: str, upto: int) -> int:
    """Merge the batches up to ``upto`` to one row per key, in the months that have several; gives how many."""
    return tables.compact(spark, root, rollup.name, upto, PARTITION, lambda rows: _arranged(merge(rollup, rows), rollup))
