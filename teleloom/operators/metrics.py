"""Metric reads."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from teleloom.functions.attributes import series_key
from teleloom.functions.predicates import bounded, finite_or_zero
from teleloom.functions.ranking import top_n
from teleloom.functions.timing import bucket_start
from teleloom.operators.rollups import METRICS_MINUTELY, merge
from teleloom.scope import Scope

TIME = "time_unix_ns"
# Fixed value: entries of the metric catalogue that are shown by default.
CATALOG_LIMIT = 500


def list_metrics(points: DataFrame, scope: Scope = Scope(), service: str = "", limit: int | None = CATALOG_LIMIT) -> DataFrame:
    """Metric catalogue: latest kind and unit, last seen, number of points; without a limit all of it."""
    df = scope.apply(points, TIME)
    if service:
        df = df.filter(F.col("service_name") == service)
    newest = F.struct(F.col(TIME).alias("ts"), F.col("metric_kind").alias("kind"), F.col("metric_unit").alias("unit"))
    grouped = df.groupBy("tenant_id", "metric_name", "service_name").agg(
        F.max(newest).alias("_newest"), F.max(TIME).alias("last_seen_ns"), F.count(F.lit(1)).alias("point_count")
    )
    catalog = grouped.select(
        "tenant_id",
        "metric_name",
        F.col("_newest.kind").alias("metric_kind"),
        F.col("_newest.unit").alias("metric_unit"),
        "service_name",
        "last_seen_ns",
        "point_count",
    )
    order = [F.col("last_seen_ns").desc(), F.col("metric_name"), F.col("service_name")]
    return top_n(catalog, scope, order, bounded(limit, CATALOG_LIMIT))


def metric_series(
    states: DataFrame, scope: Scope = Scope(), metric: str | None = None, service: str = "", bucket_s: int = 60
) -> DataFrame:
    """Last, largest and smallest value per bucket and attribute set, from the minutely rollup."""
    df = scope.apply_bucket(states, "bucket_s")
    if metric is not None:
        df = df.filter(F.col("metric_name") == metric)
    if service:
        df = df.filter(F.col("service_name") == service)
    df = df.withColumn("bucket_s", bucket_start(F.col("bucket_s"), max(60, bucket_s)))
    keys = ["tenant_id", "metric_name", "bucket_s"]
    merged = merge(METRICS_MINUTELY, df, [*keys, "attrs_keys", "attrs_values"])
    return merged.select(
        *keys,
        series_key(F.col("attrs_keys"), F.col("attrs_values")).alias("series_key"),
        finite_or_zero(F.col("value_last.value")).alias("value_last"),
        finite_or_zero(F.col("value_max")).alias("value_max"),
        finite_or_zero(F.col("value_min")).alias("value_min"),
    )


def metric_series_pivot(series: DataFrame) -> DataFrame:
    """One row per series with its (bucket, last value) points in time order."""
    shown = F.when(F.col("series_key") == "", "(no attrs)").otherwise(F.col("series_key"))
    return (
        series.groupBy("tenant_id", "metric_name", shown.alias("series_key"))
        .agg(F.array_sort(F.collect_list(F.struct("bucket_s", "value_last"))).alias("points"))
        .orderBy("tenant_id", "metric_name", "series_key")
    )
