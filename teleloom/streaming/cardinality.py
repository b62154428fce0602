"""Metric-name cap over a stream, with windows opened at a tenant's first arrival.

The names let in are carried from batch to batch as a small versioned table: at most ``cap`` names for each tenant's
running window. Points are never grouped by tenant: only distinct (tenant, name, arrival) meet the table, and the
verdict joins back by (tenant, name, window), so that one tenant sending a third of all points does not slow
a single task down.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from teleloom.functions.ranking import top_n_by
from teleloom.functions.timing import int_div
from teleloom.operators.admission import CAP_WINDOW_S, METRIC_NAME_CAP
from teleloom.session import ensure_checkpoint_dir
from teleloom.sources import tables

NS = 1_000_000_000
STATE = "tenant_id int, metric_name string, window_start_ns bigint"
# Versions of the name table that stay for replays; only the last batch of a stream is ever run again.
VERSIONS = 3


def _kept(df: DataFrame) -> DataFrame:
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def _open_windows(seen: DataFrame, names: DataFrame, window_ns: int) -> DataFrame:
    """(tenant_id, _span, _start, _opens) for the tenants seen: the running window, and the one that opens meanwhile.

    The arrivals seen lie within one window's length, so that a tenant opens one new window at most: at its
    first arrival after the running one has ended, or at its first one ever.
    """
    started = names.groupBy("tenant_id").agg(F.max("window_start_ns").alias("_start"))
    arrivals = seen.join(started, "tenant_id", "left")
    late = F.col("_start").isNull() | (F.col("_at") - F.col("_start") > window_ns)
    return arrivals.groupBy("tenant_id", "_span").agg(F.max("_start").alias("_start"), F.min(F.when(late, F.col("_at"))).alias("_opens"))


def _window(window_ns: int) -> Column:
    """Start of the window that an arrival falls in."""
    running = F.col("_at") - F.col("_start") <= window_ns
    return F.when(running, F.col("_start")).otherwise(F.col("_opens")).alias("window_start_ns")


def _let_in(seen: DataFrame, windows: DataFrame, names: DataFrame, cap: int, window_ns: int) -> DataFrame:
    """New names of the windows within what is left of their budgets, first arrivals first."""
    key = ["tenant_id", "window_start_ns"]
    placed = seen.join(windows, ["tenant_id", "_span"]).select("tenant_id", "metric_name", _window(window_ns), "_at", "_first")
    wanted = placed.groupBy(*key, "metric_name").agg(F.min(F.struct("_at", "_first")).alias("_order"))
    new = wanted.join(names, [*key, "metric_name"], "left_anti")
    order = [F.col("_order"), F.col("metric_name")]
    # No window gets more than ``cap``, which cuts the names in every task; then what is left of each budget.
    used = names.groupBy(*key).agg(F.count(F.lit(1)).alias("_used"))
    ranked = top_n_by(new, key, order, cap).join(used, key, "left")
    rank = F.row_number().over(Window.partitionBy(*key).orderBy(*order))
    fits = F.col("_rank") <= F.lit(cap) - F.coalesce("_used", F.lit(0).cast("bigint"))
    return ranked.withColumn("_rank", rank).filter(fits).select("tenant_id", "metric_name", "window_start_ns")


def guard_batch(
    points: DataFrame,
    names: DataFrame,
    cap: int = METRIC_NAME_CAP,
    window_s: int = CAP_WINDOW_S,
    arrival: str = "arrival_unix_ns",
    time_col: str = "time_unix_ns",
) -> tuple[DataFrame, DataFrame]:
    """(points with ``admitted``, names to carry on) for the points of one batch.

    ``names`` holds the names admitted in each tenant's running window. A window ends ``window_s`` after the arrival
    that opened it; the next arrival opens a new, empty one. Names are let in by arrival, those of one arrival
    by the points' time and name. A batch that spans several windows (a backlog) is decided in steps of one
    window's length, each over the distinct names of its arrivals only. A point without an arrival counts as
    arrived at 0; one without a tenant or name is not admitted.
    """
    window_ns = window_s * NS
    rows = points.withColumn("_at", F.coalesce(F.col(arrival).cast("bigint"), F.lit(0).cast("bigint")))
    rows = rows.withColumn("_span", int_div(F.col("_at"), window_ns))
    seen = _kept(rows.groupBy("tenant_id", "metric_name", "_span", "_at").agg(F.min(time_col).alias("_first")))
    spans = [r["_span"] for r in seen.select("_span").distinct().orderBy("_span").collect()]  # one for each window's length
    opened = []
    for span in spans:
        now = seen.filter(F.col("_span") == span)
        windows = _kept(_open_windows(now, names, window_ns))
        opened.append(windows)
        names = _kept(names.unionByName(_let_in(now, windows, names, cap, window_ns)))
    if not spans:
        return rows.withColumn("admitted", F.lit(False)).drop("_at", "_span"), names
    windows = reduce(DataFrame.unionByName, opened)
    placed = rows.join(windows, ["tenant_id", "_span"], "left").withColumn("window_start_ns", _window(window_ns))
    verdicts = names.withColumn("_in", F.lit(True))
    flagged = placed.join(verdicts, ["tenant_id", "metric_name", "window_start_ns"], "left")
    flagged = flagged.withColumn("admitted", F.coalesce("_in", F.lit(False))).select(*points.columns, "admitted")
    last = names.groupBy("tenant_id").agg(F.max("window_start_ns").alias("_last"))
    ended = F.lit((spans[-1] - 1) * window_ns)  # such windows had ended before the batch's last arrivals
    carried = names.join(last, "tenant_id").filter((F.col("window_start_ns") == F.col("_last")) & (F.col("_last") >= ended))
    return flagged, carried.select("tenant_id", "metric_name", "window_start_ns")


def names_before(spark: SparkSession, root: str, batch_id: int) -> DataFrame:
    """The names carried out of the last batch before this one."""
    versions = [v for v in tables.batch_ids(spark, root) if v < batch_id]
    if not versions:
        return spark.createDataFrame([], STATE)
    return spark.read.schema(STATE).parquet(f"{root}/{tables.BATCH}={versions[-1]}")


def guard_stored(
    points: DataFrame, root: str, batch_id: int, cap: int = METRIC_NAME_CAP, window_s: int = CAP_WINDOW_S, arrival: str = "arrival_unix_ns"
) -> DataFrame:
    """Points of a micro-batch with ``admitted``; the names go on in a table under ``root``, one version for each batch.

    A batch that is run again reads the version of the batch before it, decides alike and replaces its own version.
    """
    spark = points.sparkSession
    flagged, carried = guard_batch(points, names_before(spark, root, batch_id), cap, window_s, arrival)
    carried.write.mode("overwrite").parquet(f"{root}/{tables.BATCH}={batch_id}")
    tables.remove_batches(spark, root, upto=batch_id - VERSIONS)
    return flagged


def guarded(
    root: str,
    sink: Callable[[DataFrame, int], None],
    cap: int = METRIC_NAME_CAP,
    window_s: int = CAP_WINDOW_S,
    arrival: str = "received_unix_ns",
) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function: flags the points of a batch, carries the names, calls ``sink``."""

    def run(points: DataFrame, batch_id: int) -> None:
        sink(guard_stored(points, root, batch_id, cap, window_s, arrival), batch_id)

    return run
