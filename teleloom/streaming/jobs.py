"""Streaming ingest: wire batches to fact tables and rollup states."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark import StorageLevel, inheritable_thread_target
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from teleloom.functions.timing import unix_ns_to_timestamp
from teleloom.operators import admission, ingest, rollups
from teleloom.operators.rollups import Rollup
from teleloom.sources import otlp, states, tables
from teleloom.streaming import cardinality

# Facts and rollups fed by each signal.
FLATTEN: dict[str, tuple[str, Callable[[DataFrame], DataFrame], Sequence[Rollup]]] = {
    "spans": (
        "spans",
        ingest.flatten_spans,
        (rollups.SPANS_MINUTELY, rollups.CONSUMER_HOURLY, rollups.STATUS_HOURLY),
    ),
    "logs": ("logs", ingest.flatten_logs, (rollups.LOGS_MINUTELY,)),
    "metrics": ("metric_points", ingest.flatten_metrics, (rollups.METRICS_MINUTELY,)),
    "profiles": ("profiles", ingest.flatten_profiles, ()),
}
# Arrival clamping keeps stamps within -1 h .. +5 min, so nothing is later than this.
WATERMARK = "65 minutes"


@dataclass(frozen=True)
class Admission:
    """What is let in: batches of active tenants with a valid key, and so many metric names for each tenant.

    Of spans only the listed kinds, and those of sources that start with a listed prefix; no list means all.
    """

    tenants: DataFrame
    api_keys: DataFrame
    metric_cap: int = admission.METRIC_NAME_CAP
    span_kinds: Sequence[str] = ()
    metric_window_s: int = admission.CAP_WINDOW_S
    source_prefixes: Sequence[str] = ()


# Reasons for rows that are not stored.
MALFORMED, NO_KEY, TOO_MANY_NAMES, OUT_OF_SCOPE = "malformed", "not admitted", "too many metric names", "out of scope"


def store_batch(
    batches: DataFrame, signal: str, root: str, batch_id: int, admit: Admission | None = None
) -> None:
    """Write one micro-batch: unreadable lines, facts and rollup states, each under its batch id.

    With ``admit`` batches without a valid key are not mapped; metric points over the cap of names and spans
    outside the captured kinds and sources are not stored. The cap holds over batches: the names of each tenant's
    running window are carried in ``<root>/metric_names`` (``cardinality.guard_stored``). What was let in and what was not is counted by tenant
    and reason in ``<root>/ingest_quality`` (batches, and rows within them), and batches and names that were not are listed in
    ``<root>/rejected``. Every output replaces what an earlier try of the same batch left, so a replay changes
    nothing.

    The batch is read once for its facts, which are cached for the tables made of them; unreadable lines are
    observed on the way, and only if there are any is it read again for them. Admission reads the keys alone.
    """
    if admit is not None:
        _store_admission(batches, signal, root, batch_id, admit)
    unreadable = Observation()
    source = batches
    if otlp.BAD_LINE in batches.columns:
        batches = batches.observe(unreadable, F.count_if(~otlp.is_readable()).alias("lines")).filter(otlp.is_readable())
    if admit is not None:
        batches = _checked(batches, admit).filter("admitted").drop("admitted")
    if signal == "host":
        batches = batches.persist(StorageLevel.MEMORY_AND_DISK)
        try:
            for table, rows in ingest.flatten_host_snapshots(batches).items():
                tables.write_batch(rows, root, table, batch_id)
        finally:
            batches.unpersist()
    else:
        _store_facts(batches, signal, root, batch_id, admit)
    if otlp.BAD_LINE in source.columns and _observed(unreadable, "lines") != 0:
        bad = source.filter(~otlp.is_readable()).select(otlp.BAD_LINE)
        bad.write.mode("overwrite").parquet(f"{root}/unreadable/{signal}/batch_id={batch_id}")


def _observed(observation: Observation, name: str) -> int | None:
    """An observed number; none where Spark found the plan to be empty and so ran no observation."""
    try:
        return observation.get[name]
    except Py4JJavaError:
        return None


def _checked(batches: DataFrame, admit: Admission) -> DataFrame:
    return admission.admit_by_tenant(batches, admit.tenants, admit.api_keys, F.col("received_unix_ns").cast("bigint"))


def _store_admission(batches: DataFrame, signal: str, root: str, batch_id: int, admit: Admission) -> None:
    """List the batches that are refused and count those let in; only keys are kept of the batches."""
    readable = otlp.is_readable() if otlp.BAD_LINE in batches.columns else F.lit(True)
    about = batches.select("tenant_id", "key_id", "received_unix_ns", readable.alias("_readable"))
    checked = _checked(about, admit).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        refused = checked.filter(F.col("_readable") & ~F.col("admitted"))
        refused = refused.select("tenant_id", "key_id", "received_unix_ns", F.lit(NO_KEY).alias("reject_reason"))
        refused.write.mode("overwrite").parquet(f"{root}/rejected/{signal}/batch_id={batch_id}")
        reason = F.when(~F.col("_readable"), MALFORMED).when(~F.col("admitted"), NO_KEY)
        _count_outcomes(checked.select("tenant_id", reason.alias("reject_reason")), f"{root}/ingest_quality/batches/{signal}", batch_id)
    finally:
        checked.unpersist()


def _store_facts(batches: DataFrame, signal: str, root: str, batch_id: int, admit: Admission | None) -> None:
    table, flatten, fed = FLATTEN[signal]
    reason = None
    if admit is not None and signal == "metrics":
        facts = ingest.flatten_metrics(batches, arrival=True).persist(StorageLevel.MEMORY_AND_DISK)
        names = f"{root}/metric_names"
        flagged = cardinality.guard_stored(facts, names, batch_id, admit.metric_cap, admit.metric_window_s).drop("arrival_unix_ns")
        reason = F.when(~F.col("admitted"), TOO_MANY_NAMES)
    elif admit is not None and signal == "spans" and (admit.span_kinds or admit.source_prefixes):
        inside = admission.in_capture_scope(list(admit.span_kinds), list(admit.source_prefixes))
        facts = ingest.flatten_spans(batches, source=True).withColumn("admitted", inside).drop("source_name")
        facts = flagged = facts.persist(StorageLevel.MEMORY_AND_DISK)
        reason = F.when(~F.col("admitted"), OUT_OF_SCOPE)
    else:
        facts = flagged = flatten(batches).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        stored = flagged if reason is None else flagged.filter("admitted").drop("admitted")
        tables.write_batch(stored, root, table, batch_id)
        writes = [lambda r=r: states.write_states(stored, r, root, batch_id) for r in fed]
        if reason is not None:
            outcomes = flagged.select("tenant_id", reason.alias("reject_reason"))
            writes.append(lambda: _count_outcomes(outcomes, f"{root}/ingest_quality/rows/{table}", batch_id))
        if reason is not None and signal == "metrics":
            names = flagged.filter(~F.col("admitted")).groupBy("tenant_id", "metric_name").agg(F.count(F.lit(1)).alias("points"))
            writes.append(lambda: names.write.mode("overwrite").parquet(f"{root}/rejected/{table}/batch_id={batch_id}"))
        _side_by_side(facts.sparkSession, writes)
    finally:
        facts.unpersist()


def _side_by_side(spark: SparkSession, writes: Sequence[Callable[[], None]]) -> None:
    """Run independent writes at the same time, so that one's commit does not keep executors waiting; the first error is raised."""
    if not writes:
        return
    with ThreadPoolExecutor(len(writes)) as pool:
        for done in [pool.submit(inheritable_thread_target(spark)(w)) for w in writes]:
            done.result()


def _count_outcomes(outcomes: DataFrame, path: str, batch_id: int) -> None:
    """Store the counts of one batch by tenant and reason."""
    admission.ingest_quality_counts(outcomes).write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")


def ingest_stream(
    batches: DataFrame, signal: str, root: str, checkpoint: str, admit: Admission | None = None, **trigger
) -> StreamingQuery:
    """Run the ingest of one signal; ``trigger`` as for ``DataStreamWriter.trigger``."""
    writer = batches.writeStream.foreachBatch(lambda df, batch_id: store_batch(df, signal, root, batch_id, admit))
    writer = writer.option("checkpointLocation", checkpoint).queryName(f"ingest_{signal}")
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def finalized_rollup(facts: DataFrame, rollup: Rollup, watermark: str = WATERMARK) -> DataFrame:
    """Append-mode stream of complete rollup rows, each emitted once its bucket can no longer change."""
    rows = rollups.prepared(rollup, facts).withColumn("_event", unix_ns_to_timestamp(F.col(rollup.time_col)))
    window = F.window("_event", f"{rollup.bucket_width_s} seconds").alias("_window")
    found = rollups.partials(rollup, rows.withWatermark("_event", watermark), [window, "tenant_id", *rollup.keys])
    return found.select(
        "tenant_id",
        F.unix_seconds("_window.start").alias("bucket_s"),
        *rollup.keys,
        *[name for name, _, _ in rollup.measures],
    )
