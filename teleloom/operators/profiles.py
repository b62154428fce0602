"""Stack folding and profile reads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from teleloom.functions.predicates import bounded
from teleloom.functions.ranking import top_n
from teleloom.scope import Scope

START = "start_time_unix_ns"


def _named_frames(stack: str) -> Column:
    """Frames with a name, leaf first."""
    return F.filter(stack, lambda frame: frame.isNotNull() & (frame != ""))


def fold_stacks(samples: DataFrame, keys: list[str] | None = None, stack: str = "stack") -> DataFrame:
    """One row per distinct stack with its sample count and the group's total.

    ``keys`` is the group: all captures of a tenant (default) or one capture.
    """
    keys = ["tenant_id"] if keys is None else keys
    folded = (
        samples.withColumn("stack", _named_frames(stack))
        .filter(F.size("stack") > 0)
        .groupBy(*keys, "stack")
        .agg(F.count(F.lit(1)).alias("sample_count"))
    )
    totals = folded.groupBy(*keys).agg(F.sum("sample_count").alias("total_samples"))
    return folded.join(totals, keys)


def frame_dimension(samples: DataFrame, stack: str = "stack") -> DataFrame:
    """Distinct function names with dense ids from 1; id 0 is the empty name.

    Ids follow (digest prefix, name). The prefix splits the names into 4096 even groups numbered in
    parallel; only the group sizes are added up in one place.
    """
    names = (
        samples.select(F.explode(_named_frames(stack)).alias("name"))
        .distinct()
        .withColumn("part", F.substring(F.md5(F.col("name").cast("binary")), 1, 3))
    )
    sizes = names.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    before = sizes.select(
        "part",
        (F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).alias("offset"),
    )
    numbered = names.withColumn("pos", F.row_number().over(Window.partitionBy("part").orderBy("name")))
    ids = numbered.join(F.broadcast(before), "part").select((F.col("offset") + F.col("pos")).alias("frame_id"), "name")
    empty = samples.sparkSession.range(1).select(F.lit(0).cast("bigint").alias("frame_id"), F.lit("").alias("name"))
    return empty.unionByName(ids)


def profile_top_frames(samples: DataFrame, stack: str = "stack") -> DataFrame:
    """Samples in which a function is the leaf (self) or anywhere on the stack (total)."""
    folded = fold_stacks(samples, stack=stack)
    frames = folded.select(
        "tenant_id",
        "sample_count",
        F.element_at("stack", 1).alias("leaf"),
        F.explode(F.array_distinct("stack")).alias("name"),
    )
    return frames.groupBy("tenant_id", "name").agg(
        F.sum(F.when(F.col("name") == F.col("leaf"), F.col("sample_count")).otherwise(0)).alias("self_samples"),
        F.sum("sample_count").alias("total_samples"),
    )


def list_profiles(
    profiles: DataFrame,
    tenant_id: object | None = None,
    from_ms: int | None = None,
    to_ms: int | None = None,
    service: str = "",
    kind: str = "",
    limit: int | None = 100,
) -> DataFrame:
    """Newest captures; the size is that of the stored Base64 text."""
    scope = Scope(
        tenant_id,
        from_ms * 1_000_000 if from_ms else None,
        to_ms * 1_000_000 + 999_999 if to_ms else None,
    )
    df = scope.apply(profiles, START)
    if service:
        df = df.filter(F.col("service_name") == service)
    if kind:
        df = df.filter(F.col("profile_kind") == kind)
    shown = df.select(
        "tenant_id",
        START,
        "service_name",
        "profile_kind",
        (F.col("duration_nanos") / 1e9).alias("duration_s"),
        "sample_count",
        F.length("pprof_base64").cast("bigint").alias("stored_bytes"),
        "trigger_trace_id",
        "agent_version",
    )
    order = [F.col(START).desc(), F.col("service_name"), F.col("profile_kind")]
    return top_n(shown, scope, order, bounded(limit, 100))


def decoded(profiles: DataFrame) -> DataFrame:
    """Adds the payload bytes; text that is not Base64 gives an empty payload."""
    return profiles.withColumn(
        "pprof", F.coalesce(F.try_to_binary("pprof_base64", F.lit("base64")), F.lit("").cast("binary"))
    )


def get_profile(profiles: DataFrame, tenant_id: object, service: str, kind: str, start_ns: int) -> DataFrame:
    """One capture with its payload."""
    wanted = (
        (F.col("tenant_id") == tenant_id)
        & (F.col("service_name") == service)
        & (F.col("profile_kind") == kind)
        & (F.col(START) == start_ns)
    )
    return decoded(profiles.filter(wanted).limit(1))
