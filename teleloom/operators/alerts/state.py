"""The ok / pending / firing state machine over ordered observations, and the firings it opens."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OK, PENDING, FIRING = "ok", "pending", "firing"


def alert_state_machine(observations: DataFrame, rules: DataFrame) -> DataFrame:
    """State changes of every rule over its ticks.

    ``rules`` gives ``for_seconds`` and optionally the state to start from (``last_state``,
    ``last_pending_s``). Consecutive breached ticks form a run. A run starts pending (firing at once
    when nothing has to be waited for), fires at the first tick that has lasted ``for_seconds``, and
    the first clear tick ends it. A rule has one row per tick, so its window stays small.
    """
    columns = {"last_state": F.lit(OK), "last_pending_s": F.lit(None).cast("bigint")}
    start = [
        (F.coalesce(F.col(name), default) if name in rules.columns else default).alias(name)
        for name, default in columns.items()
    ]
    rows = observations.select("rule_id", "tick_s", "observed", "breached").join(
        rules.select("rule_id", "for_seconds", *start), "rule_id"
    )
    ordered = Window.partitionBy("rule_id").orderBy("tick_s")
    so_far = ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    active_at_start = F.col("last_state") != OK

    rows = rows.withColumn("_was", F.coalesce(F.lag("breached").over(ordered), active_at_start))
    opens = F.col("breached") & ~F.col("_was")
    rows = rows.withColumn("_opens", opens).withColumn("_run", F.sum(F.when(opens, 1).otherwise(0)).over(so_far))
    # Run 0 is the one carried over from the stored state.
    carried = (F.col("_run") == 0) & active_at_start
    opened = F.max(F.when(F.col("_opens"), F.col("tick_s"))).over(so_far)
    rows = rows.withColumn("_since", F.when(carried, F.col("last_pending_s")).otherwise(opened))

    waited = (F.col("for_seconds") <= 0) | (F.col("tick_s") - F.col("_since") >= F.col("for_seconds"))
    may_fire = F.col("breached") & waited & F.col("_since").isNotNull() & ~(carried & (F.col("last_state") == FIRING))
    in_run = Window.partitionBy("rule_id", "_run")
    rows = rows.withColumn("_fired_at", F.min(F.when(may_fire, F.col("tick_s"))).over(in_run))

    fires = F.col("breached") & (F.col("tick_s") == F.col("_fired_at"))
    clears = ~F.col("breached") & F.col("_was")
    fired = F.col("_fired_at").isNotNull() | (carried & (F.col("last_state") == FIRING))
    to_state = F.when(fires, FIRING).when(F.col("_opens"), PENDING).when(clears, OK)
    from_state = F.when(F.col("_opens"), OK).when(clears & fired, FIRING).otherwise(PENDING)
    kind = F.when(fires, "firing").when(clears & fired, "resolved").otherwise("")
    return rows.withColumn("to_state", to_state).filter(F.col("to_state").isNotNull()).select(
        "rule_id",
        "tick_s",
        from_state.alias("from_state"),
        "to_state",
        kind.alias("kind"),
        "observed",
        F.when(F.col("to_state") != OK, F.col("_since")).alias("pending_since_s"),
    )


def _payload(resolved: Column | None = None) -> Column:
    fields = [
        F.col("signal_type").alias("signal"),
        F.col("operator"),
        F.col("threshold"),
        F.col("observed"),
        F.col("service_filter").alias("service"),
    ]
    if resolved is not None:
        fields.append(resolved.alias("resolved_value"))
    return F.to_json(F.struct(*fields))


def alert_firings(transitions: DataFrame, rules: DataFrame) -> DataFrame:
    """One row per firing with its resolution, if any, and the facts as JSON."""
    edges = transitions.filter(F.col("kind") != "")
    ordered = Window.partitionBy("rule_id").orderBy("tick_s")
    closing = F.struct(F.col("kind"), F.col("tick_s"), F.col("observed"))
    paired = edges.withColumn("_next", F.lead(closing).over(ordered)).filter(F.col("kind") == "firing")
    resolved = F.when(F.col("_next.kind") == "resolved", F.col("_next"))
    about = rules.select(
        "rule_id", "tenant_id", "rule_name", "signal_type", "operator", "threshold", "service_filter", "severity"
    )
    rows = paired.join(about, "rule_id")
    return rows.select(
        F.concat_ws("@", F.col("rule_id").cast("string"), F.col("tick_s").cast("string")).alias("firing_id"),
        "tenant_id",
        "rule_id",
        F.col("tick_s").alias("fired_s"),
        resolved["tick_s"].alias("resolved_s"),
        F.col("observed").alias("observed"),
        "severity",
        F.when(resolved.isNull(), _payload()).otherwise(_payload(resolved["observed"])).alias("payload_json"),
    )


def rule_state_gc(state: DataFrame, rules: DataFrame) -> DataFrame:
    """Stored rule states without those of rules that are gone or disabled."""
    return state.join(rules.filter("enabled").select("rule_id"), "rule_id", "left_semi")
