"""The alert state machine over a stream of observations, one small state per rule."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

OK, PENDING, FIRING = "ok", "pending", "firing"
OUTPUT = (
    "rule_id long, tick_s long, from_state string, to_state string, kind string, observed double, pending_since_s long"
)


def next_state(state: str, since: int | None, breached: bool, tick: int, wait: int) -> tuple[str, int | None]:
    """State and pending instant after one observation."""
    if not breached:
        return OK, None
    if state == OK:
        return (PENDING if wait > 0 else FIRING), tick
    if state == PENDING and since is not None and tick - since >= wait:
        return FIRING, since
    return state, since


class RuleMachine(StatefulProcessor):
    """Keeps (state, pending instant, last tick) of a rule; emits its state changes.

    A rule that is no longer enabled loses its state. A disabled rule is not evaluated, so mostly it just
    stops being observed: an observation after a longer gap than ``max_gap_s`` finds it at ``ok``. What is left
    in the store is a few numbers for each rule that was pending or firing when it was switched off.
    """

    def __init__(self, max_gap_s: int) -> None:
        self.max_gap_s = max_gap_s

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.kept = handle.getValueState("rule", "state string, since long, last long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        seen = pd.concat(list(rows)).sort_values("tick_s")
        state, since, last = self.kept.get() if self.kept.exists() else (OK, None, None)
        changes = []
        for row in seen.itertuples():
            if last is not None and row.tick_s - last > self.max_gap_s:
                state, since = OK, None
            last = int(row.tick_s)
            if not row.enabled:
                state, since = OK, None
                continue
            new, new_since = next_state(state, since, bool(row.breached), int(row.tick_s), int(row.for_seconds))
            if new != state:
                kind = "firing" if new == FIRING else "resolved" if state == FIRING else ""
                changes.append((key[0], int(row.tick_s), state, new, kind, float(row.observed), new_since))
            state, since = new, new_since
        if state == OK:
            self.kept.clear()
        else:
            self.kept.update((state, since, last))
        columns = [field.split(" ")[0] for field in OUTPUT.split(", ")]
        out = pd.DataFrame(changes, columns=columns)
        out["pending_since_s"] = out["pending_since_s"].astype("Int64")
        yield out

    def close(self) -> None:
        pass


def alert_state_stream(observations: DataFrame, rules: DataFrame, max_gap_s: int) -> DataFrame:
    """State changes from a stream of (rule_id, tick_s, observed, breached).

    A rule without an observation for ``max_gap_s`` was off meanwhile and starts over: it must be longer than the
    time between ticks, and should be a few of them.

    Needs the RocksDB state store (``teleloom.session.STREAMING_CONF``).
    """
    about = rules.select(F.col("rule_id").cast("bigint").alias("rule_id"), "for_seconds", "enabled")
    rows = observations.withColumn("rule_id", F.col("rule_id").cast("bigint")).join(about, "rule_id", "left")
    rows = rows.withColumn("enabled", F.coalesce("enabled", F.lit(False))).na.fill(0, ["for_seconds"])
    return rows.groupBy("rule_id").transformWithStateInPandas(
        statefulProcessor=RuleMachine(max_gap_s), outputStructType=OUTPUT, outputMode="Append", timeMode="None"
    )
