"""Rule evaluation over streams of facts: an observation for every rule and tick, with or without facts.

Facts are added up by tenant, service and pane in Spark's windowed aggregation; a pane is handed on once the watermark
has passed it. The closed panes that a rule watches are kept in the rule's state, and an event-time timer evaluates
the rule at every tick. The rules themselves are the initial state, so that a rule without facts ticks too and
gives 0; later changes of rules come as a stream of their own.

The observations feed ``alert_state.alert_state_stream``.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from teleloom.functions.predicates import flag, is_server_error, is_server_span
from teleloom.functions.timing import unix_ns_to_timestamp
from teleloom.operators.alerts.rules import LATENCY_SIGNALS, METRIC_SIGNALS, SIGNALS, breached, severity_floor
from teleloom.operators.alerts.signals import live_rules
from teleloom.operators.rollups import SLICES_PER_E, latency_slice

NS = 1_000_000_000
MS = 1_000_000.0
PANE_S = 60
WATERMARK = "5 minutes"
OUTPUT = "rule_id long, tick_s long, observed double, operator string, threshold double"
SUMS = ["n", "errors", "counted"]
COLUMNS = ["pane_s", "instant", "slice", *SUMS, "total", "top"]
ABOUT = ["rule_id", "signal_type", "operator", "threshold", "window_s"]
STATE = (
    "signal string, operator string, threshold double, window_s long, next_s long, pane_s array<long>, instant array<boolean>, "
    "slice array<long>, n array<long>, errors array<long>, counted array<long>, total array<double>, top array<double>"
)
KINDS = {"spans": [*LATENCY_SIGNALS, "error_rate", "request_volume"], "logs": ["log_count"], "points": METRIC_SIGNALS}


def _live(rules: DataFrame, *columns: str) -> DataFrame:
    """Rules that are evaluated; the state's functions see no names that begin with an underscore."""
    live = live_rules(rules, *columns).withColumn("rule_id", F.col("rule_id").cast("long"))
    return live.withColumn("window_s", F.col("_window_s").cast("long")).drop("_window_s")


def _closed_panes(
    kind: str, facts: DataFrame, time_col: str, pane_s: int, watermark: str, detail: Column | None, metric: Column | None, **sums: Column
) -> DataFrame:
    """Sums of closed panes by tenant, service, detail (slice or severity) and metric, in one shape for all signals.

    Windows include both their ends, so that a fact at a tick counts for that tick and for the one a window later:
    facts at the very begin of a pane stay apart.
    """
    time = F.col(time_col)
    rows = facts.withColumn("_event", unix_ns_to_timestamp(time)).withWatermark("_event", watermark)
    named = {"instant": F.pmod(time, F.lit(pane_s * NS)) == 0, "detail": F.lit(0) if detail is None else detail, "metric": F.lit("") if metric is None else metric}
    rows = rows.withColumns(named).withColumn("detail", F.col("detail").cast("long"))
    pane = F.window("_event", f"{pane_s} seconds").alias("_window")
    whole = {**{s: F.lit(0).cast("long") for s in SUMS}, "total": F.lit(None).cast("double"), "top": F.lit(None).cast("double")}
    found = rows.groupBy(pane, "tenant_id", "service_name", *named).agg(*[e.alias(f"_{n}") for n, e in sums.items()])
    return found.select(
        F.window_time("_window").alias("_event"),
        F.unix_seconds("_window.start").alias("pane_s"),
        F.lit(kind).alias("_kind"),
        "tenant_id",
        "service_name",
        *named,
        *[(F.col(f"_{n}") if n in sums else empty).alias(n) for n, empty in whole.items()],
    )


def _watching(panes: DataFrame, rules: DataFrame) -> DataFrame:
    """Closed panes once for every rule that watches their service or the whole tenant."""
    kind = F.lit(None).cast("string")
    for name, signals in KINDS.items():
        kind = F.when(F.col("signal_type").isin(signals), name).otherwise(kind)
    about = rules.withColumn("_kind", kind).withColumn("_floor", severity_floor(F.col("signal_param"))).withColumnRenamed("service_filter", "_watched")
    both = F.array_distinct(F.array(F.coalesce("service_name", F.lit("")), F.lit("")))
    rows = panes.withColumn("_watched", F.explode(both)).join(about, ["tenant_id", "_watched", "_kind"])
    heeded = F.when(F.col("_kind") == "logs", F.col("detail") >= F.col("_floor")).when(F.col("_kind") == "points", F.col("metric") == F.col("signal_param"))
    rows = rows.filter(F.coalesce(heeded, F.lit(True)))
    slice_ = F.when(F.col("signal_type").isin(list(LATENCY_SIGNALS)), F.col("detail")).otherwise(F.lit(0).cast("long"))
    return rows.select(*ABOUT, F.lit(True).alias("live"), "_event", "pane_s", "instant", slice_.alias("slice"), *SUMS, "total", "top")


class RuleWindows(StatefulProcessor):
    """Keeps the panes of a rule's window; gives its observed value at every tick that the watermark has passed.

    A state holds a row for each pane of the window that had facts, for latencies one for each slice of it.
    """

    def __init__(self, pane_s: int, step_s: int, first_s: int | None, told: bool) -> None:
        self.pane_s, self.step_s, self.first_s = pane_s, step_s, first_s
        # Whether changes of rules come as rows of their own; else the rules joined to the facts say what holds.
        self.told = told

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.kept = handle.getValueState("rule", STATE)

    def _due_ms(self, tick: int) -> int:
        """When the pane that begins with the tick, and so holds the facts at that instant, is closed."""
        return (tick + self.pane_s) * 1000

    def _wait(self, tick: int | None) -> None:
        self.handle.registerTimer(1 if tick is None else self._due_ms(tick))

    def handleInitialState(self, key, rows: pd.DataFrame, timerValues) -> None:
        self._keep(*_about(rows.iloc[-1]), self.first_s, pd.DataFrame(columns=COLUMNS))
        self._wait(self.first_s)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(rows))
        panes, changes = new[new["n"] > 0], new[new["n"] == 0]
        if len(changes) and not changes.iloc[-1]["live"]:
            self.kept.clear()
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
        elif self.kept.exists() or len(changes) or not self.told:
            stored = self.kept.get() if self.kept.exists() else None
            tick, had = (self.first_s, pd.DataFrame(columns=COLUMNS)) if stored is None else (stored[4], _frame(stored[5:]))
            if stored is None:
                self._wait(tick)
            about = _about(changes.iloc[-1]) if len(changes) else stored[:4] if self.told else _about(new.iloc[-1])
            both = pd.concat([had, panes[COLUMNS]]) if len(had) else panes[COLUMNS]
            sums = {**{s: "sum" for s in SUMS}, "total": lambda x: x.sum(min_count=1), "top": "max"}
            self._keep(*about, tick, both.groupby(["pane_s", "instant", "slice"], as_index=False).agg(sums) if len(both) else both)
        yield _out([])

    def _keep(self, signal: str, operator: str, threshold: float, window_s: int, tick: int | None, panes: pd.DataFrame) -> None:
        kinds = dict(zip(COLUMNS, [int, bool, int, int, int, int, float, float], strict=True))
        lists = [[None if pd.isna(x) else kind(x) for x in panes[c]] for c, kind in kinds.items()]
        self.kept.update((signal, operator, threshold, window_s, tick, *lists))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        out = []
        if self.kept.exists():
            signal, operator, threshold, window_s, tick, *lists = self.kept.get()
            panes, passed = _frame(lists), timerValues.getCurrentWatermarkInMs()
            if tick is None:  # the last one that is due
                tick = (passed // 1000 - self.pane_s) // self.step_s * self.step_s
            while self._due_ms(tick) <= passed:
                start = panes["pane_s"]
                inside = (start >= tick - window_s) & ((start < tick) | ((start == tick) & panes["instant"].astype(bool)))
                out.append((key[0], tick, observed(signal, panes[inside]), operator, threshold))
                tick += self.step_s
            self._keep(signal, operator, threshold, window_s, tick, panes[panes["pane_s"] >= tick - window_s])
            self._wait(tick)
        yield _out(out)

    def close(self) -> None:
        pass


def _about(row) -> tuple[str, str, float, int]:
    return row["signal_type"], row["operator"], float(row["threshold"]), int(row["window_s"])


def _frame(lists) -> pd.DataFrame:
    return pd.DataFrame({c: list(values) for c, values in zip(COLUMNS, lists, strict=True)})


def _out(rows: list) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=[f.split(" ")[0] for f in OUTPUT.split(", ")])


def observed(signal: str, panes: pd.DataFrame) -> float:
    """A signal's value over some panes; 0 without facts. Quantiles are nearest ranks, given by the middle of their slice."""
    n = int(panes["n"].sum())
    if n == 0:
        return 0.0
    if signal == "error_rate":
        return float(panes["errors"].sum() / n)
    if signal in METRIC_SIGNALS:
        counted = int(panes["counted"].sum())
        if counted == 0:
            return 0.0
        return float(panes["total"].sum() / counted if signal == "metric_avg" else panes["top"].max())
    if signal in LATENCY_SIGNALS:
        by_slice = panes.groupby("slice")["n"].sum().sort_index()
        wanted = max(1, int(np.ceil(n * LATENCY_SIGNALS[signal])))
        middle = (by_slice.index[int(np.searchsorted(by_slice.cumsum().to_numpy(), wanted))] + 0.5) / SLICES_PER_E
        return float(np.sign(middle) * np.floor(np.exp(abs(middle)) - 0.5) / MS)
    return float(n)


def evaluate_rules_stream(
    rules: DataFrame,
    spans: DataFrame | None = None,
    logs: DataFrame | None = None,
    points: DataFrame | None = None,
    changes: DataFrame | None = None,
    first_s: int | None = None,
    step_s: int = 60,
    pane_s: int = PANE_S,
    watermark: str = WATERMARK,
) -> DataFrame:
    """(rule_id, tick_s, observed, breached) of every live rule at every tick, in append mode.

    Ticks are ``first_s`` and every ``step_s`` after it; without it they are multiples of ``step_s`` from the first
    watermark on. ``pane_s`` must divide ``first_s``, ``step_s`` and the windows of all rules
    (``signals.pane_seconds``). A tick is evaluated once the watermark has passed it by a pane; facts later than the
    watermark are left out, as everywhere in a stream. Of several signals the slowest stream leads.

    ``rules`` is a table that Spark reads with every micro-batch; the rules live when the stream is first started tick
    from the begin. Without ``changes`` a later rule ticks from its first facts on, and one that is gone goes on
    with 0. ``changes`` is a stream of the rule rows that changed: a new rule starts when it comes there, a changed one
    goes on as it says, and a disabled one stops. Counts, rates, means and maxima equal those of ``signals.evaluate_rules``; latencies are nearest ranks,
    at most 0.4 % off.

    Needs the RocksDB state store (``teleloom.session.STREAMING_CONF``).
    """
    live = _live(rules)
    one, panes = F.count(F.lit(1)), []
    if spans is not None:
        sums = {"n": one, "errors": F.sum(flag(is_server_error()))}
        panes.append(_closed_panes("spans", spans.filter(is_server_span()), "start_time_unix_ns", pane_s, watermark, latency_slice(F.col("duration_ns")), None, **sums))
    if logs is not None:
        panes.append(_closed_panes("logs", logs, "time_unix_ns", pane_s, watermark, F.col("severity_number"), None, n=one))
    if points is not None:
        value = F.coalesce("value_double", F.col("value_int").cast("double"), "histogram_sum")
        sums = {"n": one, "counted": F.count(value), "total": F.sum(value), "top": F.max(value)}
        panes.append(_closed_panes("points", points, "time_unix_ns", pane_s, watermark, None, F.col("metric_name"), **sums))
    rows = _watching(reduce(DataFrame.unionByName, panes), live)
    if changes is not None:
        known = changes.filter(F.col("signal_type").isin(SIGNALS)).withColumn("_live", F.col("enabled"))
        window = _live(known.withColumn("enabled", F.lit(True)), "_live")
        zero, none = F.lit(0).cast("long"), F.lit(None).cast("double")
        # Never late.
        stamp = F.lit("2262-01-01 00:00:00").cast("timestamp")
        rows = rows.unionByName(
            window.select(
                *ABOUT, F.col("_live").alias("live"), stamp.alias("_event"), zero.alias("pane_s"),
                F.lit(False).alias("instant"), zero.alias("slice"), *[zero.alias(s) for s in SUMS], none.alias("total"), none.alias("top"),
            )
        )
    found = rows.groupBy("rule_id").transformWithStateInPandas(
        statefulProcessor=RuleWindows(pane_s, step_s, first_s, changes is not None),
        outputStructType=OUTPUT,
        outputMode="Append",
        timeMode="EventTime",
        initialState=live.select(*ABOUT).groupBy("rule_id"),
    )
    return found.select("rule_id", "tick_s", "observed", breached(F.col("operator"), F.col("observed"), F.col("threshold")).alias("breached"))
