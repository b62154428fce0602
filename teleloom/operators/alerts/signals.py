"""Rolling-window signals of all alert rules in one job.

Facts are first added up by tenant, service and pane, the shortest time that all windows and the tick grid are
made of. Panes are joined to the rules that watch them; every pane counts for a run ``low..high`` of the tick grid.
Counts are added at the begin of a run and taken off behind it (``functions.sliding``), so that neither long
windows nor a dense grid multiply rows. Latency quantiles are exact: counts by magnitude slice tell for every
tick which slice holds the wanted rank, and only the durations in that slice are ordered.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from teleloom.functions.predicates import finite_or_zero, flag, is_server_error, is_server_span, ratio
from teleloom.functions.sliding import block_aggregates, run_length, running_counts
from teleloom.operators.alerts.rules import (
    LATENCY_SIGNALS,
    LEAST_EVALUATED_WINDOW_S,
    MAX_WINDOW_S,
    METRIC_SIGNALS,
    SIGNALS,
    breached,
    severity_floor,
)

NS = 1_000_000_000
MS = 1_000_000.0
# Slices per factor e of a duration, in which ranks are looked up: about 1.6 % wide.
SLICES_PER_E = 64


@dataclass(frozen=True)
class Ticks:
    """Evaluation instants ``first_s``, ``first_s + step_s``, ... up to ``last_s``."""

    first_s: int
    last_s: int
    step_s: int = 60

    @classmethod
    def at(cls, as_of_s: int) -> Ticks:
        return cls(as_of_s, as_of_s, 60)

    @property
    def count(self) -> int:
        return (self.last_s - self.first_s) // self.step_s + 1

    def low(self, time_ns: Column) -> Column:
        """First step not before the fact; it may be below 0."""
        return F.ceil((time_ns - self.first_s * NS) / (self.step_s * NS))

    def high(self, time_ns: Column, window_s: Column) -> Column:
        """Last step whose window still reaches back to the fact; it may be beyond the last one."""
        return F.floor((time_ns - self.first_s * NS + window_s.cast("bigint") * NS) / (self.step_s * NS))

    def seconds(self, step: Column) -> Column:
        return step * self.step_s + self.first_s

    def cut(self, facts: DataFrame, time_col: str) -> DataFrame:
        """Facts any window can reach; constant bounds that reach the scan."""
        return facts.filter(
            (F.col(time_col) >= (self.first_s - MAX_WINDOW_S) * NS) & (F.col(time_col) <= self.last_s * NS)
        )


def live_rules(rules: DataFrame, *columns: str) -> DataFrame:
    """Enabled rules with a supported signal and the window they are evaluated with, and further columns."""
    window = F.greatest(F.lit(LEAST_EVALUATED_WINDOW_S), F.col("window_seconds"))
    live = rules.filter(F.col("enabled") & F.col("signal_type").isin(SIGNALS)).withColumn("_window_s", window)
    return live.select(
        "rule_id", "tenant_id", "service_filter", "signal_type", "signal_param", "operator", "threshold", "_window_s", *columns
    )


def pane_seconds(rules: DataFrame, ticks: Ticks) -> int:
    """The most seconds that the step and all windows are multiples of; one small job over the rules."""
    windows = live_rules(rules).select("_window_s").distinct().collect()  # no more than the seconds of a day
    return math.gcd(ticks.step_s, *[int(r["_window_s"]) for r in windows])


def _panes(
    facts: DataFrame, time_col: str, ticks: Ticks, pane_s: int, detail: list[str], sums: dict[str, tuple[Column, str]]
) -> DataFrame:
    """Sums by tenant, service, pane (``_at``, in ns) and further columns, for the service and for the whole tenant.

    Windows include both their ends, so the instants at which panes meet are panes of their own; the middle stands
    for the others. ``_watched`` is the service, or empty for the tenant.
    """
    time, width = F.col(time_col), pane_s * NS
    since = F.pmod(time - ticks.first_s * NS, F.lit(width))
    at = time - since + F.when(since == 0, 0).otherwise(width // 2)
    rows = ticks.cut(facts, time_col).withColumn("_at", at)
    merge = {"sum": F.sum, "max": F.max}
    by_pane = rows.groupBy("tenant_id", "service_name", "_at", *detail).agg(*[merge[kind](e).alias(n) for n, (e, kind) in sums.items()])
    both = F.array_distinct(F.array(F.coalesce("service_name", F.lit("")), F.lit("")))
    return by_pane.select("tenant_id", F.explode(both).alias("_watched"), "_at", *detail, *sums)


def _watching(panes: DataFrame, rules: DataFrame, ticks: Ticks) -> DataFrame:
    """Panes joined to the rules that watch them, with the run of steps they count for."""
    rows = panes.join(rules.withColumnRenamed("service_filter", "_watched"), ["tenant_id", "_watched"])
    rows = rows.withColumn("_low", ticks.low(F.col("_at"))).withColumn("_high", ticks.high(F.col("_at"), F.col("_window_s")))
    return rows.filter((F.col("_low") <= F.col("_high")) & (F.col("_high") >= 0) & (F.col("_low") < ticks.count))


def _observed(df: DataFrame, ticks: Ticks, value: Column) -> DataFrame:
    return df.select("rule_id", ticks.seconds(F.col("_step")).alias("tick_s"), finite_or_zero(value).alias("observed"))


def _slice(duration: Column) -> Column:
    """A whole number that does not fall as the duration grows."""
    return F.floor(F.signum(duration.cast("double")) * F.log1p(F.abs(duration).cast("double")) * SLICES_PER_E).cast("bigint")


def _wanted_rank(total: Column) -> Column:
    """Position of the rule's quantile among so many values."""
    at = F.lit(None).cast("double")
    for name, q in LATENCY_SIGNALS.items():
        at = F.when(F.col("signal_type") == name, F.lit(q) * (total - 1)).otherwise(at)
    return at


def _is_latency() -> Column:
    return F.col("signal_type").isin(list(LATENCY_SIGNALS))


def _server_spans(spans: DataFrame) -> DataFrame:
    return spans.filter(is_server_span())


def _count_cells(rules: DataFrame, spans: DataFrame | None, logs: DataFrame | None, ticks: Ticks, pane_s: int) -> DataFrame:
    """(rule_id, signal_type, _len, _slice, _step, n, errors): counts of spans and records for each rule and tick.

    Rules on latency have a row for each magnitude slice, others one row.
    """
    rows = None
    if spans is not None:
        facts = _server_spans(spans).select(
            "tenant_id", "service_name", "start_time_unix_ns", _slice(F.col("duration_ns")).alias("_slice"), flag(is_server_error()).alias("_error")
        )
        sums = {"n": (F.lit(1).cast("bigint"), "sum"), "errors": (F.col("_error"), "sum")}
        panes = _panes(facts, "start_time_unix_ns", ticks, pane_s, ["_slice"], sums)
        rules_on = rules.filter(F.col("signal_type").isin([*LATENCY_SIGNALS, "error_rate", "request_volume"]))
        found = _watching(panes, rules_on, ticks).withColumn("_slice", F.when(_is_latency(), F.col("_slice")).otherwise(F.lit(0)))
        rows = found.select("rule_id", "signal_type", "_window_s", "_low", "_high", "_slice", "n", "errors")
    if logs is not None:
        facts = logs.select("tenant_id", "service_name", "time_unix_ns", "severity_number")
        panes = _panes(facts, "time_unix_ns", ticks, pane_s, ["severity_number"], {"n": (F.lit(1).cast("bigint"), "sum")})
        rules_on = rules.filter(F.col("signal_type") == "log_count").withColumn("_floor", severity_floor(F.col("signal_param")))
        found = _watching(panes, rules_on, ticks).filter(F.col("severity_number") >= F.col("_floor"))
        zero = F.lit(0).cast("bigint")
        found = found.select("rule_id", "signal_type", "_window_s", "_low", "_high", zero.alias("_slice"), "n", zero.alias("errors"))
        rows = found if rows is None else rows.unionByName(found)
    length = (F.floor(F.col("_window_s") / ticks.step_s) + 1).alias("_len")
    keys = ["rule_id", "signal_type", "_len", "_slice"]
    runs = rows.groupBy("rule_id", "signal_type", length, "_low", "_high", "_slice").agg(F.sum("n").alias("n"), F.sum("errors").alias("errors"))
    return running_counts(runs, keys, ["n", "errors"], ticks.count)


def _durations(rules: DataFrame, spans: DataFrame, ticks: Ticks, pane_s: int) -> DataFrame:
    """Durations watched by latency rules, by slice, run and chunk of as many steps as the longest run has."""
    facts = _server_spans(spans).select("tenant_id", "service_name", "start_time_unix_ns", "duration_ns")
    panes = _panes(facts, "start_time_unix_ns", ticks, pane_s, ["duration_ns"], {"_times": (F.lit(1).cast("bigint"), "sum")})
    rows = _watching(panes, rules.filter(_is_latency()), ticks)
    length = F.floor(F.col("_window_s") / ticks.step_s) + 1
    rows = rows.select("rule_id", _slice(F.col("duration_ns")).alias("_slice"), "duration_ns", "_times", "_low", "_high", length.alias("_len"))
    # A run is no longer than a chunk, so it meets two at most.
    chunks = F.array_distinct(F.array(F.floor(F.col("_low") / F.col("_len")), F.floor(F.col("_high") / F.col("_len"))))
    return rows.withColumn("_chunk", F.explode(chunks)).drop("_len")


def _from_counts(
    rules: DataFrame, spans: DataFrame | None, logs: DataFrame | None, ticks: Ticks, pane_s: int, latency: bool
) -> DataFrame:
    """Observed values of the rules on spans and records.

    All of them pass the same steps; a rule that only counts has one slice, which holds its value.
    """
    cells = _count_cells(rules, spans, logs, ticks, pane_s)
    counted = F.when(F.col("signal_type") == "error_rate", ratio(F.col("errors"), F.col("n"))).otherwise(F.col("n").cast("double"))
    if not latency:
        return _observed(cells, ticks, counted)
    at_tick = Window.partitionBy("rule_id", "_step")
    up_to = at_tick.orderBy("_slice").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cells = cells.withColumn("_total", F.sum("n").over(at_tick)).withColumn("_before", F.sum("n").over(up_to) - F.col("n"))
    cells = cells.withColumn("_rank", _wanted_rank(F.col("_total")))
    holds = lambda rank, start, n: (rank >= start) & (rank < start + n)
    low, high = F.floor("_rank"), F.ceil("_rank")
    hit = F.col("_rank").isNull() | holds(low, F.col("_before"), F.col("n")) | holds(high, F.col("_before"), F.col("n"))
    chosen = cells.filter(hit).select("rule_id", "_slice", "_step", "_before", "_rank", F.floor(F.col("_step") / F.col("_len")).alias("_chunk"), counted.alias("_counted"))
    facts = _durations(rules, spans, ticks, pane_s).withColumnsRenamed({"rule_id": "_rule", "_slice": "_own_slice", "_chunk": "_own_chunk"})
    same = (F.col("rule_id") == F.col("_rule")) & (F.col("_slice") == F.col("_own_slice")) & (F.col("_chunk") == F.col("_own_chunk"))
    inside = F.col("_rank").isNotNull() & (F.col("_low") <= F.col("_step")) & (F.col("_step") <= F.col("_high"))
    met = chosen.join(facts, same & inside, "left")
    met = met.groupBy("rule_id", "_step", "_slice", "_before", "_rank", "_counted", "duration_ns").agg(F.sum("_times").alias("_times"))
    in_slice = Window.partitionBy("rule_id", "_step", "_slice").orderBy("duration_ns")
    start = F.col("_before") + F.sum("_times").over(in_slice.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("_times")
    met = met.withColumn("_start", start)
    pick = lambda rank: F.max(F.when(holds(rank, F.col("_start"), F.col("_times")), F.col("duration_ns"))).cast("double")
    found = met.groupBy("rule_id", "_step").agg(F.max("_rank").alias("_rank"), F.max("_counted").alias("_counted"), pick(low).alias("_lo"), pick(high).alias("_hi"))
    between = (F.col("_lo") + (F.col("_hi") - F.col("_lo")) * (F.col("_rank") - low)) / MS
    return _observed(found, ticks, F.when(F.col("_rank").isNull(), F.col("_counted")).otherwise(between))


def _of(rules: DataFrame, signals: list[str]) -> DataFrame:
    return live_rules(rules).filter(F.col("signal_type").isin(signals))


def signal_latency(rules: DataFrame, spans: DataFrame, ticks: Ticks, pane_s: int = 1) -> DataFrame:
    """p50/p90/p99 of server spans in ms. ``pane_s`` must divide the step and all windows."""
    return _from_counts(_of(rules, list(LATENCY_SIGNALS)), spans, None, ticks, pane_s, latency=True)


def signal_error_rate(rules: DataFrame, spans: DataFrame, ticks: Ticks, pane_s: int = 1) -> DataFrame:
    """Share of failed server spans."""
    return _from_counts(_of(rules, ["error_rate"]), spans, None, ticks, pane_s, latency=False)


def signal_request_volume(rules: DataFrame, spans: DataFrame, ticks: Ticks, pane_s: int = 1) -> DataFrame:
    """Number of server spans."""
    return _from_counts(_of(rules, ["request_volume"]), spans, None, ticks, pane_s, latency=False)


def signal_log_count(rules: DataFrame, logs: DataFrame, ticks: Ticks, pane_s: int = 1) -> DataFrame:
    """Log records at or above the rule's severity floor."""
    return _from_counts(_of(rules, ["log_count"]), None, logs, ticks, pane_s, latency=False)


def signal_metric(rules: DataFrame, points: DataFrame, ticks: Ticks, pane_s: int = 1) -> DataFrame:
    """Average or largest value of the rule's metric.

    Points are added up by pane and slid over the ticks block by block, which only ever adds: no rounding errors
    stay behind from points that have left the window.
    """
    wanted = _of(rules, METRIC_SIGNALS)
    value = F.coalesce("value_double", F.col("value_int").cast("double"), "histogram_sum")
    facts = points.select("tenant_id", "service_name", "time_unix_ns", "metric_name", value.alias("_value"))
    sums = {
        "total": (F.col("_value"), "sum"),
        "n": (F.when(F.col("_value").isNotNull(), 1).otherwise(0).cast("bigint"), "sum"),
        "top": (F.col("_value"), "max"),
        "points": (F.lit(1).cast("bigint"), "sum"),
    }
    # Only points of a metric that some rule watches.
    watched = wanted.select("tenant_id", F.col("signal_param").alias("metric_name")).distinct()
    facts = facts.join(watched, ["tenant_id", "metric_name"], "left_semi")
    panes = _panes(facts, "time_unix_ns", ticks, pane_s, ["metric_name"], sums)
    rows = _watching(panes, wanted, ticks).filter(F.col("metric_name") == F.col("signal_param"))
    rows = rows.withColumn("_len", run_length(F.col("_low"), F.col("_high")))
    # A fact at the very instant where a pane begins counts for one step more.
    shorter = F.floor(F.col("_window_s") / ticks.step_s)
    lengths = F.filter(F.array(shorter, shorter + 1), lambda n: n > 0)
    grid = wanted.select("rule_id", "signal_type", F.explode(lengths).alias("_len"))
    merge = {"total": "sum", "n": "sum", "top": "max", "points": "sum"}
    rolled = block_aggregates(rows, grid, ["rule_id", "signal_type"], merge, ticks.count).filter(F.col("points") > 0)
    mean = F.when(F.col("n") > 0, F.col("total") / F.col("n"))
    return _observed(rolled, ticks, F.when(F.col("signal_type") == "metric_avg", mean).otherwise(F.col("top")))


def evaluate_rules(
    rules: DataFrame, spans: DataFrame, logs: DataFrame, points: DataFrame, ticks: Ticks, pane_s: int | None = None
) -> DataFrame:
    """Observed value and breach of every live rule at every tick; 0 where nothing was observed.

    Spans are read twice, records and points once. Without ``pane_s`` the longest possible panes are looked up in
    the rules.
    """
    pane_s = pane_seconds(rules, ticks) if pane_s is None else pane_s
    counted = [*LATENCY_SIGNALS, "error_rate", "request_volume", "log_count"]
    seen = _from_counts(_of(rules, counted), spans, logs, ticks, pane_s, latency=True).unionByName(signal_metric(rules, points, ticks, pane_s))
    steps = F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(ticks.count - 1).cast("bigint")))
    grid = live_rules(rules).withColumn("_step", steps).withColumn("tick_s", ticks.seconds(F.col("_step")))
    observed = F.coalesce("observed", F.lit(0.0))
    return grid.join(seen, ["rule_id", "tick_s"], "left").select(
        "rule_id",
        "tenant_id",
        "tick_s",
        observed.alias("observed"),
        breached(F.col("operator"), observed, F.col("threshold")).alias("breached"),
    )
