"""Trace summaries as traces finish: the summary of every trace is kept in state and closed by an event-time timer.

Spans are folded into a summary of fixed size (and the set of service names), so that a trace with very many spans takes
no more state than a small one. A trace is closed once the newest span end seen lies ``idle_s`` behind its own end. A
span that comes later, by up to ``late_s``, opens it again: the trace is closed anew with the next ``revision``, and the
highest revision of a trace is its summary (``latest``). Its state is removed once no span of it can come any more.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from teleloom.functions.predicates import flag, is_server_span
from teleloom.functions.timing import unix_ns_to_timestamp
from teleloom.operators.traces import END, START, TRACE_KEYS

IDLE_S = 60
LATE_S = 3600
MS_NS = 1_000_000

SPAN = [START, END, "span_id", "service_name", "duration_ns", "is_db", "is_http", "is_server", "is_root"]
#: Counts, extent, the first root and server spans with their starts, the slowest span, services, and the revision handed on last.
STATE = (
    "span_count long, start_ns long, end_ns long, db_spans long, http_client_spans long, root_at long, root_id string, "
    "server_at long, server_id string, slowest_ns long, slowest_at long, slowest_id string, services array<string>, revision long, told long"
)
OUTPUT = (
    "tenant_id int, trace_id string, span_count long, start_ns long, end_ns long, total_ns long, services array<string>, db_spans long, "
    "http_client_spans long, root_span_id string, slowest_span_id string, slowest_duration_ns long, revision long"
)
FIELDS = [part.strip().split(" ")[0] for part in STATE.split(", ")]
NAMES = [part.strip().split(" ")[0] for part in OUTPUT.split(", ")]


def _first(rows: pd.DataFrame, had: tuple) -> tuple:
    """The earliest of some spans and the one known so far; the smaller id of equal starts."""
    if rows.empty:
        return had
    row = rows.sort_values([START, "span_id"]).iloc[0]
    new = (int(row[START]), row["span_id"])
    return new if had[0] is None else min(had, new)


def _slowest(rows: pd.DataFrame, had: tuple | None) -> tuple:
    row = rows.sort_values(["duration_ns", START, "span_id"], ascending=[False, True, False]).iloc[0]
    new = (int(row["duration_ns"]), int(row[START]), row["span_id"])
    return new if had is None else max(had, new, key=lambda x: (x[0], -x[1], x[2]))


def folded(kept: dict | None, rows: pd.DataFrame) -> dict:
    """A trace's summary with some more spans."""
    had = kept or dict.fromkeys(FIELDS[5:12]) | {"span_count": 0, "db_spans": 0, "http_client_spans": 0, "services": [], "revision": 0, "told": 0}
    root = _first(rows[rows["is_root"]], (had["root_at"], had["root_id"]))
    server = _first(rows[rows["is_server"]], (had["server_at"], had["server_id"]))
    slowest = _slowest(rows, (had["slowest_ns"], had["slowest_at"], had["slowest_id"]) if kept else None)
    start, end = int(rows[START].min()), int(rows[END].max())
    return {
        "span_count": had["span_count"] + len(rows),
        "start_ns": min(start, had["start_ns"]) if kept else start,
        "end_ns": max(end, had["end_ns"]) if kept else end,
        "db_spans": had["db_spans"] + int(rows["is_db"].sum()),
        "http_client_spans": had["http_client_spans"] + int(rows["is_http"].sum()),
        **dict(zip(FIELDS[5:12], (*root, *server, *slowest), strict=True)),
        "services": sorted({*had["services"], *rows.loc[rows["service_name"].fillna("") != "", "service_name"]}),
        "revision": had["revision"],
        "told": had["told"],
    }


class OpenTrace(StatefulProcessor):
    """One trace: folds its spans, and hands on its summary when it falls silent."""

    def __init__(self, idle_s: int, late_s: int) -> None:
        self.idle_ms, self.late_ms = idle_s * 1000, late_s * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.trace = handle.getValueState("trace", STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        kept = dict(zip(FIELDS, self.trace.get(), strict=True)) if self.trace.exists() else None
        for batch in rows:
            kept = folded(kept, batch)
        self._keep(kept)
        # The watermark is ``late_s`` behind the newest end.
        self._wake(kept["end_ns"] // MS_NS + self.idle_ms - self.late_ms)
        yield pd.DataFrame(columns=NAMES)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        out = []
        if self.trace.exists():
            kept = dict(zip(FIELDS, self.trace.get(), strict=True))
            if kept["told"] < kept["span_count"]:
                kept |= {"revision": kept["revision"] + 1, "told": kept["span_count"]}
                out.append(_row(key, kept))
            # Spans that end before the watermark are left out: none of this trace is left to come but by a longer end.
            if kept["end_ns"] // MS_NS < timerValues.getCurrentWatermarkInMs():
                self.trace.clear()
            else:
                self._keep(kept)
                self._wake(kept["end_ns"] // MS_NS + 1)
        yield pd.DataFrame(out, columns=NAMES)

    def _keep(self, kept: dict) -> None:
        self.trace.update(tuple(kept[f] for f in FIELDS))

    def _wake(self, at_ms: int) -> None:
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(max(at_ms, 1))

    def close(self) -> None:
        pass


def _row(key, kept: dict) -> tuple:
    root = kept["root_id"] if kept["root_at"] is not None else kept["server_id"]
    whole = max(1, kept["end_ns"] - kept["start_ns"])
    about = [kept[f] for f in ("span_count", "start_ns", "end_ns")]
    counts = [list(kept["services"]), kept["db_spans"], kept["http_client_spans"]]
    return (*key, *about, whole, *counts, root, kept["slowest_id"], kept["slowest_ns"], kept["revision"])


def _is(condition: Column) -> Column:
    return flag(condition) == 1


def trace_summary_stream(spans: DataFrame, idle_s: int = IDLE_S, late_s: int = LATE_S) -> DataFrame:
    """``traces.trace_summary`` of a stream, with the ``revision`` of each row, in append mode.

    Event time is the end of a span. Spans that end more than ``late_s`` before the newest end seen so far may be left
    out; if one of a removed trace ends after that, the trace starts again at revision 1. ``late_s`` must not be
    smaller than ``idle_s``. Spans without a tenant or trace id belong to the trace of that null key, as in the batch.

    Needs the RocksDB state store (``teleloom.session.STREAMING_CONF``).
    """
    if late_s < idle_s:
        raise ValueError("late_s must be at least idle_s")
    no_db = F.col("db_system") == ""
    rows = spans.select(
        F.col("tenant_id").cast("int").alias("tenant_id"),
        "trace_id",
        *[F.col(c) for c in SPAN[:5]],
        _is(~no_db).alias("is_db"),
        _is((F.col("span_kind") == "CLIENT") & no_db).alias("is_http"),
        _is(is_server_span()).alias("is_server"),
        _is(is_server_span() & (F.coalesce("parent_span_id", F.lit("")) == "")).alias("is_root"),
        unix_ns_to_timestamp(F.col(END)).alias("ended"),
    )
    return rows.withWatermark("ended", f"{int(late_s)} seconds").groupBy(*TRACE_KEYS).transformWithStateInPandas(
        statefulProcessor=OpenTrace(idle_s, late_s), outputStructType=OUTPUT, outputMode="Append", timeMode="EventTime"
    )


def latest(summaries: DataFrame) -> DataFrame:
    """Of stored rows of the stream the highest revision of each trace."""
    newest = Window.partitionBy(*TRACE_KEYS).orderBy(F.desc("revision"), F.desc("end_ns"))
    return summaries.withColumn("_n", F.row_number().over(newest)).filter("_n = 1").drop("_n")
