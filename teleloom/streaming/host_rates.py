"""Host rates as samples arrive: the last sample of every key is kept in state.

The rules for the rates are those of ``operators.counters``; only the preceding sample comes from the state instead of a
window over the history. A sample that is not newer than the last one of its key came too late and is left out. A
sample more than ``expiry_ns`` after the last one of its key is a first one again. What a key that fell silent leaves
behind is one sample (for processes: one snapshot of the host).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from teleloom.operators import counters
from teleloom.operators.counters import HOST, TIME

EXPIRY_NS = 10 * 365 * 86_400 * 1_000_000_000


class LastSample(StatefulProcessor):
    """Hands on every sample with the columns of the one before it."""

    def __init__(self, order: str, columns: Sequence[str], state: str, fields: Sequence[str], expiry_ns: int, first_by: str | None):
        self.order, self.columns, self.state, self.fields = order, list(columns), state, list(fields)
        self.expiry_ns, self.first_by = expiry_ns, first_by

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", self.state)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        seen = pd.concat(list(rows))
        seen = seen.sort_values([self.order, *([self.first_by] if self.first_by else [])]).drop_duplicates(self.order)
        if "usable" in seen.columns:
            seen = seen[seen["usable"]]
        last = tuple(self.last.get()) if self.last.exists() else None
        if last is not None:
            seen = seen[seen[self.order] > last[0]]
        out = []
        for row in seen[[self.order, *self.columns]].itertuples(index=False):
            near = last is not None and row[0] - last[0] <= self.expiry_ns
            out.append(last if near else (None,) * (1 + len(self.columns)))
            last = tuple(x.item() if hasattr(x, "item") else x for x in row)
        if out:
            self.last.update(last)
        paired = seen.reset_index(drop=True)
        for i, name in enumerate([self.order, *self.columns]):
            paired[f"previous_{name}"] = pd.array([o[i] for o in out], dtype="Float64" if isinstance(last and last[i], float) else "Int64")
        yield paired[self.fields]

    def close(self) -> None:
        pass


def previous_in_state(expiry_ns: int = EXPIRY_NS, first_by: str | None = None) -> Callable[..., DataFrame]:
    """A stand-in for ``history.with_previous`` on streams.

    Of several rows of a key and instant the first by ``first_by`` counts; they must arrive together. Rows whose
    column ``usable``, if there is one, is false are then left out.
    """

    def pair(df: DataFrame, keys: Sequence[str], order: str, columns: Sequence[str], name: str = "previous") -> DataFrame:
        kept = [c for c in columns if c != order]
        given = df.schema
        about = T.StructType([given[order], *[given[c] for c in kept]])
        state = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in about)
        out = T.StructType([*[f for f in given if f.name != "usable"], *[T.StructField(f"previous_{f.name}", f.dataType) for f in about]])
        found = df.groupBy(*keys).transformWithStateInPandas(
            statefulProcessor=LastSample(order, kept, state, [f.name for f in out], expiry_ns, first_by),
            outputStructType=out,
            outputMode="Append",
            timeMode="None",
        )
        whole = F.struct(*[F.col(f"previous_{c}").alias(c) for c in [order, *kept]])
        before = F.when(F.col(f"previous_{order}").isNotNull(), whole)
        return found.withColumn(name, before).drop(*[f"previous_{c}" for c in [order, *kept]])

    return pair


def host_cpu_stream(samples: DataFrame, expiry_ns: int = EXPIRY_NS) -> DataFrame:
    """``counters.host_cpu_utilization`` of a stream."""
    return counters.host_cpu_utilization(samples, previous_in_state(expiry_ns))


def network_rates_stream(samples: DataFrame, expiry_ns: int = EXPIRY_NS) -> DataFrame:
    """``counters.network_counter_rates`` of a stream."""
    return counters.network_counter_rates(samples, previous_in_state(expiry_ns))


def disk_rates_stream(samples: DataFrame, expiry_ns: int = EXPIRY_NS) -> DataFrame:
    """``counters.disk_counter_rates`` of a stream; the mounts of a device at an instant must arrive together."""
    real = counters.real_disks(samples).withColumn("usable", F.col("total_bytes") > 0)
    pair = previous_in_state(expiry_ns, first_by="mountpoint")
    return counters.disk_rates(pair(real, [*HOST, "device"], TIME, [TIME, *counters.DISK_COUNTERS]))


class LastSnapshot(StatefulProcessor):
    """Keeps the ticks of all processes in a host's last snapshot; gives the busiest ones of every snapshot."""

    def __init__(self, top: int, expiry_ns: int) -> None:
        self.top, self.expiry_ns = top, expiry_ns

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "time long, pids array<long>, ticks array<long>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        seen, out = pd.concat(list(rows)), []
        at, known = None, {}
        if self.last.exists():
            at, pids, ticks = self.last.get()
            known = dict(zip(pids, ticks, strict=True))
        for time, snapshot in seen.groupby(TIME, sort=True):
            if at is not None and time <= at:
                continue
            if at is not None and time - at > self.expiry_ns:
                at, known = None, {}
            elapsed = max(counters.LEAST_ELAPSED_S, (time - at) / 1e9) if at is not None else None
            before = snapshot["pid"].map(known)
            gone = snapshot["total_ticks"] - before
            busy = (gone / counters.TICKS_PER_SECOND / (elapsed or 1) / snapshot["logical_cores"]).clip(0, 1)
            busy = busy.where(before.notna() & (gone >= 0), 0.0).fillna(0.0)
            found = snapshot.assign(cpu_utilization=busy.astype(float))
            out.append(found.sort_values(["cpu_utilization", "pid"], ascending=[False, True]).head(self.top))
            at, known = int(time), dict(zip(snapshot["pid"].tolist(), snapshot["total_ticks"].tolist(), strict=True))
        if out:
            self.last.update((at, [int(p) for p in known], [int(t) for t in known.values()]))
        yield (pd.concat(out) if out else seen.head(0).assign(cpu_utilization=0.0))[[*HOST, TIME, "pid", "cpu_utilization", "rss_pages", "thread_count"]]

    def close(self) -> None:
        pass


def process_topn_stream(samples: DataFrame, top: int = counters.TOP_PROCESSES, expiry_ns: int = EXPIRY_NS) -> DataFrame:
    """``counters.process_cpu_topn`` of a stream; the processes of a snapshot must arrive together.

    A state holds one snapshot's processes of a host. A process that a snapshot lists twice counts by its last row.
    """
    given = samples.schema
    out = T.StructType([*[given[c] for c in [*HOST, TIME, "pid"]], T.StructField("cpu_utilization", T.DoubleType()), given["rss_pages"], given["thread_count"]])
    columns = [*HOST, TIME, "pid", "total_ticks", "logical_cores", "rss_pages", "thread_count"]
    return samples.select(*columns).groupBy(*HOST).transformWithStateInPandas(
        statefulProcessor=LastSnapshot(top, expiry_ns), outputStructType=out, outputMode="Append", timeMode="None"
    )
