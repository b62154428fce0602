"""Alert signals, in a batch and as a stream, against a plain evaluation of every rule and tick."""

import random
import statistics

import pytest
from pyspark.sql import functions as F

from teleloom.functions.sliding import block_aggregates, running_counts
from teleloom.operators.alerts import signals
from teleloom.operators.alerts.signals import Ticks
from teleloom.streaming import alert_rules

NS = 1_000_000_000
BASE = 1_700_000_040  # a whole minute
RULES = "rule_id long, tenant_id int, service_filter string, signal_type string, signal_param string, operator string, threshold double, window_seconds int, enabled boolean, for_seconds int"
SPANS = "tenant_id int, service_name string, span_kind string, start_time_unix_ns long, duration_ns long, status_code string, http_status_code int"
LOGS = "tenant_id int, service_name string, time_unix_ns long, severity_number int"
POINTS = "tenant_id int, service_name string, time_unix_ns long, metric_name string, value_double double, value_int long, histogram_sum double"
FLOORS = {"": 17, "WARN": 13, "info": 9}
Q = {"latency_p50": 0.5, "latency_p90": 0.9, "latency_p99": 0.99}


def made(seed, windows, n=400, span_s=1800):
    r = random.Random(seed)

    def at():  # every fourth at a whole minute, so that it lies on the ends of windows
        s = r.randrange(span_s)
        return (BASE + s // 60 * 60) * NS if r.random() < 0.25 else (BASE + s) * NS + r.randrange(NS)

    kinds = [*Q, "error_rate", "request_volume", "log_count", "metric_avg", "metric_max"]
    params = {"log_count": list(FLOORS), "metric_avg": ["cpu", "none"], "metric_max": ["cpu", "mem"]}
    rules = []
    for i, kind in enumerate(kinds * 3):
        param, service = r.choice(params.get(kind, [""])), r.choice(["", "", "a", "b", "nobody"])
        rules.append((i, r.choice([1, 2, 3]), service, kind, param, r.choice(["gt", "lt"]), r.choice([0.0, 2.0, 50.0]), r.choice(windows), True, 0))
    rules += [(90, 1, "", "error_rate", "", "gt", 0.0, 60, False, 0), (91, 1, "", "cpu_heat", "", "gt", 0.0, 60, True, 0)]
    who = lambda: (r.choice([1, 1, 1, 2]), r.choice(["a", "a", "b", "c"]))
    spans = [(*who(), r.choice(["SERVER"] * 4 + ["CLIENT"]), at(), int(r.lognormvariate(17, 1.5)), r.choice(["OK", "ERROR", "UNSET"]), r.choice([0, 200, 404, 500])) for _ in range(n)]
    spans += [(1, "a", "SERVER", (BASE + 300) * NS, 5, "OK", 200)] * 4
    logs = [(*who(), at(), r.choice([1, 9, 13, 17, 21])) for _ in range(n)]
    points = [(*who(), at(), r.choice(["cpu", "mem"]), *r.choice([(r.uniform(-5, 9), None, None), (None, r.randrange(9), None), (None, None, 2.5), (None, None, None)])) for _ in range(n)]
    return rules, spans, logs, points


def quantile(values, q):
    values = sorted(values)
    at = q * (len(values) - 1)
    low = int(at)
    high = min(low + 1, len(values) - 1)
    return values[low] + (values[high] - values[low]) * (at - low)


def plain(rules, spans, logs, points, ticks):
    """{(rule, tick): observed} of live rules."""
    out = {}
    for rule, tenant, service, kind, param, _, _, window, enabled, _ in rules:
        if not enabled or kind == "cpu_heat":
            continue
        window = max(60, window)
        for tick in ticks:
            inside = lambda t: (tick - window) * NS <= t <= tick * NS  # noqa: E731, B023
            mine = lambda x: x[0] == tenant and service in ("", x[1])  # noqa: E731, B023
            seen = [s for s in spans if mine(s) and s[2] == "SERVER" and inside(s[3])]
            if kind in Q:
                value = quantile([s[4] for s in seen], Q[kind]) / 1e6 if seen else 0
            elif kind == "error_rate":
                value = sum(s[5] == "ERROR" or s[6] >= 500 for s in seen) / len(seen) if seen else 0
            elif kind == "request_volume":
                value = len(seen)
            elif kind == "log_count":
                value = sum(mine(x) and inside(x[2]) and x[3] >= FLOORS[param] for x in logs)
            else:
                vs = [v for x in points if mine(x) and inside(x[2]) and x[3] == param for v in [next((y for y in x[4:] if y is not None), None)] if v is not None]
                value = (statistics.fmean(vs) if kind == "metric_avg" else max(vs)) if vs else 0
            out[rule, tick] = value
    return out


@pytest.mark.parametrize(
    ("windows", "ticks"),
    [
        ([60, 120, 600], Ticks(BASE, BASE + 2100, 60)),
        ([30, 45, 90, 200, 3600], Ticks(BASE + 17, BASE + 2000, 37)),
        ([60, 300, 900], Ticks(BASE + 60, BASE + 1800, 600)),
        ([60, 1800], Ticks.at(BASE + 900)),
    ],
)
def test_every_rule_at_every_tick(spark, windows, ticks):
    rules, spans, logs, points = made(len(windows) + ticks.step_s, windows)
    frames = [spark.createDataFrame(rows, schema) for rows, schema in ((rules, RULES), (spans, SPANS), (logs, LOGS), (points, POINTS))]
    instants = range(ticks.first_s, ticks.last_s + 1, ticks.step_s)
    wanted = plain(rules, spans, logs, points, instants)
    got = {(x.rule_id, x.tick_s): x.observed for x in signals.evaluate_rules(*frames, ticks).collect()}
    assert set(got) == set(wanted)
    assert {k: v for k, v in got.items() if abs(v - wanted[k]) > 1e-9} == {}
    volume = {(x.rule_id, x.tick_s): x.observed for x in signals.signal_request_volume(frames[0], frames[1], ticks).collect()}
    assert volume == {k: v for k, v in wanted.items() if v and rules[k[0]][3] == "request_volume"}
    plans = signals.evaluate_rules(*frames, ticks)._jdf.queryExecution().optimizedPlan().toString()
    assert "sequence(_low" not in plans


def test_sliding_helpers_on_small_series(spark):
    r = random.Random(2)
    rows = [(r.choice("ab"), low := r.randrange(-6, 30), low + r.randrange(-1, 9), r.randrange(1, 5)) for _ in range(60)]
    got = {(x.k, x._step): x.v for x in running_counts(spark.createDataFrame(rows, "k string, _low long, _high long, v long"), ["k"], ["v"], 20).collect()}
    wanted = {}
    for k, low, high, v in rows:
        for i in range(max(0, low), min(19, high) + 1):
            wanted[k, i] = wanted.get((k, i), 0) + v
    assert got == wanted
    rows = [(r.choice("ab"), n := r.choice([1, 2, 7]), r.randrange(1 - n, 20), float(r.randrange(9))) for _ in range(50)]
    grid = spark.createDataFrame([(k, n) for k in "ab" for n in (1, 2, 7)], "k string, _len long")
    table = spark.createDataFrame(rows, "k string, _len long, _low long, v double").withColumn("top", F.col("v"))
    got = {(x.k, x._step): (x.v, x.top) for x in block_aggregates(table, grid, ["k"], {"v": "sum", "top": "max"}, 20).collect() if x.v is not None}
    wanted = {}
    for k, n, low, v in rows:
        for i in range(max(0, low), min(19, low + n - 1) + 1):
            total, top = wanted.get((k, i), (0, 0))
            wanted[k, i] = (total + v, max(top, v))
    assert got == wanted


def run(spark, stream, path):
    stream.writeStream.format("parquet").option("checkpointLocation", f"{path}/checkpoint").outputMode("append").trigger(availableNow=True).start(f"{path}/out").awaitTermination()
    return spark.read.parquet(f"{path}/out")


def test_rules_as_a_stream_equal_the_grid(spark, tmp_path):
    """Three files: facts out of order within the watermark, a restart in between, and one fact that comes too late."""
    rules, spans, logs, points = made(7, [60, 120, 600], n=250, span_s=1500)
    rules.append((50, 3, "", "error_rate", "", "gt", 0.0, 300, True, 0))  # no facts at all
    cuts = [BASE + 500, BASE + 1000, BASE + 1500]
    late = (1, "a", "SERVER", (BASE + 30) * NS, 10**12, "ERROR", 500)
    first, last = BASE - 60, BASE + 1500
    shifted = lambda t: t + 100 * NS if (t // NS) % 7 == 0 else t  # noqa: E731  comes up to a file later than others
    part = lambda t: next((i for i, c in enumerate(cuts) if shifted(t) < c * NS), 2)
    table = spark.createDataFrame(rules, RULES)
    end = (BASE + 4000) * NS  # pushes the watermark over all ticks
    names = {"spans": (spans, SPANS, 3), "logs": (logs, LOGS, 2), "points": (points, POINTS, 2)}

    def streams():
        read = {n: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/{n}/*") for n, (_, schema, _) in names.items()}
        return alert_rules.evaluate_rules_stream(table, read["spans"], read["logs"], read["points"], first_s=first, step_s=60, pane_s=60, watermark="4 minutes")

    for i in range(3):
        for name, (rows, schema, at) in names.items():
            some = [x for x in rows if part(x[at]) == i]
            if i == 2 and name == "spans":
                some += [late]
            spark.createDataFrame(some, schema).coalesce(1).write.parquet(f"{tmp_path}/{name}/{i}")
        run(spark, streams(), str(tmp_path))
    closing = {"spans": (9, "z", "CLIENT", end, 1, "OK", 0), "logs": (9, "z", end, 1), "points": (9, "z", end, "cpu", 1.0, None, None)}
    closing["spans"] = (9, "z", "SERVER", end, 1, "OK", 0)
    for i in (3, 4):
        for name, (_, schema, _) in names.items():
            spark.createDataFrame([closing[name]], schema).coalesce(1).write.parquet(f"{tmp_path}/{name}/{i}")
        out = run(spark, streams(), str(tmp_path))
    got = {(x.rule_id, x.tick_s): x for x in out.collect() if first <= x.tick_s <= last}
    wanted = plain(rules, spans, logs, points, range(first, last + 1, 60))
    assert out.count() == out.select("rule_id", "tick_s").distinct().count()
    assert set(got) == set(wanted)
    of = {x[0]: x for x in rules}
    exact = {k: v for k, v in wanted.items() if of[k[0]][3] not in Q}
    assert {k: (got[k].observed, v) for k, v in exact.items() if abs(got[k].observed - v) > 1e-9} == {}
    assert {got[50, t].observed for t in range(first, last + 1, 60)} == {0.0}
    for (rule, tick), x in got.items():
        _, tenant, service, kind, *_, window, _, _ = of[rule]
        if kind in Q:
            ds = sorted(s[4] for s in spans if s[0] == tenant and service in ("", s[1]) and s[2] == "SERVER" and (tick - window) * NS <= s[3] <= tick * NS)
            near = ds[max(1, -int(-len(ds) * Q[kind] // 1)) - 1] / 1e6 if ds else 0
            assert abs(x.observed - near) <= 0.0041 * near + 1e-6
        assert x.breached == (x.observed > of[rule][6] if of[rule][5] == "gt" else x.observed < of[rule][6])


def test_changed_rules_in_the_stream(spark, tmp_path):
    rule = lambda i, enabled, threshold=0.0: (i, 1, "", "request_volume", "", "gt", threshold, 60, enabled, 0)
    at = lambda s: (1, "a", "SERVER", (BASE + s) * NS, 5, "OK", 200)
    known = {1: rule(1, True), 2: rule(2, True)}

    def go():
        table = spark.createDataFrame(list(known.values()), RULES)
        spans = spark.readStream.schema(SPANS).parquet(f"{tmp_path}/spans/*")
        changes = spark.readStream.schema(RULES).parquet(f"{tmp_path}/rules/*")
        return run(spark, alert_rules.evaluate_rules_stream(table, spans, changes=changes, first_s=BASE, watermark="0 seconds"), str(tmp_path))

    steps = [([at(10), at(70), at(330)], []), ([at(400)], [rule(2, False), rule(3, True, 5.0)]), ([at(610), at(700)], [rule(1, True, 9.0)]), ([at(900)], [])]
    for i, (facts, changed) in enumerate(steps):
        spark.createDataFrame(facts, SPANS).coalesce(1).write.parquet(f"{tmp_path}/spans/{i}")
        spark.createDataFrame(changed, RULES).coalesce(1).write.parquet(f"{tmp_path}/rules/{i}")
        known.update({x[0]: x for x in changed})
        out = go()
    got = {}
    for x in out.collect():
        got.setdefault(x.rule_id, {})[(x.tick_s - BASE) // 60] = (x.observed, x.breached)
    assert got[1][1] == (1.0, True) and got[1][3] == (0.0, False) and not got[1][11][1]
    assert max(got[2]) < max(got[1]) and 3 in got and got[3][1][1] is False
    assert sorted(got[1]) == list(range(max(got[1]) + 1))
