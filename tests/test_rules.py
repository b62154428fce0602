"""Small tables with exact expectations."""

import itertools
import math
from datetime import date

import numpy as np
import pytest
from pyspark.sql import functions as F

from teleloom.functions import quantiles, timing, wire
from teleloom.functions.history import with_previous
from teleloom.operators import admission, consumers, counters, ingest, logs, rollups, spans, tenants
from teleloom.operators.alerts import notify, state
from teleloom.scope import Scope
from teleloom.sources import otlp, tables
from teleloom.streaming.alert_state import next_state

NS = 1_000_000_000
HOUR = 3600 * NS


def values(df, *columns):
    return [tuple(r) for r in df.select(*columns).collect()]


# ---------------------------------------------------------------------------- time


@pytest.mark.parametrize(
    "start,end,wanted",
    [
        (8 * HOUR, 8 * HOUR + 5 * NS, (9 * HOUR, 9 * HOUR + 5 * NS)),  # too old: moved, duration kept
        (8 * HOUR, 8 * HOUR - 60 * NS, (9 * HOUR, 9 * HOUR)),  # end before start
        (9 * HOUR + 1800 * NS, 12 * HOUR, (9 * HOUR + 1800 * NS, 12 * HOUR)),  # only the end outside
        (11 * HOUR, 11 * HOUR + 7, (10 * HOUR + 300 * NS, 10 * HOUR + 300 * NS + 7)),  # in the future
    ],
)
def test_span_clamp(spark, start, end, wanted):
    df = spark.createDataFrame([(start, end)], "s long, e long")
    moved = timing.clamp_span_window(F.col("s"), F.col("e"), F.lit(10 * HOUR))
    assert values(df, *moved) == [wanted]


def test_point_clamp_and_truncation(spark):
    df = spark.createDataFrame([(11 * HOUR,), (10 * HOUR,)], "t long")
    assert values(df, timing.clamp_timestamp(F.col("t"), F.lit(10 * HOUR))) == [(10 * HOUR + 300 * NS,), (10 * HOUR,)]
    micros = F.unix_micros(timing.unix_ns_to_timestamp(F.lit(1_700_000_000_123_456_789)))
    assert values(df.limit(1), micros) == [(1_700_000_000_123_456,)]


# ---------------------------------------------------------------------------- wire values


def test_any_value_text_and_integer(spark):
    schema = "v struct<string_value:string,bool_value:boolean,int_value:string,double_value:double,bytes_value:binary>"
    cases = [
        (("x", None, None, None, None), "x", None),
        (("12", None, None, None, None), "12", 12),
        ((None, True, None, None, None), "true", None),
        ((None, None, "-7", None, None), "-7", -7),
        ((None, None, None, 2.0, None), "2", 2),
        ((None, None, None, 0.25, None), "0.25", 0),
        ((None, None, None, 12345678.5, None), "12345678.5", 12345678),
        ((None, None, None, 1e20, None), "1E+20", None),
        ((None, None, None, 0.00025, None), "0.00025", 0),
        ((None, None, None, 1.5e-7, None), "1.5E-07", 0),
        ((None, None, None, None, b"abc"), "YWJj", None),
        ((None, None, None, None, None), "", None),
    ]
    df = spark.createDataFrame([(c[0],) for c in cases], schema).coalesce(1)
    got = values(df, wire.any_value_to_string(F.col("v")), wire.any_value_to_int(F.col("v")))
    assert got == [c[1:] for c in cases]


def span_line(attributes, start=None, end=None, **fields):
    pairs = [{"key": k, "value": {"string_value": v}} for k, v in attributes]
    span = {"trace_id": "AB" * 16, "span_id": "cd" * 8, "name": "n", "kind": 3, "attributes": pairs, **fields}
    span["start_time_unix_nano"], span["end_time_unix_nano"] = str(start or HOUR), str(end or HOUR + 5_000_000)
    resource = {"attributes": [{"key": "service.name", "value": {"string_value": "svc"}}]}
    import json

    return json.dumps(
        {
            "tenant_id": 1,
            "received_unix_ns": str(HOUR),
            "resource_spans": [{"resource": resource, "scope_spans": [{"spans": [span]}]}],
        }
    )


def flat(spark, *lines):
    return ingest.flatten_spans(otlp.parsed(spark.createDataFrame([(x,) for x in lines], "value string"), "spans"))


@pytest.mark.parametrize("system", ["db.system", "db.system.name"])
@pytest.mark.parametrize("statement", ["db.statement", "db.query.text"])
def test_database_attributes_under_either_name(spark, system, statement):
    text = "update stock set n = n - 1 where part = ?"
    row = flat(spark, span_line([("shelf", "b4"), (statement, text), (system, "mariadb")])).first()
    assert (row.db_system, row.db_statement, row.attrs_keys, row.attrs_values) == ("mariadb", text, ["shelf"], ["b4"])


def test_duplicate_attributes_and_span_fields(spark):
    twice = [("http.route", "/cart"), ("db.system.name", "redis"), ("db.system", "redis"), ("http.route", "/cart/{id}")]
    row = flat(spark, span_line(twice, start=5 * HOUR, end=5 * HOUR + 1_234_567, kind=2, status={"code": 1})).first()
    assert (row.db_system, row.http_route, row.attrs_keys) == ("redis", "/cart/{id}", [])
    assert (row.span_kind, row.status_code, row.duration_ns, row.service_name) == ("SERVER", "OK", 1_234_567, "svc")
    assert (row.trace_id, row.parent_span_id) == ("ab" * 16, "")


def test_event_json_is_escaped_and_keeps_order(spark):
    pairs = [{"key": k, "value": {"string_value": v}} for k, v in (("b", 'x"y'), ("a", "1\n2"), ("b", "z"))]
    row = flat(spark, span_line([], events=[{"time_unix_nano": "5", "name": "e", "attributes": pairs}])).first()
    assert row.event_attrs_json == ['{"b":"x\\"y","a":"1\\n2","b":"z"}'] and row.event_times_unix_ns == [5]


def test_enumerations_and_severity(spark):
    df = spark.range(1)
    assert values(
        df,
        wire.span_kind(F.lit(9)),
        wire.span_status(F.lit(2)),
        wire.default_severity_text(F.lit(""), F.lit(13)),
        wire.default_severity_text(F.lit(""), F.lit(14)),
        wire.default_severity_text(F.lit("note"), F.lit(13)),
        wire.severity_of_log_level(F.lit("Critical")),
        wire.infer_server_error_status(F.lit("SERVER"), F.lit("UNSET"), F.lit(503)),
        wire.infer_server_error_status(F.lit("CLIENT"), F.lit("UNSET"), F.lit(503)),
    ) == [("INTERNAL", "ERROR", "WARN", "", "note", 21, "ERROR", "UNSET")]


# ---------------------------------------------------------------------------- admission


def test_forwarded_address_and_short_token(spark):
    data = [({"X-Forwarded-For": " , 10.0.0.1, 10.0.0.2"}, "9.9.9.9"), ({"Authorization": "Bearer a.b"}, "9.9.9.9")]
    df = spark.createDataFrame(data, "headers map<string,string>, remote_ip string").select(
        "*", F.lit(False).alias("authenticated"), F.create_map().cast("map<string,string>").alias("claims")
    )
    assert values(admission.extract_consumer_id(df, "ip"), "consumer_id") == [("10.0.0.1",), ("9.9.9.9",)]
    without = admission.extract_consumer_id(df, "jwt", fall_back_to_ip=False)
    assert values(without, "consumer_id") == [(None,), (None,)]


def test_name_cap_counts_distinct_names(spark):
    rows = [(1, n, t * NS) for t, n in enumerate("abacabd")] + [(1, "d", 400 * NS)]
    df = spark.createDataFrame(rows, "tenant_id int, metric_name string, time_unix_ns long")
    got = values(admission.metric_cardinality_guard(df, cap=2).orderBy("time_unix_ns"), "metric_name", "admitted")
    assert got == [("a", True), ("b", True), ("a", True), ("c", False), ("a", True), ("b", True), ("d", False), ("d", True)]


def test_sampling_compares_unsigned_and_follows_the_caller(spark):
    ids = ["0" * 16 + "f" * 16, "0" * 16 + "7" + "f" * 15, "0" * 32]
    df = spark.createDataFrame([(i, f) for i, f in zip(ids, [None, None, 0])], "trace_id string, flags int")
    assert admission.sample_traces(df, 0.5).count() == 2
    assert admission.sample_traces(df, 0.5, "flags").count() == 1
    assert (admission.sample_traces(df, 1).count(), admission.sample_traces(df, 0).count()) == (3, 0)


# ---------------------------------------------------------------------------- counters


def disk(spark, rows):
    schema = "time_unix_ns long, sectors_read long, device string, fs_type string, mountpoint string, total_bytes long"
    zero = F.lit(0).cast("bigint")
    return spark.createDataFrame(rows, schema).select(
        F.lit(1).alias("tenant_id"), F.lit("h").alias("host_id"), "*", zero.alias("free_bytes"), zero.alias("reads"),
        zero.alias("writes"), zero.alias("sectors_written"),
    )


def test_disk_rates(spark):
    sda = ("/dev/sda", "ext4", "/", 100)
    rows = [
        (0, 50, *sda),
        (10 * NS, 105, *sda),
        (20 * NS, 10, *sda),  # counter went back
        (0, 1, "/dev/sda", "ext4", "/mnt", 100),  # second mount of the device
        (0, 1, "tmpfs", "tmpfs", "/tmp", 100),
        (0, 1, "/dev/sdz", "ext4", "/z", 0),
    ]
    got = counters.disk_counter_rates(disk(spark, rows)).orderBy("time_unix_ns")
    assert values(got, "device", "mountpoint", "read_bytes_per_sec") == [
        ("/dev/sda", "/", 0), ("/dev/sda", "/", 2560), ("/dev/sda", "/", 0)
    ]


def test_previous_row_over_chunks(spark):
    rows = [(k, t, t * 10) for k in "ab" for t in (1, 5, 11, 12, 35, 99)]
    df = spark.createDataFrame(rows, "k string, t long, v long")
    got = values(with_previous(df, ["k"], "t", ["v"], chunk_ns=10).orderBy("k", "t"), "k", "t", "previous.v")
    assert got == [(k, t, p) for k in "ab" for t, p in ((1, None), (5, 10), (11, 50), (12, 110), (35, 120), (99, 350))]


# ---------------------------------------------------------------------------- spans


def span_rows(spark, rows, schema):
    base = {
        "tenant_id": "1", "service_name": "'s'", "service_version": "'1'", "span_name": "'n'", "span_kind": "'SERVER'",
        "status_code": "'OK'", "http_method": "'GET'", "http_status_code": "200", "http_route": "'/r'", "consumer_id": "''",
        "start_time_unix_ns": "0L", "duration_ns": "1L", "span_id": "'x'",
    }
    df = spark.createDataFrame(rows, schema)
    for name, text in base.items():
        if name not in df.columns:
            df = df.withColumn(name, F.expr(text))
    return df


def test_latency_powers(spark):
    df = spark.createDataFrame([(10,), (1_000_000,), (1_900_000,), (40_000_000_000,), (8_000_000,)], "d long")
    assert values(df, spans.latency_power(F.col("d"))) == [(-4,), (0,), (0,), (14,), (3,)]


def test_sparkline_edge_folds_into_the_last_slot(spark):
    df = span_rows(spark, [(0,), (9 * NS,), (10 * NS,)], "start_time_unix_ns long")
    row = spans.service_sparklines(df, Scope.seconds(0, 10), buckets=3).first()
    assert row["counts"] == [1, 0, 2]


def test_nearest_rank(spark):
    df = span_rows(spark, [(i * 1_000_000,) for i in (1, 2, 3, 4)], "duration_ns long")
    row = spans.span_sample_kpis(df).first()
    assert (row["p50_ms"], row["p95_ms"], row["slowest_ms"]) == (3, 4, 4)


def test_error_notions_differ(spark):
    df = span_rows(spark, [(404, "UNSET"), (500, "UNSET"), (200, "ERROR")], "http_status_code int, status_code string")
    assert spans.overview(df).first()["error_spans"] == 2
    assert spans.list_spans(df, errors_only=True).count() == 3
    assert rollups.partials(rollups.SPANS_MINUTELY, df).first()["error_count"] == 1


def test_paging_with_cursor(spark):
    df = span_rows(spark, [(i, str(i)) for i in range(10)], "start_time_unix_ns long, span_id string")
    scope, seen, cursor = Scope(tenant_id=1), [], None
    while True:
        found = spans.list_spans(df, scope, limit=4, cursor_ns=cursor).collect()
        if not found:
            break
        seen += sorted((r["start_time_unix_ns"] for r in found), reverse=True)
        cursor = found[0]["next_cursor_ns"]
        if cursor == 0:
            break
    assert seen == list(range(9, -1, -1))


def test_hourly_sparkline_of_a_consumer(spark):
    # From 00:30 to 02:30: hour 0 starts before the range, hour 2 falls outside the two slots.
    df = span_rows(spark, [(h * HOUR + 1,) for h in (0, 1, 1, 2)], "start_time_unix_ns long")
    states = rollups.partials(rollups.CONSUMER_HOURLY, df)
    row = consumers.consumer_routes_sparkline(states, Scope.seconds(1800, 9000)).first()
    assert (row["hourly_requests"], row["request_count"], row["consumer_id"]) == ([0, 2], 3, "(anonymous)")


def test_log_paging_and_millisecond_bounds(spark):
    rows = [(1, 5_000_000 + i, "s", 9, "INFO", "b", str(i), "") for i in range(5)]
    schema = (
        "tenant_id int, time_unix_ns long, service_name string, severity_number int, severity_text string, body string,"
        "trace_id string, span_id string"
    )
    df = spark.createDataFrame(rows, schema)
    assert logs.list_logs(df, 1, from_ms=5, to_ms=5).count() == 5
    assert logs.list_logs(df, 1, to_ms=4).count() == 0
    # The same millisecond: the exact cursor continues where the first page ended.
    first = logs.list_logs(df, 1, limit=2).collect()
    last = min((r["time_unix_ns"], r["trace_id"] + r["span_id"]) for r in first)
    assert logs.list_logs(df, 1, after=last).count() == 3


def test_limits_can_be_lifted(spark):
    ids = [(i, f"{i:04d}") for i in range(1200)]
    many = span_rows(spark, ids, "start_time_unix_ns long, span_id string")
    assert [spans.list_spans(many, limit=n).count() for n in (0, 1100, None)] == [50, 1100, 1200]
    schema = (
        "tenant_id int, time_unix_ns long, service_name string, severity_number int, severity_text string, body string,"
        " trace_id string, span_id string"
    )
    lines = spark.createDataFrame([(1, i, "s", 9, "INFO", "b", "t", s) for i, s in ids], schema)
    assert [logs.logs_for_trace(lines, 1, "T", n).count() for n in (500, None)] == [500, 1200]
    assert [logs.logs_for_traces(lines, lines.limit(1), n).count() for n in (500, None)] == [500, 1200]
    assert [logs.list_logs(lines, limit=n).count() for n in (1150, None)] == [1150, 1200]


# ---------------------------------------------------------------------------- quantiles and latency states


def test_quantiles_against_numpy(spark):
    rng = np.random.default_rng(7)
    groups = {
        "hot": rng.lognormal(16, 2, 20_000).astype(int),
        "same": np.full(500, 12_345),
        "two": np.array([1, 3]),
        "negative": rng.integers(-1000, 1000, 999),
    }
    rows = list(itertools.chain.from_iterable([(k, int(v)) for v in vs] for k, vs in groups.items()))
    df = spark.createDataFrame(rows, "k string, v long").repartition(5)
    probs = {"p50": 0.5, "p90": 0.9, "p99": 0.99}
    out = quantiles.summarize(df, ["k"], {"n": quantiles.count_all()}, F.col("v"), probs)
    for row in out.collect():
        vs = groups[row["k"]]
        assert row["n"] == len(vs)
        for name, q in probs.items():
            assert math.isclose(row[name], float(np.quantile(vs, q)), rel_tol=1e-9, abs_tol=1e-9)


def test_quantiles_of_missing_values_and_null_keys(spark):
    rows = [("a", None, 1), ("a", None, 2), (None, 4, 3), (None, 8, 4), ("b", 5, None), ("b", None, 6)]
    df = spark.createDataFrame(rows, "k string, v long, w long")
    measures = {"n": quantiles.count_all(), "top": quantiles.largest(F.col("w")), "sum": quantiles.total(F.col("w"))}
    out = quantiles.summarize(df, ["k"], measures, F.col("v"), {"mid": 0.5})
    assert {tuple(r) for r in out.collect()} == {("a", 2, 2, 3, 0.0), (None, 2, 4, 7, 6.0), ("b", 2, 6, 6, 5.0)}


def test_latency_states_merge_alike_in_any_order(spark):
    df = span_rows(spark, [(i,) for i in range(1, 40_001)], "duration_ns long").repartition(16)
    df = df.withColumn("start_time_unix_ns", F.col("duration_ns") % 50 * HOUR)
    found = set()
    for number in (1, 7):
        parts = rollups.partials(rollups.SPANS_MINUTELY, df).repartition(number, "bucket_s")
        halfway = rollups.merge(rollups.SPANS_MINUTELY, parts, ["tenant_id", "service_name", "span_kind", "bucket_s"])
        merged = rollups.merge(rollups.SPANS_MINUTELY, halfway, ["tenant_id"])
        found.add(tuple(merged.select("request_count", *rollups.latency_ms({"p50": 0.5, "p99": 0.99})).first()))
    (n, p50, p99) = found.pop()
    assert not found and n == 40_000
    assert abs(p50 * 1e6 / 20_000 - 1) < 0.004 and abs(p99 * 1e6 / 39_600 - 1) < 0.004


# ---------------------------------------------------------------------------- alerts


def replay(pattern, wait, state_at=("ok", None)):
    """The state machine, tick by tick."""
    now, since = state_at
    out = []
    for i, c in enumerate(pattern):
        new, new_since = next_state(now, since, c == "1", 60 * i, wait)
        if new != now:
            out.append((60 * i, now, new))
        now, since = new, new_since
    return out


@pytest.mark.parametrize(
    "pattern,wait,wanted",
    [
        ("010", 0, [(60, "ok", "firing"), (120, "firing", "ok")]),
        ("11110", 120, [(0, "ok", "pending"), (120, "pending", "firing"), (240, "firing", "ok")]),
        ("101", 120, [(0, "ok", "pending"), (60, "pending", "ok"), (120, "ok", "pending")]),
    ],
)
def test_state_machine_cases(spark, pattern, wait, wanted):
    assert replay(pattern, wait) == wanted
    assert machine(spark, {1: (pattern, wait, "ok", None)}) == {1: wanted}


def machine(spark, cases):
    seen = [(r, 60 * i, 0.0, c == "1") for r, (p, *_) in cases.items() for i, c in enumerate(p)]
    rules = spark.createDataFrame(
        [(r, w, s, since) for r, (_, w, s, since) in cases.items()],
        "rule_id int, for_seconds int, last_state string, last_pending_s long",
    )
    obs = spark.createDataFrame(seen, "rule_id int, tick_s long, observed double, breached boolean")
    out = {r: [] for r in cases}
    for row in state.alert_state_machine(obs, rules).orderBy("rule_id", "tick_s").collect():
        out[row["rule_id"]].append((row["tick_s"], row["from_state"], row["to_state"]))
    return out


def test_state_machine_equals_replay_for_all_patterns(spark):
    starts = [("ok", None), ("pending", -60), ("firing", -600)]
    cases = {
        i: ("".join(p), wait, *start)
        for i, (p, wait, start) in enumerate(
            itertools.product(itertools.product("01", repeat=6), (0, 60, 120, 240), starts)
        )
    }
    wanted = {i: replay(p, w, (s, since)) for i, (p, w, s, since) in cases.items()}
    assert machine(spark, cases) == wanted


def test_value_texts(spark):
    rows = [("latency_p99", 1234.5), ("error_rate", 0.12345), ("request_volume", 0.5), ("metric_avg", 2.005), ("log_count", 7.0)]
    df = spark.createDataFrame(rows, "s string, v double")
    got = [r[0] for r in values(df, notify.format_value(F.col("s"), F.col("v")))]
    assert got[:3] == ["1,235ms", "12.35%", "1"] and got[4] == "7.00"


# ---------------------------------------------------------------------------- tables and retention


def test_retention_of_days_and_months(spark):
    parts = spark.createDataFrame(
        [("r", 1, "202605"), ("r", 1, "202606"), ("s", 1, "20260605"), ("s", 1, "20260606"), ("s", 2, "20200101"), ("s", 9, "20200101"), ("s", 1, "x")],
        "table_name string, tenant_id int, period string",
    )
    known = spark.createDataFrame([(1, 14, "active"), (2, 14, "deleted")], "tenant_id int, data_retention_days int, status string")
    today = 1_781_913_600 * NS  # 2026-06-20
    gone = tenants.retention_sweep(parts, known, today)
    assert sorted(values(gone, "tenant_id", "period")) == [(1, "202605"), (1, "20260605")]


def test_written_tables_are_partitioned_and_pruned(spark, tmp_path):
    df = span_rows(spark, [(d * 86_400 * NS, str(d), t) for d in range(4) for t in (1, 2)], "start_time_unix_ns long, trace_id string, tenant_id int")
    tables.write_partitioned(df, str(tmp_path), "spans")
    tables.write_partitioned(df, str(tmp_path), "spans")
    stored = tables.read_table(spark, str(tmp_path), "spans")
    assert stored.count() == 2 * df.count()
    scoped = Scope.seconds(86_400, 2 * 86_400, tenant_id=2).apply(stored, "start_time_unix_ns")
    assert scoped.count() == 4
    plan = scoped._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(tenant_id" in plan and "event_date" in plan.split("PartitionFilters:")[1][:200]


def test_one_layout_for_batches_appends_compaction_and_retention(spark, tmp_path):
    root = str(tmp_path)
    days = [(d * 86_400 * NS, f"{d}-{i}", t) for d in range(4) for t in (1, 2) for i in range(3)]
    df = span_rows(spark, days, "start_time_unix_ns long, trace_id string, tenant_id int")
    tables.write_partitioned(df.filter("tenant_id = 1"), root, "spans")
    for batch in (0, 1, 2):
        tables.write_batch(df.filter(F.endswith("trace_id", F.lit(f"-{batch}"))), root, "spans", batch)
    tables.write_batch(df.filter(F.endswith("trace_id", F.lit("-2"))), root, "spans", 2)  # a replay
    everything = lambda: sorted(values(tables.read_table(spark, root, "spans"), "tenant_id", "trace_id"))
    wanted = sorted([(t, x) for _, x, t in days] + [(t, x) for _, x, t in days if t == 1])
    assert everything() == wanted

    batches = lambda: {r.batch_id for r in tables.read_table(spark, root, "spans").select("batch_id").distinct().collect()}
    assert tables.compact(spark, root, "spans", upto=1) == 8 and everything() == wanted and batches() == {-3, 2}
    assert tables.compact(spark, root, "spans", upto=1) == 0
    tables.write_batch(df.filter(F.endswith("trace_id", F.lit("-0")) & (F.col("tenant_id") == 1)), root, "spans", 3)
    assert tables.compact(spark, root, "spans", upto=3) == 8 and batches() == {-5}
    assert everything() == sorted(wanted + [(t, x) for _, x, t in days if t == 1 and x.endswith("-0")])

    # As of 1970-01-04 tenant 1 keeps one day, tenant 2 everything.
    known = spark.createDataFrame([(1, 1, "active"), (2, 90, "active")], "tenant_id int, data_retention_days int, status string")
    listed = tables.list_partitions(spark, root, "spans")
    assert listed.count() == 8
    gone = tenants.retention_sweep(listed, known, 3 * 86_400 * NS)
    assert sorted(values(gone, "tenant_id", "period")) == [(1, "1970-01-01"), (1, "1970-01-02")]
    assert tables.remove_partitions(spark, root, gone) == 2
    left = tables.read_table(spark, root, "spans")
    assert sorted(set(values(left, "tenant_id", "event_date"))) == [
        (1, date(1970, 1, 3)), (1, date(1970, 1, 4)), *[(2, date(1970, 1, d)) for d in (1, 2, 3, 4)],
    ]


def test_a_compaction_that_was_cut_off_is_finished(spark, tmp_path):
    root = str(tmp_path)
    df = span_rows(spark, [(i * NS, str(i)) for i in range(6)], "start_time_unix_ns long, trace_id string")
    for batch in (0, 1):
        tables.write_batch(df.filter(f"cast(trace_id as int) % 2 = {batch}"), root, "spans", batch)
    # The merged files are complete, the exchange did not happen.
    merged = tables.arranged(df, "spans").withColumn("batch_id", F.lit(-3))
    merged.write.partitionBy("tenant_id", "event_date", "batch_id").parquet(f"{root}/spans/_compacting")
    assert tables.read_table(spark, root, "spans").count() == 6
    assert tables.compact(spark, root, "spans", upto=1) == 0
    assert sorted(values(tables.read_table(spark, root, "spans"), "trace_id", "batch_id")) == [(str(i), -3) for i in range(6)]


def test_span_attributes_with_missing_keys_and_values(spark):
    import json

    def span(attributes):
        line = {"tenant_id": 1, "received_unix_ns": "0", "resource_spans": [{"scope_spans": [{"spans": [{"attributes": attributes}]}]}]}
        return flat(spark, json.dumps(line)).first()

    text = lambda key, value: {"key": key, "value": {"string_value": value}}
    row = span([None, {"value": {"string_value": "x"}}, text("http.route", "a"), text("http.route", "b"), text("k", "v"), {"key": "e"}])
    assert row.http_route == "b" and row.attrs_keys == ["", "", "k", "e"] and row.attrs_values == ["", "x", "v", ""]
    code = lambda value: text("http.response.status_code", value)
    # The last number counts, the last text without one does not.
    assert span([code("200"), code("404"), code("?")]).http_status_code == 404
    # The first filled text in the order of arrival, also among duplicates.
    row = span([text("db.system.name", ""), text("db.system", "a"), text("db.system", "b"), {"key": "db.query.text"}])
    assert row.db_system == "a" and row.db_statement == ""
    row = span(None)
    assert row.attrs_keys == [] and row.http_route == "" and row.http_status_code == 0


def test_metric_points_of_the_first_kind_present(spark):
    import json

    gauge, histogram = {"data_points": [{"as_double": 2.5}, None]}, {"data_points": [{"count": "3", "bucket_counts": ["1", None]}]}
    metrics = [
        {"name": "a", "gauge": gauge, "sum": {"data_points": [{"as_int": "1"}]}},
        {"name": "b", "sum": {"data_points": [{"as_int": "1"}], "is_monotonic": True, "aggregation_temporality": 2}, "histogram": histogram},
        {"name": "c", "gauge": {}, "histogram": histogram},
        {"name": "d", "gauge": {"data_points": []}, "histogram": histogram},
        {"name": "e"},
    ]
    line = json.dumps({"tenant_id": 1, "received_unix_ns": "0", "resource_metrics": [{"scope_metrics": [{"metrics": metrics}]}]})
    rows = ingest.flatten_metrics(otlp.parsed(spark.createDataFrame([(line,)], "value string"), "metrics")).collect()
    got = [
        (r.metric_name, r.metric_kind, r.aggregation_temporality, r.is_monotonic, r.value_double, r.value_int, r.histogram_count,
         r.histogram_bucket_counts) for r in rows
    ]
    assert got == [
        ("a", "GAUGE", "UNSPECIFIED", False, 2.5, None, None, []),
        ("a", "GAUGE", "UNSPECIFIED", False, None, None, None, []),
        ("b", "SUM", "CUMULATIVE", True, None, 1, None, []),
        ("c", "HISTOGRAM", "UNSPECIFIED", False, None, None, 3, [1, 0]),
    ]
