"""Streams against the batch results over the same input."""

import json
import shutil

import pytest
from pyspark.sql import functions as F

from teleloom.operators import ingest, rollups
from teleloom.operators.alerts import state
from teleloom.sources import nested_views, otlp, states, views
from teleloom.streaming import alert_state, cardinality, jobs

SF = "/root/testdata/sf0.001"
P3 = {"p50": 0.5, "p99": 0.99}
DAY_3_NS = 1_704_067_200_000_000_000 + 3 * 86_400_000_000_000
JAN_1995 = (788_918_400_000_000_000, 789_523_200_000_000_000)


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.fixture(scope="module")
def span_files(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("span_lines") / "in")
    # A few days: every tenant and day is a folder of the fact table.
    lines = nested_views.span_lines(spark, SF)
    early = otlp.parsed(lines.withColumn("line", F.col("value")), "spans")
    early = early.filter(F.col("received_unix_ns").cast("bigint") < DAY_3_NS)
    early.select("line").repartition(3).write.text(path)
    return path


def read_values(states_df, rollup):
    merged = rollups.merge(rollup, states_df)
    if "latency_counts" in merged.columns:
        merged = merged.select("*", *rollups.latency_ms(P3)).drop("latency_counts")
    return merged.select(*sorted(merged.columns))


def test_ingest_stream_equals_batch_and_survives_a_restart(spark, span_files, tmp_path):
    root, checkpoint = str(tmp_path / "out"), str(tmp_path / "checkpoint")
    source = otlp.stream_batches(spark, span_files, "spans", files_per_trigger=1)
    jobs.ingest_stream(source, "spans", root, checkpoint).awaitTermination()

    facts = ingest.flatten_spans(otlp.read_batches(spark, span_files, "spans"))
    stored = spark.read.parquet(f"{root}/spans")
    assert stored.select("batch_id").distinct().count() == 3
    columns = ["trace_id", "span_id", "start_time_unix_ns", "http_status_code", "consumer_id", "db_statement"]
    assert rows(stored.select(columns)) == rows(facts.select(columns))
    for rollup in (rollups.SPANS_MINUTELY, rollups.CONSUMER_HOURLY, rollups.STATUS_HOURLY):
        wanted = rows(read_values(rollups.partials(rollup, facts), rollup))
        assert rows(read_values(states.read_states(spark, rollup, root), rollup)) == wanted

    # Nothing new after a restart; a batch stored again replaces itself.
    jobs.ingest_stream(source, "spans", root, checkpoint).awaitTermination()
    assert spark.read.parquet(f"{root}/spans").count() == facts.count()
    again = otlp.read_batches(spark, span_files, "spans")
    jobs.store_batch(again, "spans", str(tmp_path / "twice"), 0)
    jobs.store_batch(again, "spans", str(tmp_path / "twice"), 0)
    assert spark.read.parquet(str(tmp_path / "twice/spans")).count() == facts.count()


def test_compaction_keeps_values(spark, span_files, tmp_path):
    root = str(tmp_path)
    rollup = rollups.CONSUMER_HOURLY
    facts = ingest.flatten_spans(otlp.read_batches(spark, span_files, "spans"))
    for i, part in enumerate(("http_method = 'GET'", "http_method <> 'GET'")):
        states.write_states(facts.filter(part), rollup, root, i)
    wanted = rows(read_values(states.read_states(spark, rollup, root), rollup))
    states.compact(spark, rollup, root, upto=0)
    assert rows(read_values(states.read_states(spark, rollup, root), rollup)) == wanted
    states.compact(spark, rollup, root, upto=1)
    compacted = states.read_states(spark, rollup, root)
    assert rows(read_values(compacted, rollup)) == wanted
    assert compacted.count() == compacted.select(*rollup.grain).distinct().count()


def test_all_signals_are_stored(spark, tmp_path):
    received = F.col("received_unix_ns").cast("bigint")
    sampled = F.get("snapshots", F.lit(0))["time_unix_nano"].cast("bigint")
    few = {
        "logs": (nested_views.log_lines, received < DAY_3_NS),
        "metrics": (nested_views.metric_lines, received.between(*JAN_1995)),
        "profiles": (nested_views.profile_lines, F.get("resource_profiles", F.lit(0)).isNotNull()),
        "host": (nested_views.host_lines, (sampled > DAY_3_NS - 10**15) | sampled.between(*JAN_1995)),
    }
    for signal, (lines, condition) in few.items():
        jobs.store_batch(otlp.parsed(lines(spark, SF), signal).filter(condition), signal, str(tmp_path), 0)
    count = lambda table: spark.read.parquet(f"{tmp_path}/{table}").count()
    inside = F.col("time_unix_ns").between(*JAN_1995)
    assert count("logs") == views.logs(spark, SF).filter(F.col("time_unix_ns") < DAY_3_NS).count()
    assert count("metric_points") == views.metric_points(spark, SF).filter(inside).count()
    assert count("profiles") == views.profiles(spark, SF).count()
    assert count("host_disks") == views.host_disks(spark, SF).count()
    assert count("host_processes") == views.host_processes(spark, SF).filter(inside).count()


def test_rows_that_are_not_admitted(spark, tmp_path):
    root = str(tmp_path)
    known = spark.createDataFrame([(1, "active"), (2, "suspended"), (3, "active")], "tenant_id int, status string")
    keys = spark.createDataFrame(
        [(1, 10, None, None), (1, 11, 5, None), (2, 20, None, None), (3, 30, None, 900)],
        "tenant_id int, key_id long, revoked_unix_ns long, expires_unix_ns long",
    )
    admit = jobs.Admission(known, keys, metric_cap=2, span_kinds=["SERVER"])

    def span(kind):
        return {"trace_id": "ab" * 16, "span_id": "cd" * 8, "name": "n", "kind": kind, "start_time_unix_nano": "1", "end_time_unix_nano": "2"}

    def line(tenant, key, received=1000, **signal):
        return json.dumps({"tenant_id": tenant, "key_id": key, "received_unix_ns": str(received), **signal})

    spans = {"resource_spans": [{"resource": {"attributes": []}, "scope_spans": [{"spans": [span(2), span(3)]}]}]}
    sent = [line(1, 10, **spans), line(1, 11, **spans), line(2, 20, **spans), line(3, 30, **spans), line(1, 99, **spans),
            line(3, 30, received=800, **spans), '{"tenant_id": 1, ']
    lines = spark.createDataFrame([(x,) for x in sent], "value string")
    for _ in range(2):  # a replay changes nothing
        jobs.store_batch(otlp.parsed(lines, "spans"), "spans", root, 0, admit)
    stored = spark.read.parquet(f"{root}/spans")
    assert sorted((r.tenant_id, r.span_kind) for r in stored.collect()) == [(1, "SERVER"), (3, "SERVER")]
    refused = spark.read.parquet(f"{root}/rejected/spans")
    assert sorted((r.tenant_id, r.key_id, r.reject_reason) for r in refused.collect()) == [
        (1, 11, "not admitted"), (1, 99, "not admitted"), (2, 20, "not admitted"), (3, 30, "not admitted"),
    ]
    counted = lambda what: {
        (r.tenant_id, r.reject_reason): (r.accepted, r.rejected) for r in spark.read.parquet(f"{root}/ingest_quality/{what}/spans").collect()
    }
    batches, by_row = counted("batches"), counted("rows")
    assert batches[(1, "not admitted")] == (0, 2) and batches[(1, "")] == (1, 0) and sum(r for (_, why), (_, r) in batches.items() if why == "malformed") == 1
    assert by_row == {(t, why): n for t in (1, 3) for why, n in (("", (1, 0)), ("out of scope", (0, 1)))}

    points = [{"name": n, "gauge": {"data_points": [{"time_unix_nano": "1", "as_double": 1.0}]}} for n in ("a", "b", "c", "c")]
    metrics = {"resource_metrics": [{"resource": {"attributes": []}, "scope_metrics": [{"metrics": points}]}]}
    lines = spark.createDataFrame([(line(1, 10, **metrics),), (line(2, 20, **metrics),)], "value string")
    jobs.store_batch(otlp.parsed(lines, "metrics"), "metrics", root, 0, admit)
    assert sorted(r.metric_name for r in spark.read.parquet(f"{root}/metric_points").collect()) == ["a", "b"]
    names = spark.read.parquet(f"{root}/rejected/metric_points").collect()
    assert [(r.tenant_id, r.metric_name, r.points) for r in names] == [(1, "c", 2)]


def test_unreadable_lines_are_kept_apart(spark, tmp_path):
    lines = spark.createDataFrame([('{"tenant_id": 1, "resource_spans": []}',), ('{"tenant_id": ',)], "value string")
    jobs.store_batch(otlp.parsed(lines, "spans"), "spans", str(tmp_path), 3)
    bad = spark.read.parquet(str(tmp_path / "unreadable/spans"))
    assert [(r["_corrupt_record"], r["batch_id"]) for r in bad.collect()] == [('{"tenant_id": ', 3)]


def test_finalized_rollup_emits_closed_buckets(spark, tmp_path):
    rollup = rollups.LOGS_MINUTELY
    logs = views.logs(spark, SF).select("tenant_id", "service_name", "severity_text", "time_unix_ns")
    path = str(tmp_path / "in")
    logs.coalesce(1).sortWithinPartitions("time_unix_ns").write.parquet(path)
    stream = spark.readStream.schema(logs.schema).parquet(path)
    out = jobs.finalized_rollup(stream, rollup)
    out.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c")).outputMode("append").trigger(
        availableNow=True
    ).start(str(tmp_path / "out")).awaitTermination()
    got = {tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).select(*rollup.grain, "log_count").collect()}
    wanted = {tuple(r) for r in rollups.partials(rollup, logs).select(*rollup.grain, "log_count").collect()}
    last = max(r[1] for r in wanted)
    assert got and got <= wanted
    assert {r for r in wanted if r[1] < last - 66 * 60} <= got


def test_finalized_rollup_with_latency(spark, tmp_path):
    rollup = rollups.SPANS_MINUTELY
    spans = views.spans(spark, SF).select("tenant_id", "service_name", "span_kind", "start_time_unix_ns", "duration_ns", "status_code")
    spans.coalesce(1).sortWithinPartitions("start_time_unix_ns").write.parquet(str(tmp_path / "in"))
    out = jobs.finalized_rollup(spark.readStream.schema(spans.schema).parquet(str(tmp_path / "in")), rollup)
    out.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c")).outputMode("append").trigger(
        availableNow=True
    ).start(str(tmp_path / "out")).awaitTermination()
    got = rows(read_values(spark.read.parquet(str(tmp_path / "out")), rollup))
    wanted = rows(read_values(rollups.partials(rollup, spans), rollup))
    assert got and set(got) <= set(wanted) and len(got) > 0.9 * len(wanted)


def test_alert_state_stream_equals_batch(spark, tmp_path):
    # Three rules with different patience over a breach pattern, in two files.
    pattern = "1101110011111000110111110"
    seen = [
        (rule, 60 * i, float(c), c == "1") for rule in (1, 2, 3) for i, c in enumerate(pattern[rule:] + pattern[:rule])
    ]
    schema = "rule_id long, tick_s long, observed double, breached boolean"
    rules = spark.createDataFrame([(1, 0, True), (2, 120, True), (3, 180, True)], "rule_id long, for_seconds int, enabled boolean")
    path = tmp_path / "in"
    for i, keep in enumerate((lambda t: t < 720, lambda t: t >= 720)):
        part = spark.createDataFrame([r for r in seen if keep(r[1])], schema)
        part.coalesce(1).write.parquet(str(tmp_path / f"part{i}"))
        path.mkdir(exist_ok=True)
        for file in (tmp_path / f"part{i}").glob("*.parquet"):
            shutil.copy(file, path / f"{i}.parquet")

        stream = spark.readStream.schema(schema).parquet(str(path))
        query = alert_state.alert_state_stream(stream, rules, max_gap_s=300)
        query.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c")).outputMode(
            "append"
        ).trigger(availableNow=True).start(str(tmp_path / "out")).awaitTermination()

    columns = ["rule_id", "tick_s", "from_state", "to_state", "kind", "pending_since_s"]
    batch = state.alert_state_machine(spark.createDataFrame(seen, schema), rules)
    got = rows(spark.read.parquet(str(tmp_path / "out")).select(columns))
    assert got == rows(batch.select(columns)) and any(r[4] == "resolved" for r in got)


def test_a_rule_that_was_off_starts_over(spark, tmp_path):
    schema = "rule_id long, tick_s long, observed double, breached boolean"
    rules = spark.createDataFrame([(1, 120, True), (2, 0, True)], "rule_id long, for_seconds int, enabled boolean")
    # Rule 1 fires, is switched off while it does, and comes back breached an hour later. Rule 2 goes on firing.
    files = [
        [(1, 60 * i, 1.0, True) for i in range(4)] + [(2, 60 * i, 1.0, True) for i in range(4)],
        [(2, 60 * i, 1.0, True) for i in range(4, 64)],
        [(1, 3600 + 60 * i, 1.0, True) for i in range(4, 6)] + [(2, 3600 + 60 * i, 1.0, True) for i in range(4, 6)],
    ]
    for i, seen in enumerate(files):
        spark.createDataFrame(seen, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        query = alert_state.alert_state_stream(stream, rules, max_gap_s=180)
        query.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c")).outputMode(
            "append"
        ).trigger(availableNow=True).start(str(tmp_path / "out")).awaitTermination()
    found = spark.read.parquet(str(tmp_path / "out")).select("rule_id", "tick_s", "from_state", "to_state")
    assert sorted(map(tuple, found.collect())) == [
        (1, 0, "ok", "pending"), (1, 120, "pending", "firing"), (1, 3840, "ok", "pending"), (2, 0, "ok", "firing"),
    ]


def test_cardinality_guard_opens_windows_at_first_arrival(spark, tmp_path):
    flagged = {}

    def sink(df, batch_id):
        flagged[batch_id] = {r["metric_name"]: r["admitted"] for r in df.collect()}

    run = cardinality.guarded(str(tmp_path), sink, cap=2)
    schema = "tenant_id int, metric_name string, time_unix_ns long, received_unix_ns long"
    second = 1_000_000_000

    def batch(batch_id, at_s, names):
        data = [(1, n, at_s * second + i, at_s * second) for i, n in enumerate(names)]
        run(spark.createDataFrame(data, schema), batch_id)

    batch(0, 1000, ["a", "b", "a", "c"])
    batch(1, 1200, ["c", "a"])
    batch(2, 1000 + 361, ["c"])
    assert flagged[0] == {"a": True, "b": True, "c": False}
    assert flagged[1] == {"c": False, "a": True}
    assert flagged[2] == {"c": True}
    # A replayed batch decides alike.
    before = dict(flagged[1])
    batch(1, 1200, ["c", "a"])
    assert flagged[1] == before


def points_at(spark, batch):
    """(tenant, name, arrival in seconds) as points."""
    data = [(t, n, i, at * 1_000_000_000) for i, (t, n, at) in enumerate(batch)]
    return spark.createDataFrame(data, "tenant_id int, metric_name string, time_unix_ns long, arrival_unix_ns long")


def admitted_in_order(batch, windows, cap, window_s=300):
    """The rule applied to one point after the other; ``windows`` is its memory."""
    out = []
    for tenant, name, at in batch:
        start, names = windows.get(tenant, (None, set()))
        if start is None or at - start > window_s:
            start, names = at, set()
        if name not in names and len(names) < cap:
            names = names | {name}
        windows[tenant] = (start, names)
        out.append(name in names)
    return out


@pytest.mark.parametrize("cap", [1, 3])
def test_name_cap_over_batches_equals_the_rule_point_by_point(spark, tmp_path, cap):
    import random

    r = random.Random(cap)
    at, windows = 10_000, {}
    for batch_id in range(4):
        batch = []
        for _ in range(25):  # the third batch is a backlog over many windows
            at += r.choice([0, 0, 1, 7, 200 if batch_id == 2 else 40])
            batch.append((r.randrange(3), r.choice("abcdefgh"), at))
        batch.sort(key=lambda p: p[2])
        wanted = admitted_in_order(batch, windows, cap)
        for _ in range(2):  # a batch run again decides alike
            flagged = cardinality.guard_stored(points_at(spark, batch), str(tmp_path), batch_id, cap)
            assert [x.admitted for x in sorted(flagged.collect(), key=lambda x: x.time_unix_ns)] == wanted, batch_id
    assert len(list(tmp_path.glob("batch_id=*"))) <= cardinality.VERSIONS


def test_name_cap_of_the_ingest_holds_over_batches(spark, tmp_path):
    """Cap 1: of three names in three batches within five minutes one is stored; later a new window opens."""
    root = str(tmp_path)
    tenants = spark.createDataFrame([(1, "active")], "tenant_id int, status string")
    keys = spark.createDataFrame([(1, 10, None, None)], "tenant_id int, key_id long, revoked_unix_ns long, expires_unix_ns long")
    admit = jobs.Admission(tenants, keys, metric_cap=1)

    def send(batch_id, at_s, name):
        point = {"name": name, "gauge": {"data_points": [{"time_unix_nano": str(at_s * 10**9), "as_double": 1.0}]}}
        body = {"resource_metrics": [{"resource": {"attributes": []}, "scope_metrics": [{"metrics": [point]}]}]}
        line = json.dumps({"tenant_id": 1, "key_id": 10, "received_unix_ns": str(at_s * 10**9), **body})
        jobs.store_batch(otlp.parsed(spark.createDataFrame([(line,)], "value string"), "metrics"), "metrics", root, batch_id, admit)
        return sorted(x.metric_name for x in spark.read.parquet(f"{root}/metric_points").collect())

    send(0, 100_000, "a")
    assert send(1, 100_100, "b") == ["a"]
    assert send(2, 100_200, "c") == ["a"]
    assert send(2, 100_200, "c") == ["a"]
    assert send(3, 100_301, "b") == ["a", "b"]
    assert send(4, 100_400, "a") == ["a", "b"]
    refused = {(x.metric_name, x.batch_id) for x in spark.read.parquet(f"{root}/rejected/metric_points").collect()}
    assert refused == {("b", 1), ("c", 2), ("a", 4)}


def test_spans_of_other_sources_are_out_of_scope(spark, tmp_path):
    def scope(name, kind):
        span = {"trace_id": "ab" * 16, "span_id": "cd" * 8, "name": f"{name}/{kind}", "kind": kind, "start_time_unix_nano": "1", "end_time_unix_nano": "2"}
        return {"scope": None if name is None else {"name": name}, "spans": [span]}

    scopes = [scope(name, kind) for name in ("Shop.Web", "Shop", "Other", None) for kind in (2, 3)]
    body = {"resource_spans": [{"resource": {"attributes": []}, "scope_spans": scopes}]}
    line = json.dumps({"tenant_id": 1, "key_id": 10, "received_unix_ns": "1000", **body})
    tenants = spark.createDataFrame([(1, "active")], "tenant_id int, status string")
    keys = spark.createDataFrame([(1, 10, None, None)], "tenant_id int, key_id long, revoked_unix_ns long, expires_unix_ns long")
    lines = otlp.parsed(spark.createDataFrame([(line,)], "value string"), "spans")
    stored = lambda root: sorted(x.span_name for x in spark.read.parquet(f"{root}/spans").collect())
    for name, options, wanted in (
        ("prefix", {"source_prefixes": ["Shop.", "Oth"]}, ["Other/2", "Other/3", "Shop.Web/2", "Shop.Web/3"]),
        ("both", {"source_prefixes": ["Shop"], "span_kinds": ["SERVER"]}, ["Shop.Web/2", "Shop/2"]),
    ):
        jobs.store_batch(lines, "spans", f"{tmp_path}/{name}", 0, jobs.Admission(tenants, keys, **options))
        assert stored(f"{tmp_path}/{name}") == wanted
        assert "source_name" not in spark.read.parquet(f"{tmp_path}/{name}/spans").columns
        counts = {x.reject_reason: x.accepted + x.rejected for x in spark.read.parquet(f"{tmp_path}/{name}/ingest_quality/rows/spans").collect()}
        assert counts == {"": len(wanted), "out of scope": 8 - len(wanted)}
