"""The service map and trace summaries kept by streams, against the batch operators over the same spans."""

import pytest
from pyspark.sql import functions as F

from teleloom.operators import service_map
from teleloom.operators.rollups import SERVICE_MAP_MINUTELY
from teleloom.sources import states, views
from teleloom.streaming import service_edges

SF = "/root/testdata/sf0.001"
START = "start_time_unix_ns"


def plain(df, skip=()):
    columns = sorted(c for c in df.columns if c not in skip)
    return sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.select(columns).collect())


def run(spark, tmp_path, schema, **options):
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    service_edges.service_map_stream(stream, f"{tmp_path}/out", f"{tmp_path}/c", **options).awaitTermination()


def test_kept_map_in_any_order_and_across_a_restart(spark, tmp_path):
    spans = views.spans(spark, SF)
    # Parents of odd traces come a file later than their children, those of even traces a file earlier.
    root = F.col("parent_span_id") == ""
    odd = F.conv(F.substring("trace_id", 17, 16), 10, 10).cast("bigint") % 2 == 1
    turn = F.when(root == odd, 1).otherwise(0)
    for i in (0, 1):
        spans.filter(turn == i).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
        run(spark, tmp_path, spans.schema, watermark="400 days", longest_s=3600)
    kept = states.read_states(spark, SERVICE_MAP_MINUTELY, f"{tmp_path}/out")
    assert plain(service_map.edges_from_states(kept)) == plain(service_map.service_map_edges(spans))
    assert plain(service_map.nodes_from_states(kept), ["latency_ms"]) == plain(service_map.service_map_nodes(spans), ["latency_ms"])
    assert plain(service_map.totals_from_states(kept)) == plain(service_map.service_map_totals(spans))
    assert service_map.edges_from_states(kept).filter("target_kind = 'service'").count() > 5
    # Merging the batches of a month changes nothing.
    before = plain(service_map.edges_from_states(kept))
    assert states.compact(spark, SERVICE_MAP_MINUTELY, f"{tmp_path}/out", 10) > 0
    assert plain(service_map.edges_from_states(states.read_states(spark, SERVICE_MAP_MINUTELY, f"{tmp_path}/out"))) == before


SPAN = (
    "tenant_id int, trace_id string, span_id string, parent_span_id string, service_name string, span_kind string, start_time_unix_ns long, "
    "duration_ns long, status_code string, http_status_code int, http_url string, db_system string"
)


def span(trace, name, parent, service, at_s, tenant=1):
    return (tenant, trace, name, parent, service, "SERVER", at_s * 10**9, 5_000_000, "OK", 200, "", "")


def test_partners_that_are_too_far_or_too_late(spark, tmp_path):
    t = 1_700_000_000 // 60 * 60
    files = [
        [span("a", "1", "", "web", t), span("b", "1", "", "web", t), span("c", "2", "1", "db", t + 10), span("d", "2", "1", "db", t + 9)],
        [span("a", "2", "1", "db", t + 50), span("b", "2", "1", "db", t + 500), span("d", "1", "", "other", t + 9, tenant=2)],
        [span("z", "1", "9", "clock", t + 10_000)],
        [span("y", "1", "9", "clock", t + 10_001)],
        [span("c", "1", "", "web", t)],
    ]
    for i, rows in enumerate(files):
        spark.createDataFrame(rows, SPAN).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
        run(spark, tmp_path, spark.createDataFrame([], SPAN).schema, watermark="10 minutes", longest_s=100, skew_s=1)
    kept = states.read_states(spark, SERVICE_MAP_MINUTELY, f"{tmp_path}/out")
    # a met its parent; b's parent is too long ago; c's parent is late; d's parent belongs to another tenant.
    calls = kept.filter("kind = 'service'").select("tenant_id", "bucket_s", "source", "target", "calls").collect()
    assert [tuple(r) for r in calls] == [(1, t, "web", "db", 1)]
    own = {(r.tenant_id, r.source): r.n for r in kept.filter("kind = 'node'").groupBy("tenant_id", "source").agg(F.sum("calls").alias("n")).collect()}
    assert own == {(1, "web"): 3, (1, "db"): 4, (2, "other"): 1, (1, "clock"): 2}
    batch = service_map.calls(spark.createDataFrame([r for f in files for r in f], SPAN)).filter("kind = 'service'")
    assert batch.count() == 3  # over the whole table a, b and c have their parents


def test_a_batch_again_replaces_its_rows(spark, tmp_path):
    spans = views.spans(spark, SF)
    for _ in range(2):
        states.write_states(service_map.calls(spans), SERVICE_MAP_MINUTELY, str(tmp_path), 0)
    kept = states.read_states(spark, SERVICE_MAP_MINUTELY, str(tmp_path))
    assert plain(service_map.edges_from_states(kept)) == plain(service_map.service_map_edges(spans))


@pytest.mark.parametrize("rows", [[], [span("a", "1", "1", "web", 60)], [span("a", "2", "1", "", 60), span("a", "1", "", "web", 60)]])
def test_calls_without_partners(spark, rows):
    found = service_map.calls(spark.createDataFrame(rows, SPAN))
    assert found.filter("kind <> 'node'").count() == 0
    assert found.filter("kind = 'node'").count() == sum(r[4] != "" for r in rows)
