"""Trace summaries of a stream, against the batch operator over the same spans."""

import pytest
from pyspark.sql import functions as F

from teleloom.operators import traces
from teleloom.sources import views
from teleloom.streaming import trace_summaries

SF = "/root/testdata/sf0.001"
COLUMNS = [n for n in trace_summaries.NAMES if n != "revision"]


def run(spark, tmp_path, schema, **options):
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    found = trace_summaries.trace_summary_stream(stream, **options)
    writer = found.writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/c").outputMode("append").trigger(availableNow=True)
    writer.start(f"{tmp_path}/out").awaitTermination()
    return spark.read.parquet(f"{tmp_path}/out")


def rows(df, *more):
    return sorted(tuple(tuple(x) if isinstance(x, list) else x for x in r) for r in df.select(*COLUMNS, *more).collect())


SPAN = (
    "tenant_id int, trace_id string, span_id string, parent_span_id string, service_name string, span_kind string, start_time_unix_ns long, "
    "end_time_unix_ns long, duration_ns long, db_system string"
)
S = 10**9


def span(trace, name, at_s, long_s=1, parent="p", service="web", kind="SERVER", db="", tenant=1):
    return (tenant, trace, name, parent, service, kind, at_s * S, (at_s + long_s) * S, long_s * S, db)


def test_traces_of_all_spans(spark, tmp_path):
    """Two thirds of the spans, and after a restart the others in one file with the end of time."""
    spans = views.spans(spark, SF)
    last = spans.agg(F.max("end_time_unix_ns").alias("t")).first()["t"]
    end = spans.limit(1).withColumns({"trace_id": F.lit("end"), "start_time_unix_ns": F.lit(last + 10**15), "end_time_unix_ns": F.lit(last + 10**15)})
    part = F.pmod(F.xxhash64("span_id"), F.lit(3))
    spans.filter(part > 0).repartition(2).write.parquet(f"{tmp_path}/in/0")
    run(spark, tmp_path, spans.schema, idle_s=60, late_s=400 * 86400)
    spans.filter(part == 0).coalesce(1).write.parquet(f"{tmp_path}/in/1")
    run(spark, tmp_path, spans.schema, idle_s=60, late_s=400 * 86400)
    end.coalesce(1).write.parquet(f"{tmp_path}/in/2")
    run(spark, tmp_path, spans.schema, idle_s=60, late_s=400 * 86400)
    end.withColumn("trace_id", F.lit("end2")).coalesce(1).write.parquet(f"{tmp_path}/in/3")
    found = trace_summaries.latest(run(spark, tmp_path, spans.schema, idle_s=60, late_s=400 * 86400))
    wanted = rows(traces.trace_summary(spans))
    assert rows(found.filter(~F.col("trace_id").startswith("end"))) == wanted and len(wanted) > 100


def test_closed_reopened_and_removed(spark, tmp_path):
    t = 1_700_000_000
    files = [
        [span("a", "2", t, kind="CLIENT"), span("a", "3", t + 1, 3, db="redis", service="db", kind="CLIENT"), span("b", "1", t, parent="")],
        [span("clock", "1", t + 200)],  # closes a and b
        [span("clock", "2", t + 201), span("a", "1", t - 5, 9, parent=""), span("a", "0", t - 5, 9, parent="", tenant=2)],  # opens a again
        [span("clock", "3", t + 400)],
        [span("clock", "4", t + 2000)],  # the states of a and b go
        [span("clock", "5", t + 2001)],
        [span("a", "9", t + 10)],  # too late: left out
        [span("clock", "6", t + 2300)],
    ]
    schema = spark.createDataFrame([], SPAN).schema
    for i, some in enumerate(files):
        spark.createDataFrame(some, SPAN).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
        found = run(spark, tmp_path, schema, idle_s=60, late_s=1000)
    found = found.filter("trace_id <> 'clock'")
    assert [(r.tenant_id, r.trace_id, r.revision, r.span_count, r.root_span_id) for r in found.orderBy("tenant_id", "trace_id", "revision").collect()] == [
        (1, "a", 1, 2, None), (1, "a", 2, 3, "1"), (1, "b", 1, 1, "1"), (2, "a", 1, 1, "0"),
    ]
    batch = spark.createDataFrame([r for some in files[:6] for r in some if r[1] != "clock"], SPAN)
    assert rows(trace_summaries.latest(found)) == rows(traces.trace_summary(batch))


@pytest.mark.parametrize("cut", [1, 3, 7])
def test_folding_in_parts_equals_folding_at_once(cut):
    import pandas as pd

    r = __import__("random").Random(cut)
    one = lambda i: (r.randrange(5), r.randrange(5, 9), f"s{i}", r.choice(["", "x", "y", None]), r.randrange(4), *[r.random() < 0.4 for _ in range(4)])
    whole = pd.DataFrame([one(i) for i in range(12)], columns=trace_summaries.SPAN)
    kept = None
    for at in range(0, len(whole), cut):
        kept = trace_summaries.folded(kept, whole[at : at + cut])
    assert kept == trace_summaries.folded(None, whole)


def test_lateness_shorter_than_silence_is_refused(spark):
    with pytest.raises(ValueError):
        trace_summaries.trace_summary_stream(spark.createDataFrame([], SPAN), idle_s=10, late_s=5)
