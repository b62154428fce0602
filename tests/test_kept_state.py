"""Streams that keep a small state, against the batch operators over the same rows and across restarts."""

import random

import pytest
from pyspark.sql import functions as F

from teleloom.operators import counters, tenants
from teleloom.sources import views
from teleloom.streaming import host_rates, registry

SF = "/root/testdata/sf0.001"
TIME = "time_unix_ns"
CASES = {
    "cpu": (views.cpu_counters, counters.host_cpu_utilization, host_rates.host_cpu_stream),
    "disks": (views.disk_counters, counters.disk_counter_rates, host_rates.disk_rates_stream),
    "networks": (views.network_counters, counters.network_counter_rates, host_rates.network_rates_stream),
    "processes": (views.process_counters, counters.process_cpu_topn, host_rates.process_topn_stream),
}


@pytest.mark.parametrize("name", list(CASES))
def test_host_rates_as_samples_arrive(spark, tmp_path, name):
    """Two runs of the stream, the second with a late sample of every host that is left out."""
    view, batch, stream = CASES[name]
    rows = view(spark, SF)
    hosts = sorted({r.host_id for r in rows.select("host_id").distinct().collect()})[:2]
    rows = rows.filter(F.col("host_id").isin(hosts))
    times = sorted(r[TIME] for r in rows.select(TIME).distinct().collect())[:40]
    rows = rows.filter(F.col(TIME) <= times[-1]).cache()
    halves = [rows.filter(F.col(TIME) <= times[len(times) // 2]), rows.filter(F.col(TIME) > times[len(times) // 2])]
    first = rows.groupBy("tenant_id", "host_id").agg(F.min(TIME).alias(TIME))
    late = rows.join(first, ["tenant_id", "host_id", TIME]).select(rows.columns)
    for i, part in enumerate([halves[0], halves[1].unionByName(late)]):
        part.coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
        found = stream(spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in/*"))
        found.writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/c").outputMode("append").trigger(availableNow=True).start(
            f"{tmp_path}/out"
        ).awaitTermination()
    wanted = batch(rows)
    got = spark.read.parquet(f"{tmp_path}/out").select(wanted.columns)
    clean = lambda df: sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.collect())
    assert clean(got) == clean(wanted) and got.count() > 10
    rows.unpersist()


def test_registry_in_any_order_and_again(spark, tmp_path):
    r = random.Random(4)
    schema = "tenant_id int, service_name string, service_version string, start_time_unix_ns long"
    batches = [[(r.randrange(3), r.choice("abcdefgh"), f"v{r.randrange(9)}", r.randrange(1000)) for _ in range(12)] for _ in range(6)]
    batches[2] = []
    root = str(tmp_path / "registry")
    for i, batch in enumerate(batches):
        for _ in range(2):  # a batch run again changes nothing
            registry.store_registry(spark.createDataFrame(batch, schema), root, i, buckets=4)
    whole = spark.createDataFrame([x for b in batches for x in b], schema)
    columns = ["tenant_id", "service_name", "service_version", "first_seen_ns", "last_seen_ns"]
    rows = lambda df: sorted(map(tuple, df.select(columns).collect()))
    assert rows(registry.read_registry(spark, root)) == rows(tenants.upsert_service_registry(whole))
    # Replaying an old batch by itself, and a late batch, move nothing backwards.
    newest = {(x.tenant_id, x.service_name): (x.last_seen_ns, x.service_version) for x in registry.read_registry(spark, root).collect()}
    registry.store_registry(spark.createDataFrame([(t, s, "old", -5) for t, s in newest], schema), root, 6, buckets=4)
    after = registry.read_registry(spark, root).collect()
    assert {(x.tenant_id, x.service_name): (x.last_seen_ns, x.service_version) for x in after} == newest
    assert {x.first_seen_ns for x in after} == {-5}
    assert len(list(tmp_path.glob("registry/bucket=*/batch_id=*"))) <= 4 * registry.VERSIONS


def test_registry_stream(spark, tmp_path):
    spans = views.spans(spark, SF).select("tenant_id", "service_name", "service_version", "start_time_unix_ns")
    spans.repartition(3).write.parquet(f"{tmp_path}/in")
    for _ in range(2):
        stream = spark.readStream.schema(spans.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        registry.registry_stream(stream, f"{tmp_path}/registry", f"{tmp_path}/c").awaitTermination()
    got = registry.read_registry(spark, f"{tmp_path}/registry")
    wanted = tenants.upsert_service_registry(spans).select(got.columns)
    assert got.count() == wanted.count() and got.exceptAll(wanted).count() == 0
