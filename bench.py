"""Times the headline queries and prints one JSON line.

Every query runs over the whole tables into a no-op sink; the best of three runs counts. The ingest
entry reads span batches from JSON files written beforehand and flattens them; the store entry, run once,
also writes facts and rollups.
BENCH_SF_DIR and BENCH_CPUS choose the data and the number of cores; BENCH_QUERIES (comma-separated,
or ``all``) other queries.
"""

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from teleloom.operators import ingest  # noqa: E402
from teleloom.plans import QUERIES  # noqa: E402
from teleloom.session import local_session  # noqa: E402
from teleloom.sources import nested_views, otlp, views  # noqa: E402
from teleloom.streaming import jobs  # noqa: E402

HEADLINE = [
    "overview",
    "list_services",
    "latency_timeseries",
    "top_routes",
    "top_queries",
    "list_spans",
    "service_sparklines",
    "route_summary",
    "trace_summary",
    "service_map_service_edges",
    "service_map",
    "rollup_consumer_hourly",
    "list_consumers",
    "route_status_breakdown",
    "list_logs",
    "log_volume_timeseries",
    "metric_series",
    "host_utilization",
    "disk_counter_rates",
    "profile_top_frames",
    "evaluate_rules",
]
RUNS = 3


def best(run) -> float:
    """Seconds of the fastest of a few runs."""
    taken = []
    for _ in range(RUNS):
        start = time.perf_counter()
        run().write.format("noop").mode("overwrite").save()
        taken.append(time.perf_counter() - start)
    return round(min(taken), 3)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    wanted = os.environ.get("BENCH_QUERIES", "")
    names = list(QUERIES) if wanted == "all" else wanted.split(",") if wanted else HEADLINE
    cores = int(cpus) if cpus.isdigit() else 8
    spark = local_session(cpus, "teleloom-bench", shuffle_partitions=cores)
    seconds = {name: best(lambda: QUERIES[name](spark, sf_dir)) for name in names}
    extra = {}
    if not wanted:
        lines = os.path.join(tempfile.mkdtemp(prefix="teleloom-bench-"), "spans")
        nested_views.span_lines(spark, sf_dir).repartition(cores).write.text(lines)
        seconds["ingest_spans_from_files"] = best(
            lambda: ingest.flatten_spans(otlp.read_batches(spark, lines, "spans"))
        )
        count = views.spans(spark, sf_dir).count()
        extra["ingest_spans_per_sec"] = round(count / seconds["ingest_spans_from_files"])
        # The whole path of a batch: admission left open, facts and three rollups written to Parquet.
        requests = otlp.read_batches(spark, lines, "spans")
        start = time.perf_counter()
        jobs.store_batch(requests, "spans", tempfile.mkdtemp(prefix="teleloom-bench-"), 0)
        seconds["store_spans_batch"] = round(time.perf_counter() - start, 3)
        extra["stored_requests_per_sec"] = round(requests.count() / seconds["store_spans_batch"])
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")),
                **extra,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
