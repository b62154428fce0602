"""The flatten queries shuffle text or narrow rows, and read their batches once."""

import contextlib
import io

from pyspark.sql import functions as F
from teleloom.operators import ingest
from teleloom.plans import QUERIES
from teleloom.sources import nested_views, otlp

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain("simple")
    return out.getvalue()


def test_records_are_text_before_they_are_grouped(spark):
    for lines in (nested_views.span_lines, nested_views.metric_lines, nested_views.host_lines):
        grouped = [line for line in plan(lines(spark, SF)).splitlines() if "collect_list" in line]
        assert grouped and not any("collect_list(struct(" in line for line in grouped)


def test_spans_are_shuffled_once(spark):
    assert plan(nested_views.span_lines(spark, SF)).count("Exchange") == 1


def test_snapshots_are_parsed_in_one_pass(spark):
    assert plan(QUERIES["flatten_host_snapshots"](spark, SF)).count("lineitem.parquet") == 1


def test_snapshot_counts_are_those_of_the_tables(spark):
    values = [
        '{"tenant_id":1,"snapshots":[{"disks":[{"device":"a"},null],"networks":[]},{"processes":[{"pid":1}]},null]}',
        '{"tenant_id":2,"snapshots":[{}]}', '{"tenant_id":3,"snapshots":[]}', '{"tenant_id":4}', '{"snapshots":[{"disks":[{}]}]}', "{",
    ]
    batches = otlp.parsed(spark.createDataFrame([(v,) for v in values], "value string"), "host")
    counted = {(r.table_name, r.tenant_id, r.row_count) for r in ingest.host_snapshot_counts(batches).collect()}
    tables = ingest.flatten_host_snapshots(batches)
    assert counted == {
        (name, r.tenant_id, r["count"]) for name, rows in tables.items() for r in rows.groupBy("tenant_id").agg(F.count(F.lit(1)).alias("count")).collect()
    }
    assert ("host_disks", 1, 2) in counted and ("host_disks", None, 1) in counted


def test_snapshots_are_flattened_before_they_are_counted(spark):
    # Every column of every table is there in the plan that makes the counts, with its rule for missing values.
    spark.conf.set("spark.sql.debug.maxToStringFields", "200")
    try:
        text = plan(QUERIES["flatten_host_snapshots"](spark, SF))
        batches = otlp.parsed(nested_views.host_lines(spark, SF), "host")
    finally:
        spark.conf.unset("spark.sql.debug.maxToStringFields")
    made = "".join(line for line in text.splitlines() if "from_json" not in line)
    for table, rows in ingest.flatten_host_snapshots(batches).items():
        assert f"partial_count({table}#" in made
        for column in set(rows.columns) - {"tenant_id", "event_date", "time_unix_ns", *ingest.HOST_KEYS}:
            assert f", {column}, coalesce(" in made or f", {column}, greatest(" in made, f"{table}: {column}"
    assert "element_at(_map#" in made and all(f", {key}, None" in made for key in ingest.HOST_KEYS.values())


def test_rows_made_in_one_pass_are_those_of_the_tables(spark):
    values = [
        '{"tenant_id":1,"snapshots":[{"resource":{"attributes":[{"key":"host.id","value":{"string_value":"h"}},{"key":"os.type","value":'
        '{"int_value":"5"}}]},"time_unix_nano":"1704067200000000123","cpu":{"logical_cores":70000,"load_1m":0.5},"memory":{"used_bytes":"7"},'
        '"disks":[{"device":"a","total_bytes":"9"},null,{"device":"b","used_bytes":"x"}],"networks":[{"interface_name":"e","rx_errors":"2"}],'
        '"processes":[null,{"pid":1,"user":"u","cpu_utilization":0.25}]},{"processes":[{"pid":2},{"pid":2}],"networks":[]},null]}',
        '{"tenant_id":2,"snapshots":[{},{"disks":[null]}]}', '{"tenant_id":3,"snapshots":[]}', '{"tenant_id":4}',
        '{"snapshots":[{"time_unix_nano":"-1","disks":[{}]}]}', "{",
    ]
    batches = otlp.parsed(spark.createDataFrame([(v,) for v in values], "value string"), "host")
    made = ingest.host_snapshot_rows(batches)
    for table, rows in ingest.flatten_host_snapshots(batches).items():
        of_table = made.filter(F.col(table).isNotNull()).select(f"{table}.*")
        assert of_table.columns == rows.columns and of_table.dtypes == rows.dtypes
        assert sorted(map(str, of_table.collect())) == sorted(map(str, rows.collect())) and rows.count() > 0
