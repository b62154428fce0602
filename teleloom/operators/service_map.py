"""Service dependency graph: nodes, three kinds of edges, and totals."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from teleloom.functions.predicates import flag, is_error_status, is_server_error
from teleloom.functions.quantiles import count_all, count_where, summarize
from teleloom.operators.rollups import SERVICE_MAP_MINUTELY, latency_ms, merge
from teleloom.scope import Scope

START = "start_time_unix_ns"
MS = 1_000_000.0


def _id(kind: str, name: str | Column) -> Column:
    return F.concat(F.lit(kind + ":"), F.col(name) if isinstance(name, str) else name)


def service_nodes(spans: DataFrame, scope: Scope = Scope()) -> DataFrame:
    df = scope.apply(spans, START).filter(F.col("service_name") != "")
    return summarize(
        df,
        ["tenant_id", "service_name"],
        {"calls": count_all(), "errors": count_where(is_server_error())},
        F.col("duration_ns"),
        {"p50_ms": 0.5},
        scale=MS,
    )


def _edge(df: DataFrame, keys: list[str], failed: Column) -> DataFrame:
    grouped = df.groupBy("tenant_id", *keys).agg(
        F.count(F.lit(1)).alias("calls"),
        F.sum(flag(failed)).alias("errors"),
        F.sum("duration_ns").alias("_ns"),
    )
    return grouped.withColumn("avg_ms", F.col("_ns") / F.col("calls") / MS).drop("_ns")


PARENT_KEY = ["tenant_id", "trace_id", "span_id"]
Pair = Callable[[DataFrame, DataFrame], DataFrame]


def by_key(child: DataFrame, parent: DataFrame) -> DataFrame:
    """Child spans with the ``source`` of their parent. The key holds the span id, so one huge trace still
    spreads over all reducers."""
    return child.join(parent.drop(START), PARENT_KEY)


def _between(spans: DataFrame, scope: Scope, pair: Pair) -> DataFrame:
    """Spans of one service that another one called, with ``source`` and ``target``.

    Both sides are cut to the scope and to the needed columns before they are paired.
    """
    df = scope.apply(spans, START).filter(F.col("service_name") != "")
    child = df.filter(F.col("parent_span_id") != "").select(
        "tenant_id",
        "trace_id",
        F.col("parent_span_id").alias("span_id"),
        F.col("service_name").alias("target"),
        START,
        "status_code",
        "http_status_code",
        "duration_ns",
    )
    parent = df.select(*PARENT_KEY, START, F.col("service_name").alias("source"))
    return pair(child, parent).filter(F.col("source") != F.col("target"))


def service_edges(spans: DataFrame, scope: Scope = Scope()) -> DataFrame:
    """Calls between different services, from child spans joined to their parents."""
    return _edge(_between(spans, scope, by_key), ["source", "target"], is_server_error())


def _outbound(spans: DataFrame, scope: Scope) -> DataFrame:
    """Spans that call a database or, over HTTP, another host, with the ``kind`` and ``target`` of the call.

    A span calls one of them at most, so that both kinds of edges come from one pass.
    """
    df = scope.apply(spans, START).filter(F.col("service_name") != "")
    outside = (F.col("span_kind") == "CLIENT") & (F.col("http_url") != "")
    database = F.col("db_system") != ""
    host = F.when(outside, F.try_parse_url("http_url", F.lit("HOST")))
    target = F.when(database, F.col("db_system")).otherwise(host)
    kind = F.when(database, "database").otherwise("external")
    failed = F.when(database, is_error_status()).otherwise(is_server_error())
    return df.select("*", kind.alias("kind"), target.alias("target"), failed.alias("_failed"))


def outbound_edges(spans: DataFrame, scope: Scope = Scope()) -> DataFrame:
    """Calls by service, kind and target; database calls fail by their status alone."""
    calls = _outbound(spans, scope).filter(F.coalesce("target", F.lit("")) != "")
    return _edge(calls, ["kind", "service_name", "target"], F.col("_failed"))


def database_edges(spans: DataFrame, scope: Scope = Scope()) -> DataFrame:
    found = outbound_edges(spans.filter(F.col("db_system") != ""), scope).filter(F.col("kind") == "database")
    return found.drop("kind").withColumnRenamed("target", "db_system")


def external_edges(spans: DataFrame, scope: Scope = Scope()) -> DataFrame:
    """Outbound HTTP calls by target host."""
    found = outbound_edges(spans.filter(F.col("db_system") == ""), scope).filter(F.col("kind") == "external")
    return found.drop("kind").withColumnRenamed("target", "host")


PREFIX = {"service": "svc", "database": "db", "external": "ext"}


def _target_id(kind: Column, target: Column) -> Column:
    prefix = F.when(kind == "database", PREFIX["database"]).otherwise(PREFIX["external"])
    return F.concat_ws(":", prefix, target)


def service_map_edges(spans: DataFrame, scope: Scope = Scope()) -> DataFrame:
    """All edges with ``svc:``/``db:``/``ext:`` node ids and the kind of the target."""
    between = service_edges(spans, scope).select(
        "tenant_id",
        _id("svc", "source").alias("source_id"),
        _id("svc", "target").alias("target_id"),
        F.lit("service").alias("target_kind"),
        F.col("target").alias("target_label"),
        "calls",
        "errors",
        "avg_ms",
    )
    outward = outbound_edges(spans, scope).select(
        "tenant_id",
        _id("svc", "service_name").alias("source_id"),
        _target_id(F.col("kind"), F.col("target")).alias("target_id"),
        F.col("kind").alias("target_kind"),
        F.col("target").alias("target_label"),
        "calls",
        "errors",
        "avg_ms",
    )
    return between.unionByName(outward)


def service_map_nodes(spans: DataFrame, scope: Scope = Scope()) -> DataFrame:
    """All graph nodes. Database and external nodes add up their edges; their latency is the
    call-weighted mean."""
    services = service_nodes(spans, scope).select(
        "tenant_id",
        _id("svc", "service_name").alias("node_id"),
        F.col("service_name").alias("label"),
        F.lit("service").alias("kind"),
        "calls",
        "errors",
        F.col("p50_ms").alias("latency_ms"),
    )

    targets = outbound_edges(spans, scope).groupBy("tenant_id", "kind", F.col("target").alias("label")).agg(
        F.sum("calls").alias("calls"),
        F.sum("errors").alias("errors"),
        (F.sum(F.col("avg_ms") * F.col("calls")) / F.sum("calls")).alias("latency_ms"),
    )
    return services.unionByName(targets.withColumn("node_id", _target_id(F.col("kind"), F.col("label"))))


def service_map_totals(spans: DataFrame, scope: Scope = Scope()) -> DataFrame:
    """Node counts by kind and the edge count of each tenant.

    One pass gives the services and their targets; only the edges between services take a join.
    """
    service = F.struct(F.lit("service").alias("kind"), F.lit("").alias("source"), F.col("service_name").alias("name"))
    called = F.struct("kind", F.col("service_name").alias("source"), F.col("target").alias("name"))
    touched = F.filter(F.array(service, called), lambda x: F.coalesce(x["name"], F.lit("")) != "")
    pairs = _outbound(spans, scope).select("tenant_id", F.explode(touched).alias("t")).select("tenant_id", "t.*").distinct()
    names = pairs.groupBy("tenant_id", "kind", "name").agg(F.count(F.lit(1)).alias("n"))
    counted = lambda kind: F.sum(flag(F.col("kind") == kind))
    per_kind = names.groupBy("tenant_id").agg(
        counted("service").alias("services"),
        counted("database").alias("databases"),
        counted("external").alias("external"),
        F.sum(F.when(F.col("kind") != "service", F.col("n")).otherwise(0)).alias("_outward"),
    )
    between = service_edges(spans, scope).groupBy("tenant_id").agg(F.count(F.lit(1)).alias("_between"))
    edges = F.col("_outward") + F.coalesce("_between", F.lit(0).cast("bigint"))
    return per_kind.join(between, "tenant_id", "left").withColumn("edges", edges).drop("_outward", "_between")


# ---------------------------------------------------------------------------- kept states

CALL = ["tenant_id", START, "kind", "source", "target", "failed", "duration_ns"]


def calls(spans: DataFrame, scope: Scope = Scope(), pair: Pair = by_key) -> DataFrame:
    """The facts of the service map, for ``rollups.SERVICE_MAP_MINUTELY``.

    ``kind`` is ``node`` for a service's own span, else the kind of what was called: ``service``, ``database`` or
    ``external``. A call has the time of the called span, or of the span that calls out.
    """
    named = scope.apply(spans, START).filter(F.col("service_name") != "")
    nodes = named.select("*", F.lit("node").alias("kind"), F.col("service_name").alias("source"), F.lit("").alias("target"))
    between = _between(spans, scope, pair).withColumn("kind", F.lit("service"))
    outward = _outbound(spans, scope).filter(F.coalesce("target", F.lit("")) != "").withColumnRenamed("service_name", "source")
    inside = [x.withColumn("failed", is_server_error()).select(*CALL) for x in (nodes, between)]
    return inside[0].unionByName(inside[1]).unionByName(outward.withColumn("failed", F.col("_failed")).select(*CALL))


def _merged(states: DataFrame, scope: Scope) -> DataFrame:
    found = merge(SERVICE_MAP_MINUTELY, scope.apply_bucket(states, "bucket_s"), ["tenant_id", "kind", "source", "target"])
    return found.withColumn("avg_ms", F.col("total_ns") / F.col("calls") / MS)


def edges_from_states(states: DataFrame, scope: Scope = Scope()) -> DataFrame:
    """``service_map_edges`` read from kept states.

    A scope takes whole minutes of the called spans. The parent of a call may lie outside of it, whereas the read over
    spans wants both inside.
    """
    to_service = F.col("kind") == "service"
    return _merged(states, scope).filter(F.col("kind") != "node").select(
        "tenant_id",
        _id("svc", "source").alias("source_id"),
        F.when(to_service, _id("svc", "target")).otherwise(_target_id(F.col("kind"), F.col("target"))).alias("target_id"),
        F.col("kind").alias("target_kind"),
        F.col("target").alias("target_label"),
        "calls",
        "errors",
        "avg_ms",
    )


def nodes_from_states(states: DataFrame, scope: Scope = Scope()) -> DataFrame:
    """``service_map_nodes`` read from kept states; the latency of services is a nearest rank, at most 0.4 % off."""
    merged = _merged(states, scope)
    services = merged.filter(F.col("kind") == "node").select(
        "tenant_id",
        _id("svc", "source").alias("node_id"),
        F.col("source").alias("label"),
        F.lit("service").alias("kind"),
        "calls",
        "errors",
        *latency_ms({"latency_ms": 0.5}),
    )
    called = merged.filter(F.col("kind").isin("database", "external")).groupBy("tenant_id", "kind", F.col("target").alias("label"))
    targets = called.agg(
        F.sum("calls").alias("calls"), F.sum("errors").alias("errors"), (F.sum("total_ns") / F.sum("calls") / MS).alias("latency_ms")
    )
    return services.unionByName(targets.withColumn("node_id", _target_id(F.col("kind"), F.col("label"))))


def totals_from_states(states: DataFrame, scope: Scope = Scope()) -> DataFrame:
    """``service_map_totals`` read from kept states: distinct nodes and edges are distinct keys of the states.

    Keys are made distinct before anything is counted, so that a tenant's minutes combine in the map tasks.
    """
    keys = scope.apply_bucket(states, "bucket_s").select("tenant_id", "kind", "source", "target").distinct()
    target = F.when(F.col("kind") == "node", F.col("source")).when(F.col("kind") != "service", F.col("target"))
    of = lambda kind: F.count_distinct(F.when(F.col("kind") == kind, target))
    return keys.groupBy("tenant_id").agg(
        of("node").alias("services"),
        of("database").alias("databases"),
        of("external").alias("external"),
        F.sum(flag(F.col("kind") != "node")).alias("edges"),
    )
