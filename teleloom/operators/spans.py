"""Span reads: overview, listings, time series, top lists, sparklines and route details.

Latency columns are milliseconds. Without a tenant in the scope every result is keyed by tenant.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from teleloom.functions.attributes import attribute_map
from teleloom.functions.predicates import (
    bounded,
    display_consumer,
    flag,
    is_error_status,
    is_request_error,
    is_server_error,
    is_server_span,
    ratio,
    stored_consumer,
)
from teleloom.functions.quantiles import count_all, count_where, joined_null_safe, largest, summarize, total
from teleloom.functions.ranking import top_n
from teleloom.functions.timing import bucket_seconds, int_div, to_millis, to_seconds
from teleloom.scope import Scope

START = "start_time_unix_ns"
MS = 1_000_000.0
P50_90_99 = {"p50_ms": 0.5, "p90_ms": 0.9, "p99_ms": 0.99}
P50_99 = {"p50_ms": 0.5, "p99_ms": 0.99}


def _duration() -> Column:
    return F.col("duration_ns")


def _scoped(spans: DataFrame, scope: Scope) -> DataFrame:
    return scope.apply(spans, START)


def _only(df: DataFrame, **equals) -> DataFrame:
    """Add an equality filter for every parameter that is set."""
    for column, value in equals.items():
        if value is not None:
            df = df.filter(F.col(column) == value)
    return df


# ---------------------------------------------------------------------------- listing


def list_spans(
    spans: DataFrame,
    scope: Scope = Scope(),
    service: str | None = None,
    kind: str | None = None,
    route: str | None = None,
    consumer: str | None = None,
    errors_only: bool = False,
    cursor_ns: int | None = None,
    limit: int | None = 50,
) -> DataFrame:
    """Newest spans first; ``next_cursor_ns`` is the start to pass as the next page's cursor.

    ``limit`` rows of each tenant, all without one.
    """
    df = _only(
        _scoped(spans, scope),
        service_name=service or None,
        span_kind=kind or None,
        http_route=route or None,
        consumer_id=None if consumer is None else stored_consumer(consumer),
    )
    if errors_only:
        df = df.filter(is_request_error())
    if cursor_ns:
        df = df.filter(F.col(START) < cursor_ns)
    rows = top_n(df, scope, [F.col(START).desc(), F.col("span_id").desc()], bounded(limit, 50))
    # At most the listed rows of each tenant.
    return rows.withColumn("next_cursor_ns", F.min(START).over(Window.partitionBy("tenant_id")))


def search_spans(spans: DataFrame, text: str = "", hide_preflight: bool = True, errors_only: bool = False) -> DataFrame:
    """Case-insensitive search over the descriptive columns."""
    df = spans
    if hide_preflight:
        df = df.filter(F.upper("http_method") != "OPTIONS")
    if errors_only:
        df = df.filter(is_request_error())
    needle = text.strip().lower()
    if needle:
        found = F.lit(False)
        for column in ("http_route", "span_name", "http_url", "service_name", "consumer_id", "db_statement"):
            found = found | F.contains(F.lower(F.coalesce(column, F.lit(""))), F.lit(needle))
        df = df.filter(found)
    return df


def span_sample_kpis(listed: DataFrame) -> DataFrame:
    """Summary of a listed sample (at most 1000 spans per tenant) with nearest-rank percentiles."""
    grouped = listed.groupBy("tenant_id").agg(
        F.count(F.lit(1)).alias("span_count"),
        F.sum(flag(is_server_error())).alias("error_count"),
        F.array_sort(F.collect_list(_duration() / MS)).alias("_sorted"),
    )

    def nearest(q: float) -> Column:
        n = F.col("span_count")
        return F.get("_sorted", F.least(n - 1, F.floor(n * F.lit(q))).cast("int"))

    return grouped.select(
        "tenant_id",
        "span_count",
        "error_count",
        ratio(F.col("error_count"), F.col("span_count")).alias("error_rate"),
        nearest(0.5).alias("p50_ms"),
        nearest(0.95).alias("p95_ms"),
        F.array_max("_sorted").alias("slowest_ms"),
    )


def volume_strip(listed: DataFrame, bins: int = 60) -> DataFrame:
    """Counts over equal-width bins between the first and last start of each tenant's spans."""
    # Spans of the same millisecond are added up before they meet their tenant's frame.
    rows = listed.groupBy("tenant_id", to_millis(F.col(START)).alias("ms")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(flag(is_server_error())).alias("errors")
    )
    frames = listed.groupBy("tenant_id").agg(
        to_millis(F.min(START)).alias("min_ms"),
        F.greatest(F.lit(1).cast("bigint"), to_millis(F.max(START)) - to_millis(F.min(START))).alias("width_ms"),
    )
    spot = F.floor((F.col("ms") - F.col("min_ms")) / F.col("width_ms") * bins)
    counts = (
        rows.join(frames, "tenant_id")
        .groupBy("tenant_id", F.least(F.lit(bins - 1), spot).cast("int").alias("bin"))
        .agg(F.sum("n").alias("span_count"), F.sum("errors").alias("error_count"))
    )
    grid = frames.select("*", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    return grid.join(counts, ["tenant_id", "bin"], "left").select(
        "tenant_id",
        "bin",
        (F.col("min_ms") + (F.col("bin") + 0.5) * F.col("width_ms") / bins).alias("center_ms"),
        F.coalesce("span_count", F.lit(0).cast("bigint")).alias("span_count"),
        F.coalesce("error_count", F.lit(0).cast("bigint")).alias("error_count"),
    )


# ---------------------------------------------------------------------------- labels

# Framework activity names shown with a friendlier text.
FRIENDLY_NAMES = {
    "Microsoft.AspNetCore.Hosting.HttpRequestIn": "HTTP request (no route)",
    "System.Net.Http.HttpRequestOut": "HttpClient call",
}
STATEMENT_CHARS = 140


def _first_set(*columns: Column) -> Column:
    """First value that is neither null nor empty, else ''."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in columns], F.lit(""))


def _host_and_path(url: Column) -> Column:
    """host[:port] + path of an absolute URL, without a default port; other text unchanged."""
    pattern = r"^([A-Za-z][A-Za-z0-9+.\-]*)://(?:[^/?#@]*@)?([^/?#]+)([^?#]*)"
    scheme = F.lower(F.regexp_extract(url, pattern, 1))
    host = F.lower(F.regexp_extract(url, pattern, 2))
    path = F.regexp_extract(url, pattern, 3)
    host = (
        F.when(scheme == "http", F.regexp_replace(host, ":80$", ""))
        .when(scheme == "https", F.regexp_replace(host, ":443$", ""))
        .otherwise(host)
    )
    return F.when(host == "", url).otherwise(F.concat(host, F.when(path == "", "/").otherwise(path)))


def _shortened(text: Column, limit: int) -> Column:
    flat = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.when(F.length(flat) > limit, F.concat(F.substring(flat, 1, limit - 1), F.lit("…"))).otherwise(flat)


def friendly_span_name(name: Column) -> Column:
    out = F.when(name == "", "(unknown)")
    for raw, shown in FRIENDLY_NAMES.items():
        out = out.when(name == raw, shown)
    return out.otherwise(name)


def operation_label(spans: DataFrame) -> DataFrame:
    """Adds ``label_badge`` (database system or HTTP method) and ``label`` to every span."""
    attrs = attribute_map(F.col("attrs_keys"), F.col("attrs_values"))
    attr = lambda key: F.try_element_at(F.col("_attrs"), F.lit(key))
    is_db = F.col("db_system") != ""
    method = _first_set(F.col("http_method"), attr("http.request.method"), attr("http.method"))
    url = _first_set(F.col("http_url"), attr("url.full"))
    path = _first_set(
        F.col("http_route"),
        attr("http.route"),
        attr("url.path"),
        F.when(url != "", _host_and_path(url)),
        friendly_span_name(F.col("span_name")),
    )
    statement = _first_set(_shortened(F.col("db_statement"), STATEMENT_CHARS), F.col("span_name"))
    return (
        spans.withColumn("_attrs", attrs)
        .withColumn("label_badge", F.when(is_db, F.upper("db_system")).otherwise(method))
        .withColumn("label", F.when(is_db, statement).otherwise(path))
        .drop("_attrs")
    )


# ---------------------------------------------------------------------------- aggregates


def overview(spans: DataFrame, scope: Scope = Scope()) -> DataFrame:
    """Totals, server-error rate, latency quantiles and number of services; all span kinds."""
    df = _scoped(spans, scope)
    summary = summarize(
        df,
        ["tenant_id"],
        {"total_spans": count_all(), "error_spans": count_where(is_server_error())},
        _duration(),
        P50_90_99,
        scale=MS,
    )
    services = (
        df.groupBy("tenant_id", "service_name").agg(F.lit(1).alias("one")).groupBy("tenant_id")
        .agg(F.count("one").alias("services"))
    )
    return (
        joined_null_safe(summary, services, ["tenant_id"])
        .withColumn("error_rate", ratio(F.col("error_spans"), F.col("total_spans")))
        .orderBy("tenant_id")
    )


def list_services(spans: DataFrame, scope: Scope = Scope()) -> DataFrame:
    """Per service: latest version seen, volume, errors, latency, last seen."""
    newest = F.struct(F.col(START).alias("ts"), F.col("service_version").alias("version"))
    summary = summarize(
        _scoped(spans, scope),
        ["tenant_id", "service_name"],
        {
            "_newest": largest(newest),
            "span_count": count_all(),
            "error_count": count_where(is_server_error()),
            "last_seen_ns": largest(F.col(START)),
        },
        _duration(),
        P50_90_99,
        scale=MS,
    )
    return (
        summary.withColumn("service_version", F.col("_newest.version"))
        .drop("_newest")
        .withColumn("error_rate", ratio(F.col("error_count"), F.col("span_count")))
        .orderBy("tenant_id", F.col("span_count").desc(), "service_name")
    )


def _timeseries(df: DataFrame, keys: list[str], bucket_s: int) -> DataFrame:
    df = df.withColumn("bucket_s", bucket_seconds(F.col(START), bucket_s if bucket_s > 0 else 60))
    return summarize(
        df,
        [*keys, "bucket_s"],
        {"span_count": count_all(), "error_count": count_where(is_server_error())},
        _duration(),
        P50_90_99,
        scale=MS,
    ).orderBy(*keys, "bucket_s")


def latency_timeseries(
    spans: DataFrame, scope: Scope = Scope(), service: str | None = None, bucket_s: int = 60
) -> DataFrame:
    """Volume, errors and latency per non-empty time bucket."""
    return _timeseries(_only(_scoped(spans, scope), service_name=service), ["tenant_id"], bucket_s)


def top_routes(spans: DataFrame, scope: Scope = Scope(), limit: int | None = 20) -> DataFrame:
    keys = ["service_name", "span_name", "http_method", "http_route"]
    first = lambda rows: top_n(rows, scope, [F.col("span_count").desc(), *keys], bounded(limit, 20))
    summary = summarize(
        _scoped(spans, scope),
        ["tenant_id", *keys],
        {"span_count": count_all(), "error_count": count_where(is_server_error())},
        _duration(),
        P50_90_99,
        scale=MS,
        keep=first,
    )
    return first(summary)


def _database_spans(spans: DataFrame, scope: Scope) -> DataFrame:
    return _scoped(spans, scope).filter(F.col("db_system") != "")


def database_overview(spans: DataFrame, scope: Scope = Scope()) -> DataFrame:
    """Database spans only; errors are ERROR status alone."""
    df = _database_spans(spans, scope)
    summary = summarize(
        df,
        ["tenant_id"],
        {
            "total_queries": count_all(),
            "error_queries": count_where(is_error_status()),
            "_total_ns": total(_duration()),
        },
        _duration(),
        P50_90_99,
        scale=MS,
    )
    systems = (
        df.groupBy("tenant_id", "db_system").agg(F.lit(1).alias("one")).groupBy("tenant_id")
        .agg(F.count("one").alias("distinct_systems"))
    )
    return (
        joined_null_safe(summary, systems, ["tenant_id"])
        .withColumn("error_rate", ratio(F.col("error_queries"), F.col("total_queries")))
        .withColumn("total_db_ms", F.col("_total_ns") / MS)
        .drop("_total_ns")
        .orderBy("tenant_id")
    )


def top_queries(spans: DataFrame, scope: Scope = Scope(), limit: int | None = 20) -> DataFrame:
    """Database statements grouped by system and the first 200 characters of the statement."""
    df = _database_spans(spans, scope).filter(F.col("db_statement") != "")
    order = [F.col("query_count").desc(), F.col("db_system"), F.col("query_template")]
    first = lambda rows: top_n(rows, scope, order, bounded(limit, 20))
    summary = summarize(
        df.withColumn("query_template", F.substring("db_statement", 1, 200)),
        ["tenant_id", "db_system", "query_template"],
        {
            "query_count": count_all(),
            "error_count": count_where(is_error_status()),
            "_total_ns": total(_duration()),
        },
        _duration(),
        P50_90_99,
        scale=MS,
        keep=first,
    )
    return first(summary.withColumn("total_ms", F.col("_total_ns") / MS).drop("_total_ns"))


def db_system_breakdown(spans: DataFrame, scope: Scope = Scope()) -> DataFrame:
    return summarize(
        _database_spans(spans, scope),
        ["tenant_id", "db_system"],
        {"query_count": count_all()},
        _duration(),
        P50_99,
        scale=MS,
    ).orderBy("tenant_id", F.col("query_count").desc(), "db_system")


# ---------------------------------------------------------------------------- sparklines


def _sparklines(df: DataFrame, key: str, scope: Scope, buckets: int, failed: Column) -> DataFrame:
    """Fixed-length count and error arrays per key over equal slices of the scope's range."""
    if not 1 <= buckets <= 200:
        buckets = 30
    width = max(1, max(1, int(scope.seconds_long)) // buckets)
    slot = int_div(to_seconds(F.col(START)) - scope.start_s, width)
    slots = (
        df.withColumn("_slot", F.least(slot, F.lit(buckets - 1)).cast("int"))
        .filter(F.col("_slot") >= 0)
        .groupBy("tenant_id", key, "_slot")
        .agg(F.count(F.lit(1)).alias("_c"), F.sum(flag(failed)).alias("_e"))
    )
    per_key = slots.groupBy("tenant_id", key).agg(
        F.map_from_entries(F.collect_list(F.struct("_slot", "_c"))).alias("_counts"),
        F.map_from_entries(F.collect_list(F.struct("_slot", "_e"))).alias("_errors"),
        F.sum("_c").alias("total"),
    )

    def filled(by_slot: str) -> Column:
        zero = F.lit(0).cast("bigint")
        return F.transform(
            F.sequence(F.lit(0), F.lit(buckets - 1)),
            lambda i: F.coalesce(F.try_element_at(F.col(by_slot), i), zero),
        )

    return per_key.select(
        "tenant_id", key, filled("_counts").alias("counts"), filled("_errors").alias("errors"), "total"
    )


def service_sparklines(spans: DataFrame, scope: Scope, buckets: int = 30) -> DataFrame:
    lines = _sparklines(_scoped(spans, scope), "service_name", scope, buckets, is_server_error())
    return lines.orderBy("tenant_id", F.col("total").desc(), "service_name")


def consumer_sparklines(spans: DataFrame, scope: Scope, buckets: int = 30, limit: int | None = 200) -> DataFrame:
    """Server spans of the most active consumers; an empty consumer shows as anonymous."""
    served = _scoped(spans, scope).filter(is_server_span())
    lines = _sparklines(served, "consumer_id", scope, buckets, is_request_error())
    lines = top_n(lines, scope, [F.col("total").desc(), F.col("consumer_id")], bounded(limit, 200))
    return lines.withColumn("consumer_id", display_consumer(F.col("consumer_id")))


# ---------------------------------------------------------------------------- one route, or all

ROUTE_KEYS = ["tenant_id", "service_name", "http_route"]


def _route_spans(spans: DataFrame, scope: Scope, service: str | None, route: str | None) -> DataFrame:
    return _only(_scoped(spans, scope).filter(is_server_span()), service_name=service, http_route=route)


def route_summary(
    spans: DataFrame, scope: Scope, service: str | None = None, route: str | None = None
) -> DataFrame:
    """Volume, errors, dominant method and latency per route; no row where there is no traffic."""
    df = _route_spans(spans, scope, service, route)
    summary = summarize(
        df,
        ROUTE_KEYS,
        {"total": count_all(), "errors": count_where(is_server_error())},
        _duration(),
        {"p50_ms": 0.5, "p75_ms": 0.75, "p95_ms": 0.95, "p99_ms": 0.99},
        scale=MS,
    )
    by_method = df.groupBy(*ROUTE_KEYS, "http_method").agg(F.count(F.lit(1)).alias("n"))
    dominant = by_method.groupBy(*ROUTE_KEYS).agg(F.max(F.struct("n", "http_method")).alias("m"))
    minutes = max(1 / 60, scope.seconds_long / 60)
    return (
        joined_null_safe(summary, dominant, ROUTE_KEYS)
        .withColumn("http_method", F.col("m.http_method"))
        .drop("m")
        .withColumn("error_rate", ratio(F.col("errors"), F.col("total")))
        .withColumn("requests_per_minute", F.col("total") / F.lit(minutes))
    )


def route_timeseries(
    spans: DataFrame, scope: Scope = Scope(), service: str | None = None, route: str | None = None, bucket_s: int = 60
) -> DataFrame:
    return _timeseries(_route_spans(spans, scope, service, route), ROUTE_KEYS, bucket_s)


# Latency histogram range, as powers of two of a millisecond.
LOWEST_POWER, HIGHEST_POWER, LEAST_MS = -4, 14, 0.0001


def latency_power(duration_ns: Column) -> Column:
    """Largest power of two not above the latency in ms, limited to the histogram range."""
    ms = F.greatest(duration_ns / MS, F.lit(LEAST_MS))
    guess = F.floor(F.log2(ms))
    # The logarithm can be off by one unit in the last place at exact powers.
    exact = (
        F.when(F.pow(F.lit(2.0), guess + 1) <= ms, guess + 1)
        .when(F.pow(F.lit(2.0), guess) > ms, guess - 1)
        .otherwise(guess)
    )
    return F.greatest(F.lit(LOWEST_POWER), F.least(F.lit(HIGHEST_POWER), exact)).cast("int")


def route_latency_histogram(
    spans: DataFrame, scope: Scope = Scope(), service: str | None = None, route: str | None = None
) -> DataFrame:
    """Non-empty power-of-two latency buckets [lower, upper) per route."""
    return (
        _route_spans(spans, scope, service, route)
        .groupBy(*ROUTE_KEYS, latency_power(_duration()).alias("power"))
        .agg(F.count(F.lit(1)).alias("span_count"))
        .withColumn("lower_ms", F.pow(F.lit(2.0), F.col("power")))
        .withColumn("upper_ms", F.pow(F.lit(2.0), F.col("power") + 1))
        .orderBy(*ROUTE_KEYS, "power")
    )
