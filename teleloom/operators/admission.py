"""What is let in: tenants and keys, metric-name caps, sampling, capture scope, consumer identity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from teleloom.functions.ranking import top_n_by
from teleloom.functions.timing import int_div

# Fixed values of the metric-name cap.
METRIC_NAME_CAP = 2000
CAP_WINDOW_S = 300
NS = 1_000_000_000


def metric_cardinality_guard(
    points: DataFrame, cap: int = METRIC_NAME_CAP, window_s: int = CAP_WINDOW_S, time_col: str = "time_unix_ns"
) -> DataFrame:
    """Adds ``admitted``: at most ``cap`` distinct metric names per tenant and window, first seen first.

    For one table of points: windows are aligned to the epoch. A stream opens them at the first arrival and carries
    the names from batch to batch (``streaming.cardinality``).
    Names are cut to ``cap`` in every task before the shuffle, and admitted names join back by
    (tenant, window, name).
    """
    rows = points.withColumn("_window", int_div(F.col(time_col), window_s * NS))
    names = rows.groupBy("tenant_id", "_window", "metric_name").agg(F.min(time_col).alias("_first"))
    admitted = top_n_by(names, ["tenant_id", "_window"], [F.col("_first"), F.col("metric_name")], cap)
    admitted = admitted.select("tenant_id", "_window", "metric_name", F.lit(True).alias("_in"))
    joined = rows.join(admitted, ["tenant_id", "_window", "metric_name"], "left")
    return joined.withColumn("admitted", F.coalesce("_in", F.lit(False))).drop("_in", "_window")


def admit_by_tenant(
    batches: DataFrame, tenants: DataFrame, api_keys: DataFrame, as_of_ns: Column
) -> DataFrame:
    """Adds ``admitted``: the tenant is active and the key is its own, not revoked and not expired.

    Valid keys are looked up for the distinct (tenant, key) of the batches and joined back by these.
    """
    good_keys = api_keys.filter(F.col("revoked_unix_ns").isNull()).select(
        "tenant_id", "key_id", F.col("expires_unix_ns").alias("_expires"), F.lit(True).alias("_known")
    )
    active = tenants.filter(F.col("status") == "active").select("tenant_id")
    used = batches.select("tenant_id", "key_id").distinct()
    valid = used.join(good_keys, ["tenant_id", "key_id"]).join(active, "tenant_id", "left_semi")
    joined = batches.join(valid, ["tenant_id", "key_id"], "left")
    fresh = F.col("_expires").isNull() | (F.col("_expires") > as_of_ns)
    return joined.withColumn("admitted", F.coalesce(F.col("_known") & fresh, F.lit(False))).drop("_expires", "_known")


def ingest_quality_counts(outcomes: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Accepted and rejected records by reason; ``reject_reason`` is null for accepted ones."""
    reason = F.coalesce("reject_reason", F.lit(""))
    return outcomes.groupBy(*(keys or ["tenant_id"]), reason.alias("reject_reason")).agg(
        F.sum(F.when(reason == "", 1).otherwise(0)).alias("accepted"),
        F.sum(F.when(reason != "", 1).otherwise(0)).alias("rejected"),
    )


def sample_traces(spans: DataFrame, ratio: float, parent_flags: str | None = None) -> DataFrame:
    """Head sampling by trace: the low 64 bits of the trace id, unsigned, below ``ratio``.

    With ``parent_flags`` (a column of trace flags received from the caller) spans that continue a
    trace follow its recorded bit instead.
    """
    if ratio >= 1:
        keep = F.lit(True)
    elif ratio <= 0:
        keep = F.lit(False)
    else:
        threshold = int(ratio * float(2**64 - 1))
        low_bits = F.conv(F.substring("trace_id", 17, 16), 16, 10).cast("decimal(20,0)")
        keep = low_bits < F.lit(str(threshold)).cast("decimal(20,0)")
    if parent_flags is not None:
        recorded = F.col(parent_flags).bitwiseAND(1) != 0
        keep = F.when(F.col(parent_flags).isNotNull(), recorded).otherwise(keep)
    return spans.filter(keep)


def in_capture_scope(kinds: list[str] | None = None, prefixes: list[str] | None = None, source: str = "source_name") -> Column:
    """Whether a span is of one of the kinds and its source starts with one of the prefixes; empty lists mean all."""
    inside = F.lit(True)
    if kinds:
        inside = inside & F.coalesce(F.col("span_kind").isin(kinds), F.lit(False))
    if prefixes:
        wanted = F.lit(False)
        for prefix in prefixes:
            wanted = wanted | F.startswith(F.coalesce(F.col(source), F.lit("")), F.lit(prefix))
        inside = inside & wanted
    return inside


def filter_capture_scope(
    spans: DataFrame, kinds: list[str] | None = None, prefixes: list[str] | None = None, source: str = "source_name"
) -> DataFrame:
    """Spans of the wanted kinds whose source starts with one of the prefixes; empty lists mean all."""
    return spans.filter(in_capture_scope(kinds, prefixes, source))


# ---------------------------------------------------------------------------- consumer identity

DEFAULT_CLAIM = "sub"
DEFAULT_HEADER = "X-API-Consumer"


def _filled(value: Column) -> Column:
    """The value, null when blank."""
    return F.when(F.trim(F.coalesce(value, F.lit(""))) != "", value)


def _header(name: str) -> Column:
    """Header value by name in any case."""
    lowered = F.transform_keys("headers", lambda k, _: F.lower(k))
    return F.try_element_at(lowered, F.lit(name.lower()))


def client_ip() -> Column:
    """First non-blank forwarded address, else the remote address."""
    parts = F.transform(F.split(_header("X-Forwarded-For"), ","), lambda p: F.trim(p))
    forwarded = F.try_element_at(F.filter(parts, lambda p: p != ""), F.lit(1))
    return F.coalesce(forwarded, _filled(F.col("remote_ip")))


def bearer_claim(claim: str = DEFAULT_CLAIM) -> Column:
    """A text or number claim of the bearer token's payload, unverified; null when there is none."""
    header = _header("Authorization")
    is_bearer = F.startswith(F.lower(header), F.lit("bearer "))
    parts = F.split(F.trim(F.substring(header, 8, 1_000_000_000)), "\\.")
    encoded = F.translate(F.get(parts, F.lit(1)), "-_", "+/")
    padded = F.rpad(encoded, (F.ceil(F.length(encoded) / 4) * 4).cast("int"), "=")
    payload = F.decode(F.try_to_binary(padded, F.lit("base64")), "UTF-8")
    path = f"$['{claim}']"
    kind = F.schema_of_variant(F.try_variant_get(F.try_parse_json(payload), path, "variant"))
    usable = (kind == "STRING") | kind.rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)")
    return F.when(is_bearer & (F.size(parts) >= 3) & usable, _filled(F.get_json_object(payload, path)))


def extract_consumer_id(
    requests: DataFrame, mode: str = "jwt", name: str | None = None, fall_back_to_ip: bool = True
) -> DataFrame:
    """Adds ``consumer_id`` from a claim (``jwt``), a header (``header``) or the address (``ip``).

    ``requests`` has ``headers`` (map), ``remote_ip``, ``authenticated`` and ``claims`` (map).
    """
    if mode == "jwt":
        claim = (name or "").strip() or DEFAULT_CLAIM
        verified = F.when(F.col("authenticated"), F.try_element_at("claims", F.lit(claim)))
        found = F.coalesce(_filled(verified), bearer_claim(claim))
    elif mode == "header":
        found = _filled(_header((name or "").strip() or DEFAULT_HEADER))
    elif mode == "ip":
        found = client_ip()
    else:
        raise ValueError(f"unknown mode {mode}")
    if fall_back_to_ip and mode != "ip":
        found = F.coalesce(found, client_ip())
    return requests.withColumn("consumer_id", found)
