"""Registered queries and their SQL checks."""

from teleloom.plans import (  # noqa: F401
    alert_queries,
    consumer_queries,
    host_queries,
    ingest_queries,
    log_metric_queries,
    rollup_queries,
    span_queries,
    tenant_queries,
)
from teleloom.plans.registry import ORACLES, QUERIES  # noqa: F401
