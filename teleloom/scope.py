"""Tenant and time scope shared by every read."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NS_PER_S = 1_000_000_000


@dataclass(frozen=True)
class Scope:
    """Optional tenant and an optional time range, inclusive at both ends (epoch nanoseconds).

    Without a tenant an operator answers for all tenants at once, keyed by ``tenant_id``.
    """

    tenant_id: object | None = None
    start_ns: int | None = None
    end_ns: int | None = None

    @classmethod
    def seconds(cls, start_s: int | None = None, end_s: int | None = None, tenant_id: object | None = None) -> Scope:
        return cls(
            tenant_id,
            None if start_s is None else start_s * NS_PER_S,
            None if end_s is None else end_s * NS_PER_S,
        )

    @property
    def start_s(self) -> int:
        return self.start_ns // NS_PER_S

    @property
    def end_s(self) -> int:
        return self.end_ns // NS_PER_S

    @property
    def seconds_long(self) -> float:
        return (self.end_ns - self.start_ns) / NS_PER_S

    def apply(self, df: DataFrame, time_col: str = "time_unix_ns") -> DataFrame:
        """Filter to the scope; tables partitioned by ``event_date`` also get a partition filter."""
        if self.tenant_id is not None:
            df = df.filter(F.col("tenant_id") == self.tenant_id)
        if self.start_ns is not None:
            df = df.filter(F.col(time_col) >= self.start_ns)
            if "event_date" in df.columns:
                df = df.filter(F.col("event_date") >= _utc_date(self.start_ns))
        if self.end_ns is not None:
            df = df.filter(F.col(time_col) <= self.end_ns)
            if "event_date" in df.columns:
                df = df.filter(F.col("event_date") <= _utc_date(self.end_ns))
        return df

    def apply_bucket(self, df: DataFrame, bucket_col: str) -> DataFrame:
        """Rollup scope: the range applies to the bucket start, in whole epoch seconds."""
        if self.tenant_id is not None:
            df = df.filter(F.col("tenant_id") == self.tenant_id)
        if self.start_ns is not None:
            df = df.filter(F.col(bucket_col) >= -(-self.start_ns // NS_PER_S))
            if "bucket_month" in df.columns:
                df = df.filter(F.col("bucket_month") >= _utc_month(self.start_ns))
        if self.end_ns is not None:
            df = df.filter(F.col(bucket_col) <= self.end_ns // NS_PER_S)
            if "bucket_month" in df.columns:
                df = df.filter(F.col("bucket_month") <= _utc_month(self.end_ns))
        return df


def _utc_date(ns: int) -> Column:
    return F.to_date(F.timestamp_seconds(F.lit(ns // NS_PER_S)))


def _utc_month(ns: int) -> Column:
    return F.date_format(F.timestamp_seconds(F.lit(ns // NS_PER_S)), "yyyyMM")
