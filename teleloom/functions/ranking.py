"""Top-n and paging helpers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from teleloom.scope import Scope


def top_n(df: DataFrame, scope: Scope, order: Sequence[Column], n: int | None) -> DataFrame:
    """The first ``n`` rows of each tenant; all of them if it is None.

    One tenant: a plain ordered limit. All tenants: a row-number filter, which Spark cuts to ``n``
    rows per tenant in every task before the shuffle; rows come in order within their tenant.
    """
    if n is None:
        return df.orderBy("tenant_id", *order)
    if scope.tenant_id is not None:
        return df.orderBy(*order).limit(n)
    return top_n_by(df, ["tenant_id"], order, n)


def top_n_by(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int | None) -> DataFrame:
    """The first ``n`` rows of each key; all of them if it is None."""
    if n is None:
        return df.orderBy(*keys, *order)
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).filter(F.col("_rank") <= n).drop("_rank")


def page(df: DataFrame, keys: Sequence[str], order: Sequence[Column], page_no: int, size: int | None) -> DataFrame:
    """One page of an ordered result, with the count of the whole result as ``total``.

    With ``keys`` each key has its own pages and total. Without a size the page has all rows.
    """
    keys = list(keys)
    if size is None:
        totals = df.groupBy(*(keys or [F.lit(0).alias("_whole")])).agg(F.count(F.lit(1)).alias("total"))
        rows = df if keys else df.withColumn("_whole", F.lit(0))
        return rows.join(totals, keys or ["_whole"]).drop("_whole").orderBy(*keys, *order)
    first = max(0, (max(1, page_no) - 1) * size)
    if not keys:
        whole = df.groupBy(F.lit(0).alias("_whole")).agg(F.count(F.lit(1)).alias("total"))
        rows = df.orderBy(*order).offset(first).limit(size).withColumn("_whole", F.lit(0))
        return rows.join(F.broadcast(whole), "_whole").drop("_whole")
    totals = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("total"))
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    rows = df.withColumn("_rank", rank).filter(F.col("_rank") <= first + size)
    return rows.filter(F.col("_rank") > first).drop("_rank").join(totals, keys)
