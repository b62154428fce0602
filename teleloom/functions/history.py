"""Previous-row lookups over time that split a long history into day chunks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from teleloom.functions.timing import int_div

DAY_NS = 86_400 * 1_000_000_000


def with_previous(
    df: DataFrame, keys: Sequence[str], order: str, columns: Sequence[str], name: str = "previous", chunk_ns: int = DAY_NS
) -> DataFrame:
    """Adds a struct ``name`` with ``columns`` of the preceding row of the same key, null for the first.

    Rows are windowed per (key, chunk), so one key's whole history never lands in a single task. Only
    the first and last row of every chunk meet their key's other chunks in a second window. Both
    branches read the same shuffle.
    """
    keys = list(keys)
    row = F.struct(*columns)
    chunked = df.withColumn("_chunk", int_div(F.col(order), chunk_ns))
    inside = Window.partitionBy(*keys, "_chunk").orderBy(order)
    marked = chunked.withColumn(name, F.lag(row).over(inside)).withColumn(
        "_last", F.lead(F.lit(1)).over(inside).isNull()
    )
    opens = F.col(name).isNull()
    edges = marked.filter(opens | F.col("_last")).withColumn(
        "_carried", F.lag(row).over(Window.partitionBy(*keys).orderBy(order))
    )
    first = edges.filter(opens).withColumn(name, F.col("_carried")).drop("_carried")
    return marked.filter(~opens).unionByName(first).drop("_chunk", "_last")
