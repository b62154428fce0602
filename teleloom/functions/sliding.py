"""Aggregates over sliding windows of a numbered series of steps, without repeating rows for each step.

``running_counts`` is for whole numbers, which can be taken off again: a row that counts for the steps
``low``..``high`` is added at ``low`` and taken off behind ``high``, and running sums give every step's value.

``block_aggregates`` is for what cannot be taken off, such as maxima, or sums of floating numbers that should not
gather rounding errors. Steps are cut into blocks of the window's length; a window then is the end of one block
and the begin of the next, whose aggregates are running ones.

Neither costs more for longer windows.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_MERGE = {"sum": F.sum, "max": F.max, "min": F.min}


def running_counts(rows: DataFrame, keys: Sequence[str], sums: Sequence[str], steps: int, name: str = "_step") -> DataFrame:
    """(keys, step, sums) of every step 0..steps-1 that some row counts for.

    ``rows`` has the first and last step it counts for in ``_low`` and ``_high``, and whole numbers to add up. They
    should be added up by key and run before; a key has no more than two changes for each of its steps.
    """
    keys = list(keys)
    starts = F.struct(F.greatest(F.lit(0).cast("bigint"), F.col("_low")).alias(name), *[F.col(s).alias(s) for s in sums], F.lit(1).alias("_rows"))
    ends = F.struct((F.col("_high") + 1).alias(name), *[(-F.col(s)).alias(s) for s in sums], F.lit(-1).alias("_rows"))
    inside = rows.filter((F.col("_low") <= F.col("_high")) & (F.col("_high") >= 0) & (F.col("_low") < steps))
    changes = inside.select(*keys, F.inline(F.array(starts, ends))).repartition(*keys)
    changes = changes.groupBy(*keys, name).agg(*[F.sum(s).alias(s) for s in [*sums, "_rows"]])
    ordered = Window.partitionBy(*keys).orderBy(name)
    so_far = ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    until = F.least(F.lead(name).over(ordered), F.lit(steps).cast("bigint"))
    found = changes.select(*keys, name, until.alias("_until"), *[F.sum(s).over(so_far).alias(s) for s in [*sums, "_rows"]])
    found = found.filter((F.col("_rows") > 0) & (F.col(name) < F.col("_until")))
    return found.select(*keys, F.explode(F.sequence(F.col(name), F.col("_until") - 1)).alias(name), *sums)


def block_aggregates(
    rows: DataFrame, grid: DataFrame, keys: Sequence[str], aggregates: Mapping[str, str], steps: int, name: str = "_step"
) -> DataFrame:
    """(keys, step, aggregates) of every step 0..steps-1, over the rows at the last ``_len`` steps up to it.

    ``rows`` has its step, which may be below 0, in ``_low``, the length of its window in ``_len``, and the columns to
    aggregate; a key may have rows of several lengths. ``grid`` has (keys, ``_len``) of all that can occur.
    """
    keys = list(keys)
    whole = [F.lit(None).cast(rows.schema[column].dataType).alias(column) for column in aggregates]
    first = (1 - F.col("_len")).cast("bigint")
    every = grid.select(*keys, "_len", F.explode(F.sequence(first, F.lit(steps - 1).cast("bigint"))).alias("_low"), *whole)
    filled = rows.select(*keys, "_len", "_low", *aggregates).unionByName(every)
    filled = filled.withColumn("_block", F.floor(F.col("_low") / F.col("_len")))
    place = [*keys, "_len", "_block"]
    merged = filled.repartition(*place).groupBy(*place, "_low").agg(*[_MERGE[kind](c).alias(c) for c, kind in aggregates.items()])
    ordered = Window.partitionBy(*place).orderBy("_low")
    up_to = ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    from_here = ordered.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    ran = merged.select(
        *keys,
        "_len",
        "_low",
        *[_MERGE[kind](c).over(up_to).alias(f"_begin_{c}") for c, kind in aggregates.items()],
        *[_MERGE[kind](c).over(from_here).alias(f"_end_{c}") for c, kind in aggregates.items()],
    )
    # A whole block is the begin up to its last step; its end from the first step would be the same once more.
    begins = F.struct(F.col("_low").alias(name), *[F.col(f"_begin_{c}").alias(c) for c in aggregates])
    ends = F.struct((F.col("_low") + F.col("_len") - 1).alias(name), *[F.col(f"_end_{c}").alias(c) for c in aggregates])
    both = F.when(F.pmod("_low", "_len") == 0, F.array(begins)).otherwise(F.array(begins, ends))
    parts = ran.select(*keys, F.inline(both)).filter(F.col(name).between(0, steps - 1))
    return parts.groupBy(*keys, name).agg(*[_MERGE[kind](c).alias(c) for c, kind in aggregates.items()])


def run_length(low: Column, high: Column) -> Column:
    return (high - low + 1).cast("bigint")
