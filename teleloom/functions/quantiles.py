"""Grouped summaries with exact quantiles that stay bounded for very large groups.

``percentile`` keeps every distinct value of a group in one buffer. Here no task holds more than a slice of
a group, at any size of the input:

1. rows are counted per (key, magnitude slice), with every other measure added up alongside; map tasks combine
   them to a few thousand rows a key at most, and the slices split a hot key over many reducers;
2. running totals over the slices of a key tell which slices hold the wanted ranks;
3. the input is read once more, its key and value only, and joined to the chosen slices, a few for each key: Spark
   sends them to all tasks if they turn out small, and splits a hot slice otherwise. What is left, the values of the
   chosen slices, is counted in the map tasks, ordered slice by slice, and the values at the ranks taken.

Nothing runs while the plan is built. Quantiles are linear-interpolated.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from teleloom.functions.predicates import finite_or_zero

# Slices per factor e of magnitude: about 0.2 % wide.
SLICES_PER_E = 512

Measure = tuple[Column, str]
_MERGE = {"sum": F.sum, "max": F.max, "min": F.min}


def count_all() -> Measure:
    return F.lit(1).cast("bigint"), "sum"


def count_where(condition: Column) -> Measure:
    return F.when(condition, F.lit(1)).otherwise(F.lit(0)).cast("bigint"), "sum"


def total(value: Column) -> Measure:
    return value, "sum"


def largest(value: Column) -> Measure:
    return value, "max"


def smallest(value: Column) -> Measure:
    return value, "min"


def summarize(
    df: DataFrame,
    keys: Sequence[str],
    measures: Mapping[str, Measure],
    value: Column,
    quantiles: Mapping[str, float],
    scale: float = 1.0,
    keep: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """One row per key: merged measures, then quantiles of ``value`` divided by ``scale``.

    A quantile of no values is 0. ``df`` is read twice, so it should be a scan with filters and expressions. Where
    only some keys are wanted, by their measures, ``keep`` picks them before values are looked up.
    """
    keys = list(keys)
    valued = df.withColumn("_value", value).withColumn("_slice", magnitude_slice(F.col("_value")))
    positions = [F.lit(float(q)) * (F.col("_total") - 1) for q in quantiles.values()]
    chosen = _slices_with_ranks(valued, keys, measures, positions, keep)
    picked = _values_at_ranks(valued, chosen, keys, measures, positions)
    out = []
    for i, (name, p) in enumerate(zip(quantiles, positions, strict=True)):
        low, high = F.col(f"_lo{i}").cast("double"), F.col(f"_hi{i}").cast("double")
        out.append(finite_or_zero((low + (high - low) * (p - F.floor(p))) / scale).alias(name))
    return picked.select(*keys, *measures, *out)


def magnitude_slice(value: Column) -> Column:
    """A non-decreasing integer of the value: slices of nearly constant relative width."""
    value = value.cast("double")
    return F.floor(F.signum(value) * F.log1p(F.abs(value)) * SLICES_PER_E).cast("bigint")


def _holds(rank: Column, start: Column, count: Column) -> Column:
    return (rank >= start) & (rank < start + count)


def _slices_with_ranks(
    valued: DataFrame, keys: list[str], measures: Mapping[str, Measure], positions: list[Column], keep: Callable[[DataFrame], DataFrame] | None
) -> DataFrame:
    """(keys, _total, measures, _slice, _before): the slices of each key that hold a wanted rank.

    Every key has one slice at least, if need be the one of its missing values.
    """
    merged = [_MERGE[kind](expr).alias(name) for name, (expr, kind) in measures.items()]
    slices = valued.groupBy(*keys, "_slice").agg(F.count("_value").alias("_n"), *merged)
    by_key = Window.partitionBy(*keys)
    running = by_key.orderBy("_slice").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    slices = slices.withColumns({"_before": F.sum("_n").over(running) - F.col("_n"), "_total": F.sum("_n").over(by_key)})
    hit = F.col("_total") == 0
    for p in positions:
        for rank in (F.floor(p), F.ceil(p)):
            hit = hit | _holds(rank, F.col("_before"), F.col("_n"))
    by_hit = slices.groupBy(*keys).agg(
        F.max("_total").alias("_total"),
        *[_MERGE[kind](name).alias(name) for name, (_, kind) in measures.items()],
        # Two slices for each quantile at most.
        F.collect_list(F.when(hit, F.struct("_slice", "_before"))).alias("_hits"),
    )
    wanted = by_hit if keep is None else keep(by_hit)
    return wanted.select(*keys, "_total", *measures, F.inline("_hits"))


def _values_at_ranks(
    valued: DataFrame, chosen: DataFrame, keys: list[str], measures: Mapping[str, Measure], positions: list[Column]
) -> DataFrame:
    """(keys, _total, measures, _lo0, _hi0, ...): all measures and the values around each position."""
    cell = [*keys, "_slice"]
    right = chosen.withColumnsRenamed({c: f"_k_{c}" for c in cell})
    same = F.lit(True)
    for c in cell:
        same = same & F.col(c).eqNullSafe(F.col(f"_k_{c}"))
    met = valued.select(*cell, "_value").join(right, same)
    about = ["_total", "_before", *measures]
    counted = met.groupBy(*cell, "_value").agg(F.count("_value").alias("_n"), *[F.first(c).alias(c) for c in about])
    in_slice = Window.partitionBy(*cell).orderBy("_value")
    up_to = F.sum("_n").over(in_slice.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    values = counted.withColumn("_start", F.col("_before") + up_to - F.col("_n"))
    picks = []
    for i, p in enumerate(positions):
        for side, rank in (("lo", F.floor(p)), ("hi", F.ceil(p))):
            picks.append(F.max(F.when(_holds(rank, F.col("_start"), F.col("_n")), F.col("_value"))).alias(f"_{side}{i}"))
    return values.groupBy(*keys).agg(F.max("_total").alias("_total"), *[F.first(name).alias(name) for name in measures], *picks)


def joined_null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Inner join on keys that may be null; a summary on either side still reads its input once."""
    named = right.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_r_{k}"))
    return left.join(named, same).drop(*[f"_r_{k}" for k in keys])
