"""Attribute-set columns: two parallel string arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def attribute_map(keys: Column, values: Column) -> Column:
    """Map of an attribute set; empty when the arrays do not match.

    Duplicate keys keep the last value (session setting ``spark.sql.mapKeyDedupPolicy``).
    """
    nothing = F.create_map().cast("map<string,string>")
    return F.when(F.size(keys) == F.size(values), F.map_from_arrays(keys, values)).otherwise(nothing)


def series_key(keys: Column, values: Column) -> Column:
    """Legend text ``k=v,k=v`` of an attribute set."""
    return F.array_join(F.zip_with(keys, values, lambda k, v: F.concat(k, F.lit("="), v)), ",")


def attributes_hash(keys: Column, values: Column) -> Column:
    """Identity of an attribute set."""
    return F.xxhash64(F.concat(keys, values))
