"""Integer vectors for the searches over embeddings, and the cells in which queries meet candidates."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCALE = 256
#: Components of the queries, and of the candidates, that meet in one cell: some 32 MB each.
BLOCK_COMPONENTS = 4 << 20
GROUP_COMPONENTS = 4 << 20


def integer_vectors(rows: DataFrame, vector: str, **columns: Column) -> DataFrame:
    """(``columns``, dim, x): components times 256, rounded down, of the rows whose vectors take part; repeated rows once.

    Vectors that are null or empty or hold a null or a non-finite component take no part.
    """
    finite = F.forall(F.col(vector), lambda c: F.abs(c.cast("double")) < F.lit(float("inf")))
    usable = rows.where(F.coalesce(finite, F.lit(False)) & (F.size(vector) > 0))
    x = F.transform(F.col(vector), lambda c: F.floor(SCALE * c.cast("double")))
    return usable.select(*[c.alias(name) for name, c in columns.items()], F.size(vector).alias("dim"), x.alias("x")).distinct()


def parts(components: int, size: int, least: int = 1) -> int:
    return max(least, -(-components // size))


def part_of(count: int, *columns: str) -> Column:
    return F.pmod(F.xxhash64(*columns), F.lit(count)).cast("int")


def every(count: int) -> Column:
    return F.explode(F.sequence(F.lit(0), F.lit(count - 1)))


def flat(table: pa.Table, name: str, dtype=np.int64) -> np.ndarray:
    """All values of a column of arrays, one after the other."""
    return table[name].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(dtype, copy=False)


def exact_type(a: np.ndarray, b: np.ndarray, dim: int) -> type:
    """The fastest number type in which inner products of these integers are exact."""
    bound = int(np.abs(a).max(initial=0)) * int(np.abs(b).max(initial=0)) * dim
    return np.float32 if bound < 1 << 24 else np.float64 if bound < 1 << 53 else np.int64
