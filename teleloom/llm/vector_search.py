"""Exact top-k inner products by aggregation without random access."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from teleloom.llm.vectors import BLOCK_COMPONENTS, GROUP_COMPONENTS, every, exact_type, flat, integer_vectors, part_of, parts

BEST = 5
#: Candidates whose lists are read together, and queries that read them in step.
SHARD_ROWS = 2048
CHUNK_QUERIES = 512
#: Parts of every list that have been read when the bounds are looked at.
SHARES = (0.5, 0.75, 1.0)
#: Share of pairs up to which the pairs left are followed one query at a time.
FEW = 0.15


class Shard:
    """Sorted lists of some candidates, one for each dimension, read from the end that suits a query's component.

    After a list has been read to some depth from the top, every candidate's component is known if it is at least
    the last value read, and at most that value otherwise: the component clipped from below is its upper bound.
    From the bottom the clipping is from above. So the bounds of all candidates at a depth are inner products
    with clipped components, and reading on moves the clipping values.
    """

    def __init__(self, ids: np.ndarray, x: np.ndarray):
        self.ids, self.x, self.sorted = ids, x, np.sort(x, axis=0)
        self.known: dict[float, tuple[np.ndarray, np.ndarray]] = {}

    def bounds(self, share: float) -> tuple[np.ndarray, np.ndarray]:
        """Upper and lower ends of the components at a depth: for positive components of a query, then for negative ones."""
        if share not in self.known:
            depth = int(np.ceil(len(self.x) * share))
            top, bottom = self.sorted[-depth], self.sorted[depth - 1]
            upper = np.concatenate([np.maximum(self.x, top), np.minimum(self.x, bottom)], 1)
            lower = np.concatenate([np.where(self.x >= top, self.x, self.sorted[0]), np.where(self.x <= bottom, self.x, self.sorted[-1])], 1)
            self.known[share] = upper, lower
        return self.known[share]

    def search(self, query_ids: np.ndarray, q: np.ndarray, least: np.ndarray, k: int):
        """(query, candidates, scores) of all that can be among the first ``k`` of a query.

        ``q`` holds the positive components of every query, then the negative ones; ``least`` the k-th score that
        a query has found so far. A candidate leaves when its upper bound is under the query's ``least``, or under
        the k-th lower bound here where the query has none; lists are read on for those that are left.
        """
        own = query_ids[:, None] == self.ids[None, :]
        none = np.finfo(q.dtype).min if q.dtype.kind == "f" else np.iinfo(q.dtype).min
        alive, upper = ~own, None
        for share in SHARES:
            if upper is not None and alive.mean() <= FEW:
                break
            high, low = self.bounds(share)
            upper = q @ high.T
            bound, new = least.copy(), np.flatnonzero(least == none)
            if len(new) and len(self.ids) > k:
                lower = q[new] @ low.T
                lower[own[new]] = none
                bound[new] = np.partition(lower, -k, axis=1)[:, -k]
            alive &= upper >= bound[:, None]
        else:
            share = None
        for i in np.flatnonzero(alive.any(1)):
            rows = np.flatnonzero(alive[i])
            if share is None:
                yield i, rows, upper[i, rows]
                continue
            for deeper in SHARES[SHARES.index(share) :]:
                score = self.bounds(deeper)[0][rows] @ q[i]
                rows, score = rows[score >= least[i]], score[score >= least[i]]
            yield i, rows, score


def search_cell(queries: pa.Table, candidates: pa.Table, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, candidate, score): the first ``k`` candidates of the cell for each of its queries."""
    dim = queries["dim"][0].as_py()
    q, x = flat(queries, "x").reshape(-1, dim), flat(candidates, "x").reshape(-1, dim)
    query_ids, ids = queries["id"].to_numpy(), candidates["id"].to_numpy()
    kind = exact_type(q, x, dim)
    q = np.concatenate([np.maximum(q, 0), np.minimum(q, 0)], 1).astype(kind)
    x = x.astype(kind)
    least = np.full(len(q), np.finfo(kind).min if kind is not np.int64 else np.iinfo(kind).min, kind)
    best = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in query_ids]
    for a in range(0, len(ids), SHARD_ROWS):
        shard = Shard(ids[a : a + SHARD_ROWS], x[a : a + SHARD_ROWS])
        for b in range(0, len(q), CHUNK_QUERIES):
            chunk = slice(b, b + CHUNK_QUERIES)
            for i, rows, scores in shard.search(query_ids[chunk], q[chunk], least[chunk], k):
                top, had = best[b + i]
                top, had = np.concatenate([top, shard.ids[rows]]), np.concatenate([had, scores.astype(np.int64)])
                order = np.lexsort((top, -had))[:k]
                best[b + i] = top[order], had[order]
                if len(order) == k:
                    least[b + i] = had[order[-1]]
    sizes = [len(top) for top, _ in best]
    return np.repeat(query_ids, sizes), np.concatenate([t for t, _ in best]), np.concatenate([s for _, s in best])


def nearest(rows: DataFrame, asks: Column, k: int = BEST, vector: str = "embedding", key: str = "vec_id") -> DataFrame:
    """(query_id, rank, key, score): for every row that ``asks``, the ``k`` other rows of highest inner product.

    ``asks`` is a condition on ``key``. Components are multiplied by 256 and rounded down; scores are exact as long
    as they fit 64 bits; equal scores come by ascending key. Queries and candidates are dealt to cells of bounded
    size, each candidate to the cells of every block of queries, so that every query meets every row once.
    In a cell the candidates' lists are read shard by shard (``Shard``); a query's results so far set the
    bound for the next shard. The cells' results are merged by rank.

    Vectors that are null or empty or hold a null or non-finite component, and rows without a key, take no part.
    Repeated rows count once; of different vectors with one key all are candidates and the smallest one asks; a row
    is no candidate of its own key. Vectors are held against vectors of their own length. Other columns
    are not read; no rows give no rows.
    """
    named = integer_vectors(rows.where(F.col(key).isNotNull()), vector, id=F.col(key).cast("bigint"), asks=F.coalesce(asks, F.lit(False)))
    totals = named.agg(F.sum("dim").alias("all"), F.sum(F.when(F.col("asks"), F.col("dim"))).alias("asks"), F.count("*").alias("rows")).first()
    cores = rows.sparkSession.sparkContext.defaultParallelism
    blocks = parts(totals["asks"] or 0, BLOCK_COMPONENTS)
    groups = parts(totals["all"] or 0, GROUP_COMPONENTS, min(-(-2 * cores // blocks), max(1, totals["rows"] // SHARD_ROWS)))
    queries = named.where("asks").groupBy("id").agg(F.min(F.struct("x", "dim")).alias("v")).select("id", "v.dim", "v.x")
    queries = queries.select("dim", part_of(blocks, "id").alias("block"), every(groups).alias("group"), "id", "x")
    candidates = named.select("dim", every(blocks).alias("block"), part_of(groups, "id", "x").alias("group"), "id", "x")
    cell = ["dim", "block", "group"]
    dealt = [side.repartition(2 * blocks * groups, *cell).groupBy(*cell) for side in (queries, candidates)]

    def run(queries: pa.Table, candidates: pa.Table) -> pa.Table:
        found = search_cell(queries, candidates, k) if len(queries) and len(candidates) else [np.zeros(0, np.int64)] * 3
        return pa.table(dict(zip(("query_id", "key", "score"), map(pa.array, found), strict=True)))

    found = dealt[0].cogroup(dealt[1]).applyInArrow(run, "query_id bigint, key bigint, score bigint")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "key")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", F.col("key").alias(key), "score")
