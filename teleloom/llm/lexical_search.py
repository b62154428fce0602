"""Ranked lexical search: impact-sorted lists, read in step until score intervals settle the ranking."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from teleloom.llm.common import kept, small_batches

BEST = 50
#: Items are searched in blocks of so many bytes of text, which bounds the terms that the driver and a task hold.
BLOCK_BYTES = 4 << 20
#: Documents, and postings, whose lists a task holds at a time; documents that a task takes at least, if there are as many.
SHARD_DOCS = 8192
SHARD_POSTINGS = 4 << 20
TASK_DOCS = 8192
#: Parts of every list that have been read when the intervals are looked at.
SHARES = (1 / 8, 1 / 2, 1.0)
#: Bytes of a text that are cut into terms at a time.
PIECE = 1 << 20
#: Partial rankings of an item that are merged first.
PARTS = 32

# Bytes of a term stand for themselves, A-Z for a-z, all others for a blank; bytes from 0x80 belong to other letters.
TERM_BYTES = bytes(b if b >= 0x80 else ord(chr(b).lower()) if chr(b).isalnum() else 0x20 for b in range(256))


def term_pieces(text: str | None) -> Iterator[list[bytes]]:
    """All terms of a whole text in order, in pieces."""
    body = (text or "").encode().translate(TERM_BYTES)
    start = 0
    while start < len(body):
        end = body.find(b" ", start + PIECE)
        end = len(body) if end < 0 else end
        yield body[start:end].split()
        start = end


def item_terms(items: DataFrame, text: str, key: str, block: int, blocks: int) -> list[tuple[int, list[bytes]]]:
    """The distinct terms of each item of a block, of at most some ``BLOCK_BYTES``; texts that share an id are one item."""
    rows = items.where(F.col(key).isNotNull()).select(F.col(key).cast("bigint").alias("i"), F.col(text).alias("t"))
    found: dict[int, set[bytes]] = {}
    for row in rows.where(F.pmod(F.xxhash64("i"), F.lit(blocks)) == block).toLocalIterator():
        found.setdefault(row["i"], set()).update(t for piece in term_pieces(row["t"]) for t in piece)
    return [(i, sorted(terms)) for i, terms in sorted(found.items()) if terms]


def postings(docs: DataFrame, text: str, key: str, numbers: dict[bytes, int]) -> DataFrame:
    """(key, n, terms, tfs) of every document: its number of terms, and how often it holds each numbered term."""
    shared = docs.sparkSession.sparkContext.broadcast(numbers)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            sizes, ends, terms, tfs = [], [0], [], []
            for text_ in batch.column(1):
                n, own = 0, Counter()
                for piece in term_pieces(text_.as_py()):
                    n += len(piece)
                    for term, times in Counter(piece).items():
                        if term in known:
                            own[known[term]] += times
                sizes.append(n)
                terms.extend(own.keys())
                tfs.extend(own.values())
                ends.append(len(terms))
            lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(x, pa.int32())) for x in (terms, tfs)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), *lists], ["key", "n", "terms", "tfs"])

    rows = docs.select(F.col(key).cast("bigint").alias("key"), F.col(text).alias("text"))
    return rows.mapInArrow(run, "key bigint, n bigint, terms array<int>, tfs array<int>")


class Lists:
    """The postings of a shard of documents, by term and falling impact."""

    def __init__(self, keys: np.ndarray, terms: np.ndarray, rows: np.ndarray, impacts: np.ndarray, n_terms: int):
        order = np.lexsort((-impacts, terms))
        self.keys, self.docs, self.impacts = keys, rows[order], impacts[order]
        self.bounds = np.searchsorted(terms[order], np.arange(n_terms + 1))

    def search(self, terms: np.ndarray, weights: np.ndarray, k: int, least: float) -> tuple[np.ndarray, np.ndarray]:
        """(documents, scores) of all that can be among the first ``k`` and reach ``least``, the k-th score known so far.

        The lists of the terms are read in step from their highest impacts. What a document has been seen with is
        its lower bound; each list that it was not yet seen in can add that list's next impact at most, its upper
        bound. A document leaves when its upper bound is under the k-th lower bound; reading ends when the
        bounds of all that are left agree, so that membership, ties and scores are settled.
        """
        first, last = self.bounds[terms], self.bounds[terms + 1]
        has = last > first
        first, length, weights = first[has], (last - first)[has], weights[has].astype(np.float64)
        if not len(first) or (weights * self.impacts[first]).sum() < max(least, 1):
            return np.zeros(0, np.int64), np.zeros(0)
        size = len(self.keys)
        lower, alive, read = np.zeros(size), np.ones(size, bool), np.zeros(len(first), np.int64)
        seen, seen_in = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for share in SHARES:
            depth = np.ceil(length * share).astype(np.int64)
            counts = depth - read
            lists = np.repeat(np.arange(len(first)), counts)
            at = np.arange(counts.sum()) + np.repeat(first + read - (np.cumsum(counts) - counts), counts)
            left = alive[self.docs[at]]
            at, lists, read = at[left], lists[left], depth
            lower += np.bincount(self.docs[at], weights[lists] * self.impacts[at], size)
            seen, seen_in = np.concatenate([seen, self.docs[at]]), np.concatenate([seen_in, lists])
            coming = np.where(depth < length, weights * self.impacts[np.minimum(first + depth, first + length - 1)], 0)
            upper = lower + coming.sum() - np.bincount(seen, coming[seen_in], size)
            settled = max(least, np.partition(lower, -k)[-k] if size >= k else 0, 1)
            alive &= upper >= settled
            if (upper[alive] == lower[alive]).all():
                break
        found = np.flatnonzero(alive)
        return found, lower[found]


def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """(keys, n, postings of each row, terms, tfs) of some thousand documents at a time; rows without a key or term left out."""
    held: list[list[np.ndarray]] = []
    for batch in batches:
        counts = np.diff(batch.column(2).offsets.to_numpy())
        use = batch.column(0).is_valid().to_numpy(zero_copy_only=False) & (counts > 0)
        flat = [batch.column(i).flatten().to_numpy()[np.repeat(use, counts)] for i in (2, 3)]
        rows = batch.filter(pa.array(use))
        held.append([rows.column(0).to_numpy(), rows.column(1).to_numpy(), counts[use], *flat])
        if sum(len(h[0]) for h in held) >= SHARD_DOCS or sum(len(h[3]) for h in held) >= SHARD_POSTINGS:
            yield [np.concatenate(x) for x in zip(*held, strict=True)]
            held = []
    if held:
        yield [np.concatenate(x) for x in zip(*held, strict=True)]


def search_block(index: DataFrame, wanted: list[tuple[int, list[bytes]]], numbers: dict[bytes, int], k: int) -> DataFrame:
    """(item, key, score): the first ``k`` documents of each item in every task's share of the index."""
    totals = index.where("n > 0").agg(F.count("*").alias("docs"), F.sum("n").alias("terms"), F.first(F.lit(1))).first()
    n_docs, n_terms = totals["docs"], totals["terms"] or 1
    weights = np.zeros(len(numbers), np.int64)
    for row in index.select(F.explode("terms").alias("term")).groupBy("term").count().collect():  # one row for each numbered term
        weights[row["term"]] = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * row["count"] + 1)))
    queries = [(i, np.array([numbers[t] for t in terms])) for i, terms in wanted]
    shared = index.sparkSession.sparkContext.broadcast((queries, weights))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, weights = shared.value
        if not queries:
            return
        best = [(np.zeros(0, np.int64), np.zeros(0)) for _ in queries]
        for keys, sizes, counts, terms, tfs in shards(batches):
            rows = np.repeat(np.arange(len(keys)), counts)
            share = np.array([50 * n * n_docs // n_terms for n in sizes.tolist()], np.int64) + 50
            tf = tfs.astype(np.int64)
            lists = Lists(keys, terms, rows, 1_000_000_000 * tf // (1000 * tf + 20 * share[rows]), len(weights))
            for q, (_, own) in enumerate(queries):
                top, scores = best[q]
                found, more = lists.search(own, weights[own], k, scores[-1] if len(scores) == k else 0)
                if len(found):
                    top, scores = np.concatenate([top, keys[found]]), np.concatenate([scores, more])
                    order = np.lexsort((top, -scores))[:k]
                    best[q] = top[order], scores[order]
        items = np.repeat([i for i, _ in queries], [len(top) for top, _ in best])
        found = [np.concatenate([b[j] for b in best]).astype(np.int64) for j in (0, 1)]
        yield pa.RecordBatch.from_arrays([pa.array(items, pa.int64()), *map(pa.array, found)], ["item", "key", "score"])

    tasks = max(1, -(-index.count() // TASK_DOCS))
    return index.coalesce(tasks).mapInArrow(run, "item bigint, key bigint, score bigint").where("score > 0")


def rank_documents(
    docs: DataFrame,
    items: DataFrame,
    k: int = BEST,
    text: str = "text",
    key: str = "doc_id",
    item_text: str = "text",
    item_key: str = "item_id",
) -> DataFrame:
    """(item, rank, key, score): the ``k`` documents of highest score for each item, equal scores by ascending key.

    Terms are runs of ASCII letters and digits and of all other characters from U+0080, with A-Z lower-cased.
    A term that ``df`` of the N documents hold weighs floor(1000 ln((2N+2) / (2df+1))); a document with n
    of all L terms that holds it tf times gets the weight times (10^9 tf) div (1000 tf + 20 (50 + (50nN) div L)).

    One pass over the whole texts leaves the numbers of the items' terms in each document; statistics are counts
    over all of them. Each task holds impact-sorted lists of some thousand documents at a time and reads
    them until the first documents of every item are settled (``Lists.search``), given what it has found before.

    Null and blank texts have no terms: as documents they count for nothing, as items they have no rows. Items that
    share an id are one item with the terms of all; items without an id are left out. Documents without a key
    count in the statistics and are not ranked; repeated rows are ranked each. Texts of any length are read
    whole. Other columns are not read; an empty table on either side gives no rows.
    """
    small_batches(docs.sparkSession)
    size = items.agg(F.coalesce(F.sum(F.octet_length(item_text)), F.lit(0)).alias("bytes")).first()["bytes"]
    blocks = size // BLOCK_BYTES + 1
    ranked = None
    for block in range(blocks):
        wanted = item_terms(items, item_text, item_key, block, blocks)
        numbers = {t: i for i, t in enumerate(sorted({t for _, terms in wanted for t in terms}))}
        found = search_block(kept(postings(docs, text, key, numbers)), wanted, numbers, k)
        ranked = found if ranked is None else ranked.union(found)
    order = [F.col("score").desc(), F.col("key")]
    some = F.row_number().over(Window.partitionBy("item", "part").orderBy(*order))
    some = ranked.withColumn("part", F.spark_partition_id() % PARTS).withColumn("r", some).where(F.col("r") <= k)
    first = some.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).where(F.col("rank") <= k)
    return first.select(F.col("item").alias(item_key), "rank", F.col("key").alias(key), "score")
