"""Benchmark passages in documents: SimHash of item-sized windows, Hamming blocks, exact similarity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from teleloom.llm.common import DIGEST_BYTES, broadcast_if_small, kept, row_identity, without, word_array

SHINGLE_WORDS = 5
SIMILARITY = 0.8
#: Bits that a window's fingerprint may differ from an item's. Texts of similarity 0.8 differ in 9.7 of 64
#: bits on average, with a deviation of 2.9, so that the radius is some five deviations away.
RADIUS = 24
# Five blocks of a fingerprint: of at most 24 differing bits at most four lie in one of them.
BLOCKS = ((0, 13), (13, 13), (26, 13), (39, 13), (52, 12))


def shingles(words: Column, width: Column | int) -> Column:
    """Hashes of all word runs of a width, in order; none if there are fewer words."""
    last = F.size(words) - width
    return F.when(
        last >= 0, F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(F.slice(words, i + 1, width if isinstance(width, Column) else F.lit(width))))
    ).otherwise(F.array().cast("array<bigint>"))


def simhash(hashes: Column) -> Column:
    """64-bit SimHash of shingle hashes, each weighted by how often it occurs."""

    def bit(b: Column) -> Column:
        ones = F.aggregate(hashes, F.lit(0), lambda n, h: n + F.getbit(h, b).cast("int"))
        return F.when(2 * ones > F.size(hashes), F.call_function("shiftleft", F.lit(1).cast("bigint"), b)).otherwise(F.lit(0).cast("bigint"))

    return F.aggregate(F.transform(F.sequence(F.lit(0), F.lit(63)), bit), F.lit(0).cast("bigint"), lambda a, b: a.bitwiseOR(b))


def block_values(fp: Column) -> Column:
    """(block, value) of every block of a fingerprint."""
    return F.array(
        *[
            F.struct(F.lit(i).alias("block"), F.shiftrightunsigned(fp, low).bitwiseAND(F.lit((1 << bits) - 1)).alias("value"))
            for i, (low, bits) in enumerate(BLOCKS)
        ]
    )


def flips(most: int) -> Column:
    """All differences of at most so many bits within a block."""
    return F.filter(F.sequence(F.lit(0).cast("bigint"), F.lit((1 << 13) - 1).cast("bigint")), lambda x: F.bit_count(x) <= most)


def weighted_similarity(a: Column, b: Column) -> Column:
    """Shared shingles over all shingles, every shingle counted as often as it occurs."""

    def often(x: Column) -> Column:
        return F.least(F.size(F.filter(a, lambda y: y == x)), F.size(F.filter(b, lambda y: y == x)))

    repeated = (F.size(F.array_distinct(a)) < F.size(a)) | (F.size(F.array_distinct(b)) < F.size(b))
    slow = F.aggregate(F.array_distinct(a), F.lit(0), lambda n, x: n + often(x))
    shared = F.when(repeated, slow).otherwise(F.size(F.array_intersect(a, b)))
    return shared / (F.size(a) + F.size(b) - shared)


def item_windows(items: DataFrame, text: str, key: str) -> DataFrame:
    """(item, n_words, width, hashes, fp) of every item that has a word."""
    rows = items.select(F.col(key).alias("item"), word_array(F.col(text)).alias("w")).where(F.size("w") > 0)
    rows = rows.select("item", "w", F.size("w").alias("n_words"), F.least(F.size("w"), F.lit(SHINGLE_WORDS)).alias("width"))
    rows = rows.select("item", "n_words", "width", shingles(F.col("w"), F.col("width")).alias("hashes"))
    return rows.withColumn("fp", simhash(F.col("hashes")))


def candidate_windows(docs: DataFrame, items: DataFrame, widths: list[int], similarity: float) -> DataFrame:
    """(id, windows): for each document the item-sized windows that can reach the similarity with some item.

    A window of n shingles needs n * similarity of them to be benchmark shingles, whatever the item. The hash
    of every shingle of every document is looked up among those of all items of each size; the positions found
    give all windows that hold enough of them, and no other window can be similar.
    """
    known = items.select("n_words", "width", F.explode("hashes").alias("h")).distinct()
    known = broadcast_if_small(kept(known), 24)
    words = docs.select("id", word_array(F.col("t")).alias("w"))
    every = F.array(*[F.struct(F.lit(x).alias("width"), shingles(F.col("w"), x).alias("hs")) for x in widths])
    found = words.select("id", F.size("w").alias("m"), F.explode(every).alias("s")).select("id", "m", "s.width", F.posexplode("s.hs").alias("pos", "h"))
    hits = found.join(known, ["width", "h"]).groupBy("id", "m", "n_words", "width").agg(F.sort_array(F.collect_list("pos")).alias("p"))
    n = F.col("n_words") - F.col("width") + 1
    hits = hits.withColumn("n", n).withColumn("need", F.greatest(F.lit(1), F.ceil(n * similarity - 1e-9).cast("int")))
    hits = hits.where(F.size("p") >= F.col("need")).withColumn("top", F.greatest(F.lit(0), F.col("m") - F.col("n_words")))

    def around(i: Column) -> Column:
        first, last = F.element_at("p", i), F.element_at("p", i + F.col("need") - 1)
        a, b = F.greatest(F.lit(0), last - F.col("n") + 1), F.least(first, F.col("top"))
        return F.when(a <= b, F.sequence(a, b)).otherwise(F.array().cast("array<int>"))

    starts = F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(1), F.size("p") - F.col("need") + 1), around)))
    hits = hits.select("id", "n_words", "width", starts.alias("starts")).where(F.size("starts") > 0)
    return hits.groupBy("id").agg(F.collect_list(F.struct("n_words", "width", "starts")).alias("windows"))


def similar_windows(
    docs: DataFrame, items: DataFrame, text: str, key: str, item_text: str, item_key: str, similarity: float, radius: int
) -> DataFrame:
    """(id, k, item, similarity, start): every passage that is similar to an item; ``id`` stands for key and text.

    Windows that can be similar get a SimHash, equal windows once. Items are spread over all block values
    within the radius's share, which finds every fingerprint within the radius; pairs within it are verified
    exactly.
    """
    per_block = radius // len(BLOCKS)
    sized = kept(item_windows(items, item_text, item_key))
    widths = sorted(r["width"] for r in sized.select("width").distinct().collect())  # at most five values
    rows = docs.select(F.col(key).alias("k"), row_identity(F.col(key), F.col(text)).alias("id"), F.col(text).alias("t")).where("t is not null")
    near = kept(candidate_windows(rows, sized, widths or [SHINGLE_WORDS], similarity))
    starts = F.aggregate("windows", F.lit(0).cast("bigint"), lambda n, x: n + 4 * F.size(x["starts"]) + 40)
    named = rows.join(broadcast_if_small(near, starts + DIGEST_BYTES), "id").select("id", "k", word_array(F.col("t")).alias("w"), F.explode("windows").alias("s"))
    placed = named.select("id", "k", "w", "s.n_words", "s.width", F.explode("s.starts").alias("start"))
    placed = placed.withColumn("w", F.slice("w", F.col("start") + 1, F.col("n_words")))
    placed = placed.select("id", "k", "start", "n_words", F.xxhash64("w").alias("c1"), F.hash("w").alias("c2"), shingles(F.col("w"), F.col("width")).alias("hashes"))
    placed = kept(placed)
    content = ["n_words", "c1", "c2"]
    distinct = placed.groupBy(*content).agg(F.first("hashes").alias("hashes")).withColumn("fp", simhash(F.col("hashes")))
    distinct = kept(distinct)

    # Multi-index: every item stands at all values within per_block bits of its own, a window at its own.
    at_items = sized.select("item", "n_words", "hashes", "fp", F.explode(block_values(F.col("fp"))).alias("b"))
    at_items = at_items.select("item", "n_words", F.col("fp").alias("ifp"), "b.block", "b.value")
    bits = F.element_at(F.array(*[F.lit(b) for _, b in BLOCKS]), F.col("block") + 1)
    at_items = at_items.withColumn("flip", F.explode(flips(per_block))).where(F.col("flip") < F.call_function("shiftleft", F.lit(1).cast("bigint"), bits))
    at_items = at_items.select("item", "n_words", "ifp", "block", F.col("value").bitwiseXOR(F.col("flip")).alias("value"))
    at_windows = distinct.select(*content, "fp", F.explode(block_values(F.col("fp"))).alias("b")).select(*content, "fp", "b.block", "b.value")
    met = at_windows.join(at_items, ["n_words", "block", "value"])
    met = met.where(F.bit_count(F.col("fp").bitwiseXOR(F.col("ifp"))) <= radius).select(*content, "item").distinct()
    pairs = met.join(distinct.drop("fp"), content).join(sized.select("item", F.col("hashes").alias("ih")), "item")
    similar = pairs.withColumn("similarity", weighted_similarity(F.col("ih"), F.col("hashes"))).where(F.col("similarity") >= similarity)
    similar = kept(similar.select(*content, "item", "similarity"))
    return placed.select("id", "k", "start", *content).join(similar, content).select("id", "k", "item", "similarity", "start")


def leaks(
    docs: DataFrame,
    items: DataFrame,
    text: str = "text",
    key: str = "doc_id",
    item_text: str = "text",
    item_key: str = "item_id",
    similarity: float = SIMILARITY,
    radius: int = RADIUS,
) -> DataFrame:
    """(doc_id, item_id, similarity, first_word): documents with a passage similar to a benchmark item.

    A passage is a run of as many words as the item has (the whole document if it is shorter). Similarity is
    the weighted Jaccard index of the runs' shingles of five words; an item with fewer words is one shingle.
    A pair's best similarity is given, and where the first passage that has it begins, in words from 0.

    Case and marks count. Null and empty texts and items match nothing. Repeated rows give a pair once, and
    rows that share a key count as one document; rows without a key are examined too, and give pairs with a
    null key. Texts of any length are read whole. Other columns are not read; an empty table on either
    side gives no rows.
    """
    hits = similar_windows(docs, items, text, key, item_text, item_key, similarity, radius)
    best = hits.groupBy("k", "item").agg(F.max(F.struct(F.col("similarity"), (-F.col("start")).alias("s"))).alias("m"))
    return best.select(
        F.col("k").alias(key), F.col("item").alias(item_key), F.col("m.similarity").alias("similarity"), (-F.col("m.s")).cast("bigint").alias("first_word")
    )


def drop_contaminated(
    docs: DataFrame,
    items: DataFrame,
    text: str = "text",
    key: str = "doc_id",
    item_text: str = "text",
    item_key: str = "item_id",
    similarity: float = SIMILARITY,
    radius: int = RADIUS,
) -> DataFrame:
    """The rows without any leak, with all their columns.

    Each text is judged by itself: a clean row stays although another one with its key leaks, and a leaky
    row without a key goes. Repeated rows share their verdict.
    """
    hits = similar_windows(docs, items, text, key, item_text, item_key, similarity, radius)
    return without(docs, row_identity(docs[key], docs[text]), kept(hits.select("id").distinct()))
