"""Near duplicates by SimHash, with the codewords of a covering code as meeting points."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from teleloom.llm.common import broadcast_if_small, components, kept, row_identity, small_batches, without

SHINGLE_WORDS = 4
HASH_SEED = 42
MAX_BITS = 4
#: Homes, and visitors, of an anchor that meet in one cell; a fuller anchor is cut into a grid of cells.
CELL_ROWS = 2000

# The generator polynomial of the binary Golay code of length 23, which is perfect: every
# word of 23 bits lies within 3 bits of exactly one codeword.
GOLAY_BITS = 23
GOLAY_POLYNOMIAL = 0b101011100011
GOLAY_RADIUS = 3
# The bits of a fingerprint: two blocks with Golay anchors, and 18 bits that are their own anchor (radius 0).
BLOCKS = ((0, GOLAY_BITS), (GOLAY_BITS, GOLAY_BITS), (2 * GOLAY_BITS, 18))


def shingle_hashes(text: str | None, shingle_words: int) -> np.ndarray:
    """64-bit hashes of the word shingles of a whole text, in order; none if it has no word."""
    import xxhash

    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    body = b" ".join(words)
    ends = np.cumsum(lengths + 1) - 1
    width = min(shingle_words, len(words))
    spans = zip((ends - lengths)[: len(words) - width + 1].tolist(), ends[width - 1 :].tolist(), strict=True)
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(body[a:b], HASH_SEED) for a, b in spans), np.uint64, len(words) - width + 1)


def fingerprint(text: str | None, shingle_words: int = SHINGLE_WORDS) -> int:
    """64-bit SimHash over the word shingles of a whole text; zero if it has no word."""
    hashes = shingle_hashes(text, shingle_words)
    if not len(hashes):
        return 0
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 14):
        bits = np.unpackbits(hashes[i : i + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, text: str, key: str, shingle_words: int) -> DataFrame:
    """(key, identity, fp) of every row; the identity stands for key and text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [fingerprint(t.as_py(), shingle_words) for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(values, pa.int64())], ["key", "identity", "fp"])

    own = F.col(key).cast("bigint")
    rows = docs.select(own.alias("key"), row_identity(own, F.col(text)).alias("identity"), F.col(text).alias("text"))
    return rows.mapInArrow(run, "key bigint, identity string, fp bigint")


def block_thresholds(max_bits: int) -> list[int]:
    """Bits allowed in each block so that two fingerprints within ``max_bits`` meet in at least one of them.

    If every block had more differing bits than its threshold, these would be more than ``max_bits``.
    A block with threshold -1 is not needed.
    """
    shares = [-1, -1, -1]
    for i in range(max_bits + 1):
        shares[(0, 1, 2)[i % 3]] += 1
    return shares


def coset_patterns(radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(syndrome of every 23-bit value's parts, patterns by syndrome, their bounds).

    The patterns of a syndrome are all error patterns of at most ``radius`` bits that have it, the lightest
    first, which is the only one of at most three bits. XOR with a value gives the codewords around it.
    """
    bit_syndromes = []
    for i in range(GOLAY_BITS):
        value = 1 << i
        for k in range(GOLAY_BITS - 1, 10, -1):
            if value >> k & 1:
                value ^= GOLAY_POLYNOMIAL << (k - 11)
        bit_syndromes.append(value)
    found: list[list[int]] = [[] for _ in range(1 << 11)]
    for weight in range(radius + 1):
        for bits in combinations(range(GOLAY_BITS), weight):
            syndrome = 0
            for b in bits:
                syndrome ^= bit_syndromes[b]
            found[syndrome].append(sum(1 << b for b in bits))
    bounds = np.concatenate([[0], np.cumsum([len(f) for f in found])])
    return np.array(bit_syndromes, np.uint64), np.array([p for f in found for p in f], np.uint64), bounds


def anchor_rows(fps: np.ndarray, max_bits: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each block: (row, anchor key, home) of every anchor within covering radius plus threshold."""
    for i, ((low, bits), threshold) in enumerate(zip(BLOCKS, block_thresholds(max_bits), strict=True)):
        if threshold < 0:
            continue
        part = fps.view(np.uint64) >> np.uint64(low) & np.uint64((1 << bits) - 1)
        rows = np.arange(len(fps))
        if bits != GOLAY_BITS:
            # Every value is an anchor, so that the anchors within the threshold are its neighbours.
            flips = [sum(1 << b for b in c) for w in range(threshold + 1) for c in combinations(range(bits), w)]
            for flip in flips:
                yield rows, (part ^ np.uint64(flip)).astype(np.int64) | i << 32, np.full(len(fps), flip == 0)
            continue
        syndromes_of_bits, patterns, bounds = coset_patterns(GOLAY_RADIUS + threshold)
        syndrome = np.zeros(len(fps), np.uint64)
        for b in range(bits):
            syndrome ^= (part >> np.uint64(b) & np.uint64(1)) * syndromes_of_bits[b]
        first = bounds[syndrome.astype(np.int64)]
        counts = bounds[syndrome.astype(np.int64) + 1] - first
        rows = np.repeat(rows, counts)
        nth = np.arange(len(rows)) - np.repeat(np.cumsum(counts) - counts, counts)
        anchors = part[rows] ^ patterns[np.repeat(first, counts) + nth]
        yield rows, anchors.astype(np.int64) | i << 32, nth == 0


def _links(homes: np.ndarray, visitors: np.ndarray, home_nodes: np.ndarray, visitor_nodes: np.ndarray, max_bits: int):
    """(node, label): nodes of a cell that some path of links inside it ties to a smaller node, its smallest."""
    near = np.bitwise_count(homes[:, None] ^ visitors[None, :]) <= max_bits
    near &= home_nodes[:, None] != visitor_nodes[None, :]
    h, v = near.any(1), near.any(0)
    if not h.any():
        return None
    near, a, b = near[h][:, v], home_nodes[h], visitor_nodes[v]
    # A fingerprint can be home and visitor: both carry the same node, and labels are evened out by node.
    top = np.iinfo(np.int64).max
    label_a, label_b = a.copy(), b.copy()
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    while True:
        new_a = np.minimum(label_a, np.where(near, label_b[None, :], top).min(1))
        new_b = np.minimum(label_b, np.where(near, new_a[:, None], top).min(0))
        even = np.full(len(nodes), top)
        np.minimum.at(even, at, np.concatenate([new_a, new_b]))
        new_a, new_b = even[at[: len(a)]], even[at[len(a) :]]
        if (new_a == label_a).all() and (new_b == label_b).all():
            break
        label_a, label_b = new_a, new_b
    return nodes[even < nodes], even[even < nodes]


def links(distinct: DataFrame, max_bits: int, cell_rows: int = CELL_ROWS) -> DataFrame:
    """(a, b): links between the nodes of distinct fingerprints (fp, node), enough to tie every component.

    A fingerprint's home is the nearest anchor of each block; it also visits every other anchor within the
    covering radius plus the block's threshold. Two fingerprints that differ in at most the threshold meet
    at the home of either. Homes and visitors of an anchor are compared pair by pair on all 64 bits; a cell
    gives each node's smallest tie only, not all its links.
    """

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = batch.column(0).to_numpy(zero_copy_only=False)
            nodes = batch.column(1).to_numpy(zero_copy_only=False)
            for rows, anchors, home in anchor_rows(fps, max_bits):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(anchors), pa.array(home), pa.array(fps[rows]), pa.array(nodes[rows])], ["anchor", "home", "fp", "node"]
                )

    at = kept(distinct.select("fp", "node").mapInArrow(spread, "anchor bigint, home boolean, fp bigint, node bigint"))
    # An anchor without a home, or with one row only, has nothing to compare. Full anchors are cut into cells.
    load = at.groupBy("anchor").agg(F.count("*").alias("rows"), F.count_if("home").alias("homes")).where("homes > 0 and rows > 1")
    parts = lambda c: F.ceil(F.col(c) / cell_rows).cast("int")
    load = kept(load.select("anchor", parts("homes").alias("home_parts"), parts("rows").alias("visitor_parts")))
    met = at.join(broadcast_if_small(load, 16), "anchor")
    part = lambda c: F.pmod(F.xxhash64("fp"), F.col(c)).cast("int")
    every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    homes = met.where("home").select("anchor", part("home_parts").alias("hp"), every("visitor_parts").alias("vp"), "home", "fp", "node")
    visits = met.select("anchor", every("home_parts").alias("hp"), part("visitor_parts").alias("vp"), F.lit(False).alias("home"), "fp", "node")
    cells = homes.unionByName(visits).repartition("anchor", "hp", "vp").sortWithinPartitions("anchor", "hp", "vp")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[np.ndarray] | None = None
        for batch in _with_end(batches):
            new = None if batch is None else [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            whole = rest if new is None else new if rest is None else [np.concatenate(x) for x in zip(rest, new, strict=True)]
            if whole is None or not len(whole[0]):
                continue
            cuts = np.flatnonzero((np.diff(whole[0]) != 0) | (np.diff(whole[1]) != 0) | (np.diff(whole[2]) != 0)) + 1
            bounds = np.concatenate([[0], cuts, [len(whole[0])]])
            if new is not None:  # the last cell may go on
                rest = [c[bounds[-2] :] for c in whole]
                bounds = bounds[:-1]
            out_a, out_b = [], []
            for k in np.flatnonzero(np.diff(bounds) > 1):
                home, fp, node = (c[bounds[k] : bounds[k + 1]] for c in whole[3:])
                if home.any() and not home.all():
                    found = _links(fp[home].view(np.uint64), fp[~home].view(np.uint64), node[home], node[~home], max_bits)
                    if found is not None:
                        out_a.append(found[0])
                        out_b.append(found[1])
            if out_a:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out_a)), pa.array(np.concatenate(out_b))], ["a", "b"])

    return cells.select("anchor", "hp", "vp", "home", "fp", "node").mapInArrow(compare, "a bigint, b bigint")


def _with_end(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from batches
    yield None


def grouped(docs: DataFrame, text: str, key: str, max_bits: int, shingle_words: int) -> DataFrame:
    """(key, identity, fp, component) of every row: a component is named by the smallest fingerprint in it.

    Fingerprints are their own nodes, so that one that only rows without a key have ties others as well.
    """
    small_batches(docs.sparkSession)
    rows = kept(fingerprints(docs, text, key, shingle_words))
    distinct = kept(rows.select("fp").distinct().withColumn("node", F.col("fp")))
    tied = components(links(distinct, max_bits)).withColumnRenamed("node", "fp")
    return rows.join(tied, "fp", "left").select("key", "identity", "fp", F.coalesce("component", "fp").alias("component"))


def near_duplicates(
    docs: DataFrame, text: str = "text", key: str = "doc_id", max_bits: int = MAX_BITS, shingle_words: int = SHINGLE_WORDS
) -> DataFrame:
    """(key, fingerprint, component_id) of every row.

    ``component_id`` is the smallest integer key that links of at most ``max_bits`` differing bits reach,
    the row's own included. Fingerprints are taken over whole texts, equal ones compared once.

    Null, empty and blank texts have fingerprint zero and are linked like any other; a text of fewer words
    than a shingle is one shingle. Repeated rows share fingerprint and component. A row without a key takes
    the component of its fingerprint, and ties others like any row; a component without any key is null.
    A key that stands for several texts ties none of them. Other columns are not read; no rows give no rows.
    """
    rows = kept(grouped(docs, text, key, max_bits, shingle_words))
    least = rows.groupBy("component").agg(F.min("key").alias("component_id"))
    found = rows.join(least, "component")
    return found.select(F.col("key").alias(key), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near_duplicates(
    docs: DataFrame, text: str = "text", key: str = "doc_id", max_bits: int = MAX_BITS, shingle_words: int = SHINGLE_WORDS
) -> DataFrame:
    """One row of each group stays, with all its columns: one with the smallest key.

    A row without a key stays only if its group has none with one. Of several texts with the smallest key one
    stays, and of rows that repeat key and text one, whatever their other columns hold.
    """
    rows = kept(grouped(docs, text, key, max_bits, shingle_words).groupBy("component", "identity").agg(F.min("key").alias("key"), F.count("*").alias("rows")))
    first = rows.groupBy("component").agg(F.min(F.struct(F.col("key").isNull().alias("none"), "key", "identity")).alias("first"))
    verdict = rows.join(first, "component").withColumn("stays", F.col("identity") == F.col("first.identity"))
    verdict = kept(verdict.where("not stays or rows > 1").select("identity", "stays"))
    gone, repeated = verdict.where("not stays").select("identity"), verdict.where("stays").select("identity")
    return without(docs, row_identity(docs[key].cast("bigint"), docs[text]), gone, repeated)
