"""Removal of passages that an earlier document has, located by sharded Aho-Corasick automata."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import compress, count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from teleloom.llm.common import kept, small_batches
from teleloom.llm.textbytes import framed, joined, rolling, sized, word_hashes, word_spans

WINDOW = 13
#: A window's seed is the run of so many of its words with the smallest hash; equal windows have equal seeds.
SEED_WORDS = 5
#: Passages that one automaton takes, on average; their number decides the number of shards.
SHARD_ROWS = 4000
#: A seed is hot if it has at least so many passages, and this share of all; the share bounds the list of hot
#: seeds, which the workers are sent. A text that repeats few words has many passages of one seed.
HOT_PASSAGES = 2000
HOT_SHARE = 1e-5
#: Bits of the filter for each recurring seed, and the most it has (64 MB). The filter saves shuffled
#: passages; one that is too full for the data lets more of them through and changes no result.
FILTER_BITS = 16
FILTER_MOST = 1 << 29
CHUNK_BITS = 1 << 19
#: Recurring windows of hot seeds that one broadcast automaton takes (some 2 kB each); beyond it they are joined.
HOT_WINDOWS = 20_000


def least_places(values: np.ndarray, width: int) -> np.ndarray:
    """The place of the smallest of each ``width`` neighbours, the first one of equals."""
    low, place, have = values, np.arange(len(values)), 1
    while have < width:
        step = min(have, width - have)
        left, right = low[:-step], low[step:]
        later = right < left
        low, place = np.where(later, right, left), np.where(later, place[step:], place[:-step])
        have += step
    return place


def window_seeds(texts: list[str | None], window: int = WINDOW) -> tuple:
    """(bytes, word begins, word ends, first word of each text, windows, where each one's seed begins, seeds).

    ``windows`` are the positions of the windows that lie within one text; a seed's place and hash are given
    for each of them.
    """
    raw, starts = joined(texts)
    word_at, word_to = word_spans(raw)
    first = np.searchsorted(word_at, starts)
    runs = rolling(word_hashes(raw, word_at, word_to), SEED_WORDS)
    each = window - SEED_WORDS + 1
    if len(word_at) < window:
        none = np.zeros(0, np.int64)
        return raw, word_at, word_to, first, none, none, np.zeros(0, np.uint64)
    place = least_places(runs, each)
    windows = np.flatnonzero(np.arange(window, len(place) + window) <= np.repeat(first[1:], np.diff(first))[: len(place)])
    place = place[windows]
    return raw, word_at, word_to, first, windows, place, runs[place]


def seed_counts(docs: DataFrame, text: str, window: int) -> DataFrame:
    """(seed, n, m): seeds, the number of rows that have them, and of passages around them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, texts in sized(batches, 0):
            _, _, _, first, windows, place, seeds = window_seeds(texts, window)
            fresh = np.concatenate([[True], np.diff(place) != 0])[: len(place)]
            owner, seeds = np.searchsorted(first, windows[fresh], "right"), seeds[fresh]
            order = np.argsort(seeds, kind="stable")  # owners ascend already
            owner, seeds = owner[order], seeds[order]
            begins = np.concatenate([[True], seeds[1:] != seeds[:-1]])[: len(seeds)]
            single = begins | np.concatenate([[True], np.diff(owner) != 0])[: len(seeds)]
            values, counts = seeds[begins], np.diff(np.flatnonzero(begins[single]), append=single.sum())
            passages = np.diff(np.flatnonzero(begins), append=len(seeds))
            columns = [pa.array(values.view(np.int64)), pa.array(counts, pa.int64()), pa.array(passages, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["seed", "n", "m"])

    rows = docs.select(F.col(text)).mapInArrow(run, "seed bigint, n bigint, m bigint")
    return rows.groupBy("seed").agg(F.sum("n").alias("n"), F.sum("m").alias("m"))


def _bits(seeds: np.ndarray, chunks: int) -> tuple[np.ndarray, np.ndarray]:
    """Chunk of every seed, and its two bits within."""
    seeds = seeds.view(np.uint64)
    low = seeds & np.uint64(CHUNK_BITS - 1), seeds >> np.uint64(19) & np.uint64(CHUNK_BITS - 1)
    return (seeds >> np.uint64(38)) % np.uint64(chunks), np.stack(low)


def seed_filter(seeds: DataFrame, count: int) -> np.ndarray:
    """Bits (chunk, byte) that are set for every given seed; each chunk is made by one task."""
    chunks = max(1, min(FILTER_MOST, 1 << (FILTER_BITS * max(1, count)).bit_length()) // CHUNK_BITS)

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: dict[int, np.ndarray] = {}
        for batch in batches:
            chunk, bits = _bits(batch.column(0).to_numpy(zero_copy_only=False), chunks)
            for c in np.unique(chunk).tolist():
                own = made.setdefault(c, np.zeros(CHUNK_BITS // 8, np.uint8))
                at = bits[:, chunk == c].ravel()
                np.bitwise_or.at(own, at >> np.uint64(3), np.uint8(1) << (at & np.uint64(7)).astype(np.uint8))
        for c, own in made.items():
            yield pa.RecordBatch.from_arrays([pa.array([c], pa.int64()), pa.array([own.tobytes()], pa.binary())], ["chunk", "bits"])

    dealt = seeds.select("seed", F.expr(f"pmod(shiftrightunsigned(seed, 38), {chunks})").alias("chunk")).repartition("chunk")
    out = np.zeros((chunks, CHUNK_BITS // 8), np.uint8)
    for row in dealt.select("seed").mapInArrow(fill, "chunk bigint, bits binary").toLocalIterator():
        out[row["chunk"]] |= np.frombuffer(row["bits"], np.uint8)
    return out


def _passes(filled: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    chunk, bits = _bits(seeds, len(filled))
    hit = filled[chunk, bits >> np.uint64(3)] >> (bits & np.uint64(7)).astype(np.uint8) & 1
    return hit.all(0)


def locate(texts: list[bytes], docs: list[int], at: list[int], window: int) -> Iterator[tuple[int, int, int]]:
    """(row, first word, last word + 1) of everything in the passages that a smaller document has too.

    Equal passages are one text, with its smallest and largest document. Windows that recur are confirmed word
    by word, with the smallest document that has them; an automaton of these is compiled, and every text that may
    hold one is streamed through it. Documents behind a text's smallest one have the same spans: each window of
    the text has been seen by then.
    """
    rows: dict[bytes, list[int]] = {}
    for i, text in enumerate(texts):
        rows.setdefault(text, []).append(i)
    distinct = list(rows)
    low = [min([docs[i] for i in rows[text]]) for text in distinct]
    high = [max([docs[i] for i in rows[text]]) for text in distinct]
    places: dict[int, list[int]] = {}
    for t, j in zip(*shared_windows(distinct, low, high, window), strict=True):
        places.setdefault(t, []).append(j)
    numbers: dict[bytes, int] = defaultdict(count(1).__next__)
    words = {t: tuple(map(numbers.__getitem__, distinct[t].split())) for t in places}
    order = sorted(places, key=low.__getitem__)
    first: dict[tuple, int] = {}
    recurring: set[tuple] = set()
    for t in order:
        sequence, doc, last = words[t], low[t], high[t]
        for j in places[t]:
            run = sequence[j : j + window]
            if first.setdefault(run, doc) != last:
                recurring.add(run)
    if not recurring:
        return
    automaton = compiled({run: first[run] for run in recurring})
    for t in order:
        early = list(covered(automaton, words[t], low[t], window))
        late = list(covered(automaton, words[t], high[t], window)) if high[t] > low[t] else early
        for i in rows[distinct[t]]:
            for begin, end in early if docs[i] == low[t] else late:
                yield i, at[i] + begin, at[i] + end


def shared_windows(texts: list[bytes], low: list[int], high: list[int], window: int) -> tuple[list[int], list[int]]:
    """(text, place in it) of the windows whose hash several documents have: all that recur, and few others.

    ``low`` and ``high`` are the smallest and the largest document of each text.
    """
    raw, starts = framed(texts)
    word_at, word_to = word_spans(raw)
    first = np.searchsorted(word_at, starts)
    hashes = rolling(word_hashes(raw, word_at, word_to), window)
    ends = np.repeat(first[1:], np.diff(first))[: len(hashes)]
    windows = np.flatnonzero(np.arange(window, len(hashes) + window) <= ends)
    if not len(windows):
        return [], []
    owner = np.searchsorted(first, windows, "right") - 1
    order = np.argsort(hashes[windows])
    ordered, by = hashes[windows][order], owner[order]
    begins = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
    several = np.minimum.reduceat(np.array(low, np.int64)[by], begins) < np.maximum.reduceat(np.array(high, np.int64)[by], begins)
    chosen = np.sort(order[np.repeat(several, np.diff(begins, append=len(order)))])
    return owner[chosen].tolist(), (windows[chosen] - first[owner[chosen]]).tolist()


def compiled(passages: dict[tuple, int]):
    """The automaton of word numbers that finds the passages, each with its smallest document."""
    import ahocorasick

    automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
    for run, doc in passages.items():
        automaton.add_word(run, doc)
    automaton.make_automaton()
    return automaton


def covered(automaton, words: tuple, doc: int, window: int) -> Iterator[tuple[int, int]]:
    """Spans of the words that windows of a smaller document cover."""
    begin = end = -1
    for last, first in automaton.iter(words):
        if first < doc:
            if last - window + 1 > end:
                if end >= 0:
                    yield begin, end
                begin = last - window + 1
            end = last + 1
    if end >= 0:
        yield begin, end


def repeated_spans(docs: DataFrame, text: str, key: str, window: int) -> DataFrame:
    """(key, _hash, a, b): spans of words to remove, of rows named by key and text hash; they may overlap."""
    rows = docs.where(F.col(key).isNotNull()).select(F.col(key).cast("bigint").alias("k"), F.col(text).alias("t"), F.xxhash64(text).alias("h"))
    counts = kept(seed_counts(rows, "t", window).where("n > 1"))
    totals = counts.agg(F.count("*").alias("seeds"), F.coalesce(F.sum("m"), F.lit(0)).alias("m")).first()
    hot_from = max(HOT_PASSAGES, int(totals["m"] * HOT_SHARE))
    hot = np.array([r["seed"] for r in counts.where(F.col("m") >= hot_from).select("seed").collect()], np.int64)
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((seed_filter(counts, totals["seeds"]), np.sort(hot)))

    def candidates(batches: Iterator[pa.RecordBatch], hot_ones: bool) -> Iterator[pa.RecordBatch]:
        """Passages around a recurring seed: all windows in a row that share it, or single windows of a hot one."""
        filled, hot_seeds = shared.value
        for batch, texts in sized(batches):
            raw, word_at, word_to, first, windows, place, seeds = window_seeds(texts, window)
            # Neighbouring windows mostly have the same seed, which is looked up once.
            begins = np.concatenate([[True], np.diff(place) != 0])[: len(place)]
            each = seeds[begins]
            signed = each.view(np.int64)
            is_hot = hot_seeds[np.minimum(np.searchsorted(hot_seeds, signed), len(hot_seeds) - 1)] == signed if len(hot_seeds) else np.zeros(len(each), bool)
            take = (is_hot if hot_ones else _passes(filled, each) & ~is_hot)[np.cumsum(begins) - 1]
            windows, place, signed = windows[take], place[take], seeds.view(np.int64)[take]
            if hot_ones:
                a, b = windows, windows
            else:
                begins = np.concatenate([[True], (np.diff(windows) != 1) | (np.diff(place) != 0)])[: len(windows)]
                at = np.flatnonzero(begins)
                a, b, signed = windows[at], windows[np.concatenate([at[1:], [len(windows)]])[: len(at)] - 1], signed[at]
            owner = np.searchsorted(first, a, "right") - 1
            body = raw.tobytes()
            # Words joined by one space already are taken as they stand.
            loose = np.cumsum(np.concatenate([[False], (word_at[1:] - word_to[:-1] != 1) | (raw[word_to[:-1]] != 0x20)]))
            spans = zip(word_at[a].tolist(), word_to[b + window - 1].tolist(), (loose[a] == loose[b + window - 1]).tolist(), strict=True)
            passages = [body[x:y] if tidy else b" ".join(body[x:y].split()) for x, y, tidy in spans]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(signed),
                    batch.column(0).take(pa.array(owner)),
                    batch.column(2).take(pa.array(owner)),
                    pa.array(a - first[owner], pa.int64()),
                    pa.array(passages, pa.binary()),
                ],
                ["seed", "k", "h", "at", "words"],
            )

    shape = "seed bigint, k bigint, h bigint, at bigint, words binary"
    cold = rows.mapInArrow(lambda batches: candidates(batches, False), shape)
    shards = max(1, -(-int(totals["m"]) // SHARD_ROWS))

    def sharded(group: pa.Table) -> pa.Table:
        keys = group.column("k").to_pylist()
        found = list(locate(group.column("words").to_pylist(), keys, group.column("at").to_pylist(), window))
        at = pa.array([i for i, _, _ in found], pa.int64())
        ends = [pa.array([f[i] for f in found], pa.int64()) for i in (1, 2)]
        return pa.table([group.column("k").take(at), group.column("h").take(at), *ends], names=["k", "h", "a", "b"])

    by_shard = cold.withColumn("shard", F.pmod(F.xxhash64("seed"), F.lit(shards))).drop("seed").groupBy("shard")
    spans = by_shard.applyInArrow(sharded, "k bigint, h bigint, a bigint, b bigint")
    if len(hot):
        spans = spans.union(_hot_spans(rows, lambda batches: candidates(batches, True), shape, window))
    return spans


def _hot_spans(rows: DataFrame, candidates, shape: str, window: int) -> DataFrame:
    """Spans covered by windows of hot seeds, which up to all documents may share.

    The windows' smallest documents are a plain aggregate, reduced within each slice of a task first. One
    automaton of those that recur is sent to all tasks, and every document is streamed through it where it
    lies; if they are too many, they are joined to all their occurrences, which Spark can split.
    """

    def reduced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in candidates(batches):
            found = pa.table([batch.column("words"), batch.column("k")], ["words", "k"]).group_by("words").aggregate([("k", "min"), ("k", "max")])
            yield from found.select(["words", "k_min", "k_max"]).rename_columns(["words", "first", "last"]).combine_chunks().to_batches()

    ends = rows.mapInArrow(reduced, "words binary, first bigint, last bigint")
    recurring = ends.groupBy("words").agg(F.min("first").alias("first"), F.max("last").alias("last")).where("first < last").drop("last")
    recurring = kept(recurring)
    if recurring.count() > HOT_WINDOWS:
        later = rows.mapInArrow(candidates, shape).join(recurring, "words").where("k > first")
        return later.select("k", "h", F.col("at").alias("a"), (F.col("at") + window).alias("b"))
    shared = rows.sparkSession.sparkContext.broadcast([(bytes(r["words"]), r["first"]) for r in recurring.collect()])

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers: dict[bytes, int] = {}
        automaton = compiled({tuple([numbers.setdefault(w, len(numbers) + 1) for w in t.split()]): doc for t, doc in shared.value})
        for batch, texts in sized(batches):
            found = []
            for i, (doc, text) in enumerate(zip(batch.column(0).to_pylist(), texts, strict=True)):
                sequence = tuple([numbers.get(w, 0) for w in (text or "").encode().split()])
                if shared.value and len(sequence) >= window:
                    found += [(i, a, b) for a, b in covered(automaton, sequence, doc, window)]
            at = pa.array([i for i, _, _ in found], pa.int64())
            spans = [pa.array([f[i] for f in found], pa.int64()) for i in (1, 2)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(2).take(at), *spans], ["k", "h", "a", "b"])

    return rows.mapInArrow(stream, "k bigint, h bigint, a bigint, b bigint")


def remove_repeated_passages(docs: DataFrame, text: str = "text", key: str = "doc_id", window: int = WINDOW) -> DataFrame:
    """(key, n_words, n_removed, kept_text) of every row.

    Words are separated by ASCII blanks. A word goes if some run of ``window`` words that covers it starts in
    a document with a smaller integer key as well; runs are judged on the input, and no row's own
    repetitions count. Kept words are joined by one space.

    First, seeds of all windows are counted; then passages around seeds that recur are dealt to shards by
    their seed, and each shard confirms them, compiles its automaton and streams its passages through it.
    Null and empty texts have no words. Rows without a key lose nothing and take nothing from others. Rows
    that repeat a key are one document for each other. Other columns are not read; no rows give no rows.
    """
    small_batches(docs.sparkSession)
    spans = repeated_spans(docs, text, key, window)
    # A row's spans are bounded by its own text.
    lists = spans.groupBy("k", "h").agg(F.collect_list(F.struct("a", "b")).alias("spans"))
    source = docs.select(F.col(key), F.col(text).alias("_t"), F.xxhash64(text).alias("_h"))
    both = source.join(lists, (source[key] == lists["k"]) & (source["_h"] == lists["h"]), "left")
    kind = docs.select(F.col(key)).schema[0].simpleString().replace(":", " ", 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in sized(batches):
            counts, removed, left = [], [], []
            found = batch.column(2)
            begins, ends = (found.values.field(c).to_numpy(zero_copy_only=False) for c in ("a", "b"))
            offsets, valid = found.offsets.to_pylist(), found.is_valid().to_pylist()
            for i, whole in enumerate(texts):
                words = (whole or "").encode().split()
                counts.append(len(words))
                if valid[i]:
                    go = np.zeros(len(words), bool)
                    for a, b in zip(begins[offsets[i] : offsets[i + 1]].tolist(), ends[offsets[i] : offsets[i + 1]].tolist(), strict=True):
                        go[a:b] = True
                    words = list(compress(words, (~go).tolist()))
                removed.append(counts[-1] - len(words))
                left.append(b" ".join(words).decode())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(left, pa.string())],
                [key, "n_words", "n_removed", "kept_text"],
            )

    return both.select(key, "_t", "spans").mapInArrow(run, f"{kind}, n_words bigint, n_removed bigint, kept_text string")
