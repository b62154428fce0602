"""Token counts by a broadcast table of frequent pre-token lengths and a cache in every worker."""

from __future__ import annotations

import re
from array import array
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from teleloom.llm.common import kept, small_batches

MARK = "▁"
#: Pre-tokens of the first tier are at least this share of all, which bounds their number by its inverse. The first
#: tier holds hints only: a pre-token outside it is encoded by the library, so that no bound has a part in any count.
HINT_SHARE = 5e-5
#: Different pre-tokens that a task hands on, and those it counts at once.
HINT_WORDS = 20_000
TASK_WORDS = 100_000
CACHE_WORDS = 300_000
#: A longer pre-token is encoded, but not held.
CACHE_CHARS = 64
TOKEN_LIMIT = 4096

# A run of spaces with the other characters behind it. No piece has the space mark behind another
# character, so that no merge crosses these borders.
PRE_TOKEN = re.compile(f"[ {MARK}]*[^ {MARK}]+|[ {MARK}]+")


def load_encoder(model: str):
    """The library with one model file, whose pieces must not cross the borders of pre-tokens."""
    import sentencepiece

    encoder = sentencepiece.SentencePieceProcessor(model_file=model)
    crossing = [p for p in map(encoder.id_to_piece, range(encoder.get_piece_size())) if MARK in p.lstrip(MARK)]
    if crossing:
        raise ValueError(f"pieces of {model} cross word borders: {crossing[:3]}")
    return encoder


def _length(encoder, word: str) -> int:
    """Tokens of a pre-token inside a text. Every text starts with a space mark of its own, also this one."""
    # "x" is a piece of its own after any pre-token, as merges never cross a border.
    return len(encoder.encode("x" + word)) - len(encoder.encode("x"))


def count_tokens(text: str, encoder, tables: list[dict], cache: dict) -> int:
    """Tokens of a whole text: the sum over its pre-tokens."""
    if not text:
        return 0
    if "\0" in text:
        return len(encoder.encode(text))
    total = 0
    for word in PRE_TOKEN.findall(" " + text):
        n = tables[0].get(word)
        if n is None:
            n = cache.get(word)
            if n is None:
                n = _length(encoder, word)
                if len(word) <= CACHE_CHARS:
                    if len(cache) >= CACHE_WORDS:
                        cache.clear()
                    cache[word] = n
        total += n
    return total


def frequent_words(docs: DataFrame, text: str, share: float = HINT_SHARE, words: int = HINT_WORDS) -> list[str]:
    """Pre-tokens that are at least a share of all counted ones, at most ``1 / share``.

    Each task counts the pre-tokens of its texts and hands on the commonest ``words``; on the way it drops the rarest
    whenever it holds ``TASK_WORDS``. Only these counts are added up; no text and no other pre-token is shuffled.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in batches:
            for value in batch.column(0):
                seen.update(w for w in PRE_TOKEN.findall(" " + value.as_py()) if len(w) <= CACHE_CHARS)
                if len(seen) > TASK_WORDS:
                    seen = Counter(dict(seen.most_common(TASK_WORDS // 2)))
        top = seen.most_common(words)
        yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in top], pa.string()), pa.array([n for _, n in top], pa.int64())], ["w", "n"])

    some = docs.select(F.col(text).alias("t")).where("t is not null").mapInArrow(count, "w string, n bigint").where(r"not contains(w, '\0')")
    counts = kept(some.groupBy("w").agg(F.sum("n").alias("n")))
    least = (counts.agg(F.sum("n").alias("n")).first()["n"] or 0) * share
    return sorted(r["w"] for r in counts.where(F.col("n") >= least).select("w").collect())


class FirstTier:
    """A broadcast table of lengths: all words in one string, their lengths as small numbers."""

    def __init__(self, words: list[str], lengths: list[int]) -> None:
        self.words, self.lengths = "\0".join(words), array("H", lengths)

    def opened(self) -> dict[str, int]:
        return dict(zip(self.words.split("\0"), self.lengths, strict=True)) if self.lengths else {}


def token_counts(
    spark: SparkSession, docs: DataFrame, model: str, text: str = "text", key: str = "doc_id", limit: int = TOKEN_LIMIT
) -> DataFrame:
    """(key, n_bytes, n_tokens, over_limit) of every whole text, as the library counts them.

    ``model`` is a sentencepiece file that every worker can open. First tier: a broadcast table of the
    lengths of the pre-tokens that are at least ``HINT_SHARE`` of all texts. Second tier: pre-tokens that miss are encoded once for
    each worker and held in a bounded cache. No text is shuffled and no row leaves its partition. A text is
    read whole into one task, however long.

    Null and empty texts have no tokens; a text of blanks has those that the library gives. Strings of
    special tokens are ordinary text. Repeated rows are counted each; other columns are not read.
    """
    small_batches(spark)
    encoder = load_encoder(model)
    hints = frequent_words(docs, text)
    shared = spark.sparkContext.broadcast(FirstTier(hints, [_length(encoder, w) for w in hints]))
    schema = docs.select(F.col(key)).schema
    names = [key, "n_bytes", "n_tokens"]
    out = f"{schema[0].simpleString().replace(':', ' ', 1)}, n_bytes bigint, n_tokens bigint"

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        library, cache = load_encoder(model), {}
        tables = [shared.value.opened()]
        for batch in batches:
            n_bytes, n_tokens = [], []
            for value in batch.column(1):
                whole = value.as_py() or ""
                n_bytes.append(len(whole.encode()))
                n_tokens.append(count_tokens(whole, library, tables, cache))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_bytes, pa.int64()), pa.array(n_tokens, pa.int64())], names)

    rows = docs.select(F.col(key), F.col(text)).mapInArrow(count, out)
    return rows.withColumn("over_limit", F.col("n_tokens") > limit)
