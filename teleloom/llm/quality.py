"""Document quality by attention over passages (multiple-instance learning), in numpy."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from teleloom.llm.common import small_batches
from teleloom.llm.textbytes import BLOCK, joined, sized, word_hashes, word_spans

#: Labelled rows the network is fitted to, in the order of a hash of their keys, at most so many of either
#: label. Every row is scored, however many there are.
TRAIN_ROWS = 700
PASSAGE = 384
HIDDEN = 16
GATE = 8
ROUNDS = 300
RATE = 0.01
KEEP_SCORE = 0.7

CLASSES = 13


def byte_classes() -> np.ndarray:
    """A small class for every byte: letters by case, digits, blanks and kinds of marks."""
    table = np.full(256, 11, np.uint8)
    table[128:] = 2
    table[ord("a") : ord("z") + 1] = 0
    table[ord("A") : ord("Z") + 1] = 1
    table[ord("0") : ord("9") + 1] = 3
    table[[ord(" "), ord("\t")]] = 4
    table[[ord("\n"), ord("\r")]] = 5
    table[[ord(c) for c in ".?"]] = 6
    table[[ord(c) for c in ",;:'\"-()"]] = 7
    table[ord("!")] = 8
    table[ord("|")] = 9
    table[[ord(c) for c in "#$%&*"]] = 10
    table[:9] = table[14:32] = 12
    return table


def passages(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(features of every passage, first passage of each text).

    A passage is a run of ``PASSAGE`` bytes; a text has at least one. Features are the shares of pairs of
    neighbouring byte classes, of words equal to the word before, and of distinct words, the mean word
    length, and the passage's length.
    """
    raw, starts = joined(texts)
    lengths = np.diff(starts) - 1
    counts = np.maximum(1, -(-lengths // PASSAGE))
    first = np.concatenate([[0], np.cumsum(counts)])
    n = int(first[-1])
    byte_text = np.repeat(np.arange(len(texts)), np.diff(starts))
    within = np.arange(len(raw)) - starts[byte_text]
    owner = first[byte_text] + np.minimum(within // PASSAGE, counts[byte_text] - 1)
    kinds = byte_classes()[raw].astype(np.int64)
    # The line feed behind a text is its last byte; no pair goes on to the next text.
    whole = byte_text[1:] == byte_text[:-1]
    pairs = (owner[:-1] * CLASSES**2 + kinds[:-1] * CLASSES + kinds[1:])[whole]
    pairs = np.bincount(pairs, minlength=n * CLASSES**2).reshape(n, -1)
    size = np.bincount(owner, minlength=n)
    out = np.zeros((n, CLASSES**2 + 4), np.float32)
    out[:, : CLASSES**2] = np.sqrt(pairs / np.maximum(1, size)[:, None])
    word_at, word_to = word_spans(raw)
    if len(word_at):
        h = word_hashes(raw, word_at, word_to)
        own = owner[word_at]
        words = np.maximum(1, np.bincount(own, minlength=n))
        same = np.concatenate([[False], (h[1:] == h[:-1]) & (own[1:] == own[:-1])])
        order = np.lexsort((h, own))
        fresh = np.concatenate([[True], (h[order][1:] != h[order][:-1]) | (own[order][1:] != own[order][:-1])])
        out[:, -4] = np.bincount(own, same, n) / words
        out[:, -3] = np.bincount(own[order], fresh, n) / words
        out[:, -2] = np.bincount(own, word_to - word_at, n) / words / 20
    out[:, -1] = np.log1p(size) / 6
    return out, first[:-1]


def training_passages(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The same for many texts, a few at a time: the features are small, the bytes' arrays are not."""
    parts, a, seen = [], 0, 0
    for i, t in enumerate(texts):
        seen += len(t or "")
        if seen >= BLOCK // 2 or i == len(texts) - 1:
            parts.append(passages(texts[a : i + 1]))
            a, seen = i + 1, 0
    before = np.cumsum([0, *[len(x) for x, _ in parts]])
    return np.concatenate([x for x, _ in parts]), np.concatenate([f + b for (_, f), b in zip(parts, before, strict=False)])


@dataclass
class Attention:
    """Passage encoder, gated attention (tanh branch, sigmoid branch, weight) and the document's score."""

    shift: np.ndarray
    scale: np.ndarray
    w: list[np.ndarray]  # encode, encode bias, tanh branch, gate branch, attention weight, score, score bias

    def forward(self, x: np.ndarray, first: np.ndarray) -> tuple:
        encode, bias, v, u, a, c, c0 = self.w
        x = (x - self.shift) * self.scale
        h = np.tanh(x @ encode + bias)
        t, s = np.tanh(h @ v), 0.5 + 0.5 * np.tanh(h @ u / 2)
        e = (t * s) @ a
        bag = np.repeat(np.arange(len(first)), np.diff([*first, len(x)]))
        e = np.exp(e - np.maximum.reduceat(e, first)[bag])
        weight = e / np.add.reduceat(e, first)[bag]
        z = np.add.reduceat(h * weight[:, None], first, axis=0)
        score = 0.5 + 0.5 * np.tanh((z @ c + c0[0]) / 2)
        return x, h, t, s, bag, weight, z, score

    def score(self, texts: list[str | None]) -> np.ndarray:
        return self.forward(*passages(texts))[-1]


def train(texts: list[str], good: list[int], rounds: int = ROUNDS, seed: int = 11) -> Attention:
    """Fit to labelled texts by Adam over all of them; both labels weigh the same."""
    x, first = training_passages(texts)
    r = np.random.default_rng(seed)
    small = lambda *shape: (r.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
    k = x.shape[1]
    w = [small(k, HIDDEN), np.zeros(HIDDEN, np.float32), small(HIDDEN, GATE), small(HIDDEN, GATE), small(GATE), small(HIDDEN), np.zeros(1, np.float32)]
    model = Attention(x.mean(0), 1 / (x.std(0) + 0.02), w)
    y = np.asarray(good, np.float32)
    share = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum()))
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in w]
    for step in range(1, rounds + 1):
        scaled, h, t, s, bag, weight, z, score = model.forward(x, first)
        encode, bias, v, u, a, c, c0 = w
        g_logit = ((score - y) * share).astype(np.float32)
        g_c, g_c0 = z.T @ g_logit, g_logit.sum()
        g_z = g_logit[:, None] * c
        # Attention: the softmax within each document, then both branches.
        gained = (h * g_z[bag]).sum(1)
        g_e = weight * (gained - np.add.reduceat(weight * gained, first)[bag])
        g_ts = g_e[:, None] * a
        g_t, g_s = g_ts * s * (1 - t * t), g_ts * t * s * (1 - s)
        g_h = weight[:, None] * g_z[bag] + g_t @ v.T + g_s @ u.T
        g_pre = g_h * (1 - h * h)
        gradients = [scaled.T @ g_pre + 1e-4 * encode, g_pre.sum(0), h.T @ g_t, h.T @ g_s, (t * s).T @ g_e, g_c, np.array([g_c0])]
        for p, g, (m, q) in zip(w, gradients, moments, strict=True):
            m += 0.1 * (g - m)
            q += 0.01 * (g * g - q)
            p -= (RATE * (m / (1 - 0.9**step)) / (np.sqrt(q / (1 - 0.99**step)) + 1e-7)).astype(np.float32)
    return model


def training_rows(docs: DataFrame, labels: DataFrame, text: str, quality: str, key: str, rows: int) -> tuple[list[str], list[int]]:
    """Texts of at most ``rows`` labels of either kind, the first by a hash of the key.

    The labels are chosen by their keys alone, and these few rows are sent to the documents.
    """
    picked = None
    for good in (0, 1):
        some = labels.where((F.col(quality) == good) & F.col(key).isNotNull()).select(F.col(key).alias("_k"), F.lit(good).alias("_good")).distinct()
        some = some.orderBy(F.xxhash64("_k"), "_k").limit(rows)
        picked = some if picked is None else picked.union(some)
    found = docs.join(F.broadcast(picked), docs[key] == F.col("_k")).select("_k", "_good", F.coalesce(F.col(text), F.lit("")).alias("_t"))
    order = sorted((r["_k"], r["_good"], r["_t"]) for r in found.collect())
    return [t for _, _, t in order], [g for _, g, _ in order]


def fit(
    docs: DataFrame, labels: DataFrame, text: str = "text", quality: str = "quality", key: str = "doc_id", rows: int = TRAIN_ROWS
) -> Attention | None:
    """The network for documents with labels; none if either label is missing."""
    texts, good = training_rows(docs, labels, text, quality, key, rows)
    return train(texts, good) if 0 in good and 1 in good else None


def score_quality(
    docs: DataFrame, model: Attention | None, text: str = "text", key: str = "doc_id", keep_score: float = KEEP_SCORE, columns: list[str] | None = None
) -> DataFrame:
    """(key, or ``columns``, score, predicted) of every row: how likely its whole text is good, and the verdict.

    Every passage of a text is encoded, and the attention's weights make one representation of them; the
    longest text takes no more than its own passages. Null and empty texts are one empty passage. Without
    a model, for want of labels, every score is 1. Repeated rows get the same score.
    """
    small_batches(docs.sparkSession)
    columns = columns or [key]
    read = columns if text in columns else [*columns, text]
    rows = docs.select(*read)
    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema[: len(columns)]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, values in sized(batches, read.index(text)):
            scores = np.ones(len(values)) if model is None else model.score(values).astype(np.float64)
            own = batch.columns[: len(columns)]
            yield pa.RecordBatch.from_arrays([*own, pa.array(np.clip(scores, 0, 1), pa.float64())], [*columns, "score"])

    scored = rows.mapInArrow(run, ", ".join([*kinds, "score double"]))
    return scored.withColumn("predicted", (F.col("score") >= keep_score).cast("int"))


def keep_good(docs: DataFrame, model: Attention | None, text: str = "text", keep_score: float = KEEP_SCORE) -> DataFrame:
    """The rows that the verdict keeps, with all their columns, under the names they had."""
    inner = [f"c{i}" for i in range(len(docs.columns))]
    at = inner[docs.columns.index(text)]
    scored = score_quality(docs.toDF(*inner), model, at, keep_score=keep_score, columns=inner)
    return scored.where("predicted = 1").select(*inner).toDF(*docs.columns)
