"""Language identification by a bidirectional gated recurrent network over bytes, in numpy."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from teleloom.llm.common import small_batches
from teleloom.llm.textbytes import joined, sized

#: Training rows of each language, in the order of a hash of their keys; with this bound the fit
#: stays on the driver. Every row is labelled by the network, however many there are.
TRAIN_ROWS = 250
HIDDEN = 8
#: Bytes that the network reads in one go. A text is cut into segments of this length.
SEGMENT = 64
ROUNDS = 260
BATCH = 192
RATE = 0.02
UNKNOWN = "und"


@dataclass
class Network:
    """Weights of both directions: by byte, recurrent, and from both states to the languages."""

    languages: list[str]
    by_byte: list[np.ndarray]  # 256 x 2H: gate and candidate, the bias within
    recurrent: list[np.ndarray]  # H x 2H
    out: np.ndarray  # 2H x L
    bias: np.ndarray

    def weights(self) -> list[np.ndarray]:
        return [*self.by_byte, *self.recurrent, self.out, self.bias]


def _halved(network: Network) -> list[tuple[np.ndarray, np.ndarray]]:
    """Weights with the gate's half divided by two: sigmoid(x) = 0.5 + 0.5 tanh(x / 2)."""
    h = len(network.recurrent[0])
    scale = np.concatenate([np.full(h, 0.5), np.ones(h)]).astype(np.float32)
    return [(e * scale, u * scale) for e, u in zip(network.by_byte, network.recurrent, strict=True)]


def states(network: Network, segments: np.ndarray) -> np.ndarray:
    """States of both directions at every position: (T, 2H, N) for byte segments (T, N)."""
    t, n = segments.shape
    h = len(network.recurrent[0])
    out = np.empty((t, 2 * h, n), np.float32)
    both, read = np.empty((2 * h, n), np.float32), np.empty((2 * h, n), np.float32)
    for d, (by_byte, recurrent) in enumerate(_halved(network)):
        by_byte, recurrent = np.ascontiguousarray(by_byte.T), np.ascontiguousarray(recurrent.T)
        state = np.zeros((h, n), np.float32)
        for i in range(t) if d == 0 else range(t - 1, -1, -1):
            np.take(by_byte, segments[i], axis=1, out=read, mode="clip")
            np.matmul(recurrent, state, out=both)
            both += read
            np.tanh(both, out=both)
            gate, candidate = both[:h], both[h:]
            gate += 1
            gate *= 0.5
            # state = gate * candidate + (1 - gate) * state
            candidate -= state
            candidate *= gate
            state = np.add(state, candidate, out=out[i, d * h : (d + 1) * h])
    return out


def position_probabilities(network: Network, hidden: np.ndarray) -> np.ndarray:
    """Probabilities of the languages at every position: (T, L, N)."""
    p = np.matmul(network.out.T, hidden) + network.bias[:, None]
    p -= p.max(1, keepdims=True)
    np.exp(p, out=p)
    p /= p.sum(1, keepdims=True)
    return p


def _gradients(network: Network, segments: np.ndarray, target: np.ndarray, mask: np.ndarray) -> list[np.ndarray]:
    """Back-propagation through time of the mean cross entropy over all labelled positions."""
    t, n = segments.shape
    h = len(network.recurrent[0])
    hidden = states(network, segments)
    p = np.ascontiguousarray(position_probabilities(network, hidden).transpose(0, 2, 1))
    hidden = np.ascontiguousarray(hidden.transpose(0, 2, 1))
    p[:, np.arange(n), target] -= 1
    p *= (mask / mask.sum())[..., None]
    g_out = np.einsum("tnh,tnl->hl", hidden, p)
    g_hidden = p @ network.out.T
    g_byte, g_rec = [], []
    for d in range(2):
        by_byte, recurrent = network.by_byte[d], network.recurrent[d]
        order = list(range(t)) if d == 0 else list(range(t - 1, -1, -1))
        g_e, g_u = np.zeros_like(by_byte), np.zeros_like(recurrent)
        back = np.zeros((n, h), np.float32)
        for k in range(t - 1, -1, -1):
            i = order[k]
            before = hidden[order[k - 1], :, d * h : (d + 1) * h] if k else np.zeros((n, h), np.float32)
            both = by_byte[segments[i]] + before @ recurrent
            gate, candidate = 0.5 + 0.5 * np.tanh(both[:, :h] / 2), np.tanh(both[:, h:])
            back = back + g_hidden[i, :, d * h : (d + 1) * h]
            g_both = np.concatenate([back * (candidate - before) * gate * (1 - gate), back * gate * (1 - candidate**2)], 1)
            np.add.at(g_e, segments[i], g_both)
            g_u += before.T @ g_both
            back = back * (1 - gate) + g_both @ recurrent.T
        g_byte.append(g_e)
        g_rec.append(g_u)
    return [*g_byte, *g_rec, g_out, p.sum((0, 1))]


def cut(raw: np.ndarray, starts: np.ndarray, segment: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(segments (N, T), bytes in each, first segment of each text) of joined texts; empty texts have one."""
    lengths = np.diff(starts) - 1
    counts = np.maximum(1, -(-lengths // segment))
    first = np.concatenate([[0], np.cumsum(counts)])
    nth = np.arange(first[-1]) - np.repeat(first[:-1], counts)
    at = np.repeat(starts[:-1], counts) + nth * segment
    used = np.clip(np.repeat(lengths, counts) - nth * segment, 0, segment)
    padded = np.concatenate([raw, np.zeros(segment, np.uint8)])
    segments = padded[at[:, None] + np.arange(segment)]
    segments[np.arange(segment) >= used[:, None]] = 0
    return segments, used, first[:-1]


def train(texts: list[str], labels: list[str], hidden: int = HIDDEN, rounds: int = ROUNDS, seed: int = 7) -> Network:
    """Fit the network to labelled texts; the same texts in the same order give the same network."""
    languages = sorted(set(labels))
    r = np.random.default_rng(seed)
    small = lambda *shape: (r.standard_normal(shape) * 0.3).astype(np.float32)
    network = Network(
        languages,
        [small(256, 2 * hidden) for _ in range(2)],
        [small(hidden, 2 * hidden) for _ in range(2)],
        small(2 * hidden, len(languages)),
        np.zeros(len(languages), np.float32),
    )
    if not texts:
        return network
    raw, starts = joined(texts)
    segments, used, first = cut(raw, starts, SEGMENT)
    counts = np.diff([*first, len(segments)])
    target = np.repeat(np.searchsorted(languages, labels), counts)
    # Every language is as likely in a batch, and every text of a language.
    weight = 1 / np.repeat(counts, counts) / np.bincount(np.searchsorted(languages, labels), minlength=len(languages))[target]
    chance = np.cumsum(weight) / weight.sum()
    moments = [(np.zeros_like(w), np.zeros_like(w)) for w in network.weights()]
    for step in range(1, rounds + 1):
        pick = np.minimum(np.searchsorted(chance, r.random(BATCH)), len(segments) - 1)
        mask = (np.arange(SEGMENT)[:, None] < used[pick][None, :]).astype(np.float32)
        if not mask.any():
            continue
        rate = RATE * min(1, 2 * (1 - step / (rounds + 1)))
        for w, g, (m, v) in zip(network.weights(), _gradients(network, segments[pick].T, target[pick], mask), moments, strict=True):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)
    return network


def label(network: Network, texts: list[str | None], block: int = 2048) -> tuple[list[str], np.ndarray]:
    """Language and pooled probability of whole texts: the mean over all of a text's positions."""
    raw, starts = joined(texts)
    segments, used, first = cut(raw, starts, SEGMENT)
    sums = np.empty((len(segments), len(network.languages)), np.float64)
    for a in range(0, len(segments), block):
        part = np.ascontiguousarray(segments[a : a + block].T)
        p = position_probabilities(network, states(network, part))
        p *= (np.arange(SEGMENT)[:, None] < used[a : a + block][None, :])[:, None]
        sums[a : a + block] = p.sum(0).T
    pooled = np.add.reduceat(sums, first, axis=0) / np.maximum(1, np.diff(starts) - 1)[:, None]
    best = pooled.argmax(1)
    return [network.languages[i] for i in best], np.clip(pooled[np.arange(len(best)), best], 0, 1)


def training_rows(docs: DataFrame, text: str, lang: str, key: str, rows: int) -> tuple[list[str], list[str]]:
    """Texts of at most ``rows`` keys of every language, the first by a hash of the key.

    The rows are chosen by their keys alone, and these few keys are sent to the documents.
    """
    usable = docs.where(F.col(text).isNotNull() & F.col(lang).isNotNull() & F.col(key).isNotNull())
    keys = usable.select(F.col(key).alias("_k"), F.col(lang).alias("_c")).distinct()
    order = Window.partitionBy("_c").orderBy(F.xxhash64("_k"), "_k")
    picked = keys.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= rows).drop("_n")
    found = usable.join(F.broadcast(picked), (usable[key] == F.col("_k")) & (usable[lang] == F.col("_c")))
    chosen = sorted((r["_c"], r["_k"], r["_t"]) for r in found.select("_c", "_k", F.col(text).alias("_t")).collect())
    return [t for _, _, t in chosen], [c for c, _, _ in chosen]


def identify(
    docs: DataFrame, labelled: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", rows: int = TRAIN_ROWS
) -> DataFrame:
    """(key, lang_pred, score) of every row of ``docs``, learned from the ``labelled`` rows.

    The network is trained on the driver on at most ``rows`` rows a language, and sent to the workers
    (some 40 kB). Each text is read whole, in segments; both directions label every byte, and the mean
    of the bytes' probabilities is the text's.

    A null text, or one without a letter, gives ``und`` and score 0; so does every text if nothing is
    labelled. Ties go to the first language by name. Repeated rows get the same answer; other columns are
    not read. No rows give no rows.
    """
    small_batches(docs.sparkSession)
    texts, labels = training_rows(labelled, text, lang, key, rows)
    network = train(texts, labels)
    kind = docs.select(F.col(key)).schema[0].simpleString().replace(":", " ", 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, values in sized(batches):
            letters = pc.fill_null(pc.match_substring_regex(batch.column(1), r"\pL"), False).to_pylist()
            if network.languages:
                names, scores = label(network, values)
            else:
                names, scores, letters = [UNKNOWN] * len(values), np.zeros(len(values)), [False] * len(values)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([n if ok else UNKNOWN for n, ok in zip(names, letters, strict=True)], pa.string()),
                    pa.array(np.where(letters, scores, 0.0), pa.float64()),
                ],
                [key, "lang_pred", "score"],
            )

    return docs.select(F.col(key), F.col(text)).mapInArrow(run, f"{kind}, lang_pred string, score double")
