"""Words and their hashes from the bytes of many texts at once."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

#: Bytes that are hashed at once; the arrays of a block take some 40 times as much.
BLOCK = 1 << 20
#: Bytes whose words' hashes are summed at once; the arrays of such a piece stay in the processor's cache.
PIECE = 1 << 16
ODD = np.uint64(0x9E3779B97F4A7C15)


def mixed(h: np.ndarray) -> np.ndarray:
    """Every bit of a hash made to depend on every other (a public 64-bit finaliser)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def odd_powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse modulo 2^64."""
    inverse = np.uint64(pow(int(ODD), -1, 1 << 64))
    up, down = np.full(n, ODD), np.full(n, inverse)
    up[:1] = down[:1] = 1
    return np.cumprod(up), np.cumprod(down)


@lru_cache(maxsize=1)
def piece_powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    return odd_powers(n)


def rolling(values: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all runs of ``width`` values; equal runs have equal hashes wherever they lie."""
    n = len(values) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = np.zeros(n, np.uint64)
    for k in range(width):
        h = h * ODD + values[k : k + n]
    return mixed(h)


def joined(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of texts, a line feed behind each, and where each text begins."""
    return framed([(t or "").encode() for t in texts])


def framed(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The same of texts that are bytes already."""
    lengths = np.fromiter((len(p) + 1 for p in parts), np.int64, len(parts))
    raw = np.frombuffer(b"\n".join([*parts, b""]), np.uint8)
    return raw, np.concatenate([[0], np.cumsum(lengths)])


def word_spans(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of every word."""
    blank = np.ones(len(raw) + 2, bool)
    blank[1:-1] = (raw == 0x20) | (raw - np.uint8(0x09) < 5)
    edge = np.flatnonzero(blank[1:] != blank[:-1])
    return edge[::2], edge[1::2]


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of every word."""
    out = np.zeros(len(starts), np.uint64)
    table = mixed(np.arange(1, 257, dtype=np.uint64) * ODD)
    powers = piece_powers(PIECE)
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + PIECE, "right")))
        base, top = int(starts[i]), int(ends[j - 1])
        up, down = powers if top - base <= PIECE else odd_powers(top - base)
        sums = np.zeros(top - base + 1, np.uint64)
        np.cumsum(table[raw[base:top]] * up[: top - base], out=sums[1:])
        a, b = starts[i:j] - base, ends[i:j] - base
        out[i:j] = mixed((sums[b] - sums[a]) * down[a])
        i = j
    return out


def sized(batches: Iterator[pa.RecordBatch], text: int = 1, limit: int = BLOCK) -> Iterator[tuple[pa.RecordBatch, list[str | None]]]:
    """Slices of the batches with about ``limit`` characters of text, and these texts; one text at least."""
    for batch in batches:
        texts = batch.column(text).to_pylist()
        a = seen = 0
        for i, t in enumerate(texts):
            seen += len(t or "")
            if seen >= limit or i == len(texts) - 1:
                yield batch.slice(a, i + 1 - a), texts[a : i + 1]
                a, seen = i + 1, 0
