"""Plain versions of the corpus operators, for small tables."""

from __future__ import annotations

import hashlib
import re
from collections import Counter

import xxhash

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return [w for w in re.split("[\x20\x09-\x0d]+", text or "") if w]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def exact(rows):
    """(doc_id, keep_id, group_size, kept, digest) of (doc_id, text)."""
    digests = [(i, sha(re.sub("[\x20\x09-\x0d]+", " ", t or ""))) for i, t in rows]
    out = []
    for i, d in digests:
        group = [j for j, e in digests if e == d]
        out.append((i, min(group), len(group), i == min(group), d))
    return out


def fingerprint(text, width=4):
    ws = words((text or "").translate(LOWER))
    if not ws:
        return 0
    width = min(width, len(ws))
    grams = [" ".join(ws[i : i + width]) for i in range(len(ws) - width + 1)]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def linked(nodes, near):
    """Smallest node reachable, by node."""
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a in nodes:
        for b in nodes:
            if a < b and near(a, b):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {n: find(n) for n in nodes}


def simhash(rows, bits=4):
    fps = {i: fingerprint(t) for i, t in rows}
    groups = linked(sorted(fps), lambda a, b: (fps[a] ^ fps[b]).bit_count() <= bits)
    return {(i, f"{fps[i]:016x}", groups[i]) for i, _ in rows}


def phrases(rows, window=13):
    """(doc_id, n_words, n_removed, kept text)."""
    first = {}
    for i, t in rows:
        ws = words(t)
        for j in range(len(ws) - window + 1):
            run = tuple(ws[j : j + window])
            first[run] = min(i, first.get(run, i))
    out = []
    for i, t in rows:
        ws, go = words(t), set()
        for j in range(len(ws) - window + 1):
            if first[tuple(ws[j : j + window])] < i:
                go.update(range(j, j + window))
        out.append((i, len(ws), len(go), " ".join(w for j, w in enumerate(ws) if j not in go)))
    return out


def similarity(a, b):
    x, y = Counter(a), Counter(b)
    return sum((x & y).values()) / sum((x | y).values())


def leaks(rows, items, least=0.8):
    """{(doc_id, item_id): (best similarity, its first window)} over all windows of the items' sizes."""
    grams = lambda ws, k: [tuple(ws[i : i + k]) for i in range(len(ws) - k + 1)]
    out = {}
    wanted = [(item, iw, min(5, len(iw)), set(grams(iw, min(5, len(iw))))) for item, text in items if (iw := words(text))]
    for i, t in rows:
        ws = words(t)
        own = {k: set(grams(ws, k)) for k in {k for _, _, k, _ in wanted}}
        for item, iw, k, theirs in wanted:
            if not own[k] & theirs:
                continue
            for start in range(max(0, len(ws) - len(iw)) + 1):
                mine = grams(ws[start : start + len(iw)], k)
                score = similarity(mine, grams(iw, k)) if mine else 0
                if score >= least and score > out.get((i, item), (0, 0))[0]:
                    out[i, item] = (score, start)
    return out
