"""The three searches against plain versions, with awkward rows."""

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from teleloom.llm import hard_negatives, lexical_search, vector_search, vectors
from teleloom.llm.queries import QUERIES

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def ranked(docs, items, k):
    """Sorted (item, rank, key, score)."""
    counts = [(i, Counter(ts), len(ts)) for i, t in docs if (ts := terms(t))]
    n_docs, n_terms = len(counts), sum(n for _, _, n in counts)
    df = Counter(t for _, c, _ in counts for t in c)
    wanted = {}
    for i, t in items:
        if i is not None:
            wanted.setdefault(i, set()).update(terms(t))
    out = []
    for item, own in wanted.items():
        scored = []
        for key, c, n in counts:
            score = 0
            for t in own & c.keys():
                w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                score += w * (1_000_000_000 * c[t] // (1000 * c[t] + 20 * (100 - 50 + 50 * n * n_docs // n_terms)))
            if score > 0 and key is not None:
                scored.append((-score, key))
        out += [(item, r + 1, key, -s) for r, (s, key) in enumerate(sorted(scored)[:k])]
    return sorted(out)


def corpus():
    r = random.Random(11)
    pool = [r.choice("abcdefghij") + r.choice("klmnop") + str(r.randrange(30)) for _ in range(400)] + ["É", "été", "ñandú", "漢字", "the", "The", "of"]
    text = lambda n: "".join(r.choice(pool[: r.choice([20, 400, 407])]) + r.choice([" ", ", ", "\n", "--", "_", "\0", "\x7f"]) for _ in range(n))
    docs = [(i * 3, text(r.randrange(1, 80))) for i in range(300)]
    docs += [(2000 + i, docs[7][1]) for i in range(60)]  # ties beyond the number of results
    docs += [(None, "the of"), (1, None), (4, ""), (7, " .,;"), (10, "THE" * 3), (13, "the " * 20_000), (13, "the of"), (13, "the of")]
    items = [(i, text(r.randrange(1, 40))) for i in range(25)]
    items += [(30, docs[7][1]), (31, None), (32, ""), (33, "nowhere found"), (None, "the"), (34, "the"), (34, "of"), (35, "the The the"), (35, "the")]
    return docs, items


@pytest.mark.parametrize(("shard", "task", "block", "piece"), [(8192, 8192, 4 << 20, 1 << 20), (17, 40, 4 << 20, 50), (64, 1, 900, 1 << 20)])
def test_ranked_documents(spark, monkeypatch, shard, task, block, piece):
    docs, items = corpus()
    for name, value in (("SHARD_DOCS", shard), ("TASK_DOCS", task), ("BLOCK_BYTES", block), ("PIECE", piece)):
        monkeypatch.setattr(lexical_search, name, value)
    about = spark.createDataFrame([(i, t, "x", 1) for i, t in items], "item_id long, text string, score string, rank int")
    table = spark.createDataFrame([(i, t, 5, 6, "t") for i, t in docs], "doc_id long, text string, n long, item long, part string").repartition(3)
    for k in (50, 3):
        got = lexical_search.rank_documents(table, about, k)
        assert got.columns == ["item_id", "rank", "doc_id", "score"]
        assert sorted(map(tuple, got.collect())) == ranked(docs, items, k)
    assert lexical_search.rank_documents(table.limit(0), about).count() == 0
    assert lexical_search.rank_documents(table, about.limit(0)).count() == 0


def test_a_list_is_not_read_on_once_the_first_are_settled():
    """One document far ahead: its two rivals are left at the first look, with the rest of the lists unread."""
    n = 4000
    impacts = np.arange(n, 0, -1).astype(np.int64) * 10
    impacts[0] = 10**6
    lists = lexical_search.Lists(np.arange(n), np.zeros(n, np.int64), np.arange(n), impacts, 1)
    found, scores = lists.search(np.array([0]), np.array([3]), 1, 0)
    assert found.tolist() == [0] and scores.tolist() == [3 * 10**6]
    assert len(lists.search(np.array([0]), np.array([3]), 1, 4 * 10**6)[0]) == 0
    tied = lexical_search.Lists(np.arange(n), np.zeros(n, np.int64), np.arange(n), np.full(n, 7), 1)
    assert len(tied.search(np.array([0]), np.array([1]), 5, 0)[0]) == n  # ties are all handed over, to be settled by key


def whole(vector):
    if not vector or any(c is None or not math.isfinite(c) for c in vector):
        return None
    return tuple(math.floor(256 * np.float32(c).astype(float)) for c in vector)


def usable(rows, label=True):
    """Distinct (id, label, integer vector) that take part."""
    return sorted({(i, c if label else 0, v) for i, x, c in rows if i is not None and (c is not None or not label) and (v := whole(x))})


def dot(a, b):
    return sum(x * y for x, y in zip(a, b, strict=True))


def near(rows, every, k):
    known, out = usable(rows, False), []
    asking = {}
    for i, _, v in known:
        if i % every == 0:
            asking.setdefault(i, v)
    for i, q in asking.items():
        scored = sorted((-dot(q, v), j) for j, _, v in known if j != i and len(v) == len(q))
        out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(scored[:k])]
    return sorted(out)


def negatives(rows, every, n_pos, n_neg):
    known, out, asking = usable(rows), [], {}
    for i, c, v in known:
        if i % every == 0:
            asking.setdefault(i, (c, v))
    for i, (c, q) in asking.items():
        scored = sorted((-dot(q, v), j, d) for j, d, v in known if len(v) == len(q))
        for p, j in [(-s, j) for s, j, d in scored if d == c and j != i][:n_pos]:
            fits = [(-s, n) for s, n, d in scored if d != c and 80 * p <= -100 * s <= 100 * p][:n_neg]
            out += [(i, j, r + 1, n, p, s) for r, (s, n) in enumerate(fits)]
    return sorted(out)


SCHEMA = "vec_id long, embedding array<float>, label int, dim string, x int, shard int, id string, query long, block int, low long, score double, asks int"


def frame(spark, rows):
    return spark.createDataFrame([(i, x, c, "d", 1, 2, "i", 3, 4, 5, 0.5, 6) for i, x, c in rows], SCHEMA).repartition(4)


def vectors_of(seed, n, dim, clusters, large=1.0):
    r = np.random.default_rng(seed)
    middle = r.normal(size=(clusters, dim)) * large
    kind = r.integers(0, clusters, n)
    x = middle[kind] + r.normal(size=(n, dim)) * 0.3 * large
    return [(int(i), [float(np.float32(c)) for c in x[i]], int(kind[i] % 3)) for i in range(n)]


def awkward(seed=1, n=700, dim=6, clusters=9):
    rows = vectors_of(seed, n, dim, clusters)
    r = random.Random(seed)
    rows += [(5000 + i, rows[14][1], i % 4) for i in range(60)]  # a large group of equal vectors
    rows += [(6000 + i, [c * 2 for c in rows[20][1]], 1) for i in range(9)] + [rows[3]] * 7
    rows += [(7000, [0.0] * dim, 1), (7001, [-0.001] * dim, 2), (7002, rows[0][1][:3], 0), (7003, [float(dim)], 1), (8000, [2.0], 2), (8001, [3.0], 2)]
    rows += [(9000, None, 1), (9001, [None] * dim, 1), (9002, [float("nan")] * dim, 2), (9003, [float("inf")] + [0.0] * (dim - 1), 2), (9004, [], 1)]
    rows += [(None, rows[0][1], 1), (9100, rows[1][1], None), (7000, rows[5][1], 0), (21, rows[0][1], 0)]
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize(("shard", "chunk", "block", "group"), [(2048, 512, 4 << 20, 4 << 20), (64, 7, 100, 1500), (30, 512, 4 << 20, 900)])
def test_nearest_vectors(spark, monkeypatch, shard, chunk, block, group):
    rows = awkward()
    for name, value in (("SHARD_ROWS", shard), ("CHUNK_QUERIES", chunk), ("BLOCK_COMPONENTS", block), ("GROUP_COMPONENTS", group)):
        monkeypatch.setattr(vector_search, name, value)
    for k in (5, 1):
        got = vector_search.nearest(frame(spark, rows), F.col("vec_id") % 7 == 0, k)
        assert got.columns == ["query_id", "rank", "vec_id", "score"]
        assert sorted(map(tuple, got.collect())) == near(rows, 7, k)
    assert vector_search.nearest(frame(spark, rows).limit(0), F.col("vec_id") % 7 == 0).count() == 0
    assert vector_search.nearest(frame(spark, rows), F.col("vec_id") < 0).count() == 0


@pytest.mark.parametrize("large", [1.0, 1e4, 3e5])
def test_products_of_any_size_are_exact(large):
    """Sums that 32-bit, 64-bit floating numbers and only whole numbers hold."""
    r = np.random.default_rng(3)
    x = np.floor(r.normal(size=(900, 16)) * 256 * large).astype(np.int64)
    table = lambda ids: pa.table({"dim": [16] * len(ids), "id": ids, "x": [x[i].tolist() for i in ids]})
    ids = list(range(900))
    query, got, score = vector_search.search_cell(table(ids[:40]), table(ids), 5)
    for q in range(40):
        wanted = sorted((-int(s), i) for i, s in enumerate((x.astype(object) @ x[q].astype(object)).tolist()) if i != q)[:5]
        assert [(-int(s), int(i)) for i, s in zip(got[query == q], score[query == q], strict=True)] == wanted


def test_most_of_the_lists_stay_unread_for_most_candidates(monkeypatch):
    r = np.random.default_rng(4)
    x = r.normal(size=(4096, 32))
    x = np.floor(256 * x / np.linalg.norm(x, axis=1, keepdims=True))
    shard = vector_search.Shard(np.arange(4096), x)
    q = np.concatenate([np.maximum(x[:20], 0), np.minimum(x[:20], 0)], 1)
    least = np.sort(x[:20] @ x.T, axis=1)[:, -6]
    left = (q @ shard.bounds(0.5)[0].T >= least[:, None]).mean()
    assert left < 0.25
    exact = x[:20] @ x.T
    for share in (0.2, 0.5, 0.75, 1.0):
        high, low = shard.bounds(share)
        assert (q @ high.T >= exact - 1e-6).all() and (q @ low.T <= exact + 1e-6).all()


@pytest.mark.parametrize(("tree", "leaf", "block", "group"), [(1024, 16, 4 << 20, 4 << 20), (50, 2, 120, 1500), (300, 1, 4 << 20, 600)])
def test_hard_negatives(spark, monkeypatch, tree, leaf, block, group):
    rows = awkward()
    for name, value in (("LEAF_ROWS", leaf), ("BLOCK_COMPONENTS", block), ("GROUP_COMPONENTS", group)):
        monkeypatch.setattr(hard_negatives, name, value)
    monkeypatch.setattr(hard_negatives.plant_trees, "__defaults__", (tree,))
    got = hard_negatives.mine(frame(spark, rows), F.col("vec_id") % 10 == 0)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    wanted = negatives(rows, 10, 5, 5)
    assert sorted(map(tuple, got.collect())) == wanted and len(wanted) > 500
    few = hard_negatives.mine(frame(spark, rows), F.col("vec_id") % 10 == 0, positives=2, negatives=1)
    assert sorted(map(tuple, few.collect())) == negatives(rows, 10, 2, 1)


def test_hard_negatives_of_nothing(spark):
    rows = awkward()
    assert hard_negatives.mine(frame(spark, rows).limit(0), F.col("vec_id") % 10 == 0).count() == 0
    assert hard_negatives.mine(frame(spark, rows), F.col("vec_id") < 0).count() == 0
    alone = [(i, [1.0, float(i)], 1) for i in range(5)]
    assert hard_negatives.mine(frame(spark, alone), F.col("vec_id") % 2 == 0).count() == 0


def test_cover_tree_covers():
    x = np.floor(256 * np.array([v for _, v, _ in vectors_of(5, 1000, 8, 12)]))
    longest = float(np.sqrt((x * x).sum(1).max()))
    order, centers, radii, children, members = hard_negatives.cover_tree(x, longest)
    assert sorted(order) == list(range(1000)) and tuple(members[0]) == (0, 1000)
    up = np.concatenate([x, np.sqrt(np.maximum(longest**2 - (x * x).sum(1), 0))[:, None]], 1)
    for node, (a, b) in enumerate(children):
        own = order[slice(*members[node])]
        assert np.linalg.norm(up[own] - up[centers[node]], axis=1).max() <= radii[node] + 1e-3
        if a < b:
            assert sorted(np.concatenate([order[slice(*members[c])] for c in range(a, b)])) == sorted(own)
            assert max(radii[a:b]) < radii[node]
        else:
            assert len(own) <= hard_negatives.LEAF_ROWS or radii[node] == 0
    assert (children[:, 0] < children[:, 1]).sum() > 20


def test_search_queries_read_whole_tables(spark):
    sf = "/root/testdata/sf0.001"
    items = spark.read.parquet(f"{sf}/benchmark.parquet").count()
    asked = spark.read.parquet(f"{sf}/embeddings.parquet").where("vec_id % 50 = 0").count()
    assert QUERIES["op11_lexical_search"](spark, sf).select("item_id").distinct().count() == items
    assert QUERIES["op12_vector_search"](spark, sf).count() == 5 * asked
    assert vectors.exact_type(np.array([2]), np.array([3]), 4) is np.float32
