"""Hard negatives within score windows, by best-first descent of cover trees over norm-augmented candidates."""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from teleloom.llm.common import kept
from teleloom.llm.vectors import BLOCK_COMPONENTS, GROUP_COMPONENTS, every, flat, integer_vectors, part_of, parts

POSITIVES = 5
NEGATIVES = 5
#: A negative's score lies between these shares, in percent, of the positive's.
LEAST_PERCENT, MOST_PERCENT = 80, 100
#: Candidates of one tree, and of a leaf.
TREE_ROWS = 1024
LEAF_ROWS = 16
LEAST, MOST = np.iinfo(np.int64).min, np.iinfo(np.int64).max
#: Slack of a bound for rounding, as a share of the largest product.
SLACK = 1e-9

TREE = (
    "dim int, shard int, ids array<bigint>, labels array<bigint>, x array<bigint>, "
    "centers array<int>, radii array<double>, children array<int>, members array<int>"
)


def cover_tree(x: np.ndarray, longest: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(order, centers, radii, children, members) of the tree over the rows of ``x``.

    Rows get one more component that makes all of them ``longest``, so that they lie on a sphere. Every level
    halves the covering radius: the members of a node are covered by children whose centers are farther from each
    other than that radius. A node's own radius is the largest distance of a member from its center. Nodes of
    at most ``LEAF_ROWS`` members or of radius zero are leaves. Children of a node follow each other, and so do the
    members of a node in ``order``; of both the tree has the range (from, to) for every node.
    """
    norms = (x * x).sum(1)
    augmented = np.sqrt(np.maximum(longest * longest - norms, 0))
    near = x @ x.T + augmented[:, None] * augmented[None, :]
    distance = np.sqrt(np.maximum(2 * longest * longest - 2 * near, 0))
    # Equal rows have distance zero whatever the rounding.
    distance[distance < 1e-6 * longest] = 0
    root = int(distance.max(1).argmin())
    members, centers, reach = [np.arange(len(x))], [root], [distance[root].max()]
    level = [reach[0]]
    children: list[tuple[int, int]] = []
    at = 0
    while at < len(members):
        own, radius = members[at], level[at] / 2
        children.append((len(members), len(members)))
        if len(own) > LEAF_ROWS and reach[at] > 0:
            while radius >= reach[at]:
                radius /= 2
            left, center = own, centers[at]
            while len(left):
                covered = distance[center, left] <= radius
                mine = left[covered]
                members.append(mine)
                centers.append(center)
                reach.append(distance[center, mine].max())
                level.append(radius)
                left = left[~covered]
                center = left[0] if len(left) else -1
            children[at] = (children[at][0], len(members))
        at += 1
    # Members in depth-first order, so that those of a node follow each other.
    first = np.zeros(len(members), np.int64)
    for node, (a, b) in enumerate(children):
        start = first[node]
        for child in range(a, b):
            first[child] = start
            start += len(members[child])
    order = np.empty(len(x), np.int64)
    for node, (a, b) in enumerate(children):
        if a == b:
            order[first[node] : first[node] + len(members[node])] = members[node]
    bounds = np.stack([first, first + [len(m) for m in members]], 1)
    return order, np.array(centers), np.array(reach), np.array(children), bounds


class Tree:
    def __init__(self, row: dict, dim: int):
        arrays = {k: np.asarray(v) for k, v in row.items() if k not in ("dim", "shard")}
        self.ids, self.labels, self.radii = arrays["ids"], arrays["labels"], arrays["radii"]
        self.x = arrays["x"].reshape(-1, dim).astype(np.float64)
        self.longest = np.sqrt((self.x * self.x).sum(1).max())
        self.centers = self.x[arrays["centers"]]
        self.children, self.members = arrays["children"].reshape(-1, 2), arrays["members"].reshape(-1, 2)
        self.leaf = self.children[:, 0] == self.children[:, 1]
        # The label of a node's members if they share one; nodes of several labels are never skipped for theirs.
        least = np.array([self.labels[a:b].min() for a, b in self.members])
        most = np.array([self.labels[a:b].max() for a, b in self.members])
        self.label, self.mixed = least, least != most

    def search(self, q: np.ndarray, norm: float, own: int, label: int, same: bool, low: np.ndarray, high: np.ndarray, tops: list, k: int) -> None:
        """Update ``tops``, the best (ids, scores) of each window ``low``..``high``, with this tree's rows.

        A member's inner product differs from the center's by at most the query's norm times the radius. Nodes are
        opened best first; one whose interval meets no window, or only such that have ``k`` better scores, is
        left out with all below it. Members of leaves are verified exactly.
        """
        slack = SLACK * norm * self.longest + 0.5

        def needed() -> np.ndarray:
            return np.array([max(lo, s[-1] if len(s) == k else lo) for lo, (_, s) in zip(low, tops, strict=True)])

        def reaches(nodes: np.ndarray, floor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            score = self.centers[nodes] @ q
            spread = self.radii[nodes] * norm + slack
            fits = self.mixed[nodes] | ((self.label[nodes] == label) == same)
            fits &= (((score + spread)[:, None] >= floor) & ((score - spread)[:, None] <= high)).any(1)
            return nodes[fits], (score + spread)[fits]

        def verify(nodes: np.ndarray) -> None:
            rows = np.concatenate([np.arange(*self.members[n]) for n in nodes])
            rows = rows[((self.labels[rows] == label) == same) & ((self.ids[rows] != own) | (not same))]
            scores = np.rint(self.x[rows] @ q).astype(np.int64)
            for w in range(len(low)):
                fits = (scores >= low[w]) & (scores <= high[w])
                if fits.any():
                    ids, had = np.concatenate([tops[w][0], self.ids[rows[fits]]]), np.concatenate([tops[w][1], scores[fits]])
                    order = np.lexsort((ids, -had))[:k]
                    tops[w] = ids[order], had[order]

        nodes, upper = reaches(np.array([0]), needed())
        heap = [(-u, n) for u, n in zip(upper.tolist(), nodes.tolist(), strict=True)]
        while heap:
            upper, node = heapq.heappop(heap)
            floor = needed()
            if -upper < floor.min():
                break
            if self.leaf[node]:
                verify(np.array([node]))
                continue
            nodes, upper = reaches(np.arange(*self.children[node]), floor)
            leaves = self.leaf[nodes]
            if leaves.any():
                verify(nodes[leaves])
            for u, n in zip(upper[~leaves].tolist(), nodes[~leaves].tolist(), strict=True):
                heapq.heappush(heap, (-u, n))


def plant_trees(rows: DataFrame, tree_rows: int = TREE_ROWS) -> DataFrame:
    """One row for each tree over some thousand of the candidates (id, label, dim, x), dealt by a hash of the row."""
    sizes = rows.agg(F.count("*").alias("rows"), F.max(F.aggregate("x", F.lit(0).cast("bigint"), lambda n, c: n + c * c)).alias("norm")).first()
    longest = float(np.sqrt(sizes["norm"] or 0))

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        dim = key[0].as_py()
        x = flat(table, "x").reshape(-1, dim)
        order, centers, radii, children, members = cover_tree(x.astype(np.float64), longest)
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        ids, labels = table["id"].to_numpy()[order], table["label"].to_numpy()[order]
        lists = {"ids": ids, "labels": labels, "x": x[order].ravel(), "centers": place[centers].astype(np.int32), "radii": radii}
        lists |= {"children": children.ravel().astype(np.int32), "members": members.ravel().astype(np.int32)}
        return pa.table({"dim": pa.array([dim], pa.int32()), "shard": pa.array([key[1].as_py()], pa.int32())} | {k: pa.array([v]) for k, v in lists.items()})

    shard = part_of(parts(sizes["rows"], tree_rows), "id", "x")
    return rows.select("dim", shard.alias("shard"), "id", "label", "x").groupBy("dim", "shard").applyInArrow(run, TREE)


def search_trees(trees: DataFrame, queries: DataFrame, same: bool, k: int) -> DataFrame:
    """(query, slot, id, score): the ``k`` best rows of the same (or another) label in each window of the queries.

    ``queries`` has id, label, dim, x, and the bounds ``low`` and ``high`` of the windows, numbered by ``slot``. Trees and
    queries are dealt to cells of bounded size, each tree to the cells of every block of queries. ``trees`` and
    ``queries`` are read twice, so they should be kept.
    """
    size = trees.agg(F.sum(F.size("x")).alias("n"), F.count("*").alias("trees")).first()
    asked = queries.agg(F.sum("dim").alias("n")).first()["n"] or 0
    blocks = parts(asked, BLOCK_COMPONENTS)
    cores = trees.sparkSession.sparkContext.defaultParallelism
    groups = parts(size["n"] or 0, GROUP_COMPONENTS, min(-(-2 * cores // blocks), max(1, size["trees"])))
    cell = ["dim", "block", "group"]
    left = queries.select("dim", part_of(blocks, "id").alias("block"), every(groups).alias("group"), "id", "label", "x", "low", "high")
    right = trees.select(every(blocks).alias("block"), F.pmod("shard", F.lit(groups)).alias("group"), *trees.columns)
    dealt = [side.repartition(2 * blocks * groups, *cell).groupBy(*cell) for side in (left, right)]

    def run(queries: pa.Table, trees: pa.Table) -> pa.Table:
        out: list[tuple[int, int, np.ndarray, np.ndarray]] = []
        if len(queries) and len(trees):
            dim = queries["dim"][0].as_py()
            woods = [Tree(row, dim) for batch in trees.to_batches() for row in _rows(batch)]
            x = flat(queries, "x").reshape(-1, dim).astype(np.float64)
            norms = np.sqrt((x * x).sum(1))
            windows = zip(queries["id"].to_pylist(), queries["label"].to_pylist(), queries["low"].to_pylist(), queries["high"].to_pylist(), strict=True)
            for i, (own, label, low, high) in enumerate(windows):
                tops = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in low]
                for tree in woods:
                    tree.search(x[i], norms[i], own, label, same, np.array(low, np.int64), np.array(high, np.int64), tops, k)
                out.extend((own, slot, ids, scores) for slot, (ids, scores) in enumerate(tops) if len(ids))
        sizes = [len(ids) for _, _, ids, _ in out]
        none = [np.zeros(0, np.int64)]
        columns = [np.repeat(np.array([o[j] for o in out], np.int64), sizes) for j in (0, 1)]
        columns += [np.concatenate([o[j] for o in out] or none) for j in (2, 3)]
        return pa.table(dict(zip(("query", "slot", "id", "score"), map(pa.array, columns), strict=True)))

    found = dealt[0].cogroup(dealt[1]).applyInArrow(run, "query bigint, slot bigint, id bigint, score bigint")
    order = Window.partitionBy("query", "slot").orderBy(F.col("score").desc(), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _rows(batch: pa.RecordBatch):
    """Rows as arrays, without Python values in between."""
    names = [n for n in batch.schema.names if n not in ("dim", "block", "group", "shard")]
    for i in range(batch.num_rows):
        yield {n: batch.column(n)[i].values.to_numpy(zero_copy_only=False) for n in names}


def mine(
    rows: DataFrame,
    anchors: Column,
    positives: int = POSITIVES,
    negatives: int = NEGATIVES,
    vector: str = "embedding",
    key: str = "vec_id",
    label: str = "label",
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    Components are multiplied by 256 and rounded down; a row's score is its inner product with the anchor, higher
    ones first, ties by smaller key. Anchors are the rows for which the condition ``anchors`` on ``key`` holds. An
    anchor's positives are its first ``positives`` other rows of its label. For each of them the first ``negatives``
    rows of other labels are given whose score is at least 80 % and at most 100 % of the positive's.

    Candidates are dealt to cover trees of some thousand rows (``cover_tree``), kept in the shared folder, and both
    searches descend the same trees (``Tree.search``): first for the positives, without bounds, then within the
    windows that the positives' scores give. Results of all trees are merged by rank.

    Rows without key or label, and vectors that are null or empty or hold a null or non-finite component, take no part.
    Repeated rows count once; of different rows with one key all are candidates, and the one of the smallest label
    and vector is the anchor. Vectors are held against vectors of their own length. Scores are exact up to
    2^53. Other columns are not read; no rows give no rows.
    """
    known = rows.where(F.col(key).isNotNull() & F.col(label).isNotNull())
    named = integer_vectors(known, vector, id=F.col(key).cast("bigint"), label=F.col(label).cast("bigint"), asks=F.coalesce(anchors, F.lit(False)))
    named = kept(named)
    trees = kept(plant_trees(named.select("id", "label", "dim", "x")))
    asking = named.where("asks").groupBy("id").agg(F.min(F.struct("label", "x", "dim")).alias("v")).select("id", "v.label", "v.dim", "v.x")
    whole = lambda value: F.array(F.lit(int(value)).cast("bigint"))
    first = kept(asking.select("*", whole(LEAST).alias("low"), whole(MOST).alias("high")))
    pairs = kept(search_trees(trees, first, True, positives).select("query", "rank", F.col("id").alias("positive_id"), F.col("score").alias("positive_score")))
    # A whole score s is in the window if LEAST_PERCENT * p <= 100 * s <= MOST_PERCENT * p; at most ``positives`` windows an anchor.
    scores = F.col("positive_score")
    hundredths = lambda n: (n / 100).cast("bigint")  # noqa: E731  of whole hundreds
    least, most = scores * LEAST_PERCENT, scores * MOST_PERCENT
    low, high = hundredths(least + F.pmod(-least, F.lit(100))), hundredths(most - F.pmod(most, F.lit(100)))
    bounds = pairs.groupBy("query").agg(F.sort_array(F.collect_list(F.struct("rank", low.alias("low"), high.alias("high")))).alias("w"))
    windows = asking.join(bounds, F.col("id") == F.col("query")).select(*asking.columns, F.col("w.low").alias("low"), F.col("w.high").alias("high"))
    found = search_trees(trees, kept(windows), False, negatives)
    found = found.select("query", (F.col("slot") + 1).cast("int").alias("slot"), "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    joined = found.join(pairs.withColumnRenamed("rank", "slot"), ["query", "slot"])
    return joined.select(F.col("query").alias("anchor_id"), "positive_id", "rank", "negative_id", "positive_score", "negative_score")
