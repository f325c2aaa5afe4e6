"""Nearest nodes of one tree: by place on the page, and by common ancestors.

The nodes of a tree, which is one document's, are gathered into one row; trees are then handled by numpy in blocks of
bounded size, and only the nearest pairs leave a task.
"""
from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.visual import safe_log

#: Distances that a block holds at once.
CELLS = 1 << 20
#: Nodes of small trees that are handled side by side; a larger tree is handled alone.
SIDE_BY_SIDE = 1 << 14

Found = tuple[np.ndarray, ...]


def per_tree(nodes: DataFrame, columns: list[str], find: Callable[..., Found], out: str, tree: str, together: bool = False) -> DataFrame:
    """find(node_id, *columns) of each tree's nodes by node_id; out: schema of what it returns, beside the tree's key.

    together: find(tree, node_id, *columns) gets several trees one after the other, with a number for each node's tree, and
    returns those numbers first.
    """
    kind = dict(nodes.dtypes)[tree]
    names = [x.split(" ")[0] for x in out.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists, keys = batch.column("rows"), batch.column("tree")
            first = np.concatenate(([0], np.cumsum(lists.value_lengths().to_numpy())))
            flat = lists.flatten()
            held = [flat.field(c) for c in ("node_id", *columns)]
            values = [x.to_numpy(zero_copy_only=False) if not pa.types.is_list(x.type) else x for x in held]
            parts: list[Found] = []
            owners: list[np.ndarray] = []
            at = 0
            while at < len(keys):
                until = max(at + 1, int(np.searchsorted(first, first[at] + SIDE_BY_SIDE, side="right")) - 1) if together else at + 1
                lo, hi = int(first[at]), int(first[until])
                own = [v[lo:hi] if isinstance(v, np.ndarray) else v.slice(lo, hi - lo) for v in values]
                if together:
                    owner, *found = find(np.repeat(np.arange(at, until), np.diff(first[at : until + 1])), *own)
                else:
                    found = find(*own)
                    owner = np.full(len(found[0]), at)
                owners.append(owner)
                parts.append(tuple(found))
                at = until
            joined = lambda x: pa.concat_arrays(x) if isinstance(x[0], pa.Array) else pa.array(np.concatenate(x))
            arrays = [joined([p[k] for p in parts]) for k in range(len(names))] if parts else []
            if parts:
                yield pa.RecordBatch.from_arrays([keys.take(pa.array(np.concatenate(owners))), *arrays], names=["tree", *names])

    gathered = nodes.groupBy(F.col(tree).alias("tree")).agg(F.array_sort(F.collect_list(F.struct(F.col("node_id").cast("bigint").alias("node_id"), *columns))).alias("rows"))
    return gathered.mapInArrow(run, f"tree {kind}, {out}").withColumnRenamed("tree", tree)


def _nearest(n: int, k: int, distance: Callable[[slice], np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, columns and distances of the k least of each row of an n x n table without its diagonal; ties by column."""
    k = min(k, n - 1)
    if k <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    rows, columns, values = [], [], []
    step = max(1, CELLS // n)
    for lo in range(0, n, step):
        d = distance(slice(lo, min(lo + step, n)))
        d[np.arange(len(d)), np.arange(lo, lo + len(d))] = np.inf
        cut = np.partition(d, k - 1, axis=1)[:, k - 1 : k]
        r, c = np.nonzero(d <= cut)  # ties of the last one too
        v = d[r, c]
        order = np.lexsort((c, v, r))
        r, c, v = r[order], c[order], v[order]
        rank = np.arange(len(r)) - np.searchsorted(r, r)
        rows.append(r[rank < k] + lo)
        columns.append(c[rank < k])
        values.append(v[rank < k])
    return np.concatenate(rows), np.concatenate(columns), np.concatenate(values)


def _by_center(node: np.ndarray, x: np.ndarray, y: np.ndarray, w: np.ndarray, h: np.ndarray, k: int) -> Found:
    """Rows, ranks, columns, distances, dx and dy of the k nearest, as knn_center has them."""
    cx, cy, n = x + w / 2, y + h / 2, len(node)

    def apart(rows: slice) -> np.ndarray:
        dx, dy = cx[None, :] - cx[rows, None], cy[None, :] - cy[rows, None]
        return np.sqrt(dx * dx + dy * dy) if n > k else np.abs(node[rows, None] - node[None, :]).astype(float)

    r, c, _ = _nearest(n, k, apart)
    rank = np.arange(len(r)) - np.searchsorted(r, r) + 1
    if 1 < n <= k:
        times = np.where(rank == n - 1, k - n + 2, 1)
        again = np.concatenate([np.arange(t) for t in times])
        r, c, rank = (np.repeat(v, times) for v in (r, c, rank))
        rank = rank + again
    dx, dy = cx[c] - cx[r], cy[c] - cy[r]
    return r, rank.astype(np.int32), c, np.sqrt(dx * dx + dy * dy), dx, dy


def knn_center(boxes: DataFrame, k: int, tree: str = "page_id") -> DataFrame:
    """k nearest of boxes(tree, node_id, x, y, w, h) by distance of centres, with dx, dy; in small trees by distance in
    the document, the last repeated until there are k."""

    def find(node: np.ndarray, x: np.ndarray, y: np.ndarray, w: np.ndarray, h: np.ndarray) -> Found:
        r, rank, c, distance, dx, dy = _by_center(node, x, y, w, h, k)
        return node[r], rank, node[c], distance, dx, dy

    b = boxes.select(tree, "node_id", *[F.col(c).cast("double").alias(c) for c in "xywh"])
    return per_tree(b, ["x", "y", "w", "h"], find, "node_id bigint, rank int, neighbor_id bigint, distance double, dx double, dy double", tree)


def center_lists(boxes: DataFrame, k: int, tree: str = "page_id") -> DataFrame:
    """knn_center's neighbours as one row for each node that has any, near: a list of (distance, x, y) by rank.

    The neighbours' places come along, so that weighting them takes no join and no further shuffle.
    """

    def find(node: np.ndarray, x: np.ndarray, y: np.ndarray, w: np.ndarray, h: np.ndarray) -> Found:
        r, _, c, distance, _, _ = _by_center(node, x, y, w, h, k)
        at, first = np.unique(r, return_index=True)
        items = pa.StructArray.from_arrays([pa.array(v) for v in (distance, x[c], y[c])], names=["distance", "x", "y"])
        return node[at], pa.ListArray.from_arrays(pa.array(np.append(first, len(r)).astype(np.int32)), items)

    b = boxes.select(tree, "node_id", *[F.col(c).cast("double").alias(c) for c in "xywh"])
    return per_tree(b, ["x", "y", "w", "h"], find, "node_id bigint, near array<struct<distance:double,x:double,y:double>>", tree)


def knn_rect(boxes: DataFrame, k: int, tree: str = "page_id") -> DataFrame:
    """k nearest by the least distance between corners."""

    def find(node: np.ndarray, x: np.ndarray, y: np.ndarray, w: np.ndarray, h: np.ndarray) -> Found:
        xs, ys = (x, x + w, x, x + w), (y, y, y + h, y + h)

        def apart(rows: slice) -> np.ndarray:
            best = None
            for ax, ay in zip(xs, ys, strict=True):
                for bx, by in zip(xs, ys, strict=True):
                    dx, dy = ax[rows, None] - bx[None, :], ay[rows, None] - by[None, :]
                    d = np.sqrt(dx * dx + dy * dy)
                    best = d if best is None else np.minimum(best, d)
            return best

        r, c, v = _nearest(len(node), k, apart)
        return node[r], (np.arange(len(r)) - np.searchsorted(r, r) + 1).astype(np.int32), node[c], v

    b = boxes.select(tree, "node_id", *[F.col(c).cast("double").alias(c) for c in "xywh"])
    return per_tree(b, ["x", "y", "w", "h"], find, "node_id bigint, rank int, neighbor_id bigint, distance double", tree)


def knn_vectors(df: DataFrame, by: str, key: str, vector: str, k: int, digits: int = 6, block: int = 1024) -> DataFrame:
    """by, key, neighbor_id, distance, rank: the k nearest of df's vectors of the same group by Euclidean distance, exactly.

    Distances are rounded before they are ranked, ties go to the smaller key. Groups are cut into blocks by a hash of the
    key; each pair of blocks is a task's group of bounded size, which emits k rows for each of its queries at most.
    """
    rows = df.select(F.col(by).alias("g"), F.col(key).cast("bigint").alias("k"), F.col(vector).cast("array<double>").alias("v"))
    blocks = rows.groupBy(F.col("g").alias("_g")).agg(F.ceil(F.count("*") / F.lit(block)).cast("int").alias("n"))
    placed = rows.join(blocks, F.col("g").eqNullSafe(F.col("_g"))).select("g", "k", "v", "n", F.pmod(F.xxhash64("k"), F.col("n")).cast("int").alias("at"))
    each = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    asks = each.select("g", F.col("at").alias("i"), F.col("other").alias("j"), "k", "v", F.lit(True).alias("asks"))
    held = each.select("g", F.col("other").alias("i"), F.col("at").alias("j"), "k", "v", F.lit(False).alias("asks"))

    def find(own: pd.DataFrame) -> pd.DataFrame:
        q, c = own[own["asks"]], own[~own["asks"]]
        keys, found = c["k"].to_numpy(), []
        corpus = np.stack(c["v"].to_numpy()) if len(c) else np.zeros((0, 0))
        for me, v in zip(q["k"].to_numpy(), q["v"], strict=True):
            other = keys != me
            d = np.round(np.sqrt(((corpus[other] - v) ** 2).sum(axis=1)), digits)
            near = np.lexsort((keys[other], d))[:k]
            found.append(pd.DataFrame({"k": me, "neighbor_id": keys[other][near], "distance": d[near]}))
        out = pd.concat(found) if found else pd.DataFrame({"k": [], "neighbor_id": [], "distance": []})
        return out.assign(g=own["g"].iloc[0])[["g", "k", "neighbor_id", "distance"]]

    kind = dict(df.dtypes)[by]
    near = asks.unionByName(held).groupBy("g", "i", "j").applyInPandas(find, f"g {kind}, k bigint, neighbor_id bigint, distance double")
    ranked = near.withColumn("rank", F.row_number().over(W.partitionBy("g", "k").orderBy("distance", "neighbor_id"))).where(F.col("rank") <= k)
    return ranked.select(F.col("g").alias(by), F.col("k").alias(key), "neighbor_id", "distance", "rank")


def edge_vector(edges: DataFrame, width: str = "page_width") -> DataFrame:
    """dx, dy and distance, each as the safe logarithm of its share of the page's width."""
    return edges.select("*", *[safe_log(F.col(c) / F.col(width)).alias(f"log_{c}") for c in ("dx", "dy", "distance")])


def friends(nodes: DataFrame, most_levels: int = 5, most: int = 10, tree: str = "page_id") -> DataFrame:
    """node_id and friend_id: nodes of nodes(tree, node_id, anc_ids) with a common ancestor within most_levels; the nearest `most`.

    Nodes are compared with ever farther ones in the document, on either side, until they have enough friends there or
    have passed the last node that shares such an ancestor.
    """

    def find(of: np.ndarray, node: np.ndarray, up: pa.ListArray) -> Found:
        n = len(node)
        size = up.value_lengths().to_numpy(zero_copy_only=False)
        values = up.flatten().to_numpy(zero_copy_only=False)
        ends = np.cumsum(size)
        anc = np.full((n, most_levels), -1, np.int64)
        for level in range(most_levels):
            some = size > level
            anc[some, level] = values[ends[some] - 1 - level]
        # One number for each ancestor, as trees stand side by side: no two of them share one.
        known = anc >= 0
        pairs = np.stack((np.broadcast_to(of[:, None], anc.shape)[known], anc[known]))
        anc[known] = np.unique(pairs, axis=1, return_inverse=True)[1].reshape(-1)
        rows, others = [], []
        after, before = np.zeros(n, np.int64), np.zeros(n, np.int64)
        reach, since = np.arange(n), np.arange(n)  # the last and the first node that shares an ancestor
        owner, level = np.nonzero(anc >= 0)
        held, at = np.unique(anc[owner, level], return_inverse=True)
        last, first = np.zeros(len(held), np.int64), np.full(len(held), n, np.int64)
        np.maximum.at(last, at, owner)
        np.minimum.at(first, at, owner)
        np.maximum.at(reach, owner, last[at])
        np.minimum.at(since, owner, first[at])
        open_ = np.arange(n)  # nodes that may have friends after them still farther away
        for gap in range(1, n):
            open_ = open_[open_ + gap <= reach[open_]]
            if not len(open_):
                break
            at = open_[((after[open_] < most) | (before[open_ + gap] < most)) & (since[open_ + gap] <= open_)]
            a, b = anc[at], anc[at + gap]
            near = at[((a[:, :, None] == b[:, None, :]) & (a[:, :, None] >= 0)).any(axis=(1, 2))]
            rows += [near, near + gap]
            others += [near + gap, near]
            after[near] += 1
            before[near + gap] += 1
        r, c = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (rows, others))
        d = np.abs(node[r] - node[c])
        order = np.lexsort((node[c], d, r))
        r, c, d = r[order], c[order], d[order]
        rank = np.arange(len(r)) - np.searchsorted(r, r)
        fine = rank < most
        return of[r[fine]], node[r[fine]], node[c[fine]], d[fine]

    n = nodes.select(tree, "node_id", F.col("anc_ids").cast("array<bigint>").alias("anc_ids"))
    return per_tree(n, ["anc_ids"], find, "node_id bigint, friend_id bigint, distance bigint", tree, together=True)


def friends_of_any_tree(nodes: DataFrame, most_levels: int = 5, most: int = 10, tree: str = "page_id") -> DataFrame:
    """friends() where a tree may have more nodes than fit a task, as those that are made of tables.

    Nodes below one ancestor are friends of each other, so that the nearest `most` of a node are among as many before and
    after it there. These come from a sorted window for each ancestor, which spills; a node holds most_levels short lists.
    """
    up = nodes.select(tree, F.col("node_id").cast("bigint").alias("node_id"), F.explode(F.slice(F.reverse(F.col("anc_ids").cast("array<bigint>")), 1, most_levels)).alias("_anc"))
    around = F.collect_list("node_id").over(W.partitionBy(tree, "_anc").orderBy("node_id").rowsBetween(-most, most))
    apart = lambda x: F.struct(F.abs(x - F.col("node_id")).alias("distance"), x.alias("friend_id"))
    nearest = lambda c: F.slice(F.array_sort(F.transform(F.filter(c, lambda x: x != F.col("node_id")), apart)), 1, most)
    own = up.select(tree, "node_id", around.alias("_near"))
    if most_levels > 1:
        own = own.groupBy(tree, "node_id").agg(F.array_distinct(F.flatten(F.collect_list("_near"))).alias("_near"))
    return own.select(tree, "node_id", F.explode(nearest(F.col("_near"))).alias("_f")).select(tree, "node_id", "_f.friend_id", "_f.distance")


def partners(nodes: DataFrame, most_levels: int = 5, tree: str = "page_id") -> DataFrame:
    """node_id and partner_id: the other of the two nodes below an ancestor that has just two; the farthest such one counts."""
    up = nodes.select(tree, "node_id", F.posexplode(F.slice(F.reverse("anc_ids"), 1, most_levels)).alias("height", "anc"))
    two = up.groupBy(tree, "anc").agg(F.count("*").alias("n"), F.min("node_id").alias("a"), F.max("node_id").alias("b")).where("n = 2")
    held = up.join(two, [tree, "anc"])
    other = F.when(F.col("node_id") == F.col("a"), F.col("b")).otherwise(F.col("a"))
    return held.groupBy(tree, "node_id").agg(F.max_by(other, "height").alias("partner_id"))
