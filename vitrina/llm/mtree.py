"""Exact top-k by inner product: M-trees over shards, searched best first.

Vectors get one more component that gives all the same length, so the largest inner products are the nearest in a metric space. A
shard of bounded size is an M-tree: nodes hold a routing vector, a covering radius and the distance to the parent; leaves are pages of
vectors with their distances to the page's routing vector. The queries of a batch go through a tree together. A search skips nodes
that hold no score good enough, and children and page entries whose stored distances alone rule them out, without computing theirs.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from vitrina.llm.base import small_batches, stored
from vitrina.llm.vectors import usable

SCALE = 256
# Vectors of a shard's tree, of a page, and children of a node.
SHARD_ROWS = 8192
PAGE_ROWS = 64
FANOUT = 16
# Share of the squared lengths that bounds give way by, for rounding.
SLACK = 1e-9


class Tree(NamedTuple):
    """Nodes by number, children and entries in a row; ``vectors`` are in the order of the pages, the routing vectors by node."""

    vectors: np.ndarray
    ids: list[list[int]]
    entry_distance: np.ndarray
    routing: np.ndarray
    radius: np.ndarray
    parent_distance: np.ndarray
    first: np.ndarray  # first child, or first entry of a page
    count: np.ndarray
    page: np.ndarray
    top: float  # squared length that all vectors are brought to


def build(vectors: np.ndarray, ids: list[list[int]], top: float) -> Tree:
    """Split from the top: spread routing vectors, each vector to the nearest, until a page holds them."""
    lifted = np.column_stack([vectors, np.sqrt(np.maximum(top - (vectors.astype(float) ** 2).sum(1), 0))])
    order = np.arange(len(vectors))
    nodes: list[list] = [[lifted[:1].mean(0), 0, len(vectors), 0.0]]  # routing, range of the order, distance to the parent
    first, count, page = [], [], []
    at = 0
    while at < len(nodes):
        routing, low, high, _ = nodes[at]
        mine = order[low:high]
        groups = []
        if high - low > PAGE_ROWS:
            centres = [int(np.argmax(((lifted[mine] - routing) ** 2).sum(1)))]
            near = ((lifted[mine] - lifted[mine[centres[0]]]) ** 2).sum(1)
            owner = np.zeros(len(mine), int)
            while len(centres) < FANOUT and near.max() > 0:
                centres.append(int(np.argmax(near)))
                d = ((lifted[mine] - lifted[mine[centres[-1]]]) ** 2).sum(1)
                owner[d < near] = len(centres) - 1
                near = np.minimum(near, d)
            groups = [np.flatnonzero(owner == k) for k in range(len(centres))]
        if len(groups) > 1:
            first.append(len(nodes))
            count.append(len(groups))
            page.append(False)
            order[low:high] = mine[np.concatenate(groups)]
            for members in groups:
                centre = lifted[mine[members]].mean(0)
                nodes.append([centre, low, low + len(members), float(np.sqrt(((centre - routing) ** 2).sum()))])
                low += len(members)
        else:
            first.append(low)
            count.append(high - low)
            page.append(True)
        at += 1
    placed = lifted[order]
    radius = np.array([np.sqrt(((placed[a:b] - r) ** 2).sum(1)).max(initial=0) for r, a, b, _ in nodes])
    distance = np.zeros(len(order))
    for (r, a, b, _), is_page in zip(nodes, page):
        if is_page:
            distance[a:b] = np.sqrt(((placed[a:b] - r) ** 2).sum(1))
    return Tree(vectors[order], [ids[i] for i in order], distance, np.array([r for r, *_ in nodes]), radius,
                np.array([d for *_, d in nodes]), np.array(first), np.array(count), np.array(page), top)


def search(tree: Tree, queries: np.ndarray, own: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(query, id, score)``: the ``k`` best of a tree for each line of integer vectors, ties to smaller ids, without rows of its own id.

    The queries go through the tree together, each first down to the page of the nearest routing vectors, which gives it a score to beat; a
    node or page sees those queries alone that it is not ruled out for.
    """
    exact = float(np.abs(queries).max(initial=0)) * float(np.abs(tree.vectors).max(initial=0)) * queries.shape[1] < 2**53
    q = queries.astype(float)
    asked, vectors = (q, tree.vectors.astype(float)) if exact else (queries, tree.vectors)
    lowest = -np.inf if exact else np.iinfo(np.int64).min
    length = (q * q).sum(1)
    whole = length + tree.top
    slack = SLACK * whole + 1
    best = np.full((len(q), k), lowest, dtype=asked.dtype)  # scores of the best entries, the least first
    sizes = np.array([len(ids) for ids in tree.ids])
    ids, entry = np.concatenate([np.array(x, np.int64) for x in tree.ids]), np.repeat(np.arange(len(sizes)), sizes)
    # entries that hold nothing but a query's own id
    order = np.argsort(ids, kind="stable")
    low, high = np.searchsorted(ids[order], own), np.searchsorted(ids[order], own, side="right")
    mine = [(entry[order[i]], line) for line in np.flatnonzero(low < high) for i in range(low[line], high[line]) if sizes[entry[order[i]]] == 1]
    barred = np.array(sorted(mine), np.int64).reshape(-1, 2)
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def best_score(lines: np.ndarray, distance: np.ndarray) -> np.ndarray:
        wide = (slice(None), *[None] * (distance.ndim - 1))
        return (whole[lines][wide] - np.maximum(distance, 0) ** 2) / 2 + slack[lines][wide]

    def distance_to(lines: np.ndarray, nodes: slice) -> np.ndarray:
        routing = tree.routing[nodes]
        return np.sqrt(np.maximum(length[lines][:, None] + (routing**2).sum(1) - 2 * (q[lines] @ routing[:, :-1].T), 0))

    def read_page(node: int, lines: np.ndarray, distance: np.ndarray) -> None:
        a, b = tree.first[node], tree.first[node] + tree.count[node]
        may = best_score(lines, np.abs(distance[:, None] - tree.entry_distance[a:b])) >= best[lines, :1]
        lines, entries = lines[may.any(1)], a + np.flatnonzero(may.any(0))
        if not len(lines):
            return
        scores = asked[lines] @ vectors[entries].T
        for e, line in barred[slice(*np.searchsorted(barred[:, 0], (a, b)))]:
            scores[np.ix_(lines == line, entries == e)] = lowest
        better = (scores >= best[lines, :1]).any(1)
        lines, scores = lines[better], scores[better]
        best[lines] = np.sort(np.partition(np.hstack([best[lines], scores]), -k, axis=1)[:, -k:], axis=1)
        at, place = np.nonzero((scores >= best[lines, :1]) & (scores > lowest))
        found.append((lines[at], entries[place], scores[at, place]))

    every = np.arange(len(q))
    down, away = np.zeros(len(q), dtype=np.int64), distance_to(every, slice(0, 1))[:, 0]
    start = away
    while not tree.page[down].all():
        for node in np.unique(down[~tree.page[down]]):
            lines = np.flatnonzero(down == node)
            a = tree.first[node]
            near = distance_to(lines, slice(a, a + tree.count[node]))
            down[lines], away[lines] = a + near.argmin(1), near.min(1)
    for node in np.unique(down):
        lines = np.flatnonzero(down == node)
        read_page(node, lines, away[lines])
    todo = [(0, every, start.copy())]
    while todo:
        node, lines, distance = todo.pop()
        open_ = best_score(lines, distance - tree.radius[node]) >= best[lines, 0]
        lines, distance = lines[open_], distance[open_]
        if tree.page[node]:
            fresh = down[lines] != node
            read_page(node, lines[fresh], distance[fresh])
            continue
        a, b = tree.first[node], tree.first[node] + tree.count[node]
        near = np.abs(distance[:, None] - tree.parent_distance[a:b]) - tree.radius[a:b]
        may = best_score(lines, near) >= best[lines, :1]
        for child in range(a, b):
            some = lines[may[:, child - a]]
            if len(some):
                todo.append((child, some, distance_to(some, slice(child, child + 1))[:, 0]))
    line, at, score = (np.concatenate(x) if found else np.zeros(0, np.int64) for x in (zip(*found) if found else [()] * 3))
    kept = score >= best[line, 0]
    line, at, score = line[kept], at[kept], score[kept].astype(np.int64)
    ends = np.cumsum(sizes)
    times = sizes[at]
    place = np.repeat(ends[at] - np.cumsum(times), times) + np.arange(times.sum())
    line, score, vec_id = np.repeat(line, times), np.repeat(score, times), ids[place]
    other = vec_id != own[line]
    line, score, vec_id = line[other], score[other], vec_id[other]
    order = np.lexsort((vec_id, -score, line))
    line, score, vec_id = line[order], score[order], vec_id[order]
    first = np.searchsorted(line, line)  # of the query, in this order
    top = np.arange(len(line)) - first < k
    return line[top], vec_id[top], score[top]


def quantised(vector: Column) -> Column:
    return F.transform(vector, lambda x: F.floor(x.cast("double") * SCALE))


def top_k(rows: DataFrame, every: int, k: int, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``(query_id, rank, vec_id, score)``: for each row whose key is divisible by ``every``, the ``k`` best other rows.

    Scores are integer inner products of the quantised vectors, ties go to smaller keys. Null or empty vectors, null or non-finite
    components and null keys take no part; rows of another length are not candidates; rows equal in key and vector count once. An
    empty table gives no rows; other columns play no part.
    """
    spark = rows.sparkSession
    fine = usable(F.col(vector)) & F.col(key).isNotNull()
    own = rows.filter(fine).select(F.col(key).cast("long").alias("id"), quantised(F.col(vector)).alias("v")).distinct()
    own = stored(own.withColumns({"size": F.size("v"), "k1": F.xxhash64(F.lit(1), "v"), "k2": F.xxhash64(F.lit(2), F.lit(2), "v")}), "vectors")
    # of equal vectors, the smallest keys are all that can be returned
    place = F.row_number().over(Window.partitionBy("k1", "k2").orderBy("id"))
    kept = own.withColumn("place", place).filter(F.col("place") <= k + 1)
    distinct = stored(kept.groupBy("k1", "k2").agg(F.first("v").alias("v"), F.first("size").alias("size"), F.collect_list("id").alias("ids")), "distinct")
    longest = distinct.groupBy("size").agg(
        F.count("*").alias("n"), F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x)).alias("top"))
    lengths = {r["size"]: (max(1, -(-r["n"] // SHARD_ROWS)), float(r["top"])) for r in longest.collect()}  # one row for each length
    if not lengths:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    shards = F.lit(0)
    for size, (n, _) in lengths.items():
        shards = F.when(F.col("size") == size, n).otherwise(shards)
    small_batches(spark, 2048)
    trees = distinct.withColumn("shard", F.pmod(F.col("k2"), shards).cast("int")).select("size", "shard", "v", "ids")
    trees = stored(trees.repartition("size", "shard").sortWithinPartitions("size", "shard").mapInArrow(
        _builder(lengths), "size int, shard int, tree binary"), "trees")
    asked = own.filter(F.col("id") % every == 0).withColumn("shard", F.explode(F.sequence(F.lit(0), shards - 1)))
    asked = asked.select("size", "shard", "id", "v", F.lit(None).cast("binary").alias("tree"))
    both = trees.select("size", "shard", F.lit(None).cast("long").alias("id"), F.lit(None).cast("array<bigint>").alias("v"), "tree")
    both = both.unionByName(asked).repartition("size", "shard").sortWithinPartitions("size", "shard", F.col("id").asc_nulls_first())
    found = both.mapInArrow(_searcher(k), "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _builder(lengths: dict[int, tuple[int, float]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, vectors, ids = None, [], []

        def emit() -> pa.RecordBatch:
            tree = build(np.array(vectors, np.int64), ids, lengths[now[0]][1])
            kinds = (pa.int32(), pa.int32(), pa.binary())
            return pa.record_batch([pa.array([x], t) for x, t in zip((*now, pickle.dumps(tuple(tree))), kinds)], ["size", "shard", "tree"])

        for batch in batches:
            for *shard, v, i in zip(*(batch[c].to_pylist() for c in ("size", "shard", "v", "ids"))):
                if shard != now and now is not None:
                    yield emit()
                    vectors, ids = [], []
                now = shard
                vectors.append(v)
                ids.append(i)
        if now is not None:
            yield emit()

    return run


def _searcher(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = None
        for batch in batches:
            # a tree comes before the queries of its shard
            trees = np.flatnonzero(batch["tree"].is_valid().to_numpy(zero_copy_only=False))
            out = []
            for low, high in zip([0, *trees + 1], [*trees, batch.num_rows]):
                if low and low - 1 in trees:
                    tree = Tree(*pickle.loads(batch["tree"][int(low - 1)].as_py()))
                if low < high:
                    part = batch.slice(low, high - low)
                    own = part["id"].to_numpy()
                    line, vec_id, score = search(tree, part["v"].flatten().to_numpy().reshape(len(own), -1), own, k)
                    out.append((own[line], vec_id, score))
            columns = [np.concatenate(c) for c in zip(*out)] if out else [()] * 3
            yield pa.record_batch([pa.array(c, pa.int64()) for c in columns], ["query_id", "vec_id", "score"])

    return run
