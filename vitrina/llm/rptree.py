"""Embedding near-dedup with a forest of random-projection trees.

Every tree splits the vectors again and again at a median of a random projection; vectors near a split go both ways (spill overlap).
Vectors are compared only within leaves, by their exact cosine. The medians are those of a bounded sample, every vector is routed. A leaf
with more than ``BLOCK`` vectors of a label is compared in pairs of blocks, so a hot one is shared out and none is cut.
Equal vectors are one vector with a count, and a pair is counted only in the first leaf that both are in, so links add up exactly.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from vitrina.llm.base import components, small_batches, stored
from vitrina.llm.simhash import unite
from vitrina.llm.vectors import matrices, usable

COSINE = 0.98
TREES = 8
# Rows of a label that a leaf should hold; sets the depth, from the largest label.
LEAF_ROWS = 512
# Vectors this near to a split, on the unit sphere, go both ways.
SPILL = 0.0125
# Bound of the sample that the medians come from, and the rows a node needs for a median of its own.
FIT_ROWS = 20_000
NODE_ROWS = 16
BLOCK = 2048


class Tree(NamedTuple):
    """Directions by level; medians by node down to ``fitted`` levels, and below by the node's ancestor there and the level."""

    directions: np.ndarray
    medians: list[np.ndarray]
    deeper: np.ndarray

    def leaves(self, unit: np.ndarray, spill: float) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (row, leaf): a row is in several leaves if it came near a split."""
        row, node = np.arange(len(unit)), np.zeros(len(unit), np.int64)
        shown = unit @ self.directions.T
        for level in range(len(self.directions)):
            if level < len(self.medians):
                at = self.medians[level][node]
            else:
                at = self.deeper[level - len(self.medians)][node >> (level - len(self.medians))]
            gap = shown[row, level] - at
            left, right = gap <= spill, gap >= -spill
            row, node = np.concatenate([row[left], row[right]]), np.concatenate([2 * node[left], 2 * node[right] + 1])
        return row, node


def grow_tree(sample: np.ndarray, depth: int, rng: np.random.Generator) -> Tree:
    """Split the sample's unit vectors ``depth`` times; levels with too few rows a node take the medians of the last full level."""
    directions = rng.standard_normal((depth, sample.shape[1]))
    directions /= np.linalg.norm(directions, axis=1, keepdims=True)
    shown, node = sample @ directions.T, np.zeros(len(sample), np.int64)
    fitted = min(depth, max(0, int(np.log2(max(1, len(sample) // NODE_ROWS)))))

    def by_node(values: np.ndarray, count: int) -> np.ndarray:
        out = np.full(count, np.median(values) if len(values) else 0.0)
        for k in range(count):
            if (mine := node == k).any():
                out[k] = np.median(values[mine])
        return out

    medians = []
    for level in range(fitted):
        medians.append(by_node(shown[:, level], 1 << level))
        node = 2 * node + (shown[:, level] > medians[-1][node])
    deeper = [by_node(shown[:, level], 1 << fitted) for level in range(fitted, depth)]
    return Tree(directions, medians, np.array(deeper))


def unit_rows(matrix: np.ndarray) -> np.ndarray:
    scale = np.abs(matrix).max(axis=1, keepdims=True)  # before the squares, which could overflow
    scaled = matrix / scale
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


def forest(distinct: DataFrame, depth: int, trees: int, seed: int) -> tuple[int, list[Tree]]:
    """Length of the sampled vectors and the trees fitted to them; at most ``FIT_ROWS`` vectors reach the driver."""
    sample = distinct.select("vector", "k1").orderBy("k1").limit(FIT_ROWS).toPandas()["vector"]
    if not len(sample):
        return 0, []
    sizes = np.array([len(v) for v in sample])
    size = int(np.bincount(sizes).argmax())
    unit = unit_rows(np.array([np.asarray(v, float) for v, n in zip(sample, sizes) if n == size]))
    rng = np.random.default_rng(seed)
    return size, [grow_tree(unit, depth, rng) for _ in range(trees)]


def routed(distinct: DataFrame, size: int, trees: list[Tree]) -> DataFrame:
    """``(label, code, node, n, vector, codes)`` for every leaf of every vector; ``codes`` are all its leaves.

    Vectors of another length than the sample's are in one leaf of their label and length.
    """
    shared = distinct.sparkSession.sparkContext.broadcast(trees)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes: list[np.ndarray] = [np.zeros(0, np.int64)] * batch.num_rows
            for rows, matrix in matrices(batch["vector"]):
                if matrix.shape[1] != size:
                    for r in rows:
                        codes[r] = np.array([-matrix.shape[1]])
                    continue
                unit = unit_rows(matrix)
                found = [tree.leaves(unit, SPILL) for tree in shared.value]
                row = np.concatenate([r for r, _ in found])
                code = np.concatenate([leaf + (t << 40) for t, (_, leaf) in enumerate(found)])
                order = np.lexsort((code, row))
                for r, c in zip(rows, np.split(code[order], np.cumsum(np.bincount(row, minlength=len(rows)))[:-1])):
                    codes[r] = c
            yield pa.record_batch(
                [batch["label"], batch["node"], batch["n"], batch["vector"], pa.array(codes, pa.list_(pa.int64()))],
                ["label", "node", "n", "vector", "codes"])

    label = distinct.schema["label"].dataType.simpleString()
    rows = distinct.select("label", "node", "n", F.col("vector").cast("array<double>").alias("vector"))
    rows = rows.mapInArrow(run, f"label {label}, node long, n long, vector array<double>, codes array<long>")
    return rows.select("label", F.explode("codes").alias("code"), "node", "n", "vector", "codes")


def leaf_links(matrix: np.ndarray, n: np.ndarray, codes: list[np.ndarray], code: int, side: np.ndarray, cosine: float):
    """Links of one leaf or block pair: per vector, how many rows it is linked to here first; and links that span all pairs.

    ``side``: 0 and 1 for the two blocks, whose vectors are compared across, or all 0 for a block with itself.
    """
    a = np.flatnonzero(side == 0)
    b = np.flatnonzero(side == 1) if side.any() else a
    norm = np.linalg.norm(matrix, axis=1)
    near = (matrix[a] @ matrix[b].T) / norm[a][:, None] / norm[b] >= cosine
    if b is a:
        np.fill_diagonal(near, False)
    labels = np.arange(len(matrix))
    i, j = np.nonzero(near)
    unite(labels, a[i], b[j])
    if len(i):  # pairs that an earlier leaf has counted
        place_a, place_b = np.full(len(matrix), -1), np.full(len(matrix), -1)
        place_a[a], place_b[b] = np.arange(len(a)), np.arange(len(b))
        sizes = [len(c) for c in codes]
        who, what = np.repeat(np.arange(len(codes)), sizes), np.concatenate(codes)
        early = what < code
        who, what = who[early], what[early]
        order = np.argsort(what, kind="stable")
        who, what = who[order], what[order]
        for members in np.split(who, np.flatnonzero(np.diff(what)) + 1) if len(who) else []:
            x, y = place_a[members], place_b[members]
            near[np.ix_(x[x >= 0], y[y >= 0])] = False
    links = np.zeros(len(matrix), np.int64)
    links[a] += near.astype(np.int64) @ n[b]
    if b is not a:
        links[b] += near.T.astype(np.int64) @ n[a]
    moved = np.flatnonzero(labels != np.arange(len(labels)))
    return links, moved, labels[moved]


def compared(rows: DataFrame, cosine: float) -> DataFrame:
    """``(node, other, links)``: numbers of links with ``other`` null, and spanning links to ``other``."""
    small_batches(rows.sparkSession, 4096)
    rows = stored(rows, "leaves")
    sizes = stored(rows.groupBy("label", "code").count().filter(F.col("count") > BLOCK), "hot")
    zero = F.lit(0)
    if not sizes.isEmpty():
        hot = sizes.select("label", "code", F.ceil(F.col("count") / BLOCK).cast("int").alias("blocks"))
        rows = rows.join(hot, ["label", "code"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
        rows = rows.withColumn("own", F.pmod(F.xxhash64("node"), "blocks").cast("int"))
        rows = rows.withColumn("with", F.explode(F.sequence(zero, F.col("blocks") - 1)))
        first, second = F.least("own", "with"), F.greatest("own", "with")
        rows = rows.withColumns({"first": first, "second": second, "side": F.when(F.col("own") == first, 0).otherwise(1)})
    else:
        rows = rows.withColumns({"first": zero, "second": zero, "side": zero})
    group = ["label", "code", "first", "second"]
    rows = rows.select(*group, "side", "node", "n", "vector", "codes").repartition(*group).sortWithinPartitions(*group, "side", "node")

    def emit(page: pa.Table) -> Iterator[pa.RecordBatch]:
        matrix = matrices(page["vector"])[0][1]  # one leaf has one length
        node, n = page["node"].to_numpy(), page["n"].to_numpy()
        codes = [np.asarray(c) for c in page["codes"].to_pylist()]
        links, a, b = leaf_links(matrix, n, codes, page["code"][0].as_py(), page["side"].to_numpy(), cosine)
        some = np.flatnonzero(links)
        other = pa.concat_arrays([pa.nulls(len(some), pa.int64()), pa.array(node[b], pa.int64())])
        if len(some) or len(a):
            yield pa.record_batch([
                pa.array(np.concatenate([node[some], node[a]])), other,
                pa.array(np.concatenate([links[some], np.zeros(len(a), np.int64)]))], ["node", "other", "links"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[pa.RecordBatch] = []  # the leaf, or block pair, that is coming in
        now = None
        for batch in batches:
            keys = list(zip(*(batch[c].to_pylist() for c in group)))
            start = 0
            for i in range(1, len(keys) + 1):
                if i == len(keys) or keys[i] != keys[start]:
                    if now is not None and keys[start] != now:
                        yield from emit(pa.Table.from_batches(kept))
                        kept = []
                    now = keys[start]
                    kept.append(batch.slice(start, i - start))
                    start = i
        if kept:
            yield from emit(pa.Table.from_batches(kept))

    return rows.mapInArrow(run, "node long, other long, links long")


def near_duplicates(
    rows: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", cosine: float = COSINE,
    trees: int = TREES, seed: int = 7,
) -> DataFrame:
    """``(vec_id, n_links, component_id, kept)`` of every row: rows linked directly, the smallest key reachable, and whether it is that.

    Vectors link if their labels and lengths are equal, and their cosine is at least ``cosine``. Null labels, null, empty or zero vectors
    and those with null or non-finite components link with nothing. Equal vectors link; repeated rows count as rows; a null key names a
    component only if it has no other. An empty table gives no rows; other columns play no part.
    """
    fine = usable(F.col(vector), zero=False) & F.col(label).isNotNull()
    own = rows.select(F.col(key).alias("key"), F.col(label).alias("label"), F.col(vector).alias("vector"), fine.alias("fine"))
    hashes = [F.when(F.col("fine"), F.xxhash64(F.lit(s), F.lit(s), "label", "vector")) for s in (1, 2)]
    own = own.withColumns({"k1": hashes[0], "k2": hashes[1]})
    distinct = own.filter("fine").groupBy("k1", "k2").agg(
        F.first("label").alias("label"), F.first("vector").alias("vector"), F.count("*").alias("n"), F.min("key").alias("least"))
    distinct = stored(distinct.withColumn("node", F.monotonically_increasing_id()), "vectors")
    most = distinct.groupBy("label").count().agg(F.max("count")).first()[0] or 0
    depth = max(0, int(np.ceil(np.log2(max(1, most) / LEAF_ROWS))))
    size, grown = forest(distinct, depth, trees, seed)
    found = stored(compared(routed(distinct, size, grown), cosine), "found")
    counts = found.filter("other is null").groupBy("node").agg(F.sum("links").alias("links"))
    roots = components(found.filter("other is not null").select(F.col("node").alias("a"), F.col("other").alias("b")))
    named = distinct.select("k1", "k2", "n", "least", "node").join(counts, "node", "left").join(roots, "node", "left")
    named = stored(named.withColumn("root", F.coalesce("root", "node")), "named")
    least = named.groupBy("root").agg(F.min("least").alias("component"))
    named = named.join(least, "root").select(
        F.col("k1").alias("h1"), F.col("k2").alias("h2"), (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("links"), "component")
    joined = own.select("key", "k1", "k2").join(named, (F.col("k1") == F.col("h1")) & (F.col("k2") == F.col("h2")), "left")
    component = F.coalesce("component", "key")
    return joined.select(
        F.col("key").alias("vec_id"), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
        component.eqNullSafe(F.col("key")).alias("kept"))
