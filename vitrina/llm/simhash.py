"""SimHash near-dedup: fingerprints of word shingles, linked through BK-trees in lossless shards.

Two fingerprints that differ in at most ``RADIUS`` of 64 bits agree on at least two of six bit blocks, so each fingerprint joins
the fifteen shards named by its pairs of blocks and meets every partner in at least one. The fingerprints of a shard form a BK-tree:
a child hangs on the edge that names its Hamming distance to the parent, and a search follows only the edges within the radius.
Exact copies share one fingerprint and are collapsed first; a shard with more than ``TREE_ROWS`` fingerprints is cut into several
trees, each of which meets all of the shard's fingerprints, so no task holds an unbounded tree.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from vitrina.llm.base import components, free_name, small_batches, stored

SHINGLE = 4
RADIUS = 4
SEED = 42
# Widths of the bit blocks, from the lowest bit; RADIUS errors leave two of them alike.
BLOCKS = (11, 11, 11, 11, 10, 10)
TREE_ROWS = 20_000
# Rows of whole shards that are searched together.
PAGE_ROWS = 60_000
# Most (query, node) pairs that are open at once.
FRONTIER = 2_000_000


def shingle_hashes(text: bytes | None, width: int) -> np.ndarray:
    """Hash of every shingle of the lower-cased words of a UTF-8 text; fewer words than ``width`` are one shingle."""
    words = (text or b"").lower().split()  # on bytes: A-Z only, and the six ASCII blanks
    if not words:
        return np.zeros(0, "<u8")
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    k = min(width, len(words))
    digest, view = xxhash.xxh64_intdigest, memoryview(joined)
    spans = zip(starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist())
    return np.fromiter((digest(view[a:b], SEED) for a, b in spans), "<u8", len(words) - k + 1)


def fingerprint(text: bytes | None, width: int = SHINGLE) -> int:
    """SimHash of the shingles of a UTF-8 text; 0 without words."""
    hashes = shingle_hashes(text, width)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        block = hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(block, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, key: Column) -> DataFrame:
    """``(key, fp)`` of every row, the fingerprint as a signed long; a null or empty text has fingerprint 0."""
    small_batches(docs.sparkSession)
    rows = docs.select(key.alias("key"), F.encode("text", "utf-8").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.fromiter((fingerprint(t.as_py()) for t in batch["text"]), np.uint64, batch.num_rows)
            yield pa.record_batch([batch["key"], pa.array(found.view(np.int64))], ["key", "fp"])

    kind = rows.schema["key"].dataType.simpleString()
    return rows.mapInArrow(run, f"key {kind}, fp long")


def shard_keys(fp: Column) -> Column:
    """The shards of a fingerprint: for every pair of blocks, the pair's number and the bits of both."""
    starts = np.cumsum((0, *BLOCKS[:-1])).tolist()
    bits = [F.shiftrightunsigned(fp, s).bitwiseAND(F.lit((1 << w) - 1)) for s, w in zip(starts, BLOCKS)]
    pairs = combinations(range(len(BLOCKS)), 2)
    return F.array(*(F.lit(n << 32).bitwiseOR(F.shiftleft(bits[i], 16)).bitwiseOR(bits[j]) for n, (i, j) in enumerate(pairs)))


def grow(values: np.ndarray, roots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A forest of BK-trees over different values: parent of each value (-1: a root) and its distance to it.

    ``roots`` names the first value of each value's tree. All values sink at once, one edge a round.
    """
    n = len(values)
    parent, edge = np.full(n, -1), np.zeros(n, np.int64)
    rest = np.flatnonzero(roots != np.arange(n))
    at = roots[rest]
    while len(rest):
        d = np.bitwise_count(values[rest] ^ values[at]).astype(np.int64)
        slot = at * 65 + d
        order = np.argsort(slot, kind="stable")
        first = np.concatenate(([True], slot[order][1:] != slot[order][:-1]))
        head = order[first][np.cumsum(first) - 1]  # who takes the slot, for each in order
        new = rest[order[first]]
        parent[new], edge[new] = at[order[first]], d[order[first]]
        rest, at = rest[order[~first]], rest[head[~first]]
    return parent, edge


def search(
    values: np.ndarray, parent: np.ndarray, edge: np.ndarray, queries: np.ndarray, roots: np.ndarray, radius: int
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (index of a query, index of a value) within the radius, following only edges that can lead there."""
    children = np.flatnonzero(parent >= 0)
    slots = parent[children] * 65 + edge[children]
    order = np.argsort(slots, kind="stable")
    children, slots = children[order], slots[order]
    todo = [(np.arange(len(queries)), roots)]
    while todo:
        query, node = todo.pop()
        if len(query) > FRONTIER:
            half = len(query) // 2
            todo += [(query[:half], node[:half]), (query[half:], node[half:])]
            continue
        d = np.bitwise_count(queries[query] ^ values[node]).astype(np.int64)
        hit = d <= radius
        if hit.any():
            yield query[hit], node[hit]
        low = np.searchsorted(slots, node * 65 + np.maximum(d - radius, 0))
        high = np.searchsorted(slots, node * 65 + np.minimum(d + radius, 64), side="right")
        many = high - low
        if total := int(many.sum()):
            place = np.arange(total) - np.repeat(np.cumsum(many) - many, many) + np.repeat(low, many)
            todo.append((np.repeat(query, many), children[place]))


def unite(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Give both ends of every link one label, the smallest, in place; ``labels`` point to smaller or equal indices."""
    while True:
        x, y = labels[a], labels[b]
        open_ = x != y
        if not open_.any():
            return
        a, b, x, y = a[open_], b[open_], x[open_], y[open_]
        np.minimum.at(labels, np.maximum(x, y), np.minimum(x, y))
        while (labels[labels] != labels).any():
            labels[:] = labels[labels]


def spanning_links(group: np.ndarray, fp: np.ndarray, stored_: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that join exactly the fingerprints that BK-trees join within each group; rows come group by group."""
    labels = np.arange(len(fp))
    start = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
    number = np.cumsum(np.concatenate(([False], group[1:] != group[:-1])))
    tree = np.flatnonzero(stored_)
    root = np.full(len(start), -1)
    heads, firsts = np.unique(number[tree], return_index=True)
    root[heads] = firsts  # place, among the tree rows, of each group's first
    alone = np.bincount(number, minlength=len(start)) < 2
    ask = np.flatnonzero((root[number] >= 0) & ~alone[number])
    if len(ask):
        parent, edge = grow(fp[tree], root[number[tree]])
        for q, t in search(fp[tree], parent, edge, fp[ask], root[number[ask]], radius):
            unite(labels, ask[q], tree[t])
    moved = np.flatnonzero(labels != np.arange(len(fp)))
    return fp[moved], fp[labels[moved]]


def links(distinct: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Links ``(a, b)`` between the different fingerprints ``fp`` that span all pairs within the radius."""
    if radius > len(BLOCKS) - 2:
        raise ValueError("the blocks are lossless up to a radius of 4 only")
    rows = distinct.select(F.explode(shard_keys(F.col("fp"))).alias("shard"), "fp")
    sizes = stored(rows.groupBy("shard").count().filter(F.col("count") > TREE_ROWS), "hot")
    if not sizes.isEmpty():
        trees = F.ceil(F.col("count") / TREE_ROWS).cast("int")
        hot = sizes.select("shard", trees.alias("trees"))
        rows = rows.join(hot, "shard", "left").withColumn("trees", F.coalesce("trees", F.lit(1)))
        rows = rows.withColumn("home", F.pmod(F.xxhash64("fp"), "trees").cast("int"))
        rows = rows.withColumn("tree", F.explode(F.sequence(F.lit(0), F.col("trees") - 1)))
        rows = rows.select("shard", "tree", "fp", (F.col("home") == F.col("tree")).alias("own"))
    else:
        rows = rows.select("shard", F.lit(0).alias("tree"), "fp", F.lit(True).alias("own"))
    rows = rows.repartition("shard", "tree").sortWithinPartitions("shard", "tree", F.desc("own"), "fp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[pa.Table] = []
        for batch in batches:
            kept.append(pa.Table.from_batches([batch]))
            if sum(t.num_rows for t in kept) >= PAGE_ROWS:
                page = pa.concat_tables(kept)
                shard, tree = page["shard"].to_numpy(), page["tree"].to_numpy()
                last = np.flatnonzero((shard != shard[-1]) | (tree != tree[-1]))
                cut = int(last[-1]) + 1 if len(last) else 0  # the last shard may go on in the next batch
                kept = [page.slice(cut)]
                if cut:
                    yield emit(page.slice(0, cut))
        if kept:
            yield emit(pa.concat_tables(kept))

    def emit(page: pa.Table) -> pa.RecordBatch:
        shard, tree = page["shard"].to_numpy(), page["tree"].to_numpy()
        new = np.concatenate(([True], (shard[1:] != shard[:-1]) | (tree[1:] != tree[:-1]))) if len(shard) else np.zeros(0, bool)
        fp = page["fp"].to_numpy().view(np.uint64)
        a, b = spanning_links(np.cumsum(new), fp, page["own"].to_numpy(zero_copy_only=False), radius)
        return pa.record_batch([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

    return rows.mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, key: Column, radius: int = RADIUS) -> DataFrame:
    """Fingerprint and component of every row: ``(key, fp, component)``, component the smallest key that links reach.

    ``key`` identifies rows and is orderable. Null, empty and blank texts have fingerprint 0 and link to each other like any
    others. Repeated rows give repeated results; a null key never names a component unless all keys of it are null. An empty table
    gives no rows; other columns play no part.
    """
    spark = docs.sparkSession
    marked = stored(fingerprints(docs, key), "fingerprints")
    distinct = stored(marked.groupBy("fp").agg(F.min("key").alias("least")), "distinct")
    small_batches(spark, 20_000)
    found = stored(links(distinct, radius), "found")
    small_batches(spark)
    roots = components(found).select(F.col("node").alias("fp"), "root")
    named = distinct.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    named = stored(named, "named")
    least = named.groupBy("root").agg(F.min("least").alias("component"))
    table = stored(named.join(least, "root").select("fp", "component"), "components")
    return marked.join(table, "fp").select("key", "fp", "component")


def keep_one(docs: DataFrame, key: str = "doc_id", radius: int = RADIUS) -> DataFrame:
    """One row of each group of near-duplicates, all its columns: that with the smallest ``key``, ties by the text's hash.

    Rows without words form one group. Rows equal in key and text count as one row.
    """
    digest = F.sha2(F.coalesce(F.col("text"), F.lit("")), 256)
    absent = F.col("text").isNull()
    rows = near_duplicates(docs, F.struct(F.col(key).isNull().alias("n"), F.col(key).alias("k"), absent.alias("t"), digest.alias("d")), radius)
    kept = rows.select(F.col("component").alias("c")).distinct().select("c.k", "c.t", "c.d")
    mine, lost, text_key = (free_name(docs, c) for c in ("llm_key", "llm_absent", "llm_digest"))
    wide = docs.withColumns({mine: F.col(key), lost: absent, text_key: digest}).dropDuplicates([mine, lost, text_key])
    on = wide[mine].eqNullSafe(kept["k"]) & (wide[lost] == kept["t"]) & (wide[text_key] == kept["d"])
    return wide.join(kept, on, "left_semi").select(*docs.columns)
