"""Ranked lexical search through hashed max-sketches.

Each document folds into a sketch: its terms are hashed to coordinates, and a coordinate keeps the largest count among its terms. A
term's impact grows with its count in the document, so the count at a term's coordinate gives an upper bound of its impact, and the sum
over a query's terms one of the score. In every task the documents of a batch are taken by descending bound and scored exactly, until
no bound reaches the query's k-th best score; each task's k best meet in one ranking. Queries travel in blocks of bounded size.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from heapq import heappush, heapreplace
from typing import NamedTuple
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from vitrina.llm.base import small_batches, stored

# Coordinates of a sketch for each different term of its document, rounded up to a power of two; more make tighter bounds.
SPARSITY = 16
LEAST_WIDTH = 64
# The largest count that a coordinate tells; it stands for itself and all above.
MOST = 255
# A block of queries: about so many rows and so many bytes of text.
BLOCK_ROWS = 1024
BLOCK_BYTES = 4 << 20
# Cells (term of a query, document) that are looked up at once.
CELLS = 4_000_000
# ASCII letters and digits, A-Z lower-cased, and all bytes of other characters stay; the rest parts terms.
_FOLD = bytes(ord(chr(b).lower()) if b > 127 or chr(b).isalnum() else 32 for b in range(128)) + bytes(range(128, 256))


def terms_of(text: bytes | None) -> list[bytes]:
    """Terms of a UTF-8 text in order; none for null."""
    return text.translate(_FOLD).split() if text else []


def sketch(counts: Counter) -> bytes:
    """Coordinatewise largest count, at most ``MOST``, over a power of two of coordinates."""
    width = LEAST_WIDTH
    while width < SPARSITY * len(counts):
        width *= 2
    at = np.fromiter(map(crc32, counts), np.uint32, len(counts)) & np.uint32(width - 1)
    many = np.minimum(np.fromiter(counts.values(), np.int64, len(counts)), MOST)
    order = np.argsort(many, kind="stable")
    out = np.zeros(width, np.uint8)
    out[at[order]] = many[order]  # of several values for one place, the last stays
    return out.tobytes()


def build_index(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, n, sketch, terms, counts)`` of every document with a term, as a written table: number of terms, sketch, different terms
    parted by blanks, and how often each occurs. Repeated rows are documents of their own; other columns play no part.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(key).alias("key"), F.encode(text, "utf-8").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [Counter(terms_of(t.as_py())) for t in batch["text"]]
            some = [i for i, c in enumerate(found) if c]
            found = [found[i] for i in some]
            yield pa.record_batch([
                batch["key"].take(pa.array(some, pa.int64())), pa.array([c.total() for c in found], pa.int64()),
                pa.array([sketch(c) for c in found], pa.binary()), pa.array([b" ".join(c) for c in found], pa.binary()),
                pa.array([np.fromiter(c.values(), "<u4", len(c)).tobytes() for c in found], pa.binary()),
            ], ["key", "n", "sketch", "terms", "counts"])

    kind = rows.schema["key"].dataType.simpleString()
    return stored(rows.mapInArrow(run, f"key {kind}, n long, sketch binary, terms binary, counts binary"), "sketches")


class Block(NamedTuple):
    """Queries that are asked together: number of the first, ids, the vocabulary of all, and each one's terms with their counts."""

    first: int
    ids: list
    terms: list[bytes]
    of: list[dict[bytes, int]]

    def lists(self, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Queries of each term, one term after the other, with weight times count; and where each term's queries begin, and end."""
        place = {t: i for i, t in enumerate(self.terms)}
        term = np.array([place[t] for q in self.of for t in q], np.int64)
        query = np.repeat(np.arange(len(self.of)), [len(q) for q in self.of])
        times = np.array([c for q in self.of for c in q.values()], np.int64)
        order = np.argsort(term, kind="stable")
        starts = np.searchsorted(term[order], np.arange(len(self.terms) + 1))
        return query[order], (weights[term] * times)[order], starts


def upper_bounds(tf: np.ndarray, norms: np.ndarray, lists: tuple[np.ndarray, np.ndarray, np.ndarray], queries: int) -> np.ndarray:
    """No less than the score of each query (row) on each document (column), from the counts at the terms' coordinates."""
    query, factor, starts = lists
    term, doc = np.nonzero(tf)
    many = tf[term, doc].astype(np.int64)
    impact = np.where(many == MOST, 1_000_000, 1_000_000_000 * many // (1000 * many + 12 * norms[doc]))
    each = (starts[1:] - starts[:-1])[term]
    at = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each - starts[term], each)
    cell = query[at] * tf.shape[1] + np.repeat(doc, each)
    sums = np.bincount(cell, factor[at] * np.repeat(impact, each).astype(float), queries * tf.shape[1])
    return sums.reshape(queries, -1) * (1 + 1e-9)  # above what rounding takes off sums of many terms


def query_blocks(queries: DataFrame, key: str, text: str) -> Iterator[Block]:
    """The different ``(key, text)`` rows with a term, in blocks that a hash deals out; one block is on the driver at a time."""
    rows = stored(queries.select(F.col(key).alias("key"), F.encode(text, "utf-8").alias("text")).distinct(), "queries")
    n, size = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    blocks, first = max(1, -(-n // BLOCK_ROWS), -(-size // BLOCK_BYTES)), 0
    for b in range(blocks):
        got = rows.filter(F.pmod(F.xxhash64("key", "text"), F.lit(blocks)) == b).collect()
        found = [(r.key, Counter(terms_of(r.text and bytes(r.text)))) for r in got]
        found = [(i, dict(c)) for i, c in found if c]
        if found:
            yield Block(first, [i for i, _ in found], sorted(set().union(*(c for _, c in found))), [c for _, c in found])
            first += len(found)


def term_weights(index: DataFrame, terms: list[bytes], docs: int) -> np.ndarray:
    """Integer weight of each term from the number of documents that hold it."""
    sent = index.sparkSession.sparkContext.broadcast(frozenset(terms))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()
        for batch in batches:
            for row in batch["terms"]:
                found.update(sent.value.intersection(row.as_py().split()))
        yield pa.record_batch([pa.array(list(found), pa.binary()), pa.array(list(found.values()), pa.int64())], ["term", "df"])

    counted = index.select("terms").mapInArrow(run, "term binary, df long").groupBy("term").agg(F.sum("df").alias("df"))
    weight = F.floor(1000 * F.log((2.0 * docs + 2) / (2.0 * F.col("df") + 1))).cast("long")
    known = {bytes(r.term): r.w for r in counted.select("term", weight.alias("w")).collect()}  # of the block's terms
    return np.array([known.get(t, 0) for t in terms], np.int64)


def top_k(index: DataFrame, queries: DataFrame, k: int = 20, key: str = "item_id", text: str = "text") -> DataFrame:
    """``(query, rank, key, score)``: for each query the ``k`` documents of highest score above 0, equal scores by ascending key.

    Scores are integers, as the module's ``exact_score`` has them. Queries without a term, and documents without one, have no rows;
    equal queries are asked once; null keys come last among equal scores, and repeated documents take a rank each. Empty tables
    give no rows.
    """
    spark = index.sparkSession
    docs, length = index.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    kinds = queries.schema[key].dataType.simpleString(), index.schema["key"].dataType.simpleString()
    found = spark.createDataFrame([], f"query {kinds[0]}, number long, key {kinds[1]}, score long")
    for block in query_blocks(queries, key, text) if docs else ():
        found = found.unionByName(_searched(index, block, k, docs, length, kinds))
    place = F.row_number().over(Window.partitionBy("query", "number").orderBy(F.desc("score"), F.col("key").asc_nulls_last()))
    ranked = found.withColumn("rank", place).filter(F.col("rank") <= k)
    return ranked.select("query", F.col("rank").cast("int").alias("rank"), "key", "score")


def norm(n: int, docs: int, length: int) -> int:
    """What a document's length adds to the denominator of its impacts, in hundredths."""
    return 75 + 25 * n * docs // length


def exact_score(query: dict[bytes, int], weight: dict[bytes, int], counts: dict[bytes, int], m: int) -> int:
    """Sum over the query's terms, repeats included, of weight times impact."""
    return sum(times * weight[t] * (1_000_000_000 * tf // (1000 * tf + 12 * m)) for t, times in query.items() if (tf := counts.get(t)))


def _searched(index: DataFrame, block: Block, k: int, docs: int, length: int, kinds: tuple[str, str]) -> DataFrame:
    """``(query, number, key, score)``: each task's ``k`` best documents of each query of the block."""
    weights = term_weights(index, block.terms, docs)
    sent = index.sparkSession.sparkContext.broadcast((block, weights))
    small_batches(index.sparkSession, 2048)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, weights = sent.value
        lists = block.lists(weights)
        hashed = np.array([crc32(t) for t in block.terms], np.uint32)
        weight = dict(zip(block.terms, weights.tolist()))
        best: list[list[tuple]] = [[] for _ in block.ids]  # heaps: the k-th best first
        least = np.ones(len(block.ids), np.int64)  # what a bound must reach
        for batch in batches:
            keys = batch["key"].to_pylist()
            norms = np.array([norm(n, docs, length) for n in batch["n"].to_pylist()], np.int64)
            sketches = [s.as_buffer() for s in batch["sketch"]]
            widths = np.array([s.size for s in sketches])
            terms, counts = batch["terms"], batch["counts"]
            parsed: dict[int, dict[bytes, int]] = {}

            def counts_of(row: int) -> dict[bytes, int]:
                if row not in parsed:
                    times = np.frombuffer(counts[row].as_buffer(), "<u4").tolist()
                    parsed[row] = {t: n for t, n in zip(terms[row].as_py().split(), times) if t in weight}
                return parsed[row]

            bounds = np.zeros((len(best), len(keys)))
            for width in np.unique(widths):
                alike = np.flatnonzero(widths == width)
                at = (hashed & np.uint32(width - 1)).astype(np.int64)
                step = max(1, CELLS // len(at))
                for rows in (alike[i : i + step] for i in range(0, len(alike), step)):
                    tf = np.stack([np.frombuffer(sketches[r], np.uint8)[at] for r in rows], axis=1)
                    bounds[:, rows] = upper_bounds(tf, norms[rows], lists, len(best))
            for q in np.flatnonzero((bounds >= least[:, None]).any(axis=1)).tolist():
                heap, asked = best[q], block.of[q]
                open_ = np.flatnonzero(bounds[q] >= least[q])
                for row in open_[np.argsort(-bounds[q, open_], kind="stable")].tolist():
                    if bounds[q, row] < least[q]:
                        break
                    score = exact_score(asked, weight, counts_of(row), int(norms[row]))
                    if score < least[q]:
                        continue
                    entry = _Entry(score, keys[row])
                    if len(heap) < k:
                        heappush(heap, entry)
                    elif heap[0] < entry:
                        heapreplace(heap, entry)
                    if len(heap) == k:
                        least[q] = heap[0].score
        rows = [(block.ids[q], block.first + q, e.key, e.score) for q, heap in enumerate(best) for e in heap]
        columns = list(zip(*rows)) or [()] * 4
        yield pa.record_batch(
            [pa.array(c, t) for c, t in zip(columns, types)], ["query", "number", "key", "score"])

    schema = f"query {kinds[0]}, number long, key {kinds[1]}, score long"
    types = _arrow_types(index.sparkSession, schema)
    return stored(index.mapInArrow(run, schema), "found")


def _arrow_types(spark, schema: str) -> list[pa.DataType]:
    return spark.createDataFrame([], schema).toArrow().schema.types


class _Entry:
    """A document found: less than another if its score is smaller or, at equal scores, its key larger or null."""

    __slots__ = ("score", "key")

    def __init__(self, score: int, key) -> None:
        self.score, self.key = score, key

    def __lt__(self, other: _Entry) -> bool:
        if self.score != other.score or self.key == other.key:
            return self.score < other.score
        return self.key is None or (other.key is not None and self.key > other.key)
