"""Lexical retrieval packing: seed documents fill their windows with unused neighbours from a sharded BM25 index.

Documents are laid out by the smallest hash of their three-token shingles, so that texts with shared passages come to one shard,
and hot hashes spread over shards by the key. A shard is an inverted index over the whole texts of a bounded number of documents; its
idf and mean length are those of all documents. Windows are cut where they are full, and the rest of a cut document stays available.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from vitrina.llm.base import small_batches, stored
from vitrina.llm.tokens import binaries, encoder, forget, id_width, longs

WINDOW = 4096
# A shard ends with the document that reaches either of these.
SHARD_TOKENS = 1 << 21
SHARD_DOCS = 1 << 13
# Ids of one range partition; sets how many there are, from the total.
PART_TOKENS = 1 << 25
K1, B = 1.2, 0.75


def shingle_key(ids: np.ndarray) -> int:
    """Smallest hash of three ids in a row, as a signed 64-bit integer; shorter documents count as one shingle."""
    a = ids.astype(np.uint64)
    if len(a) < 3:
        a = np.concatenate((a, np.zeros(3 - len(a), np.uint64)))
    h = a[:-2] * np.uint64(0x9E3779B97F4A7C15) + a[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + a[2:] * np.uint64(0x165667B19E3779F9)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return int((h ^ (h >> np.uint64(32))).min().view(np.int64))


def term_counts(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different ids of a document and how often each occurs."""
    s = np.sort(ids, kind="stable")
    first = np.flatnonzero(np.concatenate(([True], s[1:] != s[:-1]))) if len(s) else np.zeros(0, int)
    return s[first], np.diff(np.append(first, len(s)))


class Index:
    """BM25 over the documents of a shard: the postings of each term, one after another."""

    def __init__(self, docs: list[np.ndarray], idf: np.ndarray, mean_length: float):
        pairs = [term_counts(d) for d in docs]
        self.spans = np.concatenate(([0], np.cumsum([len(t) for t, _ in pairs])))
        terms = np.concatenate([t for t, _ in pairs])
        counts = np.concatenate([c for _, c in pairs]).astype(np.float32)
        doc = np.repeat(np.arange(len(docs), dtype=np.int32), np.diff(self.spans))
        norm = K1 * (1 - B + B * np.array([len(d) for d in docs], np.float32) / mean_length)
        weights = idf[terms] * counts * (K1 + 1) / (counts + norm[doc])
        self.terms = terms  # by document
        order = np.argsort(terms, kind="stable")
        # as wide as the sums take them, which saves a copy for each seed
        self.doc, self.by_term = doc[order].astype(np.intp), weights[order].astype(np.float64)
        self.starts = np.searchsorted(terms[order], np.arange(len(idf) + 1))

    def neighbours(self, seed: int, free: np.ndarray) -> np.ndarray:
        """Free documents that share a term with the seed, best first by all of its terms, ties by place."""
        own = self.terms[self.spans[seed] : self.spans[seed + 1]].astype(np.intp)
        posts = [slice(a, b) for a, b in zip(self.starts[own].tolist(), self.starts[own + 1].tolist())]
        score = np.bincount(
            np.concatenate([self.doc[p] for p in posts]), np.concatenate([self.by_term[p] for p in posts]), len(free))
        found = np.flatnonzero((score > 0) & free)
        return found[np.argsort(-score[found], kind="stable")]


def pack_shard(docs: list[np.ndarray], idf: np.ndarray, mean_length: float, window: int = WINDOW):
    """Sequences of pieces ``(document, start, length)``: full ones, and at the end some whose length is a power of two."""
    sequences: list[list[tuple[int, int, int]]] = []
    size = np.array([len(d) for d in docs])
    start = size // window * window
    for d in np.flatnonzero(start):  # what fills windows on its own
        sequences += [[(int(d), s, window)] for s in range(0, int(start[d]), window)]
    left = size - start
    index = Index(docs, idf, mean_length)
    current: list[tuple[int, int, int]] = []
    space, at = window, 0

    def place(d: int) -> None:
        nonlocal space
        take = int(min(space, left[d]))
        current.append((int(d), int(start[d]), take))
        start[d] += take
        left[d] -= take
        space -= take

    while at < len(docs):
        if not left[at]:
            at += 1
            continue
        seed = at  # of a new window, or the next in order where the neighbours did not suffice
        place(seed)
        if space:
            for d in index.neighbours(seed, left > 0):
                place(d)
                if not space:
                    break
        if not space:
            sequences.append(current)
            current, space = [], window
    rest = sum(n for _, _, n in current)
    for bit in range(rest.bit_length() - 1, -1, -1):
        room, cut = rest & 1 << bit, []
        while room:
            d, s, n = current[0]
            take = min(n, room)
            cut.append((d, s, take))
            room -= take
            current[0:1] = [(d, s + take, n - take)] if take < n else []
        sequences += [cut] if cut else []
    return sequences


def document_frequencies(tokens: DataFrame, kind: str) -> np.ndarray:
    """In how many documents each id occurs; as long as the vocabulary, so it may reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        df = np.zeros(1 << 16, np.int64)
        for batch in batches:
            terms = np.concatenate([term_counts(np.frombuffer(i.as_buffer(), kind))[0] for i in batch["ids"]] or [np.zeros(0, kind)])
            more = np.bincount(terms)
            if len(more) > len(df):
                df, more = more.astype(np.int64), df
            df[: len(more)] += more
        found = np.flatnonzero(df)
        yield pa.record_batch([pa.array(found), pa.array(df[found])], ["id", "n"])

    rows = tokens.select("ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toPandas()
    df = np.zeros(int(rows["id"].max()) + 1 if len(rows) else 1, np.int64)
    df[rows["id"].to_numpy(int)] = rows["n"].to_numpy(int)
    return df


def laid_out(docs: DataFrame, tokenizer: str, end_id: int, key: str) -> DataFrame:
    """``(doc_id, ids, n_tokens, near)`` of every row, tokenized as a whole with the end id last."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(key).alias("doc_id"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        end = np.array([end_id], enc.dtype).tobytes()
        for batch in batches:
            ids = [enc.encode(t) + end for t in batch["text"].to_pylist()]
            arrays = [np.frombuffer(i, enc.dtype) for i in ids]
            yield pa.record_batch(
                [batch["doc_id"], binaries(ids), longs([len(a) for a in arrays]), longs([shingle_key(a) for a in arrays])],
                ["doc_id", "ids", "n_tokens", "near"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, ids binary, n_tokens long, near long")


def pack(docs: DataFrame, tokenizer: str, end_id: int, key: str = "doc_id", window: int = WINDOW) -> DataFrame:
    """Pieces ``(doc_id, start, length, ids, doc_tokens, sequence_id, offset)`` of all documents, ids as little-endian uint32.

    Every id of every row lies in one piece; sequences have ``window`` ids (a power of two) or, at the end of a shard, a smaller power
    of two, so none needs padding. A null or empty text has the end id only; repeated rows are packed each on its own; an empty table
    gives no rows; other columns play no part.
    """
    spark = docs.sparkSession
    kind = id_width(tokenizer)
    tokens = stored(laid_out(docs, tokenizer, end_id, key), "tokens")
    total, n = tokens.agg(F.coalesce(F.sum("n_tokens"), F.lit(0)), F.count("*")).first()
    df = document_frequencies(tokens, kind)
    idf = np.log1p((n - df + 0.5) / (df + 0.5)).astype(np.float32)
    shared, mean_length = spark.sparkContext.broadcast(idf), max(1.0, total / max(1, n))
    parts = max(spark.sparkContext.defaultParallelism, -(-total // PART_TOKENS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        keys: list = []
        held: list[np.ndarray] = []
        size, sequence = 0, TaskContext.get().partitionId() << 40

        def flush() -> pa.RecordBatch:
            nonlocal keys, held, size, sequence
            out: list[tuple] = []
            for pieces in pack_shard(held, shared.value, mean_length, window):
                offset = 0
                for d, start, length in pieces:
                    ids = held[d][start : start + length].astype("<u4").tobytes()
                    out.append((keys[d], start, length, ids, len(held[d]), sequence, offset))
                    offset += length
                sequence += 1
            columns = list(zip(*out))
            keys, held, size = [], [], 0
            kinds = [key_type, *[pa.int64()] * 2, pa.binary(), *[pa.int64()] * 3]
            return pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds)],
                                   ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])

        key_type = None
        for batch in batches:
            key_type = batch["doc_id"].type
            for k, ids in zip(batch["doc_id"].to_pylist(), batch["ids"].to_pylist()):
                keys.append(k)
                held.append(np.frombuffer(ids, kind))
                size += len(held[-1])
                if size >= SHARD_TOKENS or len(keys) >= SHARD_DOCS:
                    yield flush()
        if keys:
            yield flush()

    rows = tokens.withColumn("salt", F.xxhash64("doc_id", "n_tokens"))
    rows = rows.repartitionByRange(parts, "near", "salt").sortWithinPartitions("near", "salt", "ids").select("doc_id", "ids")
    id_type = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(
        run, f"doc_id {id_type}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")
