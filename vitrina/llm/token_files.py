"""Token-id files: documents in ascending key order, entropy-coded in blocks that decode on their own.

The container is Parquet, so that a lost executor's files are replaced as a whole and any store Spark knows can hold them; a row is
one block of the format in ``rans``. A block holds whole documents, about ``BLOCK_TOKENS`` ids. A folder needs nothing beside it: the
blocks lie in ``blocks``, the shared frequencies with their number in ``table`` and the tokenizer's digest with the end id in ``settings``.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from vitrina.llm.base import small_batches, stored
from vitrina.llm.rans import Block, Table, encode
from vitrina.llm.tokens import binaries, forget, id_width, longs, token_table

BLOCK_TOKENS = 1 << 20
# Ids of one range partition; sets how many there are, from the total.
PART_TOKENS = 1 << 25
SETTINGS = "table long, size long, end_id long, tokenizer_sha256 string"


def frequencies(tokens: DataFrame, kind: str) -> Table:
    """The shared table from the counts of all ids of all documents; as long as the vocabulary, so it may reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        counts = np.zeros(0, np.int64)
        for batch in batches:
            more = np.bincount(np.frombuffer(b"".join(batch["ids"].to_pylist()), kind))
            if len(more) > len(counts):
                counts, more = more.astype(np.int64), counts
            counts[: len(more)] += more
        found = np.flatnonzero(counts)
        yield pa.record_batch([longs(found), longs(counts[found])], ["id", "n"])

    rows = tokens.select("ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(int(rows["id"].max()) + 1 if len(rows) else 0, np.int64)
    counts[rows["id"].to_numpy(int)] = rows["n"].to_numpy(int)
    return Table.of(counts)


def write(docs: DataFrame, folder: str, tokenizer: str, end_id: int, key: str = "doc_id", block_tokens: int = BLOCK_TOKENS) -> Table:
    """Tokenize every whole text and write the blocks to ``folder`` in ascending ``key`` order, nulls first, ties by ids.

    A null or empty text has the end id only; repeated rows are written as often as they occur; an empty table gives no block.
    ``key`` is a long. Returns the shared table, which is written as well.
    """
    spark = docs.sparkSession
    kind = id_width(tokenizer)
    tokens = stored(token_table(docs, tokenizer, end_id, key), "tokens")
    table = frequencies(tokens, kind)
    total = tokens.agg(F.coalesce(F.sum("n_tokens"), F.lit(0))).first()[0]
    parts = max(spark.sparkContext.defaultParallelism, -(-total // PART_TOKENS))
    shared = spark.sparkContext.broadcast(table.freq)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        own, part, ahead = Table(shared.value), TaskContext.get().partitionId(), 0
        keys: list = []
        held: list[bytes] = []
        size = 0

        def flush() -> pa.RecordBatch:
            nonlocal keys, held, size, ahead
            width = np.dtype(kind).itemsize
            ids = np.frombuffer(b"".join(held), kind)
            absent = np.array([k is None for k in keys])
            data = encode(ids, own, np.array([k or 0 for k in keys], np.int64), np.array([len(h) // width for h in held]), absent)
            row = pa.record_batch(
                [longs([part]).cast(pa.int32()), longs([ahead]), longs([len(ids)]), binaries([data])],
                ["part", "ahead", "n_tokens", "data"])
            keys, held, size, ahead = [], [], 0, ahead + len(ids)
            return row

        for batch in batches:
            for k, ids, n in zip(*(batch[c].to_pylist() for c in ("doc_id", "ids", "n_tokens"))):
                keys.append(k)
                held.append(ids)
                size += n
                if size >= block_tokens:
                    yield flush()
        if keys:
            yield flush()

    ordered = tokens.repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", "ids")
    ordered.mapInArrow(run, "part int, ahead long, n_tokens long, data binary").write.mode("overwrite").parquet(f"{folder}/blocks")
    used = np.flatnonzero(table.freq)
    write_small(spark, pd.DataFrame({"id": used, "freq": table.freq[used]}), "id long, freq long", f"{folder}/table")
    with open(tokenizer, "rb") as file:
        digest = hashlib.file_digest(file, "sha256").hexdigest()
    settings = pd.DataFrame({"table": [table.number], "size": [len(table.freq)], "end_id": [end_id], "tokenizer_sha256": [digest]})
    write_small(spark, settings, SETTINGS, f"{folder}/settings")
    return table


def write_small(spark: SparkSession, rows: pd.DataFrame, schema: str, path: str) -> None:
    """A table no longer than the vocabulary, as one file."""
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("overwrite").parquet(path)


def read_table(spark: SparkSession, folder: str) -> Table:
    """The frequencies written beside the blocks, checked against their number."""
    settings = spark.read.schema(SETTINGS).parquet(f"{folder}/settings").first()
    rows = spark.read.schema("id long, freq long").parquet(f"{folder}/table").toPandas()
    freq = np.zeros(settings["size"], np.int64)
    freq[rows["id"].to_numpy(int)] = rows["freq"].to_numpy(int)
    table = Table(freq)
    if table.number != settings["table"]:
        raise ValueError("the frequency table is damaged")
    return table


def read(spark: SparkSession, folder: str) -> DataFrame:
    """``(doc_id, start, n_tokens, ids_crc32)`` of every document, decoded from the files: blocks in parallel, no order needed.

    ``start`` counts the ids of all documents before; the checksum is over the ids as little-endian 32-bit integers.
    """
    small_batches(spark)
    table = read_table(spark, folder)
    blocks = spark.read.schema("part int, ahead long, n_tokens long, data binary").parquet(f"{folder}/blocks")
    sizes = sorted(map(tuple, blocks.groupBy("part").agg(F.sum("n_tokens")).collect()))  # one row for each partition
    starts, total = [], 0
    for part, n in sizes:
        starts.append((part, total))
        total += n
    offsets = spark.createDataFrame(starts, "part int, base long")
    shared = spark.sparkContext.broadcast(table.freq)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Table(shared.value)
        for batch in batches:
            for data, start in zip(batch["data"], batch["start"].to_pylist()):
                block = Block.read(data.as_py(), own)
                raw = memoryview(block.ids().astype("<u4").tobytes())
                ends = np.cumsum(block.sizes.astype(np.int64))
                begins = ends - block.sizes
                crcs = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(begins.tolist(), ends.tolist())]
                yield pa.record_batch([
                    pa.array(block.docs, mask=block.absent), pa.array(start + begins), pa.array(block.sizes.astype(np.int64)),
                    pa.array(crcs, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    rows = blocks.join(F.broadcast(offsets), "part").select("data", (F.col("base") + F.col("ahead")).alias("start"))
    return rows.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
