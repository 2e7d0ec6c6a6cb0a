"""Shards in random order by a two-pass external shuffle, in DataFrame functions alone.

First pass: every row falls into one of the buckets by a seeded hash of its place (file and row in it), so that equal rows and rows of
one key part too; there are as many buckets as it takes for each to fit in memory. Second pass: each bucket's rows are moved by a
Fisher-Yates shuffle of their numbers, and written behind the rows of the buckets before it. The order is cut into shards whose
counts differ by one at most.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window, functions as F

from vitrina.llm.base import free_name, stored

SHARDS = 8
SEED = 42
# Bytes of a bucket, and what a row takes besides its text; together they bound the rows of a bucket, too.
BUCKET_BYTES = 64 << 20
ROW_BYTES = 256


def text_size(text: Column) -> Column:
    """UTF-8 bytes of a text, none for null, plus one."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1


def _placed(docs: DataFrame) -> tuple[DataFrame, Column]:
    """Rows of files, and a hash of the place of each, the same on every read; other rows are written to files first."""

    def place(df: DataFrame) -> Column:
        at = df.metadataColumn("_metadata")
        hashed = F.xxhash64(F.lit(SEED), at["file_name"], at["row_index"])
        df.select(hashed)  # resolves the names or raises
        return hashed

    try:
        return docs, place(docs)
    except AnalysisException:
        rows = stored(docs, "placed")
        return rows, place(rows)


def write_shards(docs: DataFrame, folder: str, shards: int = SHARDS, text: str = "text") -> DataFrame:
    """Write the rows to ``folder/shard=.../`` in shuffled order and return them as they are read back, with ``shard`` and ``slot``.

    ``shard`` runs from 0, ``slot`` numbers a shard's rows from 0 without gaps; underscores are added to the two names if ``docs`` has
    such columns. Every row takes a slot of its own, repeated rows and rows with null in any column included; null texts count as
    empty. An empty table gives no rows. The order depends on seed, files and the place of rows in them, not on the content.
    """
    spark = docs.sparkSession
    shard, slot = free_name(docs, "shard"), free_name(docs, "slot")
    hashed, bucket, place = (free_name(docs, c) for c in ("shuffle_hash", "shuffle_bucket", "shuffle_place"))
    start, order = free_name(docs, "shuffle_start"), free_name(docs, "shuffle_order")
    source, place_hash = _placed(docs)
    rows, weight = source.agg(F.count(F.lit(1)), F.coalesce(F.sum(text_size(F.col(text)) + ROW_BYTES), F.lit(0))).first()
    buckets = max(1, -(-weight // BUCKET_BYTES))

    # first pass: where each bucket begins, and the shuffled numbers of its rows
    sizes = source.select(F.pmod(place_hash, F.lit(buckets)).alias(bucket)).groupBy(bucket).agg(F.count(F.lit(1)).alias("n"))
    sizes = stored(sizes, "bucket-sizes")  # one row for each bucket
    before = Window.orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    begun = stored(sizes.withColumn(start, F.coalesce(F.sum("n").over(before), F.lit(0))), "bucket-starts")
    parts = max(1, min(buckets, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    numbers = F.shuffle(F.sequence(F.lit(0), (F.col("n") - 1).cast("int")), SEED)
    moves = stored(begun.repartitionByRange(parts, bucket).sortWithinPartitions(bucket).select(bucket, start, numbers.alias(order)), "bucket-orders")

    # second pass: the rows of a bucket meet, take their new numbers and are written
    within = Window.partitionBy(bucket).orderBy(hashed)
    scattered = source.withColumn(hashed, place_hash).withColumn(bucket, F.pmod(F.col(hashed), F.lit(buckets)))
    moved = scattered.withColumn(place, F.row_number().over(within) - 1).join(moves, bucket)
    moved = moved.withColumn(place, F.col(start) + F.get(F.col(order), F.col(place)))
    moved = moved.withColumn(shard, F.expr(f"cast(`{place}` * {shards} div {max(rows, 1)} as int)"))
    moved = moved.withColumn(slot, F.expr(f"`{place}` - (cast(`{shard}` as bigint) * {rows} + {shards - 1}) div {shards}"))
    kept = moved.select(*docs.columns, slot, shard)
    kept.sortWithinPartitions(shard, slot).write.partitionBy(shard).option("compression", "zstd").parquet(folder)
    return spark.read.schema(kept.schema).parquet(folder)
