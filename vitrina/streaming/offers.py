"""Offers as a stream: new files are taken up once, cleaned, deduplicated and counted."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import LongType, StructField, StructType

from vitrina.functions.dates import parse_date
from vitrina.functions.money import PRICES, parse_price_columns, parse_rating, row_max_fill
from vitrina.functions.text import canonical_category
from vitrina.operators.quality import split_valid_rows
from vitrina.schemas import RAW_OFFER_COLUMNS
from vitrina.session import BROADCAST_ROWS


def stream_files(spark: SparkSession, folder: str, schema: StructType, fmt: str = "parquet", pattern: str | None = None,
                 files_per_batch: int | None = None, **options: str) -> DataFrame:
    """Stream of the files in a folder; each is read once per checkpoint."""
    reader = spark.readStream.schema(schema).format(fmt).options(**options)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.load(folder)


def clean_raw(rows: DataFrame) -> DataFrame:
    """Row-wise cleaning of valid raw offers; group-wise steps are left to the batch side."""
    typed = parse_price_columns(rows.withColumns({
        "captured_on": parse_date(F.col("captured_on")),
        "category": canonical_category(F.col("category")),
        "rating_text": F.col("rating"),
        "rating": parse_rating(F.col("rating")),
    }), PRICES)
    return row_max_fill(typed).drop("image")


def stream_clean(offers: DataFrame, clean_path: str, quarantine_path: str, checkpoint: str) -> StreamingQuery:
    """Write valid rows cleaned and the rest as they are, batch by batch.

    Each batch writes below its own number, so a batch repeated after a failure replaces itself.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        valid, bad = split_valid_rows(batch, RAW_OFFER_COLUMNS)
        clean_raw(valid).write.mode("overwrite").parquet(f"{clean_path}/batch={number}")
        bad.write.mode("overwrite").parquet(f"{quarantine_path}/batch={number}")
        batch.unpersist()

    return offers.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_dedupe(rows: DataFrame, keys: Sequence[str], time: str, delay: str = "1 day") -> DataFrame:
    """The first row of each key; a repeat within the delay is dropped and a key older than that is forgotten, so the state stays small."""
    return rows.withWatermark(time, delay).dropDuplicatesWithinWatermark(list(keys))


def stream_once(rows: DataFrame, keys: Sequence[str], order: Sequence[str], path: str, checkpoint: str) -> StreamingQuery:
    """Write the first row of each key by ``order`` below the number of its batch, and never that key again, in this run or a later one.

    What was written is the memory: each batch leaves out the keys of all batches before it, however old, so no state is held and a
    batch repeated after a failure replaces itself. Null is a key like any other; ties fall to the smallest of the other columns.
    A batch of few keys is broadcast to the written ones, which are then read without a shuffle and for their keys alone.
    """
    rest = [c for c in rows.columns if c not in (*keys, *order)]
    schema = StructType([*rows.schema.fields, StructField("batch", LongType())])

    def write(batch: DataFrame, number: int) -> None:
        first = batch.groupBy(*keys).agg(F.min(F.struct(*order, *rest)).alias("_first")).select(*keys, "_first.*").persist()
        fresh = first
        if number:
            asked = first.select(*[F.col(k).alias(f"_{i}") for i, k in enumerate(keys)])
            same = lambda left, right: [left[k].eqNullSafe(right[f"_{i}"]) for i, k in enumerate(keys)]
            done = batch.sparkSession.read.schema(schema).parquet(path).filter(F.col("batch") < number).select(*keys)
            side = F.broadcast(asked) if first.count() <= BROADCAST_ROWS else asked
            seen = done.join(side, same(done, side), "left_semi").select(*[F.col(k).alias(f"_{i}") for i, k in enumerate(keys)])
            fresh = first.join(seen, same(first, seen), "left_anti")
        fresh.select(*rows.columns).write.mode("overwrite").parquet(f"{path}/batch={number}")
        first.unpersist()

    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_counts(rows: DataFrame, keys: Sequence[str], time: str, delay: str = "1 day", width: str = "1 day") -> DataFrame:
    """Rows per key and day; late rows within the delay still count."""
    return rows.withWatermark(time, delay).groupBy(F.window(time, width).alias("window"), *keys).agg(F.count(F.lit(1)).alias("n"))


def run_to_table(rows: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Process everything there is into a Parquet table and stop."""
    rows.writeStream.outputMode(mode).format("parquet").option("path", path).option(
        "checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def run_to_updates(rows: DataFrame, path: str, checkpoint: str) -> None:
    """Write what changed in each batch below the batch's number, so open groups are there too; a repeated batch replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    rows.writeStream.outputMode("update").foreachBatch(write).option(
        "checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def latest(updates: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The last update of each key of a folder that ``run_to_updates`` wrote."""
    values = [c for c in updates.columns if c not in (*keys, "batch")]
    last = F.max_by(F.struct(*values), "batch").alias("_last")
    return updates.groupBy(*keys).agg(last).select(*keys, "_last.*")
