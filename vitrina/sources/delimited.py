"""CSV at the edge: dialect detection, quarantine of unreadable files, table sinks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StringType, StructField, StructType

from vitrina.schemas import RAW_OFFERS
from vitrina.session import BROADCAST_ROWS, cut_lineage

CORRUPT = "corrupt_record"

# Fixed values: (separator, encoding) in the order of trial.
DIALECTS = ((",", "ISO-8859-1"), (";", "UTF-8"))

# Plain and compressed files.
PATTERN = "*.csv{,.gz}"


def file_dialects(spark: SparkSession, folder: str, columns: int = len(RAW_OFFERS), pattern: str = PATTERN) -> DataFrame:
    """``(file, separator, error)``: the first dialect whose separator splits the header as expected.

    The listing reads no content; the header is the first line of each file's first block.
    """
    path = F.col("_metadata.file_path").alias("file")
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder).select(path)
    lines = spark.read.option("pathGlobFilter", pattern).text(folder).select(
        path, F.col("_metadata.file_block_start").alias("_start"), F.monotonically_increasing_id().alias("_line"), "value")
    headers = lines.filter("_start = 0").groupBy("file").agg(F.min_by("value", "_line").alias("_header"))
    fits = [F.when(F.size(F.split("_header", sep)) == columns, F.lit(sep)) for sep, _ in DIALECTS]
    found = files.join(headers, "file", "left").withColumn("separator", F.coalesce(*fits))
    message = f"no dialect splits the header into {columns} columns"
    return found.select("file", "separator", F.when(F.col("separator").isNull(), message).alias("error"))


def read_offers_csv(spark: SparkSession, folder: str, schema: StructType = RAW_OFFERS, pattern: str = PATTERN) -> tuple[DataFrame, DataFrame]:
    """Rows of all readable files with their file name, and the report of unreadable files.

    The folder is scanned once per dialect; each scan keeps the files of its dialect by a join on
    the file name, so no file list passes through the driver. A row with too few or too many fields has its whole
    text in ``corrupt_record``, which is NULL for all others.
    """
    whole = StructType([*schema.fields, StructField(CORRUPT, StringType())])
    # The headers are read once, and the names of the files go to the rows, so that no row is shuffled for its file.
    dialects = cut_lineage(file_dialects(spark, folder, len(schema), pattern))
    few = dialects.count() <= BROADCAST_ROWS
    parts = []
    for sep, encoding in DIALECTS:
        rows = (
            spark.read.schema(whole).option("columnNameOfCorruptRecord", CORRUPT)
            .option("header", True).option("sep", sep).option("encoding", encoding)
            .option("multiLine", True).option("escape", '"').option("enforceSchema", True).option("mode", "PERMISSIVE")
            .option("pathGlobFilter", pattern).csv(folder).withColumn("file", F.col("_metadata.file_path"))
        )
        fitting = dialects.filter(F.col("separator") == sep)
        parts.append(rows.join(F.broadcast(fitting) if few else fitting, "file", "left_semi"))
    return parts[0].unionByName(parts[1]), dialects.filter("error IS NOT NULL").select("file", "error")


def split_by_width(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of ``read_offers_csv`` with the right number of fields, and the others, with what could be read and their text, for the quarantine."""
    return rows.filter(F.col(CORRUPT).isNull()).drop(CORRUPT), rows.filter(F.col(CORRUPT).isNotNull())


def read_delimited_strict(spark: SparkSession, path: str, schema: StructType, sep: str = ",") -> DataFrame:
    """CSV with minimal quoting and backslash escapes."""
    return spark.read.schema(schema).option("header", True).option("sep", sep).option("quote", '"').option("escape", "\\").csv(path)


def strip_headers(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.strip() for c in df.columns])


def write_table(df: DataFrame, path: str, fmt: str = "parquet", partition_by: Sequence[str] = ()) -> None:
    """Overwrite a table as Parquet, or as CSV with a header."""
    writer = df.write.mode("overwrite").partitionBy(*partition_by)
    writer.csv(path, header=True) if fmt == "csv" else writer.format(fmt).save(path)


def dated_batch_sink(df: DataFrame, path: str) -> None:
    """One folder per capture date and category; a rerun replaces the folders it writes only."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("captured_on", "category").parquet(path)


def quarantine_sink(bad: DataFrame, path: str) -> bool:
    """Write the quarantined rows when there are any."""
    if bad.isEmpty():
        return False
    write_table(bad, path)
    return True
