"""Helpers shared by the operators of this subpackage: scratch tables, free names, row numbers, connected components."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from vitrina.session import scratch_path

# Rows, and bytes, that a Python worker gets at once; texts may be long.
BATCH_ROWS = 512
BATCH_BYTES = "16m"


def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Keep Arrow batches of whole texts small, so that memory follows the longest texts and not the batch size."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows as a Parquet table in the shared folder; lost executors cost no earlier work and later passes prune columns."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def free_name(df: DataFrame, name: str) -> str:
    """``name`` with as many underscores as it takes to differ from every column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def numbered(df: DataFrame, by: Sequence[str], name: str = "position") -> DataFrame:
    """Rows numbered from 0 in the order of ``by``, nulls first: range partitions sorted each on its own, and an offset for each.

    Rows that are equal in all of ``by`` get their numbers in any order.
    """
    if "_part" in df.columns or "_id" in df.columns:
        raise ValueError("columns _part and _id are reserved")
    n = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows = stored(
        df.repartitionByRange(n, *by).sortWithinPartitions(*by)
        .withColumn("_id", F.monotonically_increasing_id()), "numbered")
    # the upper bits of the id hold the partition, the lower 33 the place in it
    rows = rows.withColumn("_part", F.shiftright("_id", 33))
    sizes = sorted((r[0], r[1]) for r in rows.groupBy("_part").count().collect())  # one row for each partition
    offsets, total = [], 0
    for part, size in sizes:
        offsets.append((part, total))
        total += size
    table = F.broadcast(df.sparkSession.createDataFrame(offsets, "_part long, _offset long"))
    place = F.col("_offset") + F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))
    return rows.join(table, "_part").withColumn(name, place).drop("_part", "_id", "_offset")


def components(edges: DataFrame) -> DataFrame:
    """Connected components of the links ``(a, b)``, both of one orderable type: ``(node, root)``, root the smallest node.

    Alternating large-star and small-star rounds: each links the neighbours of a node to the smallest of them, until every
    node hangs on its root. The links only shrink, each round is a table in the shared folder, and two numbers reach the driver.
    Loops and repeated links are allowed; nodes without a link to another are left out.
    """
    links = edges.filter("a is not null and b is not null and a <> b").select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    links = stored(links, "links")
    seen = _fingerprint(links)
    while seen[0]:
        links = stored(_small_star(_large_star(links)), "links")
        now = _fingerprint(links)
        if now == seen:
            break
        seen = now
    roots = links.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.unionByName(links.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def _fingerprint(links: DataFrame) -> tuple[int, int]:
    row = links.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0))).first()
    return int(row[0]), int(row[1])


def _large_star(links: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the node's smallest neighbour, or to the node itself if that is smaller."""
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m"))
    return (
        both.join(least, "a").filter("b > a")
        .select(F.col("b").alias("a"), F.least("m", "a").alias("b")).distinct()
    )


def _small_star(links: DataFrame) -> DataFrame:
    """A node and all its smaller neighbours are linked to the smallest of them."""
    least = links.groupBy("a").agg(F.min("b").alias("m"))
    moved = links.join(least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct()
