"""Joins: lookups with a checked broadcast, brand kinds, membership, union."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from vitrina.session import BROADCAST_ROWS, cut_lineage


def attach(df: DataFrame, small: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """Join a derived per-key table back to the rows it came from.

    The table is computed once, counted, and broadcast only up to ``BROADCAST_ROWS`` rows; a larger
    one takes the shuffled join, where a hot key is split by the adaptive skew join.
    """
    small = cut_lineage(small)
    if small.count() <= BROADCAST_ROWS:
        small = F.broadcast(small)
    return df.join(small, list(keys), how)


def attach_frequent(df: DataFrame, small: DataFrame, key: str, rows: str) -> DataFrame:
    """Inner join with a table that has the number of rows of ``df`` for each key in ``rows``.

    The rows of the most frequent keys, up to ``BROADCAST_ROWS`` of them, meet a broadcast table; the few others are shuffled.
    """
    small = cut_lineage(small)
    left, bound = BROADCAST_ROWS, 0
    for r in small.groupBy(rows).agg(F.count(F.lit(1)).alias("_keys")).orderBy(F.desc(rows)).collect():
        left -= r["_keys"]
        if left < 0:
            bound = r[rows]
            break
    frequent = F.broadcast(small.filter(F.col(rows) > bound))
    met = df.join(frequent, key)
    if not bound:
        return met
    others = df.join(frequent.select(key), key, "left_anti")
    return met.unionByName(others.join(small.filter(F.col(rows) <= bound), key))


def join_brand_kind(
    offers: DataFrame, brands: DataFrame, default: str = "Errores", on_duplicate: str = "multiply"
) -> DataFrame:
    """Kind of each brand; offers of unlisted brands get ``default``.

    Several list rows of one brand multiply its offers, or are an error, or only the first kind is
    kept: ``on_duplicate`` is ``multiply``, ``fail`` or ``first``.
    """
    listed = brands.select("brand", "kind")
    if on_duplicate == "first":
        listed = listed.groupBy("brand").agg(F.min("kind").alias("kind"))
    elif on_duplicate == "fail":
        if not listed.groupBy("brand").count().filter("count > 1").isEmpty():
            raise ValueError("a brand is listed more than once")
    elif on_duplicate != "multiply":
        raise ValueError(f"unknown duplicate policy {on_duplicate}")
    return offers.join(listed, "brand", "left").withColumn("kind", F.coalesce("kind", F.lit(default)))


def join_by_url(products: DataFrame, *sides: DataFrame, key: str = "url") -> DataFrame:
    """Left joins with sides that hold one row per key."""
    return reduce(lambda left, side: left.join(side, key, "left"), sides, products)


def semi_join(df: DataFrame, keys: DataFrame, on: Sequence[str]) -> DataFrame:
    return df.join(keys, list(on), "left_semi")


def anti_join(df: DataFrame, keys: DataFrame, on: Sequence[str]) -> DataFrame:
    return df.join(keys, list(on), "left_anti")


def lookup_map(df: DataFrame, table: DataFrame, key: str, value: str, default: object = None) -> DataFrame:
    """Value of the key in a ``(key, value)`` table, or ``default``."""
    joined = df.join(table.select(key, value), key, "left")
    return joined if default is None else joined.withColumn(value, F.coalesce(F.col(value), F.lit(default)))


def union_batches(*frames: DataFrame) -> DataFrame:
    """Rows of all frames; a column missing in one is NULL there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def split_by(df: DataFrame, condition: Column) -> tuple[DataFrame, DataFrame]:
    """Rows that meet the condition, and all others, those where it is NULL included."""
    met = F.coalesce(condition, F.lit(False))
    return df.filter(met), df.filter(~met)
