"""Validation, quarantine, duplicates and row filters."""

from __future__ import annotations

import datetime
from collections.abc import Sequence
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, Window, functions as F

from vitrina.functions.money import PRICES
from vitrina.operators.lookup import split_by
from vitrina.operators.quantiles import approximate_quantiles, exact_quantiles
from vitrina.schemas import RAW_OFFER_COLUMNS
from vitrina.session import written


def non_null_count(columns: Sequence[str]) -> Column:
    return reduce(add, [F.col(c).isNotNull().cast("int") for c in columns])


def split_valid_rows(df: DataFrame, columns: Sequence[str] = RAW_OFFER_COLUMNS) -> tuple[DataFrame, DataFrame]:
    """Valid rows and quarantine: a batch needs exactly the expected columns, a row a value in each."""
    if len(df.columns) != len(columns):
        return df.limit(0), df
    return split_by(df, non_null_count(df.columns) == len(columns))


def ingest_summary(df: DataFrame, columns: Sequence[str], key: Sequence[str] | None = None, files: DataFrame | None = None) -> DataFrame:
    """Rows, valid rows, quarantined rows and repeated valid rows in one table row.

    With ``files``, one row per file of the batch and an ``error`` where it could not be read, also all, read and unread files.
    """
    valid, _ = split_valid_rows(df, columns)
    key = list(key or df.columns)
    distinct = valid.groupBy(*key).agg(F.count(F.lit(1)).alias("_n")).agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("valid_rows"), F.count(F.lit(1)).alias("_distinct"))
    total = df.agg(F.count(F.lit(1)).alias("_rows")).scalar()
    summary = distinct.select(
        total.alias("input_rows"), "valid_rows", (total - F.col("valid_rows")).alias("quarantined_rows"),
        (F.col("valid_rows") - F.col("_distinct")).alias("duplicate_rows"), F.lit(len(df.columns)).alias("column_count"))
    if files is None:
        return summary
    n, unread = F.count(F.lit(1)), F.count("error")
    counted = files.agg(F.struct(n.alias("files"), (n - unread).alias("read_files"), unread.alias("unread_files"))).scalar()
    return summary.withColumn("_files", counted).select(*summary.columns, "_files.*")


def dedupe_full_row(df: DataFrame) -> DataFrame:
    """One of each set of equal rows; NULL equals NULL."""
    return df.dropDuplicates()


def count_duplicates(df: DataFrame) -> DataFrame:
    """Number of rows that repeat an earlier row, counted from per-row multiplicities."""
    copies = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("_copies"))
    return copies.agg(F.coalesce(F.sum(F.col("_copies") - 1), F.lit(0)).alias("duplicates"))


def dedupe_by_keys(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """First row of each key by an explicit order.

    The filter on the row number is pushed below the shuffle, so each task sends at most one row
    per key, however often a key occurs.
    """
    first = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(first)).filter("_rank = 1").drop("_rank")


def select_campaign_rows(
    df: DataFrame, year: int = 2025, month: int = 12, after_day: int = 14, above: float = 100_000,
    day: str = "captured_on", prices: Sequence[str] = PRICES,
) -> DataFrame:
    """Rows of the year, or of the late month of any year, with any price above the bound."""
    in_time = (F.year(day) == year) | ((F.month(day) == month) & (F.dayofmonth(day) > after_day))
    dear = reduce(lambda a, b: a | b, [F.coalesce(F.col(p) > above, F.lit(False)) for p in prices])
    return df.filter(in_time & dear)


def filter_since(df: DataFrame, start: datetime.date = datetime.date(2024, 10, 6), day: str = "captured_on") -> DataFrame:
    return df.filter(F.col(day) >= F.lit(start))


def filter_price_band(df: DataFrame, low: float = 1_000_000, high: float = 3_000_000, price: str = "list_price") -> DataFrame:
    return df.filter(F.col(price).between(low, high))


def drop_null_rows(df: DataFrame, subset: Sequence[str] | None = None) -> DataFrame:
    return df.na.drop("any", subset=list(subset) if subset else None)


def trim_outliers(
    df: DataFrame, columns: Sequence[str] = PRICES, lower: float = 0.01, upper: float = 0.99, approx: bool = False
) -> DataFrame:
    """Keep rows within two quantiles, column after column: each bound comes from the rows left so far."""
    quantiles = approximate_quantiles if approx else exact_quantiles
    left, within = written(df.select(*columns)), F.lit(True)
    for column in columns:
        bounds = {row["prob"]: row["quantile"] for row in quantiles(left, column, (lower, upper)).collect()}
        if not bounds:
            return df.limit(0)
        step = F.col(column).between(bounds[lower], bounds[upper])
        left, within = left.filter(step), within & step
    return df.filter(within)


def drop_top_n(df: DataFrame, price: str = "list_price", ties: Sequence[str] = ("offer_id",), n: int = 3) -> DataFrame:
    """All rows but the n dearest; ties are broken by key.

    Only the boundary row is looked up (a top-n of n rows); the rest is a plain filter.
    """
    order = [F.col(price).desc_nulls_last(), *[F.col(t) for t in ties]]
    top = df.select(price, *ties).orderBy(*order).limit(n)
    return df.join(F.broadcast(top.select(*ties)), list(ties), "left_anti")
