"""Incremental processing: positions, done keys, fallback rows, appended results."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F


def resume_by_position(df: DataFrame, checkpoint: DataFrame, position: str = "position") -> DataFrame:
    """Rows at or after the saved position; all rows when none is saved."""
    saved = checkpoint.agg(F.coalesce(F.max(position), F.lit(0))).first()[0]
    return df.filter(F.col(position) >= saved)


def next_checkpoint(done: DataFrame, every: int = 100, position: str = "position") -> DataFrame:
    """The last finished position that is a multiple of ``every``, as a one-row table."""
    return done.filter(F.col(position) % every == 0).agg(F.max(position).alias(position))


def resume_by_key(df: DataFrame, done: DataFrame, key: str = "name") -> DataFrame:
    """Rows whose key is not among the results so far."""
    return df.join(done.select(key), key, "left_anti")


def append_results(partial: DataFrame, new: DataFrame) -> DataFrame:
    return partial.unionByName(new, allowMissingColumns=True)


def tag_with_source(extracted: DataFrame, pages: DataFrame, key: str, columns: Sequence[str] = ("store", "url", "name")) -> DataFrame:
    """Store, URL and name of the page on each row extracted from it."""
    return extracted.join(pages.select(key, *columns), key)


def fallback_rows(wanted: DataFrame, extracted: DataFrame, key: str, sentinels: dict[str, str]) -> DataFrame:
    """Every wanted page with its rows; a page without any gets one row of sentinels."""
    return wanted.join(extracted, key, "left").na.fill(sentinels)
