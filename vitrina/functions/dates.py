"""Date expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

# Patterns tried in this order.
DATE_FORMATS = ("yyyy-MM-dd", "yyyy/MM/dd", "dd/MM/yyyy", "yyyyMMdd", "yyyy-MM-dd HH:mm:ss")


def parse_date(text: Column, formats: Sequence[str] = DATE_FORMATS) -> Column:
    """First pattern that reads the text; NULL when none does."""
    return F.coalesce(*[F.try_to_date(text, f) for f in formats])


def date_parts(df: DataFrame, day: str = "captured_on") -> DataFrame:
    return df.withColumns({"year": F.year(day), "month": F.month(day), "day": F.dayofmonth(day)})


def weekday(day: Column) -> Column:
    """English day name."""
    return F.date_format(day, "EEEE")


def weekday_order(day: Column) -> Column:
    """0 for Monday to 6 for Sunday."""
    return F.weekday(day)
