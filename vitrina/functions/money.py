"""Money, ratings and row-wise price arithmetic."""

from __future__ import annotations

import functools
import operator
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import NumericType

PRICES = ("list_price", "store_price", "partner_price", "other_price")

# Fixed values: (strict lower bound, divisor), tested from the top, first match wins.
PRICE_TIERS = (
    (1e13, 1e8),
    (1e12, 1e7),
    (1e10, 1e4),
    (1e9, 1e3),
    (1e8, 1e2),
    (3e7, 1e1),
)

_NUMBER = r"^[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?$"


def _number(text: Column) -> Column:
    return F.when(text.rlike(_NUMBER), text.try_cast("double"))


def parse_price(text: Column) -> Column:
    """Colombian money text to double: dots group, a comma is the decimal mark.

    The whole text is tried first; else only digits, dots and commas are kept, so that a sign
    before a currency mark is lost.
    """
    whole = F.trim(F.replace(F.replace(text, F.lit("."), F.lit("")), F.lit(","), F.lit(".")))
    kept = F.regexp_replace(text, "[^0-9.,]", "")
    bare = F.replace(F.replace(kept, F.lit("."), F.lit("")), F.lit(","), F.lit("."))
    return F.coalesce(_number(whole), _number(bare))


def parse_price_columns(df: DataFrame, columns: Sequence[str] = PRICES) -> DataFrame:
    """Parse text columns; columns that are already numbers only change type."""
    types = {f.name: f.dataType for f in df.schema.fields}
    return df.withColumns({
        c: F.col(c).cast("double") if isinstance(types[c], NumericType) else parse_price(F.col(c)) for c in columns
    })


def parse_rating(text: Column) -> Column:
    """The first number in the text; only a dot is a decimal mark."""
    return F.regexp_extract(text, r"(\d+\.\d+|\d+)", 1).try_cast("double")


def digits_only_number(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "").try_cast("double")


def rescale_tiers(value: Column, tiers: Sequence[tuple[float, float]] = PRICE_TIERS) -> Column:
    """Undo scale mistakes of prices by size class."""
    (bound, divisor), *rest = tiers
    chain = F.when(value > bound, value / divisor)
    for bound, divisor in rest:
        chain = chain.when(value > bound, value / divisor)
    return chain.otherwise(value)


def row_max_fill(df: DataFrame, columns: Sequence[str] = PRICES, all_null: float | None = None) -> DataFrame:
    """Missing prices take the greatest price of the row; ``all_null`` fills rows without any."""
    top = F.greatest(*columns)
    fallback = [] if all_null is None else [F.lit(float(all_null))]
    return df.withColumns({c: F.coalesce(F.col(c), top, *fallback) for c in columns})


def fill_from_list_price(df: DataFrame, columns: Sequence[str] = PRICES[1:], list_price: str = "list_price") -> DataFrame:
    return df.withColumns({c: F.coalesce(c, list_price) for c in columns})


def price_ratios(df: DataFrame, list_price: str = "list_price") -> DataFrame:
    """Each discount price over the list price; NULL where the list price is 0."""
    return df.withColumns({
        f"ratio_{c.removesuffix('_price')}": F.try_divide(F.col(c), F.col(list_price)) for c in PRICES[1:]
    })


def pct_gap(list_price: Column, floor: Column) -> Column:
    return F.try_divide(list_price - floor, floor)


def net_gap(list_price: Column, floor: Column) -> Column:
    return list_price - floor


def discount_amounts(df: DataFrame) -> DataFrame:
    return df.withColumns({
        "store_discount": F.col("list_price") - F.col("store_price"),
        "other_discount": F.col("list_price") - F.col("other_price"),
    })


def row_min(*columns: str) -> Column:
    return F.least(*columns)


def _total(terms: Sequence[Column]) -> Column:
    return functools.reduce(operator.add, terms)


def row_mean(*columns: str) -> Column:
    """Mean of the values present; NULL when none is."""
    total = _total([F.coalesce(F.col(c), F.lit(0.0)) for c in columns])
    present = _total([F.col(c).isNotNull().cast("double") for c in columns])
    return F.try_divide(total, present)


def row_cv(*columns: str) -> Column:
    """Sample standard deviation over mean of the values present; NULL below two values."""
    present = _total([F.col(c).isNotNull().cast("double") for c in columns])
    mean = row_mean(*columns)
    squares = _total([F.coalesce((F.col(c) - mean) ** 2, F.lit(0.0)) for c in columns])
    return F.when(present >= 2, F.try_divide(F.sqrt(squares / F.greatest(present - 1, F.lit(1.0))), mean))
