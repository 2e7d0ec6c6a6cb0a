"""Group statistics, imputation, scaling and per-name minima."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from vitrina.functions.money import PRICES
from vitrina.operators.lookup import attach


def count_by(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows per key; rows with a missing key part are left out."""
    return df.na.drop("any", subset=list(keys)).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def impute_group_mean(df: DataFrame, value: str = "rating", group: str = "category") -> DataFrame:
    """Missing values take the mean of their group, if it has one."""
    means = df.groupBy(group).agg(F.avg(value).alias("_mean")).filter("_mean IS NOT NULL")
    return attach(df, means, [group]).withColumn(value, F.coalesce(value, "_mean")).drop("_mean").select(*df.columns)


def _global(df: DataFrame, **measures: Column) -> dict[str, Column]:
    """Whole-table measures, computed once: one row of numbers that enters the plan as literals."""
    row = df.agg(*[m.cast("double").alias(k) for k, m in measures.items()]).first()
    return {k: F.lit(row[k]).cast("double") for k in measures}


def impute_column_mean(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    means = _global(df, **{c: F.avg(c) for c in columns})
    return df.withColumns({c: F.coalesce(F.col(c), means[c]) for c in columns})


def min_max_scale(df: DataFrame, columns: Sequence[str], suffix: str = "_scaled") -> DataFrame:
    """(x - min) / (max - min) over the table; a constant column becomes 0."""
    ends = _global(df, **{f"{c}_min": F.min(c) for c in columns}, **{f"{c}_max": F.max(c) for c in columns})
    scaled = {}
    for c in columns:
        low, high = ends[f"{c}_min"], ends[f"{c}_max"]
        scaled[c + suffix] = F.when(high > low, (F.col(c) - low) / (high - low)).when(F.col(c).isNotNull(), 0.0)
    return df.withColumns(scaled)


def standardise(df: DataFrame, columns: Sequence[str], suffix: str = "_std") -> DataFrame:
    """(x - mean) / population deviation; a constant column becomes 0."""
    stats = _global(df, **{f"{c}_mean": F.avg(c) for c in columns}, **{f"{c}_dev": F.stddev_pop(c) for c in columns})
    return df.withColumns({
        c + suffix: F.when(stats[f"{c}_dev"] > 0, (F.col(c) - stats[f"{c}_mean"]) / stats[f"{c}_dev"])
        .when(F.col(c).isNotNull(), 0.0)
        for c in columns
    })


def nonfinite_to_mean(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """NaN and infinite values become the mean of the finite ones."""
    finite = lambda c: F.when(~F.isnan(c) & (F.abs(c) != float("inf")), F.col(c))
    means = _global(df, **{c: F.avg(finite(c)) for c in columns})
    return df.withColumns({
        c: F.when(F.col(c).isNull(), F.lit(None)).otherwise(F.coalesce(finite(c), means[c])) for c in columns
    })


def name_price_stats(df: DataFrame) -> DataFrame:
    """Distinct list prices and mean of each price, per name."""
    return df.groupBy("name").agg(
        F.count_distinct("list_price").alias("distinct_list_prices"), *[F.avg(p).alias(f"mean_{p}") for p in PRICES])


def varied_names(stats: DataFrame, more_than: int = 3) -> DataFrame:
    """Names with enough distinct list prices whose four means are not all equal."""
    means = [f"mean_{p}" for p in PRICES]
    return stats.filter((F.col("distinct_list_prices") > more_than) & (F.greatest(*means) != F.least(*means)))


def mean_by(df: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(*[F.avg(c).alias(c) for c in columns])


def concat_by_key(df: DataFrame, key: str, text: str, order: Sequence[str], first: Sequence[str] = ()) -> DataFrame:
    """Texts of one key joined by blanks in row order, with the first value of other columns."""
    entry = F.struct(*order, F.col(text).alias("_text"))
    firsts = [F.min_by(c, F.struct(*order)).alias(c) for c in first]
    grouped = df.filter(F.col(text).isNotNull()).groupBy(key).agg(F.array_sort(F.collect_list(entry)).alias("_all"), *firsts)
    return grouped.select(key, *first, F.array_join(F.transform("_all", lambda e: e["_text"]), " ").alias(text))


def mean_line(df: DataFrame, value: str, keys: Sequence[str] = ("category", "store", "captured_on")) -> DataFrame:
    """Mean, count and deviation of a measure per category, store and day."""
    return df.filter(F.col(value).isNotNull()).groupBy(*keys).agg(
        F.avg(value).alias("mean"), F.count(F.lit(1)).alias("n"), F.stddev_samp(value).alias("deviation"))


def group_corr(df: DataFrame, x: str, y: str, keys: Sequence[str]) -> DataFrame:
    """Pearson correlation per group; NULL where either side does not vary."""
    both = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    varies = (F.min(x) < F.max(x)) & (F.min(y) < F.max(y))
    return both.groupBy(*keys).agg(F.when(varies, F.corr(x, y)).alias("correlation"), F.count(F.lit(1)).alias("n"))


def min_over_name(df: DataFrame, columns: Sequence[str] = PRICES, key: str = "name") -> DataFrame:
    """Minimum of each price over all rows of the name, on every row."""
    lowest = df.groupBy(key).agg(*[F.min(c).alias(f"min_{c}") for c in columns])
    return attach(df, lowest, [key])


def scale_within_name(df: DataFrame, column: str, key: str = "name") -> DataFrame:
    """Min-max scaling within the name; NULL where the name has one price only."""
    ends = df.groupBy(key).agg(F.min(column).alias("_low"), F.max(column).alias("_high"))
    scaled = F.try_divide(F.col(column) - F.col("_low"), F.col("_high") - F.col("_low"))
    return attach(df, ends, [key]).withColumn(f"{column}_scaled", scaled).drop("_low", "_high")


def first_names_per_category(df: DataFrame, k: int = 3, day: str = "captured_on") -> DataFrame:
    """The first k names of each category by date of first appearance, then by name."""
    seen = df.groupBy("category", "name").agg(F.min(day).alias("first_seen"))
    rank = F.row_number().over(Window.partitionBy("category").orderBy("first_seen", "name"))
    return seen.withColumn("position", rank).filter(F.col("position") <= k)


def top_k_by_score(df: DataFrame, query: str, score: str, ties: Sequence[str], k: int = 5) -> DataFrame:
    """The k best rows per query; the limit is applied in each task before the shuffle."""
    rank = F.row_number().over(Window.partitionBy(query).orderBy(F.col(score).desc(), *ties))
    return df.withColumn("position", rank).filter(F.col("position") <= k)


def price_points(df: DataFrame) -> DataFrame:
    """Distinct (category, store, name, list, store, other) price rows."""
    return df.select("category", "store", "name", "list_price", "store_price", "other_price").distinct()


def price_grid(df: DataFrame, y: str, cells_per_decade: int = 10) -> DataFrame:
    """Point counts on a log-log grid of list price against another price."""
    cell = lambda c: F.floor(F.log10(c) * cells_per_decade)
    return df.filter((F.col("list_price") > 0) & (F.col(y) > 0)).groupBy(
        "category", cell("list_price").alias("x_cell"), cell(y).alias("y_cell")).agg(F.count(F.lit(1)).alias("points"))


def price_history(df: DataFrame, names: DataFrame) -> DataFrame:
    """Mean of each of the four prices per selected name and day, in long form."""
    chosen = df.join(names.select("name").distinct(), "name", "left_semi").select("name", "captured_on", *PRICES)
    long = chosen.unpivot(["name", "captured_on"], list(PRICES), "price_type", "price")
    return long.filter("price IS NOT NULL").groupBy("name", "price_type", "captured_on").agg(F.avg("price").alias("mean_price"))
