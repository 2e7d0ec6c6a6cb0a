"""Column profile and association matrix."""

from __future__ import annotations

import itertools
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window, functions as F

from vitrina.operators.quantiles import quantiles_of_counts
from vitrina.session import written


def profile_numeric(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row per column: counts, spread, quartiles and moments."""
    rows = written(df.select([F.col(c).cast("double").alias(c) for c in columns]))
    long = rows.unpivot([], list(columns), "column", "_v")
    value = F.col("_v")
    base = long.groupBy("column").agg(
        F.count(F.lit(1)).alias("row_count"), F.count_if(value.isNull()).alias("missing"),
        F.count_if(value == 0).alias("zeros"), F.min(value).alias("min"), F.max(value).alias("max"),
        F.avg(value).alias("mean"), F.stddev_samp(value).alias("deviation"),
        F.skewness(value).alias("skewness"), F.kurtosis(value).alias("kurtosis"))
    # Distinct values collapse by (column, value) first, so no task sees a whole column; the quartiles come from them too.
    counts = written(long.filter(value.isNotNull()).groupBy("column", "_v").agg(F.count(F.lit(1)).alias("n")))
    distinct = counts.groupBy("column").agg(F.count(F.lit(1)).alias("distinct_values"))
    at = lambda p: F.max(F.when(F.col("prob") == p, F.col("quantile")))
    quartiles = quantiles_of_counts(counts, "_v", (0.25, 0.5, 0.75), ["column"]).groupBy("column").agg(
        at(0.25).alias("q1"), at(0.5).alias("median"), at(0.75).alias("q3"))
    return base.join(distinct, "column", "left").join(quartiles, "column", "left").withColumn(
        "distinct_values", F.coalesce("distinct_values", F.lit(0)))


def frequent_values(df: DataFrame, columns: Sequence[str], k: int = 10) -> DataFrame:
    """The k most frequent values of each column; ties by value."""
    long = df.select([F.col(c).cast("string").alias(c) for c in columns]).unpivot([], list(columns), "column", "value")
    counts = long.filter("value IS NOT NULL").groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    rank = F.row_number().over(Window.partitionBy("column").orderBy(F.desc("n"), "value"))
    return counts.withColumn("position", rank).filter(F.col("position") <= k)


def _entropy(counts: DataFrame, keys: list[str]) -> DataFrame:
    """Entropy of the counts per key, from n log n sums."""
    return counts.groupBy(*keys).agg(
        (F.log(F.sum("n")) - F.sum(F.col("n") * F.log("n")) / F.sum("n")).alias("_h"))


def association_matrix(df: DataFrame, numeric: Sequence[str], categorical: Sequence[str]) -> DataFrame:
    """``(a, b, measure, value)``: Pearson, correlation ratio, and uncertainty coefficient of a given b.

    One scan groups the rows by every categorical column, every pair of them, and all together; the measures come from its groups.
    """
    if not numeric and len(categorical) < 2:
        return df.sparkSession.createDataFrame([], "a string, b string, measure string, value double")
    keys, values = [f"_k{i}" for i in range(len(categorical))], [f"_v{i}" for i in range(len(numeric))]
    rows = df.select(*[F.col(c).alias(k) for c, k in zip(categorical, keys)], *[F.col(c).alias(v) for c, v in zip(numeric, values)])
    pairs = list(itertools.combinations(range(len(numeric)), 2))
    measures = [F.count(F.lit(1)).alias("n"), *[F.corr(values[i], values[j]).alias(f"_c{i}_{j}") for i, j in pairs]]
    for v in values:
        measures += [F.count(v).alias(f"{v}_n"), F.avg(v).alias(f"{v}_m"), F.var_pop(v).alias(f"{v}_v")]
    sets = [[], *[[k] for k in keys], *map(list, itertools.combinations(keys, 2))]
    if keys:
        grouped = rows.groupingSets(sets, *keys).agg(F.grouping_id().alias("_set"), *measures)
    else:
        grouped = rows.agg(F.lit(0).cast("long").alias("_set"), *measures)
    grouped = written(grouped)

    def groups(*of: str) -> DataFrame:
        """The groups by just these columns, without those of a null."""
        number = sum(1 << (len(keys) - 1 - i) for i, k in enumerate(keys) if k not in of)
        found = grouped.filter(F.col("_set") == number)
        return found.dropna(subset=list(of)) if of else found

    entry = lambda a, b, measure, value: F.struct(
        F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit(measure).alias("measure"), value.alias("value"))
    parts = []
    if pairs:
        parts.append(groups().select(F.inline(F.array(*[entry(numeric[i], numeric[j], "pearson", F.col(f"_c{i}_{j}")) for i, j in pairs]))))
    for a, key in zip(categorical, keys) if numeric else ():
        sums, entries = [], []
        for b, v in zip(numeric, values):
            n, m = F.col(f"{v}_n"), F.col(f"{v}_m")
            sums += [F.sum(n).alias(f"{v}_n"), F.sum(n * m).alias(f"{v}_s"), F.sum(n * m * m).alias(f"{v}_ss"), F.sum(n * F.col(f"{v}_v")).alias(f"{v}_in")]
            # variance between groups over total variance, both from the group moments
            between = F.col(f"{v}_ss") - F.try_divide(F.col(f"{v}_s") * F.col(f"{v}_s"), F.col(f"{v}_n"))
            entries.append(entry(a, b, "correlation_ratio", F.sqrt(F.try_divide(between, between + F.col(f"{v}_in")))))
        parts.append(groups(key).agg(*sums).select(F.inline(F.array(*entries))))
    for (a, x), (b, y) in itertools.combinations(list(zip(categorical, keys)), 2):
        counts = groups(x, y).select(F.col(x).alias("x"), F.col(y).alias("y"), "n")
        alone = [_entropy(counts.groupBy(k).agg(F.sum("n").alias("n")), []).scalar() for k in ("x", "y")]
        shared = alone[0] + alone[1] - F.col("_h")
        both = [entry(a, b, "uncertainty", F.try_divide(shared, alone[0])), entry(b, a, "uncertainty", F.try_divide(shared, alone[1]))]
        parts.append(_entropy(counts, []).select(F.inline(F.array(*both))))
    return reduce(DataFrame.unionByName, parts)
