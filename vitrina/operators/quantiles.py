"""Quantiles per group that never hold a whole group in one task."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from vitrina.operators.lookup import attach
from vitrina.session import BROADCAST_ROWS, cut_lineage, written

# Rank error of the mergeable sketch: 1 / ACCURACY of the group size.
ACCURACY = 10_000

# Parts that the inside of a range of values is counted in.
BINS = 1024


def approximate_quantiles(df: DataFrame, value: str, probs: Sequence[float], groups: Sequence[str] = ()) -> DataFrame:
    """``(groups, prob, quantile)`` by a mergeable sketch of bounded size."""
    found = df.groupBy(*groups).agg(
        F.percentile_approx(F.col(value).cast("double"), [float(p) for p in probs], ACCURACY).alias("_q"))
    pairs = F.arrays_zip(F.array(*[F.lit(float(p)) for p in probs]).alias("prob"), F.col("_q").alias("quantile"))
    return found.select(*groups, F.inline(pairs)).filter("quantile IS NOT NULL")


def _parts(rows: DataFrame, keys: Sequence[str], ranges: Sequence[tuple[Column, Column, Column]]) -> DataFrame:
    """Counts of ``_v`` and its ends per group, in parts that are in order by ``(_slot, _bin)``.

    The ends of the ranges (low, high, rows at most) cut the values into slots. Values inside a range fall into ``BINS`` equal bins, or into one
    for each value where the range holds no more rows than that. The others are only counted: no row is multiplied.
    """
    value = F.col("_v")
    passed = [F.coalesce(test.cast("int"), F.lit(0)) for low, high, _ in ranges for end in (low, high) for test in (value >= end, value > end)]
    bins = [F.when((value > low) & (value < high), F.when(rows_ <= BINS, value).otherwise(
        F.least(F.floor(F.try_divide(value - low, high - low) * BINS), F.lit(BINS - 1)).cast("double"))) for low, high, rows_ in ranges]
    return rows.withColumns({"_slot": reduce(Column.__add__, passed), "_bin": F.coalesce(*bins, F.lit(0.0))}).groupBy(*keys, "_slot", "_bin").agg(
        F.count(F.lit(1)).alias("n"), F.min("_v").alias("low"), F.max("_v").alias("high"), F.max("_size").alias("_size"))


def exact_quantiles(df: DataFrame, value: str, probs: Sequence[float], groups: Sequence[str] = ()) -> DataFrame:
    """``(groups, prob, quantile)`` with linear interpolation between neighbours.

    A sketch proposes a range for every probability, and one more scan counts the values below, inside and above all ranges at once. The
    part that holds a rank gives its value if it has one value, or if the rank is its first or last; else it is
    the range of another round. Groups of up to some 1.7 million rows need none. A window never sees more than
    the parts of a group, whatever its size, and a poor proposal only costs a round.
    """
    keys = list(groups) or ["_all"]
    rows = df.select(*groups, F.col(value).cast("double").alias("_v")).filter("_v IS NOT NULL")
    if not groups:
        rows = rows.withColumn("_all", F.lit(0))
    margin = 2.0 / ACCURACY
    ends = [end for p in probs for end in (max(p - margin, 0.0), min(p + margin, 1.0))]
    place = [F.lit(float(p)) * (F.col("_size") - 1) for p in probs]
    ranks = [side(x) for x in place for side in (F.floor, F.ceil)]
    values = [f"_value{i}" for i in range(len(ranks))]
    # The sketch errs by 1 / ACCURACY of the rows at each end, so a range holds six times that beside its ends.
    open_ = cut_lineage(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_size"), F.percentile_approx("_v", ends, ACCURACY).alias("_ends")))
    ranges = [(F.col("_ends")[2 * i], F.col("_ends")[2 * i + 1], F.col("_size") * 6 / ACCURACY) for i in range(len(probs))]
    known, done = {v: F.lit(None).cast("double") for v in values}, []
    while True:
        small = F.broadcast(open_) if open_.count() <= BROADCAST_ROWS else open_
        parts = _parts(rows.join(small, keys), keys, ranges)
        order = Window.partitionBy(*keys).orderBy("_slot", "_bin").rowsBetween(Window.unboundedPreceding, 0)
        parts = parts.withColumn("last", F.sum("n").over(order) - 1).withColumn("first", F.col("last") - F.col("n") + 1)
        holding = [F.max(F.when(rank.between(F.col("first"), F.col("last")), F.struct("n", "first", "last", "low", "high"))).alias(f"_part{i}")
                   for i, rank in enumerate(ranks)]
        found = parts.groupBy(*keys).agg(F.max("_size").alias("_size"), *holding)
        if done:
            found = found.join(open_.select(*keys, *values), keys)
        part = [F.col(f"_part{i}") for i in range(len(ranks))]
        settled = {v: F.coalesce(known[v], F.when((p["low"] == p["high"]) | (rank == p["first"]), p["low"]).when(rank == p["last"], p["high"]))
                   for v, p, rank in zip(values, part, ranks)}
        found = cut_lineage(found.withColumns(settled))
        known = {v: F.col(v) for v in values}
        complete = reduce(Column.__and__, [known[v].isNotNull() for v in values])
        done.append(found.filter(complete).select(*keys, "_size", *values))
        open_ = found.filter(~complete)
        if open_.isEmpty():
            break
        ranges = [tuple(F.when(known[v].isNull(), p[field]) for field in ("low", "high", "n")) for v, p in zip(values, part)]
    between = [known[a] + (known[b] - known[a]) * (x - F.floor(x)) for a, b, x in zip(values[::2], values[1::2], place)]
    quantiles = F.array(*[F.struct(F.lit(float(p)).alias("prob"), q.alias("quantile")) for p, q in zip(probs, between)])
    return reduce(DataFrame.unionByName, done).select(*groups, F.inline(quantiles))


def quantiles_of_counts(counts: DataFrame, value: str, probs: Sequence[float], groups: Sequence[str]) -> DataFrame:
    """``(groups, prob, quantile)`` as ``exact_quantiles``, from distinct values with their numbers of rows in ``n``.

    The values are sorted in ranges, whose sums tell which of them hold the ranks; a window sees the values of one range.
    """
    keys = [F.col(g) for g in groups]
    rows = counts.select(*groups, F.col(value).alias("_v"), "n").filter("_v IS NOT NULL")
    ranged = written(rows.repartitionByRange(*keys, "_v").sortWithinPartitions(*groups, "_v").withColumn("_part", F.spark_partition_id()))
    upto = Window.partitionBy(*groups).orderBy("_part").rowsBetween(Window.unboundedPreceding, 0)
    parts = ranged.groupBy(*groups, "_part").agg(F.sum("n").alias("_rows")).withColumns({
        "_end": F.sum("_rows").over(upto), "_size": F.sum("_rows").over(Window.partitionBy(*groups))})
    place = F.col("prob") * (F.col("_size") - 1)
    asked = parts.withColumn("prob", F.explode(F.array(*[F.lit(float(p)) for p in probs]))).withColumns(
        {"_share": place - F.floor(place), "_side": F.array(F.floor(place), F.ceil(place))}).select(
        *groups, "_part", "prob", "_share", (F.col("_end") - F.col("_rows")).alias("_before"), "_end", F.posexplode("_side").alias("_high", "_rank"))
    asked = cut_lineage(asked.filter((F.col("_rank") >= F.col("_before")) & (F.col("_rank") < F.col("_end"))))
    small = asked.count() <= BROADCAST_ROWS
    wanted = asked.select(*groups, "_part", "_before").distinct()
    inside = Window.partitionBy(*groups, "_part").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    held = ranged.join(F.broadcast(wanted) if small else wanted, [*groups, "_part"]).withColumn("_last", F.col("_before") + F.sum("n").over(inside) - 1)
    ranks = asked.drop("_before", "_end")
    found = held.join(F.broadcast(ranks) if small else ranks, [*groups, "_part"]).filter(
        F.col("_rank").between(F.col("_last") - F.col("n") + 1, F.col("_last")))
    at = lambda high: F.max(F.when(F.col("_high") == high, F.col("_v")))
    ends = found.groupBy(*groups, "prob").agg(at(0).alias("_low"), at(1).alias("_up"), F.max("_share").alias("_share"))
    return ends.select(*groups, "prob", (F.col("_low") + (F.col("_up") - F.col("_low")) * F.col("_share")).alias("quantile"))


def box_stats(df: DataFrame, value: str, groups: Sequence[str]) -> DataFrame:
    """Quartiles, whiskers at the last points within 1.5 interquartile ranges, and outlier count."""
    groups = list(groups)
    rows = written(df.select(*groups, F.col(value).alias("_v")).filter("_v IS NOT NULL"))
    at = lambda p: F.max(F.when(F.col("prob") == p, F.col("quantile")))
    quartiles = exact_quantiles(rows, "_v", (0.25, 0.5, 0.75), groups).groupBy(*groups).agg(
        at(0.25).alias("q1"), at(0.5).alias("median"), at(0.75).alias("q3"))
    low = F.col("q1") - 1.5 * (F.col("q3") - F.col("q1"))
    high = F.col("q3") + 1.5 * (F.col("q3") - F.col("q1"))
    within = F.col("_v").between(low, high)
    return attach(rows, quartiles, groups, how="inner").groupBy(*groups, "q1", "median", "q3").agg(
        F.count(F.lit(1)).alias("n"),
        F.min(F.when(within, F.col("_v"))).alias("whisker_low"),
        F.max(F.when(within, F.col("_v"))).alias("whisker_high"),
        F.count_if(~within).alias("outliers"),
    )
