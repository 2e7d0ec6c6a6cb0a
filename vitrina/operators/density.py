"""Kernel density and bootstrap bands of grouped measures.

Both sum one vector per row (a place for each grid point or resample). The vectors live in numpy blocks inside a task, which hands on one
partial sum per group, so what is shuffled does not grow with the rows of a group.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, functions as F

from vitrina.operators.lookup import attach
from vitrina.session import cut_lineage, written

# Vectors formed at once, and groups whose partial sums a task holds before it hands them on.
CHUNK = 1024
HELD = 1024

# Rows of a group that a task resamples; a larger group is cut into parts.
PART = 8192


def _group_sums(rows: DataFrame, vectors: Callable[..., np.ndarray]) -> DataFrame:
    """``(_group, _sum)`` of the vectors made from the columns that follow ``_group``.

    Rows are sorted by group within their task, so a task hands on each group once and holds few of them.
    """

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}

        def handed() -> pa.RecordBatch:
            sums = np.stack(list(held.values()))
            ends = np.arange(0, sums.size + 1, sums.shape[1], dtype=np.int32)
            return pa.RecordBatch.from_pydict({"_group": pa.array(list(held), pa.int64()), "_sum": pa.ListArray.from_arrays(ends, sums.reshape(-1))})

        for batch in batches:
            columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            for at in range(0, batch.num_rows, CHUNK):
                group, *values = [c[at:at + CHUNK] for c in columns]
                order = np.argsort(group, kind="stable")
                ids, starts = np.unique(group[order], return_index=True)
                sums = np.add.reduceat(vectors(*[v[order] for v in values]), starts, axis=0)
                for i, total in zip(ids.tolist(), sums):
                    held[i] = held[i] + total if i in held else total
                if len(held) > HELD:
                    yield handed()
                    held.clear()
        if held:
            yield handed()

    summed = rows.sortWithinPartitions("_group").mapInArrow(partial, "_group long, _sum array<double>")
    return summed.groupBy("_group").agg(vector_to_array(Summarizer.sum(array_to_vector("_sum"))).alias("_sum"))


def _numbered(groups: DataFrame) -> DataFrame:
    """A number per group, fixed by writing the table."""
    return cut_lineage(groups.withColumn("_group", F.monotonically_increasing_id()))


def kde(df: DataFrame, value: str, groups: Sequence[str], points: int = 200, cut: float = 3.0) -> DataFrame:
    """Gaussian density on an even grid per group, with Scott's bandwidth; every value counts at every grid point."""
    groups = list(groups)
    rows = written(df.filter(F.col(value).isNotNull()).select(*groups, F.col(value).cast("double").alias("_v")))
    stats = rows.groupBy(*groups).agg(
        F.count(F.lit(1)).alias("_size"), F.stddev_samp("_v").alias("_dev"), F.min("_v").alias("_min"), F.max("_v").alias("_max"),
    ).filter("_dev > 0")
    width = F.col("_dev") * F.pow(F.col("_size"), F.lit(-0.2))
    stats = _numbered(stats.select(
        *groups, "_size", width.alias("_width"), (F.col("_min") - cut * width).alias("_start"),
        ((F.col("_max") - F.col("_min") + 2 * cut * width) / (points - 1)).alias("_step")))
    start = (F.col("_start") - F.col("_v")) / F.col("_width")
    step = F.col("_step") / F.col("_width")
    away = attach(rows, stats, groups, how="inner").select("_group", start.alias("_a"), step.alias("_b"))
    places = np.arange(points)

    def kernels(start: np.ndarray, step: np.ndarray) -> np.ndarray:
        return np.exp(-0.5 * (start[:, None] + step[:, None] * places) ** 2)

    sums = _group_sums(away, kernels)
    scale = F.col("_size") * F.col("_width") * math.sqrt(2 * math.pi)
    grid = stats.join(sums, "_group").select("*", F.posexplode("_sum").alias("grid_point", "_kernel"))
    return grid.select(
        *groups, F.col("grid_point").cast("long").alias("grid_point"), (F.col("_start") + F.col("grid_point") * F.col("_step")).alias("x"),
        (F.col("_kernel") / scale).alias("density"))


def _poisson_steps() -> list[float]:
    """Cumulative probabilities of a Poisson variable with mean 1, as far as doubles tell them from 1."""
    steps, term, total = [], math.exp(-1), 0.0
    while total + term > total:
        total += term
        steps.append(total)
        term /= len(steps)
    return steps


def _poisson_draws(hashes: np.ndarray, replicates: int, steps: np.ndarray) -> np.ndarray:
    """Poisson(1) draws of each row for every resample; they depend only on the row's hash, so that a lost task repeats them."""
    odd = np.arange(1, replicates + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    z = hashes.view(np.uint64)[:, None] + odd
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return np.searchsorted(steps, (z ^ (z >> np.uint64(31))) / 2.0**64, side="right").astype(float)


def _quantiles(sums: np.ndarray, replicates: int, levels: Sequence[float]) -> list[np.ndarray]:
    """Quantiles of the resampled means of each row of ``sums``, NaN without a resample that holds a row, and how many hold one."""
    weights = sums[:, :replicates]
    with np.errstate(invalid="ignore", divide="ignore"):
        means = np.sort(np.where(weights > 0, sums[:, replicates:] / weights, np.nan), axis=1)
    held = (weights > 0).sum(1)
    line, found = np.arange(len(sums)), []
    for level in levels:
        place = level * np.maximum(held - 1, 0)
        below, above = (means[line, edge(place).astype(int)] for edge in (np.floor, np.ceil))
        with np.errstate(invalid="ignore"):
            found.append(below + (above - below) * (place - np.floor(place)))
    return [*found, held]


def _band_parts(rows: DataFrame, vectors: Callable[..., np.ndarray], appears: Callable[..., np.ndarray], replicates: int, levels: Sequence[float]) -> DataFrame:
    """``(_group, _low, _high, _sum)`` of rows ``(_group, n, _hash, _v)``: the band of each group that is whole in its task, else the sum of its part.

    Groups of up to ``PART`` rows are whole. Larger ones are cut, so that a sum stands for that many rows and no task holds a large group.
    A group of one row has that row's value in each resample it appears in.
    """
    chunks = F.ceil(F.col("n") / F.lit(PART))
    placed = rows.withColumn("_part", F.pmod("_hash", chunks)).repartition("_group", "_part").sortWithinPartitions("_group", "_part")
    low, high = levels

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_key, open_n, open_sum, open_rows = None, 0, None, 0

        def done(groups: np.ndarray, sizes: np.ndarray, sums: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
            whole = sizes == counts
            band = _quantiles(sums, replicates, (low, high))
            absent = ~whole | (band[2] == 0)
            return pa.RecordBatch.from_pydict({
                "_group": pa.array(groups, pa.int64()), "_low": pa.array(band[0], pa.float64(), mask=absent), "_high": pa.array(band[1], pa.float64(), mask=absent),
                "_sum": pa.array([None if w else s for w, s in zip(whole, sums)], pa.list_(pa.float64()))})

        for batch in batches:
            columns = [batch.column(c).to_numpy() for c in ("_group", "_part", "n", "_hash", "_v")]
            alone = columns[2] == 1
            if alone.any():
                group, _, _, hashes, values = (c[alone] for c in columns)
                absent = ~appears(hashes)
                band = pa.array(values, pa.float64(), mask=absent)
                yield pa.RecordBatch.from_pydict({
                    "_group": pa.array(group, pa.int64()), "_low": band, "_high": band, "_sum": pa.nulls(len(group), pa.list_(pa.float64()))})
                columns = [c[~alone] for c in columns]
            for at in range(0, len(columns[0]), CHUNK):
                group, part, n, hashes, values = (c[at:at + CHUNK] for c in columns)
                starts = np.flatnonzero(np.r_[True, (np.diff(group) != 0) | (np.diff(part) != 0)])
                sums = np.add.reduceat(vectors(hashes, values), starts, axis=0)
                counts = np.diff(np.r_[starts, len(group)])
                ids, sizes = group[starts], n[starts]
                if open_key == (group[0], part[0]):
                    sums[0] += open_sum
                    counts[0] += open_rows
                elif open_key is not None:
                    yield done(np.array([open_key[0]]), np.array([open_n]), open_sum[None], np.array([open_rows]))
                if len(starts) > 1:
                    yield done(ids[:-1], sizes[:-1], sums[:-1], counts[:-1])
                open_key, open_n, open_sum, open_rows = (group[-1], part[-1]), sizes[-1], sums[-1].copy(), counts[-1]
        if open_key is not None:
            yield done(np.array([open_key[0]]), np.array([open_n]), open_sum[None], np.array([open_rows]))

    return placed.mapInArrow(run, "_group long, _low double, _high double, _sum array<double>")


def mean_line_ci(
    df: DataFrame, value: str, keys: Sequence[str], row_id: str, replicates: int = 1000, seed: int = 0, level: float = 0.95
) -> DataFrame:
    """Mean per group with a percentile band from a Poisson bootstrap; resamples without a row are left out of the band."""
    keys = list(keys)
    rows = written(df.filter(F.col(value).isNotNull()).select(
        *keys, F.xxhash64(F.col(row_id), F.lit(seed)).alias("_hash"), F.col(value).cast("double").alias("_v")))
    stats = _numbered(rows.groupBy(*keys).agg(F.avg("_v").alias("mean"), F.count(F.lit(1)).alias("n")))
    steps = np.array(_poisson_steps())
    tail = (1 - level) / 2
    levels = (tail, 1 - tail)

    def resampled(hashes: np.ndarray, values: np.ndarray) -> np.ndarray:
        draws = _poisson_draws(hashes, replicates, steps)
        with np.errstate(invalid="ignore"):
            return np.hstack([draws, draws * values[:, None]])

    def appears(hashes: np.ndarray) -> np.ndarray:
        """Whether a resample holds the row; the first few tell it for nearly all rows."""
        found = (_poisson_draws(hashes, min(replicates, 16), steps) > 0).any(1)
        left = np.flatnonzero(~found)
        for at in range(0, len(left), CHUNK):
            some = left[at:at + CHUNK]
            found[some] = (_poisson_draws(hashes[some], replicates, steps) > 0).any(1)
        return found

    drawn = attach(rows, stats.select(*keys, "_group", "n"), keys, how="inner").select("_group", "n", "_hash", "_v")
    parts = written(_band_parts(drawn, resampled, appears, replicates, levels))
    whole = parts.filter("_sum IS NULL").select("_group", "_low", "_high")
    summed = parts.filter("_sum IS NOT NULL").groupBy("_group").agg(vector_to_array(Summarizer.sum(array_to_vector("_sum"))).alias("_sum"))

    def band(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, CHUNK):
                some = batch.slice(at, CHUNK)
                sums = some.column(1).flatten().to_numpy(zero_copy_only=False).reshape(some.num_rows, -1)
                low, high, held = _quantiles(sums, replicates, levels)
                yield pa.RecordBatch.from_pydict({
                    "_group": some.column(0), "_low": pa.array(low, mask=held == 0), "_high": pa.array(high, mask=held == 0)})

    bands = whole.unionByName(summed.mapInArrow(band, "_group long, _low double, _high double"))

    def steady(x: Column) -> Column:
        """Twelve significant digits, which the order of addition does not reach."""
        scale = F.pow(F.lit(10.0), F.floor(F.log10(F.abs(x))))
        return F.when(x == 0, x).otherwise(F.round(x / scale, 11) * scale)

    return stats.join(bands, "_group").select(*keys, "mean", "n", steady(F.col("_low")).alias("low"), steady(F.col("_high")).alias("high"))
