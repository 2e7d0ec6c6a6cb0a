"""Daily series per store and their seasonal decomposition."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StructType

# Series that are fitted together, and rows that a task gathers for them at least.
SERIES = 8
ROWS = 100_000


def daily_mean(
    df: DataFrame, value: str = "list_price", keys: Sequence[str] = ("store",), day: str = "captured_on",
    calendar: bool = False,
) -> DataFrame:
    """Mean per key and calendar day; days without rows are left out, or NULL with ``calendar``."""
    keys = list(keys)
    means = df.filter(F.col(value).isNotNull()).groupBy(*keys, F.to_date(day).alias("day")).agg(F.avg(value).alias("mean"))
    if not calendar:
        return means
    days = means.groupBy(*keys).agg(F.explode(F.sequence(F.min("day"), F.max("day"))).alias("day"))
    return days.join(means, [*keys, "day"], "left")


def _neighbours(n: int, span: int, first: int, count: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Neighbour indices, offsets and tricube weights for ``count`` positions from ``first`` on."""
    at = np.arange(first, first + count, dtype=float)
    near = min(span, n)
    start = np.clip(np.arange(first, first + count) - near // 2, 0, n - near)
    index = start[:, None] + np.arange(near)[None, :]
    offset = index - at[:, None]
    distance = np.abs(offset)
    reach = distance.max(axis=1, keepdims=True) + max(span - n, 0) // 2
    weight = np.clip(1 - (distance / np.maximum(reach, 1e-12)) ** 3, 0, None) ** 3
    weight = np.where(distance <= 1e-3 * reach, 1.0, np.where(distance > 0.999 * reach, 0.0, weight))
    return index, offset, weight


def _loess(
    y: np.ndarray, first: int, count: int, span: int, weights: np.ndarray | None, known: dict
) -> np.ndarray:
    """Locally linear fit of evenly spaced series, one in each line, at ``count`` positions from ``first`` on."""
    n = y.shape[1]
    shape = (n, span, first, count)
    if shape not in known:
        known[shape] = _neighbours(*shape)
    index, offset, weight = known[shape]
    weight = weight[None] if weights is None else weight * weights.take(index, axis=1)
    total = weight.sum(axis=2)
    weight = weight / np.where(total > 0, total, 1.0)[:, :, None]
    centre = (weight * offset).sum(axis=2)
    offset = offset - centre[:, :, None]
    spread = (weight * offset**2).sum(axis=2)
    slope = np.where(np.sqrt(spread) > 1e-3 * n, -centre / np.where(spread > 0, spread, 1.0), 0.0)
    fit = (weight * (1 + slope[:, :, None] * offset) * y.take(index, axis=1)).sum(axis=2)
    nearest = y[:, np.clip(np.arange(first, first + count), 0, n - 1)]
    return np.where(total > 0, fit, nearest)


def _odd(x: float) -> int:
    whole = math.ceil(x)
    return whole if whole % 2 else whole + 1


def _moving_mean(y: np.ndarray, width: int) -> np.ndarray:
    kernel = np.ones(width) / width
    return np.stack([np.convolve(line, kernel, mode="valid") for line in y])


def seasonal_trend(
    y: np.ndarray, period: int = 7, seasonal: int = 7, robust: bool = True, known: dict | None = None
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Trend, seasonal and residual parts by the published STL procedure (Cleveland et al., 1990); series of one length, one in each line."""
    n = y.shape[1]
    trend_span = _odd(1.5 * period / (1 - 1.5 / seasonal))
    low_span = _odd(period + 1)
    inner, outer = (2, 15) if robust else (5, 0)
    known = {} if known is None else known  # neighbour geometry, the same in every pass
    trends, seasons = np.zeros(y.shape), np.zeros(y.shape)
    open_, left = np.arange(len(y)), y  # series that go on
    trend, season, weights = np.zeros(y.shape), np.zeros(y.shape), np.ones(y.shape)
    for _ in range(outer + 1):
        for _ in range(inner):
            cycle = np.empty((len(left), n + 2 * period))
            for phase in range(period):
                part = left[:, phase::period] - trend[:, phase::period]
                cycle[:, phase::period] = _loess(part, -1, part.shape[1] + 2, seasonal, weights[:, phase::period], known)
            low = _moving_mean(_moving_mean(_moving_mean(cycle, period), period), 3)
            low = _loess(low, 0, n, low_span, None, known)
            season = cycle[:, period : period + n] - low
            trend = _loess(left - season, 0, n, trend_span, weights, known)
        trends[open_], seasons[open_] = trend, season
        residual = np.abs(left - season - trend)
        limit = 6 * np.median(residual, axis=1)
        moving = robust & (limit != 0)
        if not moving.any():
            break
        open_, left, trend, season = open_[moving], left[moving], trend[moving], season[moving]
        ratio = residual[moving] / limit[moving, None]
        weights = np.where(ratio <= 0.001, 1.0, np.where(ratio >= 0.999, 0.0, (1 - ratio**2) ** 2))
    return trends, seasons, y - seasons - trends


def _decompose(rows: pd.DataFrame, keys: list[str], period: int, robust: bool, known: dict) -> pd.DataFrame:
    """Parts of the whole series among the rows, which are in order; those of one length are fitted together."""
    series = rows.groupby(keys, dropna=False, sort=False)
    number, length = series.ngroup().to_numpy(), series[keys[0]].transform("size").to_numpy()
    parts = np.full((len(rows), 3), np.nan)
    for n in np.unique(length[length >= 2 * period]):
        at = np.flatnonzero(length == n)
        at = at[np.argsort(number[at], kind="stable")].reshape(-1, n)
        for some in np.array_split(at, -(-len(at) // SERIES)):
            y = rows["mean"].to_numpy(dtype=float)[some]
            parts[some] = np.stack(seasonal_trend(y, period, robust=robust, known=known), axis=2)
    return rows.assign(trend=parts[:, 0], season=parts[:, 1], residual=parts[:, 2])


def stl_decompose(series: DataFrame, keys: Sequence[str] = ("store",), period: int = 7, robust: bool = True) -> DataFrame:
    """Trend, weekly season and residual of each key's daily series.

    The input holds one row per key and day, so a group is as long as the calendar, not the table.
    Series shorter than two periods are returned with NULL parts.
    """
    keys = list(keys)
    fields = [series.schema[k] for k in [*keys, "day", "mean"]]
    schema = StructType(fields).add("trend", "double").add("season", "double").add("residual", "double")

    def decompose(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict = {}
        held: list[pd.DataFrame] = []
        for batch in batches:
            held.append(batch)
            if sum(map(len, held)) < ROWS:
                continue
            rows = pd.concat(held, ignore_index=True)
            number = rows.groupby(keys, dropna=False, sort=False).ngroup().to_numpy()
            whole = int(np.flatnonzero(number == number[-1])[0])  # the last series may go on in the next batch
            held = [rows[whole:]]
            if whole:
                yield _decompose(rows[:whole], keys, period, robust, known)
        if held:
            yield _decompose(pd.concat(held, ignore_index=True), keys, period, robust, known)

    rows = series.select(*keys, "day", "mean").filter("mean IS NOT NULL")
    # The fit is all computation: a fixed partition count keeps the small series from being merged into one task.
    tasks = int(series.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(tasks, *keys).sortWithinPartitions(*keys, F.col("day").asc_nulls_last()).mapInPandas(decompose, schema)
