"""Normalised Indel similarity of two texts, the one text measure Spark has no expression for."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.types import DoubleType

# Cells (pair, letter) that are compared at once.
CELLS = 1 << 18


def _letters(left: list[str], right: list[str], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the letters, one row for each text: the left ones filled up to ``width``, the right ones to the longest."""
    points = np.frombuffer("".join(left + right).encode("utf-32-le", "surrogatepass"), "<u4")
    seen = np.zeros(int(points.max()) + 1, bool)
    seen[points] = True
    numbers = np.cumsum(seen, dtype=np.uint32)  # from 1
    kinds, kind = int(numbers[-1]), np.uint8 if numbers[-1] < 254 else np.uint32
    which = (numbers.astype(kind))[points]
    out, start = [], 0
    for texts, filler in ((left, 0), (right, kinds + 1)):
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        rows = np.full((len(texts), width if texts is left else int(sizes.max())), filler, kind)
        rows[np.arange(rows.shape[1]) < sizes[:, None]] = which[start : start + sizes.sum()]
        out.append(rows)
        start += sizes.sum()
    return out[0], out[1]


def _common_lengths(left: list[str], right: list[str]) -> np.ndarray:
    """Length of the longest common subsequence of each pair, all pairs at once.

    A bit for each letter of the left text, in words of 64 that pass a carry on; one step for each place of the right texts. Bits that
    are off mark the subsequence's letters.
    """
    words = max(1, -(-max(map(len, left)) // 64))
    a, b = _letters(left, right, 64 * words)
    open_ = np.full((len(left), words), ~np.uint64(0))
    for place in range(b.shape[1]):
        hits = np.packbits(a == b[:, place : place + 1], axis=1, bitorder="little").view("<u8") & open_
        carry = np.zeros(len(left), np.uint64)
        for w in range(words):
            old, hit = open_[:, w], hits[:, w]
            total = old + hit
            over = total < old
            total = total + carry
            carry = (over | (total < carry)).astype(np.uint64)
            open_[:, w] = total | (old & ~hit)
    return 64 * words - np.bitwise_count(open_).sum(axis=1, dtype=np.int64)


def indel_ratios(left: list[str], right: list[str]) -> np.ndarray:
    """0 to 100 for each pair of texts: twice the common letters over all letters; 100 for two empty ones."""
    sizes = np.array([[len(a), len(b)] for a, b in zip(left, right)], np.int64).reshape(-1, 2)
    common = np.zeros(len(left), np.int64)
    # pairs of about the same size together, so that little is filled up
    order = np.lexsort((sizes[:, 1], -(-sizes[:, 0] // 64)))
    order = order[sizes[order].min(axis=1) > 0]
    low = 0
    while low < len(order):
        words = -(-sizes[order[low], 0] // 64)
        high = min(len(order), low + max(1, CELLS // (64 * int(words))))
        high = low + int(np.searchsorted(-(-sizes[order[low:high], 0] // 64), words, side="right"))
        rows = order[low:high].tolist()
        common[rows] = _common_lengths([left[i] for i in rows], [right[i] for i in rows])
        low = high
    total = sizes.sum(axis=1)
    return np.where(total > 0, 200.0 * common / np.maximum(total, 1), 100.0)


@F.pandas_udf(DoubleType())
def _indel_ratio(left: pd.Series, right: pd.Series) -> pd.Series:
    both = (left.notna() & right.notna()).to_numpy()
    out = np.full(len(left), np.nan)
    out[both] = indel_ratios(left[both].tolist(), right[both].tolist())
    return pd.Series(out, dtype="float64").where(both)


# Marked so that a filter on the ratio reuses it instead of computing it a second time.
_indel_ratio_once = _indel_ratio.asNondeterministic()


def indel_ratio(a: Column, b: Column) -> Column:
    """0 to 100: twice the longest common subsequence over the summed lengths."""
    return _indel_ratio_once(a, b)
