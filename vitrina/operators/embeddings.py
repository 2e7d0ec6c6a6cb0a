"""Groups of phrases by the cosine of their mean word vectors."""

from __future__ import annotations

import math

import numpy as np
from pyspark.ml.feature import Word2Vec
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, functions as F

from vitrina.functions.vectors import dot, norm
from vitrina.operators.matching import BLOCK, greedy_groups
from vitrina.session import cut_lineage

# Pivots of the blocking cells, and the vectors they are chosen among.
PIVOTS = 64
PIVOT_SAMPLE = 2048


def phrase_vectors(items: DataFrame, size: int = 150, window: int = 5, min_count: int = 1, seed: int = 42, epochs: int = 15,
                   partitions: int | None = None) -> DataFrame:
    """Unit vector of each phrase: mean of the vectors of its words, learnt from the phrases themselves.

    Training is shared out over ``partitions`` tasks, by default as many as the session runs at once.
    """
    partitions = partitions or items.sparkSession.sparkContext.defaultParallelism
    words = items.withColumn("_words", F.split("text", " "))
    model = Word2Vec(vectorSize=size, windowSize=window, minCount=min_count, maxIter=epochs, seed=seed, numPartitions=partitions,
                     inputCol="_words", outputCol="_vector").fit(words)
    vectors = model.transform(words).withColumn("_mean", vector_to_array("_vector"))
    length = norm(F.col("_mean"))
    unit = F.when(length > 0, F.transform("_mean", lambda x: x / length)).otherwise(F.col("_mean"))
    return vectors.select("item", "text", unit.alias("vector"))


def choose_pivots(vectors: DataFrame, threshold: float, pivots: int = PIVOTS, sample: int = PIVOT_SAMPLE) -> np.ndarray:
    """At most ``pivots`` unit vectors of a bounded sample, each the one least like all before, none as similar as ``threshold``.

    The sample decides how well the cells prune and never which pairs are found.
    """
    rows = vectors.filter(norm(F.col("vector")) > 0).orderBy(F.xxhash64("item"), "item").limit(sample).select("vector").collect()
    if not rows:
        return np.zeros((0, 0))
    points = np.array([r["vector"] for r in rows])
    chosen, best = [0], points @ points[0]
    while len(chosen) < pivots and best.min() < min(threshold, 0.999):
        chosen.append(int(best.argmin()))
        best = np.maximum(best, points @ points[chosen[-1]])
    return points[chosen]


def pivot_cells(vectors: DataFrame, pivots: np.ndarray, threshold: float) -> DataFrame:
    """``item, vector`` with ``_home``, the cell of the likeliest pivot, and ``_keys``, all cells whose vectors could be similar enough.

    The plane halfway between two pivots parts their cells. A vector at an angle ``a`` beyond the plane is at least that far from
    every vector of the other cell, so it joins that cell only if ``sin a`` is within the sine of the threshold's angle.
    """
    if len(pivots) < 2 or threshold <= 0:
        return vectors.select("item", "vector", F.lit(0).alias("_home"), F.array(F.lit(0)).alias("_keys"))
    reach = math.sqrt(1 - threshold**2) + 1e-9
    # a pivot is 1 away from itself here, which keeps every vector in its own cell
    gaps = np.sqrt(np.maximum(2 - 2 * pivots @ pivots.T, 0.0)) + np.eye(len(pivots))
    table = lambda m: F.array(*[F.array(*map(F.lit, row)) for row in m.tolist()])
    likeness = F.transform(table(pivots), lambda p: dot(p, F.col("vector")))
    home = (F.array_position("_likeness", F.array_max("_likeness")) - 1).cast("int")
    far = F.zip_with("_likeness", F.get(table(gaps), F.col("_home")), lambda x, gap: (F.array_max("_likeness") - x) / gap)
    cells = F.filter(F.transform(far, lambda x, i: F.when(x <= reach, i)), lambda i: i.isNotNull())
    found = vectors.select("item", "vector", likeness.alias("_likeness")).withColumn("_home", home)
    return found.select("item", "vector", "_home", cells.alias("_keys"))


def close_pairs(left: DataFrame, right: DataFrame, threshold: float) -> DataFrame:
    """Pairs ``(a, b)`` of items of ``pivot_cells``, a before b, with a cosine of at least ``threshold``.

    The earlier item meets the later one in its home cell alone, so that each pair is formed at most once.
    """
    a = left.select(F.col("item").alias("a"), F.col("vector").alias("va"), F.col("_home").alias("_cell"))
    b = right.select(F.col("item").alias("b"), F.col("vector").alias("vb"), F.explode("_keys").alias("_cell"))
    return a.join(b, "_cell").filter((F.col("a") < F.col("b")) & (dot(F.col("va"), F.col("vb")) >= threshold)).select("a", "b")


def vector_groups(vectors: DataFrame, threshold: float = 0.7, block: int = BLOCK) -> DataFrame:
    """Greedy groups ``(item, leader)`` of unit vectors ``(item, vector)`` with cosine of at least ``threshold`` to their leader.

    Zero vectors stay alone.
    """
    keyed = cut_lineage(pivot_cells(vectors, choose_pivots(vectors, threshold), threshold))
    return greedy_groups(keyed, lambda a, b: close_pairs(a, b, threshold), "first", block)


def embedding_groups(items: DataFrame, threshold: float = 0.7, block: int = BLOCK, **word2vec: int) -> DataFrame:
    """Greedy groups ``(item, leader)`` of phrases with cosine of at least ``threshold`` to their leader."""
    return vector_groups(cut_lineage(phrase_vectors(items, **word2vec)).select("item", "vector"), threshold, block)
