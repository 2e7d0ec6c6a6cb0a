"""Toxicity from class-conditional Kneser-Ney models.

A model of toxic and one of ordinary words, by their letters, are counted from labelled texts: each letter follows from up to four
before it. Rare expressions back off through shorter histories to letter-pair counts that both models share and that come from
the whole corpus, so an unseen form of a toxic word is known by its stem, and a word that few texts have weighs little. Per word, the
two log-likelihoods give a ratio; a text is scored by its mean ratio and by that of its most toxic passage, both normalised by
length, calibrated on labelled texts that the models have not seen.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, Window

from vitrina.llm.base import free_name, small_batches, stored

# Bound of the labelled texts of each class that the models are counted from, and of those that calibrate the score.
FIT_ROWS = 3000
CALIBRATION_ROWS = 1500
# Letters of a gram, and the longest gram whose counts both classes share.
ORDER = 5
SHARED_ORDER = 2
# Taken off every count, by Kneser and Ney.
DISCOUNT = 0.75
# Words of a passage.
PASSAGE = 4
# Kinds of letters that are told apart, the commonest; others are one.
ALPHABET = 1000
TOXIC_FROM = 0.7
# Words whose letters are counted at once.
COUNTED_WORDS = 1 << 15
# Words in a generation of a worker's memory; bounds its size, not the result.
CACHE_WORDS = 1 << 17
_WORD = re.compile(r"[^\W_]+")


def words_of(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


class Letters(NamedTuple):
    """Numbers of letters: 0 is the edge of a word, 1 an unlisted letter."""

    listed: np.ndarray

    @property
    def base(self) -> int:
        return len(self.listed) + 2

    def numbers(self, text: str, other: int) -> np.ndarray:
        """A number for every letter of the text; ``other`` for what is not listed, line breaks as edges."""
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
        table = np.full(int(max(points.max(initial=0), self.listed.max(initial=0))) + 1, other, np.int64)
        table[self.listed] = np.arange(2, self.base)
        if len(table) > 10:
            table[10] = 0
        return table[points]

    def of_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Letters of all words with an edge around each; for every letter but the first, those up to its word's start and itself."""
        numbers = self.numbers("\n" + "\n".join(words) + "\n", 1)
        edges = np.flatnonzero(numbers[:-1] == 0)
        return numbers, np.arange(1, len(numbers)) - np.repeat(edges, np.diff(np.append(edges, len(numbers) - 1))) + 1


def codes(numbers: np.ndarray, at: np.ndarray, order: int, base: int) -> np.ndarray:
    """The grams of an order that end at the places ``at``, as numbers: the last letter is the lowest digit."""
    return sum(numbers[at - k] * base**k for k in range(order))


def find(table: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each wanted value is in a sorted table, and whether it is there."""
    if not len(table):
        return np.zeros(len(wanted), int), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(table, wanted), len(table) - 1)
    return at, table[at] == wanted


class Level(NamedTuple):
    """What the two classes say on one order: ratios of the grams that either knows, and of the histories for all other grams."""

    grams: np.ndarray
    ratio: np.ndarray
    histories: np.ndarray
    backoff: np.ndarray


class Model(NamedTuple):
    letters: Letters
    levels: dict[int, Level]
    weights: np.ndarray  # of the calibration: constant, mean, passage, log of the length
    empty: float  # score of a text without words

    def word_ratios(self, words: list[str]) -> np.ndarray:
        """Log-likelihood ratio of each word, over all its letters."""
        numbers, depth = self.letters.of_words(words)
        base, total, open_ = self.letters.base, np.zeros(len(depth)), np.ones(len(depth), bool)
        for order in range(ORDER, SHARED_ORDER, -1):
            level = self.levels[order]
            mine = np.flatnonzero(open_ & (depth >= order))
            own = codes(numbers, mine + 1, order, base)
            at, known = find(level.grams, own)
            total[mine[known]] += level.ratio[at[known]] if known.any() else 0.0
            open_[mine[known]] = False
            at, seen = find(level.histories, own[~known] // base)
            total[mine[~known][seen]] += level.backoff[at[seen]] if seen.any() else 0.0
        return np.add.reduceat(total, np.flatnonzero(numbers[:-1] == 0)) if words else np.zeros(0)


def features(ratios: np.ndarray) -> tuple[float, float, float]:
    """Mean ratio of a text's words, that of its most toxic passage, and the log of its length."""
    sums, size = np.concatenate(([0.0], np.cumsum(ratios))), min(len(ratios), PASSAGE)
    return sums[-1] / len(ratios), (sums[size:] - sums[:-size]).max() / size, np.log(len(ratios))


def text_features(model: Model, batches: Iterator[list[str | None]]) -> Iterator[list[tuple[float, float, float] | None]]:
    """Features of the texts of each batch, none without words; ratios of recent words are remembered."""
    new: dict[str, float] = {}
    old: dict[str, float] = {}
    for texts in batches:
        lists = [words_of(t) for t in texts]
        if len(new) > CACHE_WORDS:
            new, old = {}, new
        fresh = []
        for word in set().union(*lists):
            if word not in new:
                if word in old:
                    new[word] = old[word]
                else:
                    fresh.append(word)
        new.update(zip(fresh, model.word_ratios(fresh).tolist()))
        get = new.__getitem__
        yield [features(np.fromiter(map(get, words), float, len(words))) if words else None for words in lists]


def probability(model: Model, found: tuple[float, float, float] | None) -> float:
    if found is None:
        return model.empty
    z = float(model.weights[0] + model.weights[1:] @ np.array(found))
    return 1 / (1 + np.exp(-min(max(z, -30.0), 30.0)))


def held_out(key: Column) -> Column:
    """Rows whose labels are never learned from."""
    return F.crc32(key.cast("string")) % 3 == 1


def labelled_sample(labels: DataFrame, key: str, label: str) -> DataFrame:
    """``(key, toxic, fit)``: rows that may be learned from, at most ``FIT_ROWS`` of a class to fit and ``CALIBRATION_ROWS`` to calibrate.

    Two thirds of the rows by hash are for the fit; of each part the smallest hashes are taken. Of contradicting labels the larger counts.
    """
    rows = labels.filter(F.col(key).isNotNull() & F.col(label).isNotNull() & ~F.coalesce(held_out(F.col(key)), F.lit(True)))
    rows = rows.groupBy(F.col(key).alias("key")).agg((F.max(label) > 0).cast("int").alias("toxic"))
    rows = rows.withColumn("h", F.xxhash64(F.lit("labelled"), "key")).withColumn("fit", F.pmod("h", F.lit(3)) != 2)
    rows = stored(rows, "labels")
    limit = F.when(F.col("fit"), FIT_ROWS).otherwise(CALIBRATION_ROWS)
    # hashes are even over their range, so a share of it holds several times the rows wanted, at any number of rows
    reach = F.lit(None).cast("double")
    for toxic, fit_, n in rows.groupBy("toxic", "fit").count().collect():  # four rows
        share = min(1.0, (4 * max(FIT_ROWS, CALIBRATION_ROWS) + 1000) / n)
        reach = F.when((F.col("toxic") == toxic) & (F.col("fit") == fit_), (2 * share - 1) * 2.0**63).otherwise(reach)
    place = F.row_number().over(Window.partitionBy("toxic", "fit").orderBy("h", "key"))
    rows = rows.filter(F.col("h") <= reach).withColumn("place", place)
    return rows.filter(F.col("place") <= limit).select("key", "toxic", "fit")


def word_counts(texts: DataFrame) -> DataFrame:
    """``(toxic, word, n)``: in how many fitted texts of each class a word occurs, as a written table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: Counter = Counter()
            for toxic, text in zip(batch["toxic"].to_pylist(), batch["text"].to_pylist()):
                found.update((toxic, w) for w in set(words_of(text)))
            kinds, words = list(zip(*found)) or [(), ()]
            yield pa.record_batch([pa.array(kinds, pa.int32()), pa.array(words, pa.string()), pa.array(found.values(), pa.int64())], ["toxic", "word", "n"])

    rows = texts.select("toxic", "text").mapInArrow(run, "toxic int, word string, n long")
    return stored(rows.groupBy("toxic", "word").agg(F.sum("n").alias("n")), "labelled-words")


def listed_letters(words: DataFrame) -> Letters:
    """The ``ALPHABET`` commonest letters, ties to the smaller."""
    letters = words.select(F.explode(F.split("word", "")).alias("letter"), "n").groupBy("letter").agg(F.sum("n").alias("n"))
    listed = letters.orderBy(F.desc("n"), "letter").limit(ALPHABET).collect()
    return Letters(np.array(sorted(ord(r.letter) for r in listed), np.int64))


def shared_pairs(docs: DataFrame, letters: Letters) -> np.ndarray:
    """How often each letter follows each other one in all texts of the corpus; what is not listed ends a word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = letters.base
        found = np.zeros(base * base, np.int64)
        for batch in batches:
            numbers = letters.numbers("\n".join(t.lower() for t in batch["text"].to_pylist() if t), 0)
            found += np.bincount(numbers[:-1] * base + numbers[1:], minlength=base * base)
        at = np.flatnonzero(found)
        yield pa.record_batch([pa.array(at), pa.array(found[at])], ["id", "n"])

    rows = docs.select("text").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(letters.base**2, float)
    counts[rows["id"].to_numpy(int)] = rows["n"].to_numpy(float)
    return counts.reshape(letters.base, letters.base)


def pair_probability(pairs: np.ndarray) -> np.ndarray:
    """Interpolated probability of a letter after another, never 0, flattened in the order of the codes."""
    single = pairs.sum(0) + 1
    kinds, total = (pairs > 0).sum(1, keepdims=True), pairs.sum(1, keepdims=True)
    spread = DISCOUNT * kinds * (single / single.sum())
    return np.where(total > 0, (np.maximum(pairs - DISCOUNT, 0) + spread) / np.maximum(total, 1), single / single.sum()).ravel()


def gram_counts(words: DataFrame, letters: Letters) -> pd.DataFrame:
    """``(order, toxic, gram, n)``: grams of each order above the shared one in each class's words, summed in the tasks first.

    The longest order counts texts, the others the different letters before a gram; a gram that begins a word has none before it and
    counts once for each word. What reaches the driver are the different grams of the bounded sample.
    """
    shared = words.sparkSession.sparkContext.broadcast(letters)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters = shared.value
        for batch in batches:
            kinds, texts, times = batch["toxic"].to_numpy(), batch["word"].to_numpy(zero_copy_only=False), batch["n"].to_numpy()
            for toxic in np.unique(kinds):
                mine = np.flatnonzero(kinds == toxic)
                numbers, depth = letters.of_words(texts[mine].tolist())
                word = np.cumsum(numbers[:-1] == 0) - 1
                for order in range(SHARED_ORDER + 1, ORDER + 1):
                    at = np.flatnonzero(depth >= order if order == ORDER else depth == order)
                    found, place = np.unique(codes(numbers, at + 1, order, letters.base), return_inverse=True)
                    n = np.bincount(place, times[mine][word[at]] if order == ORDER else None, minlength=len(found)).astype(np.int64)
                    yield emit(toxic, order, False, found, n)
                    if order < ORDER:
                        found = np.unique(codes(numbers, np.flatnonzero(depth > order) + 1, order + 1, letters.base))
                        yield emit(toxic, order, True, found, np.ones(len(found), np.int64))

    def emit(toxic: int, order: int, longer: bool, gram: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        same = [pa.array(np.full(len(gram), v), t) for v, t in ((toxic, pa.int32()), (order, pa.int32()), (longer, pa.bool_()))]
        return pa.record_batch([*same, pa.array(gram, pa.int64()), pa.array(n)], ["toxic", "order", "longer", "gram", "n"])

    small_batches(words.sparkSession, COUNTED_WORDS)
    rows = words.select("toxic", "word", "n").mapInArrow(run, "toxic int, order int, longer boolean, gram long, n long")
    rows = stored(rows.groupBy("toxic", "order", "longer", "gram").agg(F.sum("n").alias("n")), "grams")
    small_batches(words.sparkSession)
    size = F.lit(None).cast("long")
    for order in range(SHARED_ORDER + 1, ORDER):
        size = F.when(F.col("order") == order, F.lit(letters.base**order)).otherwise(size)
    before = rows.filter("longer").select("toxic", "order", (F.col("gram") % size).alias("gram"), F.lit(1).cast("long").alias("n"))
    counted = rows.filter("not longer").select("toxic", "order", "gram", "n").unionByName(before)
    return counted.groupBy("order", "toxic", "gram").agg(F.sum("n").alias("n")).toPandas().sort_values("gram")


def fit_levels(letters: Letters, grams_of: pd.DataFrame, pairs: np.ndarray) -> dict[int, Level]:
    """Interpolated Kneser-Ney probabilities of both classes from the shared pairs up, as ratios."""
    base, levels = letters.base, {}
    below = [np.arange(base**SHARED_ORDER), *[pair_probability(pairs)] * 2]
    for order in range(SHARED_ORDER + 1, ORDER + 1):
        own = []
        for toxic in (1, 0):
            rows = grams_of[(grams_of["order"] == order) & (grams_of["toxic"] == toxic)]
            own.append((rows["gram"].to_numpy(np.int64), rows["n"].to_numpy(float)))
        grams = np.union1d(own[0][0], own[1][0])
        histories, of = np.unique(grams // base, return_inverse=True)
        at, _ = find(below[0], grams % base ** (order - 1))
        chances, backoffs = [], []
        for (known, n), lower in zip(own, below[1:]):
            counts = np.zeros(len(grams))
            counts[np.searchsorted(grams, known)] = n
            total = np.bincount(of, counts, minlength=len(histories))
            kinds = np.bincount(of, counts > 0, minlength=len(histories))
            backoff = np.where(total > 0, DISCOUNT * kinds / np.maximum(total, 1), 1.0)
            chances.append(np.maximum(counts - DISCOUNT, 0) / np.maximum(total, 1)[of] + backoff[of] * lower[at])
            backoffs.append(np.log(backoff))
        levels[order] = Level(grams, np.log(chances[0]) - np.log(chances[1]), histories, backoffs[0] - backoffs[1])
        below = [grams, *chances]
    return levels


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", label: str = "toxic") -> Model:
    """Count the models from labelled texts, the shared pairs from all texts, and calibrate."""
    small_batches(docs.sparkSession)
    sample = stored(labelled_sample(labels, key, label), "sample")
    texts = docs.select(F.col(key).alias("key"), "text").join(F.broadcast(sample), "key")  # bounded by the two limits
    texts = stored(texts, "labelled")
    share = labels.filter(~held_out(F.col(key))).agg(F.avg((F.col(label) > 0).cast("double"))).first()[0] or 0.0
    words = word_counts(texts.filter("fit"))
    letters = listed_letters(words)
    levels = fit_levels(letters, gram_counts(words, letters), shared_pairs(docs, letters))
    model = Model(letters, levels, np.zeros(4), float(share))
    return model._replace(weights=calibrate(texts.filter("not fit"), model, float(share)))


def calibrate(texts: DataFrame, model: Model, share: float) -> np.ndarray:
    """Logistic weights of the features, classes weighted to the ``share`` of toxic labels; one small row per text reaches the driver."""
    shared = texts.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[pa.Array] = []

        def lists() -> Iterator[list[str | None]]:
            for batch in batches:
                kept.append(batch["toxic"])
                yield batch["text"].to_pylist()

        for found in text_features(shared.value, lists()):
            toxic = kept.pop()
            rows = [(y, *f) for y, f in zip(toxic.to_pylist(), found) if f is not None]
            columns = list(zip(*rows)) or [()] * 4
            yield pa.record_batch([pa.array(columns[0], pa.int32()), *(pa.array(c, pa.float64()) for c in columns[1:])], ["toxic", "a", "b", "c"])

    rows = texts.select("toxic", "text").mapInArrow(run, "toxic int, a double, b double, c double").toPandas()
    y, x = rows["toxic"].to_numpy(float), rows[["a", "b", "c"]].to_numpy(float)
    if not 0 < share < 1 or not len(y) or not 0 < y.mean() < 1:
        return np.array([np.log(max(share, 1e-6) / max(1 - share, 1e-6)), 1.0, 1.0, 0.0])
    weight = np.where(y == 1, share / y.mean(), (1 - share) / (1 - y.mean()))
    middle, scale = x.mean(0), np.where(x.std(0) > 0, x.std(0), 1.0)
    design = np.column_stack([np.ones(len(x)), (x - middle) / scale])
    ridge = np.array([1e-6, *[0.1] * 3])
    beta = np.zeros(4)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        slope = design.T @ (weight * (p - y)) + ridge * beta
        bend = (design * (weight * p * (1 - p))[:, None]).T @ design + np.diag(ridge)
        step = np.linalg.solve(bend, slope)
        beta -= step
        if np.abs(step).max() < 1e-9:
            break
    return np.array([beta[0] - (beta[1:] * middle / scale).sum(), *(beta[1:] / scale)])


def score_column(docs: DataFrame, model: Model, text: str = "text") -> Column:
    """Score of a text column, between 0 and 1; null and empty texts get the share of toxic labels."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = shared.value
        for found in text_features(model, (list(batch) for batch in batches)):
            yield pd.Series([probability(model, f) for f in found], dtype="float64")

    return score(F.col(text))


def detect(docs: DataFrame, labels: DataFrame, key: str = "doc_id", label: str = "toxic") -> DataFrame:
    """``(key, held_out, score, predicted)`` of every row of ``docs``, whole texts.

    Null and empty texts, and all texts if there is no label of either kind, get the share of toxic labels; repeated rows score alike;
    a null key is not held out; an empty table gives no rows; columns other than the key and the text play no part.
    """
    model = fit(docs, labels, key, label)
    rows = docs.select(F.col(key), F.coalesce(held_out(F.col(key)), F.lit(False)).alias("held_out"), score_column(docs, model).alias("score"))
    return rows.withColumn("predicted", (F.col("score") >= TOXIC_FROM).cast("int"))


def accepted(docs: DataFrame, labels: DataFrame, key: str = "doc_id", label: str = "toxic") -> DataFrame:
    """The rows whose score stays below ``TOXIC_FROM``, all columns as they were, whatever their names.

    Rows without a text, or with an empty one, score the share of toxic labels, and a null key changes nothing; repeated rows and
    rows of equal texts stay or go together. An empty table, or labels of one kind only, are allowed.
    """
    model = fit(docs, labels, key, label)
    score = free_name(docs, "score")
    return docs.withColumn(score, score_column(docs, model)).filter(F.col(score) < TOXIC_FROM).drop(score)
