"""Spelling variants: words one edit apart, found through neighbourhoods over a reduced alphabet.

Letters are hashed to a few symbols, so a word becomes a short string that few others share, and all its one-edit neighbours over those
symbols can be listed: some 16 for each letter instead of 180. Two words at one edit have reduced forms that are equal or at one
edit, so every word's neighbourhood is joined with the vocabulary by its reduced forms, and pairs are verified on the words
themselves. A reduced form that very many words share is joined by the words with one letter left out as well, which no more words share
than the alphabet has letters for each place. Each word then points to its commonest near word, and pointers are followed by doubling.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from vitrina.llm.base import small_batches, stored

LEAST_LETTERS = 6
LEAST_COUNT = 5
# A near word names the form of another if it occurs this many times as often.
DOMINANCE = 5
# Of how many (document, word) pairs one has a letter taken out.
THINNED = 199
# Symbols of the reduced alphabet.
SYMBOLS = 8
# Words of one reduced form from which it is joined with a letter left out, too.
HOT_WORDS = 500
# Different words that a task counts before it passes them on.
COUNTED_WORDS = 1 << 18
_RUN = re.compile("[a-zÀ-ÿ]+")


def runs(text: str | None) -> list[str]:
    """Maximal runs of letters, A-Z lower-cased only; none for null."""
    return _RUN.findall(text.encode().lower().decode()) if text else []


def thinned(key: str, run: str) -> str:
    """The run, less one letter if the document and it are dealt out to lose one."""
    h = zlib.crc32(f"{key}:{run}".encode())
    if h % THINNED:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def word_counts(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(word, n)`` of all words of ``LEAST_LETTERS`` letters that occur ``LEAST_COUNT`` times in all documents together.

    A null key is dealt out as an empty one; repeated rows count each.
    """
    small_batches(docs.sparkSession)

    def batch_of(found: Counter) -> pa.RecordBatch:
        return pa.record_batch([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], ["word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()
        for batch in batches:
            for name, body in zip(batch["key"].to_pylist(), batch["text"].to_pylist()):
                for word, n in Counter(runs(body)).items():
                    if len(word) >= LEAST_LETTERS and len(kept := thinned(name, word)) >= LEAST_LETTERS:
                        found[kept] += n
            if len(found) > COUNTED_WORDS:
                yield batch_of(found)
                found = Counter()
        yield batch_of(found)

    rows = docs.select(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("key"), F.col(text).alias("text"))
    counted = rows.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return counted.filter(F.col("n") >= LEAST_COUNT)


def symbol(letter: str) -> str:
    return chr(97 + xxhash.xxh32_intdigest(letter.encode("utf-8", "surrogatepass"), 7) % SYMBOLS)


def reduced(word: str, remembered: dict[str, str]) -> str:
    for letter in set(word) - remembered.keys():
        remembered[letter] = symbol(letter)
    return "".join(map(remembered.__getitem__, word))


def neighbourhood(form: str) -> set[str]:
    """A reduced form and all at one edit from it."""
    letters = [chr(97 + i) for i in range(SYMBOLS)]
    found = {form}
    for i in range(len(form) + 1):
        head, tail = form[:i], form[i:]
        found.update(head + x + tail for x in letters)
        if tail:
            found.add(head + tail[1:])
            found.update(head + x + tail[1:] for x in letters)
    return found


def _keyed(words: DataFrame, around: bool) -> DataFrame:
    """``(form, word, n)`` for the reduced form of each word or, ``around`` it, all forms of its neighbourhood; forms as hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        remembered: dict[str, str] = {}
        for batch in batches:
            forms, places = [], []
            for i, word in enumerate(batch["word"].to_pylist()):
                own = reduced(word, remembered)
                for form in neighbourhood(own) if around else (own,):
                    forms.append(xxhash.xxh3_64_intdigest(form.encode()) - (1 << 63))
                    places.append(i)
            at = pa.array(places, pa.int64())
            yield pa.record_batch([pa.array(forms, pa.int64()), batch["word"].take(at), batch["n"].take(at)], ["form", "word", "n"])

    small_batches(words.sparkSession, 2048)
    return words.select("word", "n").mapInArrow(run, "form long, word string, n long")


def _left_out(word: Column) -> Column:
    """Hashes of the word and of all it gives with one letter left out."""
    at = F.sequence(F.lit(1), F.char_length(word))
    shorter = F.transform(at, lambda i: F.xxhash64(F.concat(F.substring(word, F.lit(1), i - 1), F.substring(word, i + 1, F.char_length(word)))))
    return F.array_distinct(F.concat(F.array(F.xxhash64(word)), shorter))


def near_words(words: DataFrame) -> DataFrame:
    """``(word, n, near, near_n)``: every ordered pair of words at exactly one inserted, deleted or replaced letter."""
    own = stored(_keyed(words, False), "reduced")
    around = _keyed(words, True)
    hot = stored(own.groupBy("form").agg(F.count(F.lit(1)).alias("size")).filter(F.col("size") > HOT_WORDS).select("form"), "hot-forms")
    one_edit = F.levenshtein("word", "near", 1) == 1
    second = own.select("form", F.col("word").alias("near"), F.col("n").alias("near_n"))
    if hot.isEmpty():
        return around.join(second, "form").filter(one_edit).drop("form")
    cold = around.join(hot, "form", "left_anti").join(second.join(hot, "form", "left_anti"), "form").filter(one_edit).drop("form")
    left = around.join(hot, "form", "left_semi").withColumn("part", F.explode(_left_out(F.col("word"))))
    right = second.join(hot, "form", "left_semi").withColumn("part", F.explode(_left_out(F.col("near"))))
    # two words can share several parts, but a pair meets in one reduced form only
    return cold.unionByName(left.join(right, ["form", "part"]).filter(one_edit).drop("form", "part").distinct())


def _roots(forms: DataFrame) -> DataFrame:
    """``(word, root)``: where the pointers ``(word, form)`` lead in the end; each round doubles the way that a pointer goes."""
    at = stored(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        onward = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = stored(at.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        at = moved.select("word", "root")
        if moved.filter("moved").isEmpty():
            return at


def group_variants(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(word, form, root, n, n_near, form_n)`` of every word.

    ``form`` is the near word that occurs most, the first in code-point order of equals, if it occurs ``DOMINANCE`` times as often, else
    null; ``root`` is where forms lead in the end, the word itself without one. A form occurs more often than its word, so the
    way ends. Null and empty texts have no words; repeated rows count each; an empty table gives no rows; other columns play no part.
    """
    spark = docs.sparkSession
    words = stored(word_counts(docs, key, text), "words")
    tasks = max(1, spark.sparkContext.defaultParallelism)
    near = near_words(words.repartition(tasks, "word"))
    small_batches(spark)
    first = F.min(F.struct((-F.col("near_n")).alias("less"), "near"))  # strings compare by their UTF-8 bytes, as code points do
    best = near.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), first.alias("first"))
    found = words.join(best, "word", "left").withColumn("dominant", -F.col("first.less") >= DOMINANCE * F.col("n"))
    found = stored(found.select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(F.col("dominant"), F.col("first.near")).alias("form"), F.when(F.col("dominant"), -F.col("first.less")).alias("form_n")), "forms")
    roots = _roots(found.filter("form is not null"))
    return found.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
