"""String expressions: accents, cleaning, labels and keys. All of them stay inside the JVM."""

from __future__ import annotations

import functools
import glob
import os
import unicodedata
import zipfile
from collections.abc import Mapping, Sequence

import pyspark
from pyspark import SparkContext
from pyspark.ml.feature import StopWordsRemover
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StringType

from vitrina.operators.lookup import attach

# Canonical category spellings.
CATEGORY_ALIASES = {"consolas": "consola", "Celular": "celular", "Consola": "consola"}

# Store address -> alias.
STORE_ALIASES = {
    "https://www.alkosto.com/": "retail_1",
    "https://www.exito.com/": "retail_2",
    "https://www.falabella.com.co/falabella-co": "retail_3",
    "https://www.mercadolibre.com.co/": "retail_4",
    "https://www.tiendasmetro.co/": "retail_5",
}

# Sentiment label -> number.
POLARITY_NUMBERS = {"negativo": -1, "neutral": 0, "positivo": 1}

# Letters that have no canonical decomposition but a customary ascii spelling.
_SPELLED = {"ß": "ss", "æ": "ae", "œ": "oe", "ø": "o", "Æ": "AE", "Œ": "OE", "Ø": "O"}


@functools.cache
def _accent_table() -> tuple[str, str]:
    """Latin letters with marks and their base letters; bare marks come last and are deleted."""
    marked, base = [], []
    for code in (*range(0x00C0, 0x0250), *range(0x1E00, 0x1F00)):
        char = chr(code)
        plain = "".join(c for c in unicodedata.normalize("NFD", char) if not unicodedata.combining(c))
        if len(plain) == 1 and plain != char:
            marked.append(char)
            base.append(plain)
    marks = "".join(chr(code) for code in range(0x0300, 0x0370))
    return "".join(marked) + marks, "".join(base)


@functools.cache
def _compatibility_table() -> tuple[str, str, dict[str, str]]:
    """Signs that NFKD turns into ascii: one-to-one pairs, and those that need several letters."""
    single_from, single_to, spelled = [], [], {}
    for code in (*range(0x00A0, 0x00C0), *range(0x2000, 0x2190), *range(0xFB00, 0xFB07), *range(0xFF01, 0xFF5F)):
        char = chr(code)
        plain = unicodedata.normalize("NFKD", char).encode("ascii", "ignore").decode()
        if len(plain) == 1:
            single_from.append(char)
            single_to.append(plain)
        elif plain:
            spelled[char] = plain
    return "".join(single_from), "".join(single_to), spelled


def _spell_out(text: Column, table: Mapping[str, str], present: str) -> Column:
    """Expand letters into several; texts without a match of the class ``present`` are passed on.

    The one-element array binds the text to a variable, so that it is computed once.
    """

    pairs = F.create_map(*[F.lit(part) for pair in table.items() for part in pair])

    def letter(char: Column) -> Column:
        return F.when(char <= "~", char).otherwise(F.coalesce(F.try_element_at(pairs, char), char))

    def expand(value: Column) -> Column:
        spelled = F.array_join(F.transform(F.split(value, ""), letter), "")
        return F.when(value.rlike(present), spelled).otherwise(value)

    return F.transform(F.array(text), expand)[0]


def strip_accents(text: Column) -> Column:
    """Base letters without their marks; every other character is kept."""
    return F.translate(text, *_accent_table())


def to_ascii(text: Column) -> Column:
    """Compatibility decomposition to ascii; what has no ascii form is dropped."""
    single_from, single_to, spelled = _compatibility_table()
    folded = F.translate(strip_accents(text), single_from, single_to)
    return F.regexp_replace(_spell_out(folded, spelled, "[\u00a0-\u00bf\u2000-\u218f\ufb00-\ufb06]"), r"[^\x00-\x7F]", "")


def transliterate(text: Column) -> Column:
    """Nearest ascii spelling of Latin text; other scripts are dropped."""
    return to_ascii(_spell_out(text, _SPELLED, "[" + "".join(_SPELLED) + "]"))


@functools.cache
def stop_words(language: str = "spanish") -> tuple[str, ...]:
    """The stop word list that ships with Spark ML."""
    if SparkContext._active_spark_context is not None:
        return tuple(StopWordsRemover.loadDefaultStopWords(language))
    home = os.environ.get("SPARK_HOME") or os.path.dirname(pyspark.__file__)
    jar = glob.glob(os.path.join(home, "jars", "spark-mllib_*.jar"))[0]
    with zipfile.ZipFile(jar) as archive:
        listing = archive.read(f"org/apache/spark/ml/feature/stopwords/{language}.txt").decode()
    return tuple(listing.split("\n")) if not listing.endswith("\n") else tuple(listing[:-1].split("\n"))


def squeeze_blanks(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def drop_stop_words(tokens: Column, words: Sequence[str] | None = None) -> Column:
    """Array without the listed words; the literal list becomes a hash set in the plan."""
    words = list(stop_words() if words is None else words)
    return F.filter(tokens, lambda token: ~token.isin(words))


def normalised_words(text: Column) -> Column:
    """Lower-case ascii letters, digits and single blanks."""
    return squeeze_blanks(F.regexp_replace(transliterate(F.lower(text)), "[^a-z0-9 ]", ""))


def clean_text(text: Column, words: Sequence[str] | None = None) -> Column:
    """Normalised words without stop words; NULL stays NULL."""
    return F.array_join(drop_stop_words(F.split(normalised_words(text), " "), words), " ")


def remove_stopwords(text: Column, words: Sequence[str] | None = None) -> Column:
    return F.array_join(drop_stop_words(F.split(text, " "), words), " ")


def lemmatise(df: DataFrame, text: str, lemmas: DataFrame, key: str) -> DataFrame:
    """Replace each token by its lemma from a ``(form, lemma)`` table, as ``<text>_lemmas``; unknown tokens stay and NULL stays NULL.

    ``key`` tells the texts apart. The texts are partitioned by it before they are tokens. A table of bounded size is broadcast to the
    tokens, which are then not shuffled at all; a larger one takes a join on the form, whose hot forms adaptive execution splits. Of
    several lemmas of a form the first in order counts.
    """
    listed = lemmas.groupBy("form").agg(F.min("lemma").alias("lemma"))
    tokens = df.select(key, text).repartition(key).select(key, F.posexplode(F.split(text, " ")).alias("_pos", "form"))
    looked_up = attach(tokens, listed, ["form"]).groupBy(key).agg(
        F.array_sort(F.collect_list(F.struct("_pos", F.coalesce("lemma", "form").alias("word")))).alias("_words")
    )
    joined = looked_up.select(key, F.array_join(F.transform("_words", lambda w: w["word"]), " ").alias(f"{text}_lemmas"))
    return df.join(joined, key, "left")


def clean_text_lemmas(df: DataFrame, text: str, lemmas: DataFrame, key: str, words: Sequence[str] | None = None) -> DataFrame:
    """``clean_text`` with its last step: normalised words without stop words, each replaced by its lemma, as ``<text>_clean``."""
    cleaned = lemmatise(df.withColumn("_cleaned", clean_text(F.col(text), words)), "_cleaned", lemmas, key)
    return cleaned.withColumnRenamed("_cleaned_lemmas", f"{text}_clean").drop("_cleaned")


def newline_to_space(df: DataFrame) -> DataFrame:
    """Newlines become blanks in every string column."""
    names = {f.name for f in df.schema.fields if isinstance(f.dataType, StringType)}
    return df.select([F.translate(c, "\n", " ").alias(c) if c in names else F.col(c) for c in df.columns])


def strip_review_marks(text: Column) -> Column:
    """Commas, semicolons, dots and line ends are removed anywhere."""
    return F.translate(text, ",;.\n\r", "")


def trim_all(text: Column) -> Column:
    """White space of any kind is cut off at both ends."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def map_values(value: Column, table: Mapping[str, object]) -> Column:
    """Literal lookup; NULL where the value is not listed."""
    pairs = [F.lit(part) for pair in table.items() for part in pair]
    return F.try_element_at(F.create_map(*pairs), value)


def canonical_category(category: Column, aliases: Mapping[str, str] = CATEGORY_ALIASES) -> Column:
    return F.coalesce(map_values(category, aliases), category)


def alias_store(store: Column, aliases: Mapping[str, str] = STORE_ALIASES) -> Column:
    return F.coalesce(map_values(store, aliases), store)


def drop_by_mark(brand: Column) -> Column:
    """The literal ``"por "`` is removed wherever it stands, inside words too."""
    return F.replace(brand, F.lit("por "), F.lit(""))


def normalise_brand(brand: Column) -> Column:
    """Lower case, trimmed, no leading ``por``, single blanks."""
    return F.regexp_replace(F.regexp_replace(F.trim(F.lower(brand)), r"^por\s+", ""), r"\s+", " ")


def clean_brand(brand: Column) -> Column:
    return normalise_brand(drop_by_mark(brand))


def concat_features(*parts: Column | str) -> Column:
    """Texts joined by one blank; missing parts are skipped."""
    return F.concat_ws(" ", *parts)


def match_text(category: Column, description: Column, kind: Column, brand: Column) -> Column:
    """Matching key: one blank after the category, none before kind and brand; NULL if any is NULL."""
    return F.concat(category, F.lit(" "), description, kind, brand)


def spec_pair_text(prop: Column, value: Column) -> Column:
    return F.concat(prop, F.lit(": "), value)


def map_labels(label: Column, numbers: Mapping[str, int] = POLARITY_NUMBERS) -> Column:
    return map_values(label, numbers)


def truncate_tokens(text: Column, limit: int = 512) -> Column:
    """The first ``limit`` tokens joined by one blank, as the input of a length-bound model."""
    return F.array_join(F.slice(F.split(trim_all(text), r"\s+"), 1, limit), " ")


def normalise_key(name: Column) -> Column:
    return F.lower(trim_all(name))


def word_tokens(text: Column) -> Column:
    """Lower-case runs of two or more letters, digits or underscores."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}_]{2,}"), F.lit(0))
