"""Mixing sources to target weights by Pareto order sampling.

Every document first gets the whole copies that its source's target makes certain. For the rest of the target, documents are ranked
by random odds divided by inclusion odds, and taken in that order until the source's words are used up. The random number is a
hash of the document's key, so a rerun mixes alike. The place where a source's words end is found from sums over narrowing bins
of the rank, never by sorting a source.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from vitrina.llm.base import free_name, numbered, stored

WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
MOST = 2.0
# Bins of the rank in each round.
BINS = (64, 4096, 4096)
# A table of sources is broadcast up to so many.
BROADCAST_SOURCES = 10_000
WORD = r"[^\x20\x09-\x0D]+"
# Length beyond which a document's inclusion odds fall, so that a few very long ones don't make up a source.
LONG = 1000.0


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def inclusion_odds(size: Column) -> Column:
    """Relative odds of a document among the others of its source."""
    return 1 / (1 + F.log1p(size / LONG))


def rank(key: Column, size: Column, seed: int) -> Column:
    """Random odds over inclusion odds, brought to (0, 1) in the same order."""
    u = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), key), 11) + 0.5) / float(1 << 53)
    q = u / (1 - u) / inclusion_odds(size)
    return q / (1 + q)


def source_targets(sizes: DataFrame, weights: Sequence[float], share: float, most: float) -> DataFrame:
    """Target of each ``(source, source_size)``: the total's share by weight, up to ``most`` times the source, excess reshared.

    Weights repeat over the sources by code point, null last. Every round caps the sources that are above and shares what they
    leave among the others; only two sums of a round reach the driver.
    """
    rows = numbered(sizes.withColumn("absent", F.col("source").isNull()), ["absent", "source"]).drop("absent")
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("position") % len(weights) + 1).cast("int"))
    rows = stored(rows.withColumn("weight", weight.cast("double")).withColumn("top", F.col("source_size") * most), "sources")
    total = share * (rows.agg(F.sum("source_size")).first()[0] or 0)
    level, capped = 0.0, -1
    while True:
        over = F.col("top") <= F.col("weight") * level
        n, kept, free = rows.agg(
            F.count_if(over), F.coalesce(F.sum(F.when(over, F.col("top"))), F.lit(0.0)),
            F.coalesce(F.sum(F.when(~over, F.col("weight"))), F.lit(0.0))).first()
        if n == capped or not free:
            break
        level, capped = (total - kept) / free, n
    return rows.select("source", "source_size", F.least("top", F.col("weight") * level).alias("target"))


def by_source(rows: DataFrame, table: DataFrame) -> DataFrame:
    """Rows with the columns of their source's row in a table that was written before; broadcast only if it is short."""
    table = table.withColumnRenamed("source", "source_")
    small = F.broadcast(table) if table.count() <= BROADCAST_SOURCES else table
    return rows.join(small, F.col("source").eqNullSafe(F.col("source_"))).drop("source_")


def in_spans(z: Column, size: Column) -> Column:
    """Whether a row of a source is among those that its ``spans`` take: ranks from ``a`` to before ``b``, up to ``most`` words."""
    return F.exists("spans", lambda s: (z >= s["a"]) & (z < s["b"]) & (size <= s["most"]))


def last_fill(rows: DataFrame, at: DataFrame) -> DataFrame:
    """Every source's ``fill``: of the documents it has not taken, the one that brings it nearest to its target, if any does."""
    gap = F.abs(F.col("left") - F.col("words"))
    rest = by_source(rows, at).filter(~in_spans(F.col("z"), F.col("size")) & (F.col("size") < 2 * F.col("left")))
    rest = rest.groupBy("source", "left", F.struct("z", "id", "size").alias("own")).agg(F.sum("size").alias("words"))
    return rest.filter(gap < F.col("left")).groupBy("source").agg(F.min_by("own", F.struct(gap, "own")).alias("fill"))


def last_places(rows: DataFrame, targets: DataFrame) -> DataFrame:
    """Per source: whole copies, the ``spans`` of ranks whose documents get one more, and a last document to ``fill`` the rest.

    ``rows``: source, id, size, z. Bins of the rank are looked into further only where the words end. The documents in that place don't
    fit; those after it that are no longer than what is left go on in rank order, until none is left that fits. What is left then
    is less than any of them, and the nearest document may take it. Rows alike in all four columns are taken together.
    """
    whole = F.coalesce(F.floor(F.col("target") / F.nullif("source_size", F.lit(0))), F.lit(0)).cast("int")
    sources = targets.withColumn("whole", whole)
    want = F.col("target") - F.col("whole") * F.col("source_size")
    none = F.array().cast("array<struct<a:double,b:double,most:double>>")
    at = stored(sources.select("source", F.lit(0.0).alias("low"), want.alias("left"), none.alias("spans"), F.lit(True).alias("open")), "ends")
    rows = rows.filter("size > 0")
    while not at.filter("open").isEmpty():
        start = at.filter("open").select("source", F.col("low").alias("begin"), F.col("left").alias("most"))
        fits = by_source(rows, start).filter((F.col("z") >= F.col("begin")) & (F.col("size") <= F.col("most"))).drop("begin", "most")
        ends, width = start.select("source", F.col("begin").alias("low"), F.col("most").alias("left")), 1.0
        for bins in BINS:
            inside = by_source(fits, ends).filter((F.col("z") >= F.col("low")) & (F.col("z") < F.col("low") + width))
            width /= bins
            place = F.least(F.floor((F.col("z") - F.col("low")) / width), F.lit(bins - 1))
            sums = inside.groupBy("source", "low", "left", place.alias("bin")).agg(F.sum("size").alias("words"))
            upto = F.sum("words").over(Window.partitionBy("source").orderBy("bin"))  # at most ``bins`` rows for a source
            sums = sums.withColumn("before", upto - F.col("words"))
            over = F.col("before") + F.col("words") > F.col("left")
            if width * bins == 1.0:  # sources without such a place take all that fit
                totals = stored(sums.groupBy("source").agg(F.sum("words").alias("all")), "totals")
            ends = sums.filter(over).groupBy("source").agg(F.min_by(F.struct("low", "left", "bin", "before"), "bin").alias("e"))
            low, left = F.col("e.low") + F.col("e.bin") * width, F.col("e.left") - F.col("e.before")
            ends = stored(ends.select("source", low.alias("low"), left.alias("left")), "ends")
        ends = ends.select(F.col("source").alias("s"), F.col("low").alias("end"), F.col("left").alias("rest"))
        more = at.join(ends, F.col("source").eqNullSafe(F.col("s")) & F.col("open"), "left").withColumn("stop", F.col("end").isNotNull()).drop("s")
        more = more.join(totals.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")) & F.col("open"), "left").drop("s")
        span = F.struct(F.col("low").alias("a"), F.coalesce("end", F.lit(1.0)).alias("b"), F.col("left").alias("most"))
        span = span.cast("struct<a:double,b:double,most:double>")
        left = F.when(F.col("stop"), F.col("rest")).otherwise(F.col("left") - F.coalesce("all", F.lit(0)))
        at = stored(more.select(
            "source", F.coalesce(F.col("end") + width, F.col("low")).alias("low"), F.when(F.col("open"), left).otherwise(F.col("left")).alias("left"),
            F.when(F.col("open"), F.array_append("spans", span)).otherwise(F.col("spans")).alias("spans"), F.col("stop").alias("open")), "ends")
    places = sources.select(F.col("source"), "source_size", "target", "whole")
    for more in (at.select("source", "spans"), last_fill(rows, at.select("source", "left", "spans"))):
        more = more.withColumnRenamed("source", "source_")
        places = places.join(more, F.col("source").eqNullSafe(F.col("source_")), "left").drop("source_")
    return stored(places, "places")


def places_for(rows: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    sizes = stored(rows.groupBy("source").agg(F.sum("size").alias("source_size")), "sizes")
    return last_places(rows, source_targets(sizes, weights, share, most))


def narrow(docs: DataFrame, key: str, seed: int) -> DataFrame:
    """``(id, source, size, z)`` of every row; rows with a null key are told apart by their text."""
    size = word_count(F.col("text"))
    hashed = F.xxhash64(F.col(key), F.when(F.col(key).isNull(), F.col("text")))
    rows = docs.select(F.col(key).alias("id"), "source", size.alias("size"), hashed.alias("h"))
    return rows.select("id", "source", "size", rank(F.col("h"), F.col("size"), seed).alias("z"))


def taken_copies(rows: DataFrame, places: DataFrame) -> DataFrame:
    """Rows of ``narrow`` with what their source gets and the copies that the mix takes of them."""
    chosen = in_spans(F.col("z"), F.col("size")) | F.col("fill").eqNullSafe(F.struct("z", "id", "size"))
    more = F.when((F.col("size") > 0) & F.coalesce(chosen, F.lit(False)), 1).otherwise(0)
    return by_source(rows, places).withColumn("copies", F.col("whole") + more)


def mix(docs: DataFrame, key: str = "doc_id", seed: int = 0, **targets) -> DataFrame:
    """``(doc_id, size, source_size, target, taken)`` of every row: its words, its source's words and target, and the words taken.

    ``targets``: ``weights``, ``share`` and ``most`` of ``source_targets``. A null text has size 0 and is taken with no words; a null
    source is a source; repeated rows are taken alike; an empty table gives no rows; other columns play no part.
    """
    rows = stored(narrow(docs, key, seed), "sizes")
    found = taken_copies(rows, places_for(rows, **targets))
    return found.select(F.col("id").alias("doc_id"), "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def mixed(docs: DataFrame, key: str = "doc_id", seed: int = 0, **targets) -> DataFrame:
    """The mix itself: every row as often as it is taken, all columns as they were; rows without words go with the whole copies."""
    places = places_for(stored(narrow(docs, key, seed), "sizes"), **targets)
    row = free_name(docs, "row")
    wide = docs.select(F.struct(*docs.columns).alias(row), F.col(key).alias("id"), "source", word_count(F.col("text")).alias("size"))
    hashed = F.xxhash64(F.col("id"), F.when(F.col("id").isNull(), F.col(row)["text"]))
    wide = wide.withColumn("z", rank(hashed, F.col("size"), seed))
    often = taken_copies(wide, places).filter("copies > 0")
    return often.select(F.explode(F.array_repeat(row, F.col("copies").cast("int"))).alias(row)).select(f"{row}.*")
