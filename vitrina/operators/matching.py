"""Near-duplicate texts: similarity join, greedy leader groups, group numbers and reports."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from vitrina.functions.similarity import indel_ratio
from vitrina.operators.lookup import attach
from vitrina.session import cut_lineage

# Leaders are looked for among the undecided of the next BLOCK items at first and of four times as many
# in each further round, unless these would meet in more than PAIR_BUDGET candidate pairs.
BLOCK = 4096
BLOCK_GROWTH = 4
PAIR_BUDGET = 200_000_000

Pairs = Callable[[DataFrame, DataFrame], DataFrame]


def _lost_bigrams(length: Column, t: float) -> Column:
    """Most bigrams a text can lose on the way to any partner that is at least ``t`` similar.

    With lengths l and m at least t(l + m) / 2 letters stay. Each of the others lost takes two bigrams
    along and each letter put in between breaks one: at most l(2 - 1.5t) + m(1 - 1.5t), which is
    greatest at the shortest or the longest partner, tl / (2 - t) or l(2 - t) / t.
    """
    shortest, longest = t / (2 - t), (2 - t) / t
    share = 2 - 1.5 * t + max(shortest * (1 - 1.5 * t), longest * (1 - 1.5 * t))
    return F.floor(length * share + 1e-9)


def _lost_letters(length: Column, t: float) -> Column:
    return F.floor(length * (2 - 2 * t) / (2 - t) + 1e-9)


def prefix_keys(items: DataFrame, threshold: float) -> DataFrame:
    """Blocking keys in an array column ``_keys``: two texts that are similar enough share a key.

    Rare bigrams come first; as many are kept as the threshold lets a partner miss, plus one. Texts
    so short that a partner could miss them all are keyed by letters in the same way.
    """
    t = threshold / 100.0
    length = F.length("text")
    short = _lost_bigrams(length, t) + 1 > length - 1
    pairs = F.transform(F.sequence(F.lit(1), F.greatest(length - 1, F.lit(1))), lambda i: F.substring(F.col("text"), i, F.lit(2)))
    letters = F.split("text", "")
    texts = items.select("text").distinct()
    grams = texts.select("text", F.inline(F.array(
        F.struct(F.lit(False).alias("_short"), pairs.alias("_grams"), (_lost_bigrams(length, t) + 1).alias("_keep")),
        F.struct(F.lit(True).alias("_short"), F.when(short, letters).alias("_grams"), (_lost_letters(length, t) + 1).alias("_keep")),
    ))).filter("_grams IS NOT NULL")
    # A gram that occurs n times counts as n different ones.
    counted = grams.select("text", "_short", "_keep", F.explode("_grams").alias("_gram")).groupBy(
        "text", "_short", "_keep", "_gram").agg(F.count(F.lit(1)).alias("_n"))
    entries = counted.select("text", "_short", "_keep", F.explode(F.sequence(F.lit(1), F.col("_n"))).alias("_k"), "_gram").select(
        "text", "_short", "_keep", F.xxhash64("_gram", "_k").alias("_gram"))
    frequency = entries.groupBy("_short", "_gram").agg(F.count(F.lit(1)).alias("_df"))
    ordered = attach(entries, frequency, ["_short", "_gram"], how="inner").groupBy("text", "_short", "_keep").agg(
        F.array_sort(F.collect_list(F.struct("_df", "_gram"))).alias("_sorted"))
    kept = ordered.select("text", F.transform(
        F.slice("_sorted", F.lit(1), F.col("_keep").cast("int")), lambda e: F.xxhash64(e["_gram"], F.col("_short"))).alias("_part"))
    keys = kept.groupBy("text").agg(F.flatten(F.collect_list("_part")).alias("_keys"))
    return items.join(keys, "text")


def cell_keys(items: DataFrame, max_gap: float) -> DataFrame:
    """Blocking keys in an array column ``_keys`` by price alone: prices at most ``max_gap`` apart share one or two cells.

    A cell is as wide as the gap and each item joins its own and the next. Items without a price have no key, as they have no pair.
    """
    cell = F.floor(F.col("price") / (max_gap + 1e-9))
    finite = F.col("price").isNotNull() & (F.abs("price") < float("inf"))
    return items.withColumn("_keys", F.when(finite, F.array(cell, cell + 1)).otherwise(F.array().cast("array<bigint>")))


def blocking_keys(items: DataFrame, threshold: float, max_gap: float | None = None) -> DataFrame:
    """Items with keys that lose no pair: by text, or with ``max_gap`` by price cell or by text and cell, whichever forms fewer pairs.

    At a low threshold a text must keep so many keys that most pairs share several of them; the cells then form each pair once or
    twice, within the gap only.
    """
    if max_gap is None:
        return cut_lineage(prefix_keys(items, threshold))
    cells = cut_lineage(cell_keys(items, max_gap))
    both = F.flatten(F.transform("_cells", lambda c: F.transform("_keys", lambda k: F.xxhash64(k, c))))
    texts = cut_lineage(prefix_keys(cells.withColumnRenamed("_keys", "_cells"), threshold).withColumn("_keys", both).drop("_cells"))
    return texts if _candidate_pairs(texts) < _candidate_pairs(cells) else cells


def similar_pairs(
    left: DataFrame, right: DataFrame, threshold: float, max_gap: float | None = None
) -> DataFrame:
    """Pairs ``(a, b, ratio)`` of item orders with text similarity of at least ``threshold``.

    Both sides come from ``blocking_keys`` with columns ``item, text`` (and ``price`` with ``max_gap``).
    A pair is formed at the first key the two share, so it arises once; length band and the built-in
    edit distance, neither of which can lose a pair, thin the candidates before the exact ratio.
    """
    t = threshold / 100.0
    name = lambda df, side: df.select([F.col(c).alias(f"{side}_{c}") for c in df.columns])
    # Comparing is all computation: the left texts, not their keys, are spread over the tasks first.
    tasks = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    a = name(left, "a").repartition(tasks).withColumn("_key", F.explode("a__keys"))
    b = name(right, "b").withColumn("_key", F.explode("b__keys"))
    total = F.length("a_text") + F.length("b_text")
    # Cheap tests first: order, price, lengths; then whether this is the first key the two share.
    condition = F.col("a_item") < F.col("b_item")
    if max_gap is not None:
        condition = condition & (F.abs(F.col("a_price") - F.col("b_price")) <= max_gap)
    condition = condition & (2 * F.least(F.length("a_text"), F.length("b_text")) >= t * total - 1e-9)
    condition = condition & (F.array_min(F.array_intersect("a__keys", "b__keys")) == F.col("_key"))
    # The edit distance is the dearest test and comes last.
    edits = F.expr(f"levenshtein(a_text, b_text, cast(floor({1 - t} * (length(a_text) + length(b_text)) + 1e-9) as int))")
    close = a.join(b, "_key").filter(condition & (edits >= 0)).select("a_item", "b_item", "a_text", "b_text")
    rated = close.withColumn("ratio", indel_ratio(F.col("a_text"), F.col("b_text")))
    return rated.filter(F.col("ratio") >= threshold).select(F.col("a_item").alias("a"), F.col("b_item").alias("b"), "ratio")


def similarity_self_join(items: DataFrame, threshold: float = 85, max_gap: float | None = None) -> DataFrame:
    """All pairs of items (earlier, later, ratio) at least ``threshold`` similar, price gap within ``max_gap``."""
    keyed = blocking_keys(items, threshold, max_gap)
    return similar_pairs(keyed, keyed, threshold, max_gap)


def _candidate_pairs(keyed: DataFrame) -> int:
    sizes = keyed.select(F.explode("_keys").alias("_key")).groupBy("_key").agg(F.count(F.lit(1)).alias("n"))
    return sizes.agg(F.coalesce(F.sum(F.col("n") * (F.col("n") - 1) / 2), F.lit(0.0))).first()[0]


def _claimed_in_block(edges: DataFrame) -> DataFrame:
    """Items of a block that an earlier leader of the block claims.

    The leaders are the lexicographically first maximal independent set: in each round an item
    without an earlier undecided neighbour becomes a leader and claims its later neighbours.
    """
    claimed, live = None, edges.select("a", "b")
    while not live.isEmpty():
        leaders = live.select("a").distinct().join(live.select(F.col("b").alias("a")).distinct(), "a", "left_anti")
        members = cut_lineage(live.join(leaders, "a", "left_semi").select(F.col("b").alias("item")).distinct())
        claimed = members if claimed is None else claimed.union(members)
        live = live.join(members, live.a == members.item, "left_anti").join(members, live.b == members.item, "left_anti")
        live = cut_lineage(live)
    return claimed if claimed is not None else edges.select(F.col("b").alias("item")).limit(0)


def find_leaders(keyed: DataFrame, pairs: Pairs, block: int = BLOCK) -> DataFrame:
    """Items that no earlier leader is similar to, taken in ``item`` order.

    Leaders are found block by block, and each block's leaders remove what they claim from all later
    items at once. A crowd of like items therefore costs one comparison each, not one per pair.
    """
    total, start, size, found = keyed.count(), 0, block, []
    if total > block:
        undecided = cut_lineage(number_rows(keyed, ["item"], "_position"))
    else:
        undecided = keyed.withColumn("_position", F.lit(0))  # one block holds them all
    while start < total:
        part = undecided.filter(F.col("_position") < start + size)
        if size > block and _candidate_pairs(part) > PAIR_BUDGET:
            size = max(block, size // BLOCK_GROWTH**2)
            continue
        part = cut_lineage(part)
        leaders = cut_lineage(part.join(_claimed_in_block(cut_lineage(pairs(part, part))), "item", "left_anti"))
        found.append(leaders)
        start += size
        if start < total:
            rest = undecided.filter(F.col("_position") >= start)
            claimed = pairs(leaders, rest).select(F.col("b").alias("item")).distinct()
            undecided = cut_lineage(rest.join(claimed, "item", "left_anti"))
        size *= BLOCK_GROWTH
    leaders = reduce(DataFrame.union, found) if found else undecided.limit(0)
    return leaders.drop("_position")


def greedy_groups(keyed: DataFrame, pairs: Pairs, assign: str = "first", block: int = BLOCK) -> DataFrame:
    """``(item, leader)`` as the sequential greedy pass over ``item`` order would give it.

    ``keyed`` holds ``item`` and blocking keys ``_keys``; ``pairs`` forms the similar pairs (a before
    b) between two parts of it. An item joins the first or the last earlier leader similar to it.
    """
    pick = {"first": F.min, "last": F.max}[assign]
    leaders = cut_lineage(find_leaders(keyed, pairs, block))
    others = keyed.join(leaders.select("item"), "item", "left_anti")
    joined = pairs(leaders, others).groupBy(F.col("b").alias("item")).agg(pick("a").alias("leader"))
    return leaders.select("item", F.col("item").alias("leader")).union(joined)


def leader_groups(
    items: DataFrame, threshold: float = 85, max_gap: float | None = None, assign: str = "first", block: int = BLOCK
) -> DataFrame:
    """Greedy groups of texts at least ``threshold`` similar to their leader.

    ``items`` has ``item`` (unique, in the order of processing), ``text`` and, with ``max_gap``, ``price``.
    """
    keyed = blocking_keys(items, threshold, max_gap)
    return greedy_groups(keyed, lambda a, b: similar_pairs(a, b, threshold, max_gap), assign, block)


def match_products(products: DataFrame, threshold: float = 75, max_gap: float = 0.15, block: int = BLOCK) -> DataFrame:
    """Greedy product groups on text and scaled price; a later leader takes over a grouped item."""
    return leader_groups(products, threshold, max_gap, assign="last", block=block)


def number_rows(df: DataFrame, order: Sequence[str], name: str) -> DataFrame:
    """Consecutive numbers from 0 in the given order, without a single-task sort.

    Rows are range-partitioned and sorted, each partition counts its rows, and the partition offsets
    (one number per partition) are added to the place within the partition.
    """
    ordered = df.repartitionByRange(*order).sortWithinPartitions(*order)
    # The generated id holds the partition number above bit 33 and the place within it below.
    parts = cut_lineage(ordered.withColumn("_id", F.monotonically_increasing_id())).withColumns(
        {"_part": F.shiftright("_id", 33), "_place": F.col("_id").bitwiseAND((1 << 33) - 1)})
    sizes = parts.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    numbered = parts.join(F.broadcast(offsets), "_part")
    return numbered.withColumn(name, F.col("_offset") + F.col("_place")).drop("_id", "_part", "_place", "_offset")


def number_groups(groups: DataFrame, name: str = "group_id") -> DataFrame:
    """Group numbers 0, 1, 2, ... in leader order on every ``(item, leader)`` row."""
    numbers = number_rows(groups.select("leader").distinct(), ["leader"], name)
    return groups.join(numbers, "leader", "left")


def group_report(**methods: DataFrame) -> DataFrame:
    """One row per group number: the members under each method, joined by ``"; "``, empty where it has fewer groups."""
    report = None
    for method, groups in methods.items():
        members = groups.groupBy("group_id").agg(
            F.array_join(F.array_sort(F.collect_list("item")), "; ").alias(method))
        report = members if report is None else report.join(members, "group_id", "full_outer")
    return report.na.fill("", list(methods))
