"""Reply trees: paths from the root to every leaf by self-joins, branches ranked by score, each chosen path one conversation.

Paths are found by doubling: a message knows an ancestor and how far it is, and in a round joins itself to what that ancestor knows,
so the rounds grow with the logarithm of the depth. The stored rounds then unfold each chosen leaf into its path, every ancestor
once. A path is formatted in chunks of a bounded number of turns, so no task needs a whole conversation.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from vitrina.llm.base import numbered, stored

# Turns of one chunk of a formatted path.
CHUNK = 512
# The template: a turn is "<s>role\ntext</s>". In texts and roles every "<" and "[" gets a backslash behind it, so none can begin a
# control string of this or a bracket template; in roles a line break becomes "[n".
OPEN, CLOSE = "<s>", "</s>"
TRAINED = "assistant"


def escaped(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"([<\[])", r"$1\\")


def unescape(text: str) -> str:
    return re.sub(r"([<\[])\\", r"\1", text)


def unescape_role(text: str) -> str:
    return unescape(text.replace("[n", "\n"))


def paths(messages: DataFrame, branches: int = 1) -> DataFrame:
    """``(path, tree, position, id)``: the messages of the ``branches`` best root-to-leaf paths of every tree, roots at 0.

    ``messages``: long ``id`` (unique), long ``parent`` (null or unknown: a root), double ``score`` (null: 0). A path is named by its
    leaf and ranked by the mean score of its messages, ties by the smaller leaf. A cycle of parents is an error.
    """
    rows = messages.select("id", "parent", F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score"))
    known = rows.select(F.col("id").alias("parent"))
    linked = rows.join(known, "parent", "left_semi")
    state = rows.join(linked.select("id", F.col("parent").alias("anc")), "id", "left")
    top = F.col("anc").isNull()
    state = stored(state.select(
        "id", "anc", F.when(top, F.col("id")).alias("tree"), F.when(top, 0).otherwise(1).cast("long").alias("steps"),
        F.col("score").alias("total")), "paths")
    count, rounds = state.count(), []
    while not (active := state.filter("anc is not null")).isEmpty():
        if 1 << len(rounds) > count:
            raise ValueError("the parents form a cycle")
        rounds.append(active.select("id", "anc"))
        up = state.select(
            F.col("id").alias("anc"), F.col("anc").alias("next"), F.col("tree").alias("up_tree"), F.col("steps").alias("up_steps"),
            F.col("total").alias("up_total"))
        moved = active.drop("tree").join(up, "anc").select(
            "id", F.col("next").alias("anc"), F.col("up_tree").alias("tree"), (F.col("steps") + F.col("up_steps")).alias("steps"),
            (F.col("total") + F.col("up_total")).alias("total"))
        state = stored(state.filter("anc is null").unionByName(moved), "paths")
    leaves = state.join(linked.select(F.col("parent").alias("id")).distinct(), "id", "left_anti")
    order = Window.partitionBy("tree").orderBy((F.col("total") / (F.col("steps") + 1)).desc(), "id")
    best = leaves.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= branches)
    found = stored(best.select(F.col("id").alias("path"), "tree", F.col("steps").alias("position"), "id"), "unfolded")
    for k in range(len(rounds) - 1, -1, -1):
        higher = found.filter(F.col("position") >= 1 << k).join(rounds[k], "id")
        found = stored(found.unionByName(higher.select("path", "tree", (F.col("position") - (1 << k)).alias("position"), F.col("anc").alias("id"))), "unfolded")
    return found


def formatted(turns: DataFrame, keys: list[str]) -> DataFrame:
    """Text and loss spans of paths ``(*keys, position, role, text)``, in chunks: ``(*keys, chunk, turns, text, loss)``.

    ``loss`` lists the code points ``[start, stop)`` of the chunk's text that are trained on: each assistant text, without its marks.
    """
    head = F.concat(F.lit(OPEN), F.regexp_replace(escaped(F.col("role")), "\n", "[n"), F.lit("\n"))
    rows = turns.select(*keys, "position", F.floor(F.col("position") / CHUNK).alias("chunk"), F.coalesce("role", F.lit("")).alias("role"),
                        head.alias("head"), escaped(F.col("text")).alias("body"))
    rows = rows.withColumn("turn", F.concat("head", "body", F.lit(CLOSE)))
    before = F.sum(F.length("turn")).over(Window.partitionBy(*keys, "chunk").orderBy("position").rowsBetween(Window.unboundedPreceding, -1))
    start = F.coalesce(before, F.lit(0)) + F.length("head")
    span = F.when(F.col("role") == TRAINED, F.struct(start.alias("start"), (start + F.length("body")).alias("stop")))
    rows = rows.withColumn("span", span)
    parts = F.array_sort(F.collect_list(F.struct("position", "turn", "span")))
    chunks = rows.groupBy(*keys, "chunk").agg(parts.alias("parts"))
    return chunks.select(
        *keys, "chunk", F.size("parts").alias("turns"), F.array_join(F.col("parts.turn"), "").alias("text"),
        F.filter(F.col("parts.span"), F.isnotnull).alias("loss"))


def conversation_tree(rows: DataFrame, conversation: str = "conv_id", turn: str = "turn") -> DataFrame:
    """Linear conversations as messages ``(id, parent, score, tree_key, role, text)``: each row answers the one before it.

    Rows are in the order of turn, role and text, nulls first; a null conversation is one conversation.
    """
    rows = rows.select(F.col(conversation).alias("tree_key"), F.col(turn).alias("turn"), "role", "text")
    rows = numbered(rows, ["tree_key", "turn", "role", "text"], "id")
    rows = stored(rows, "messages")
    earlier = rows.select((F.col("id") + 1).alias("id"), F.col("id").alias("parent"), F.struct("tree_key").alias("k"))
    linked = rows.join(earlier, "id", "left")
    same = F.col("k").isNotNull() & F.col("k.tree_key").eqNullSafe(F.col("tree_key"))
    return stored(linked.select(
        "id", F.when(same, F.col("parent")).alias("parent"), F.lit(0.0).alias("score"), "tree_key", "role", "text"), "tree")


def format_trees(messages: DataFrame, branches: int = 1) -> DataFrame:
    """The chosen paths of reply trees ``(id, parent, score, tree_key, role, text)`` as chunks of formatted text with loss spans.

    Null roles and texts are empty; an empty table gives no rows; other columns play no part.
    """
    found = paths(messages, branches).join(messages.select("id", "tree_key", "role", "text"), "id")
    return formatted(found.select("path", "tree_key", "position", "role", "text"), ["path", "tree_key"])


def read_back(chunks: DataFrame) -> DataFrame:
    """What the formatted text says: turns, their digest, and the digest of all text under the loss mask, per path.

    Chunks of a path pass in order through running digests, one at a time.
    """
    rows = chunks.select("path", "tree_key", "chunk", "text", "loss").repartition("path").sortWithinPartitions("path", "chunk")
    pattern = re.compile(re.escape(OPEN) + "(.*?)\n(.*?)" + re.escape(CLOSE), re.DOTALL)
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, key, kind = None, None, None
        turns, loss = hashlib.sha256(), hashlib.sha256()
        n = chars = length = 0
        out: list[tuple] = []

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            kinds = [kind, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

        for batch in batches:
            kind = batch["tree_key"].type
            for p, k, text, spans in zip(*(batch[c].to_pylist() for c in ("path", "tree_key", "text", "loss"))):
                if p != path:
                    if path is not None:
                        out.append((key, n, turns.hexdigest(), chars, loss.hexdigest(), length))
                    path, key, n, chars, length = p, k, 0, 0, 0
                    turns, loss = hashlib.sha256(), hashlib.sha256()
                for role, body in pattern.findall(text):
                    turns.update(f"{unescape_role(role)}\n{unescape(body)}\n".encode())
                    n += 1
                for span in spans:
                    trained = unescape(text[span["start"] : span["stop"]])
                    loss.update(trained.encode())
                    chars += len(trained)
                length += len(text)
            if out:
                yield batch_of(out)
                out = []
        if path is not None:
            yield batch_of([(key, n, turns.hexdigest(), chars, loss.hexdigest(), length)])

    kind_ = chunks.schema["tree_key"].dataType.simpleString()
    return rows.mapInArrow(
        run, f"conv_id {kind_}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
