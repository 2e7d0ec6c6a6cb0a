"""Rules that turn stored product pages into rows: cards, specifications, reviews."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from html.parser import HTMLParser
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from vitrina.functions.text import strip_review_marks
from vitrina.schemas import MISSING_FIELD, NO_COMMENT, NO_SCORE, RAW_OFFER_COLUMNS, STATUS_PROPERTY, UNAVAILABLE
from vitrina.session import BROADCAST_ROWS, cut_lineage

_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_SIMPLE = re.compile(r"([#.]?)([\w-]+)|\[([\w-]+)(?:=\"?([^\"\]]*)\"?)?\]")


@dataclass
class Node:
    tag: str
    attrs: dict
    parent: "Node | None" = None
    parts: list = field(default_factory=list)  # child nodes and texts in order

    def walk(self) -> Iterator["Node"]:
        stack = [p for p in reversed(self.parts) if isinstance(p, Node)]
        while stack:
            node = stack.pop()
            yield node
            stack.extend(p for p in reversed(node.parts) if isinstance(p, Node))

    def texts(self) -> list[str]:
        out, stack = [], [self]
        while stack:
            part = stack.pop()
            if isinstance(part, str):
                out.append(part)
            elif part.tag not in ("script", "style"):
                stack.extend(reversed(part.parts))
        return out


class _Tree(HTMLParser):
    """Nested nodes of a page; unclosed and stray tags are tolerated."""

    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.root = self.open = Node("", {})
        self.feed(html)
        self.close()

    def handle_starttag(self, tag, attrs):
        node = Node(tag, {k: v or "" for k, v in attrs}, self.open)
        self.open.parts.append(node)
        if tag not in _VOID:
            self.open = node

    def handle_endtag(self, tag):
        node = self.open
        while node.parent is not None and node.tag != tag:
            node = node.parent
        if node.parent is not None:
            self.open = node.parent

    def handle_data(self, data):
        self.open.parts.append(data)


@dataclass(frozen=True)
class _Step:
    """One compound of a selector, and whether it must be the direct child of the one before."""

    tag: str | None
    ids: tuple[str, ...]
    classes: tuple[str, ...]
    attrs: tuple[tuple[str, str], ...]
    child: bool

    def fits(self, node: Node) -> bool:
        if self.tag and node.tag != self.tag:
            return False
        if any(node.attrs.get("id") != i for i in self.ids):
            return False
        if self.classes and not set(self.classes) <= set(node.attrs.get("class", "").split()):
            return False
        return all(k in node.attrs and (not v or node.attrs[k] == v) for k, v in self.attrs)


def _compile(selector: str, known: dict) -> list[_Step]:
    """Steps of a selector of tags, ``#id``, ``.class``, ``[attr=value]``, blanks and ``>``."""
    if selector not in known:
        steps, child = [], False
        for word in selector.replace(">", " > ").split():
            if word == ">":
                child = True
                continue
            parts = _SIMPLE.findall(word)
            steps.append(_Step(
                next((name for kind, name, attr, _ in parts if name and not kind), None),
                tuple(name for kind, name, _, _ in parts if kind == "#"), tuple(name for kind, name, _, _ in parts if kind == "."),
                tuple((attr, value) for _, _, attr, value in parts if attr), child))
            child = False
        known[selector] = steps
    return known[selector]


def select(root: Node, selector: str, known: dict | None = None) -> Iterator[Node]:
    """Nodes below ``root`` that the selector names, in page order."""
    steps = _compile(selector, {} if known is None else known)

    def reaches(node: Node, last: int) -> bool:
        if not steps[last].fits(node):
            return False
        if last == 0:
            return True
        above = node.parent
        while above is not None and above is not root.parent:
            if reaches(above, last - 1):
                return True
            if steps[last].child:
                return False
            above = above.parent
        return False

    return (node for node in root.walk() if reaches(node, len(steps) - 1))


def _read(root: Node, selector: str, pieces: bool, known: dict) -> str | None:
    """Text, or with ``selector@name`` an attribute, of the first match."""
    path, _, attr = selector.partition("@")
    node = next(select(root, path, known), None)
    if node is None:
        return None
    if attr:
        return node.attrs.get(attr)
    texts = node.texts()
    return "".join(t.strip() for t in texts) if pieces else "".join(texts).strip()


@dataclass(frozen=True)
class RuleSet:
    """What one store's pages hold.

    ``on_missing``: ``sentinel`` fills a missing field and goes on; ``stop`` adds one row of
    sentinels and ends the page; ``row`` makes every field of the row the sentinel.
    """

    container: str
    fields: tuple[tuple[str, str], ...]
    sentinel: str = MISSING_FIELD
    on_missing: str = "sentinel"
    page_fields: tuple[tuple[str, str], ...] = ()
    pieces: bool = False


# Selectors of the supported page layouts.
PRODUCT_CARDS = RuleSet(
    ".product-item",
    (
        ("url", "a.product-link@href"), ("name", "h3.product-title"), ("brand", ".product-brand"), ("seller", "span.seller-info"),
        ("rating", ".product-rating"), ("list_price", "span.old-price"), ("store_price", "span.discounted-price"),
        ("partner_price", "span.partner-price"), ("other_price", "span.other-price"),
    ),
)
SPECIFICATION_TABLE = RuleSet(
    "tbody.tabla-especificaciones tr.fila-especificacion",
    (("property", "div.contenedor-caracteristica"), ("value", "span.valor-caracteristica")), sentinel="", on_missing="row",
)
REVIEW_RULES = {
    "container_message": RuleSet(
        'div[data-fs-reviews-container="true"]', (("comment", 'div[data-fs-review-message="true"]'),), NO_COMMENT, "stop",
        (("score", '[data-fs-average-score="true"]'),), pieces=True),
    "paged_list": RuleSet(
        "#yotpo-reviews-container .yotpo-review", (("comment", ".yotpo-read-more-text"),), NO_COMMENT,
        page_fields=(("score", ".yotpo-bottom-line-left-panel.yotpo-bottom-line-score"),)),
    "nested": RuleSet(
        "div._review-text_xpeer_69", (("comment", "div._review-text_16yc3_2"),), NO_COMMENT,
        page_fields=(("score", "._numerator_7vdzo_22"),), pieces=True),
    "article": RuleSet(
        'article[data-testid="comment-component"]', (("comment", 'p[data-testid="comment-content-component"]'),), NO_COMMENT,
        page_fields=(("score", ".ui-review-capability__rating__average"),)),
    "by_class": RuleSet(
        ".vtex-reviews-and-ratings-3-x-reviewCommentMessage", (("comment", "div > span > span"),), NO_COMMENT,
        page_fields=(("score", ".vtex-reviews-and-ratings-3-x-reviewsRatingAverage"),)),
}
# Letters cut from the score of a layout.
SCORE_MARKS = {"paged_list": ","}
# Letters of pages whose rows a task holds at once, a longer page alone.
PAGE_LETTERS = 1 << 20
# Phrases of pages that hold no product any more.
UNAVAILABLE_PHRASES = ("página no existe", "Publicación pausada")


def _rows(html: str, rules: RuleSet, known: dict) -> tuple[dict, list[dict]]:
    root = _Tree(html).root
    page = {name: _read(root, selector, rules.pieces, known) for name, selector in rules.page_fields}
    rows = []
    for node in select(root, rules.container, known):
        found = {name: _read(node, selector, rules.pieces, known) for name, selector in rules.fields}
        if None in found.values():
            if rules.on_missing in ("stop", "row"):
                found = dict.fromkeys(found, rules.sentinel)
            else:
                found = {k: rules.sentinel if v is None else v for k, v in found.items()}
            if rules.on_missing == "stop":
                rows.append(found)
                break
        rows.append(found)
    return page, rows


def _parts(pages: Sequence[str | None]) -> list[slice]:
    """Pages in a row that together hold about ``PAGE_LETTERS``."""
    letters = np.cumsum([len(page) if isinstance(page, str) else 0 for page in pages], dtype=np.int64)
    ends = (np.flatnonzero(np.diff(letters // PAGE_LETTERS)) + 1).tolist()
    return [slice(a, b) for a, b in zip([0, *ends], [*ends, len(letters)])]


def extract_html(pages: DataFrame, rules: dict[str, RuleSet], keys: Sequence[str], layout: str = "layout", html: str = "html") -> DataFrame:
    """``(keys, layout, items, page_fields, error)``: one row per page with its rows as maps.

    A page that cannot be read gives an error text instead of rows; it never fails the job.
    """
    keys = list(keys)
    source = pages.select(*keys, layout, html)
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields if f.name != html)

    def parts(batch: pd.DataFrame) -> Iterator[pd.DataFrame]:
        return (batch.iloc[part] for part in _parts(batch[html]))

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict = {}  # compiled selectors
        for batch in chain.from_iterable(map(parts, batches)):
            out = []
            for name, page in zip(batch[layout], batch[html]):
                try:
                    found, rows = _rows(page, rules[name], known)
                    out.append((rows, found, None))
                except Exception as problem:
                    out.append(([], {}, f"{type(problem).__name__}: {problem}"))
            done = batch[[*keys, layout]].copy()
            done["items"] = [o[0] for o in out]
            done["page_fields"] = [o[1] for o in out]
            done["error"] = [o[2] for o in out]
            yield done

    return source.mapInPandas(
        read, f"{types}, items array<map<string,string>>, page_fields map<string,string>, error string")


def route_by_store(pages: DataFrame, layouts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pages with the layout of their store, and the stores without one with their page counts."""
    routed = pages.join(layouts.select("store", "layout"), "store")
    unknown = pages.join(layouts, "store", "left_anti").groupBy("store").agg(F.count(F.lit(1)).alias("pages"))
    return routed, unknown


def page_availability(pages: DataFrame, phrases: Sequence[str] = UNAVAILABLE_PHRASES, html: str = "html") -> DataFrame:
    """``status``: unavailable where the page holds one of the phrases."""
    gone = F.lit(False)
    for phrase in phrases:
        gone = gone | F.col(html).contains(phrase)
    return pages.withColumn("status", F.when(gone, UNAVAILABLE).otherwise("ok"))


def product_cards(pages: DataFrame) -> DataFrame:
    """The 13 raw offer columns of each product card; ``pages`` has captured_on, store, category, html."""
    keys = ["captured_on", "store", "category"]
    found = extract_html(pages.withColumn("layout", F.lit("cards")), {"cards": PRODUCT_CARDS}, keys)
    rows = found.select(*keys, F.explode("items").alias("_row"))
    known = {name for name, _ in PRODUCT_CARDS.fields}
    cells = [F.col("_row")[c].alias(c) if c in known else F.lit(MISSING_FIELD).alias(c) for c in RAW_OFFER_COLUMNS[3:]]
    return rows.select(*keys, *cells)


def specifications(pages: DataFrame) -> DataFrame:
    """(store, url, name, property, value); a page without a table, a row with a gap and a failed or
    vanished page give the status pair."""
    keys = ["store", "url", "name"]
    checked = page_availability(pages).withColumn(
        "html", F.when(F.col("status") == "ok", F.col("html")).otherwise("")).withColumn("layout", F.lit("specs"))
    found = extract_html(checked, {"specs": SPECIFICATION_TABLE}, keys)
    rows = found.select(*keys, F.explode_outer("items").alias("_row"))
    whole = (F.col("_row")["property"] != "") | (F.col("_row")["value"] != "")
    return rows.select(
        *keys, F.when(whole, F.col("_row")["property"]).otherwise(STATUS_PROPERTY).alias("property"),
        F.when(whole, F.col("_row")["value"]).otherwise(UNAVAILABLE).alias("value"))


def page_reviews(pages: DataFrame) -> DataFrame:
    """(store, url, name, score, comment) by each page's layout; every URL keeps at least one row.

    Several pages of a URL are one listing: its score may stand on any of them (the first in order counts) and only a URL without any
    review on all its pages has the sentinel, once.
    """
    keys = ["store", "url", "name"]
    # read once: the listing is looked up from the same result
    found = cut_lineage(extract_html(pages, REVIEW_RULES, keys))
    score = F.col("page_fields")["score"]
    for layout, marks in SCORE_MARKS.items():
        score = F.when(F.col("layout") == layout, F.translate(F.col("page_fields")["score"], marks, "")).otherwise(score)
    listing = cut_lineage(found.groupBy(*keys).agg(
        F.coalesce(F.min(score), F.lit(NO_SCORE)).alias("score"), F.coalesce(F.max(F.size("items")) == 0, F.lit(True)).alias("_none")))
    none = listing.filter("_none").select(*keys, "score", F.lit(NO_COMMENT).alias("comment"))
    rows = found.select(*keys, F.explode("items").alias("_row"))
    comment = strip_review_marks(F.col("_row")["comment"]).alias("comment")
    small = listing.filter("NOT _none").toDF(*[f"_{k}" for k in keys], "score", "_none")
    if small.count() <= BROADCAST_ROWS:
        small = F.broadcast(small)
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    return rows.join(small, same).select(*keys, "score", comment).unionByName(none)
