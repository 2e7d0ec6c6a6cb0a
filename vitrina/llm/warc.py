"""WARC derivatives: for every response a metadata and a plain-text conversion record that refer to it.

Records are written in WARC/1.1. Identifiers are name-based, so a repeated task writes the same records. Both derivatives name the
response they come from, its URI and date; the metadata record keeps the response's own headers and digests, and names the conversion.
"""

from __future__ import annotations

import base64
import hashlib
import html
import re
import uuid
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from vitrina.llm.base import small_batches

# Pages of one Arrow batch.
BATCH_ROWS = 256
_SPACE = uuid.uuid5(uuid.NAMESPACE_URL, "urn:warc:derivatives")
_HIDDEN = "script|style|noscript|template|svg|iframe|textarea|select"
_BLOCK = frozenset(
    "address article aside blockquote body br caption dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr "
    "html li main nav ol option p pre section table tbody td tfoot th thead title tr ul".split())
# A comment or a hidden element runs to its end, or to the end of a broken page; a tag may hold ">" in quoted values.
_MARKUP = re.compile(
    rf"<!--.*?(?:-->|\Z)|<(?P<hidden>{_HIDDEN}|title)\b[^>]*>(?P<inner>.*?)(?:</(?P=hidden)\s*>|\Z)"
    r"|</?(?P<tag>[a-z][a-z0-9]*)\b(?:[^<>\"']|\"[^\"]*\"|'[^']*')*>|<[/!?]?[a-z][^<>]*>|<[!?][^>]*>", re.I | re.S)
_LINK = re.compile(r"<a\b[^>]*?\bhref\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_CHARSET = re.compile(r"<meta\b[^>]*?\bcharset\s*=\s*[\"']?([\w.:-]+)", re.I)
_LANGUAGE = re.compile(r"<html\b[^>]*?\blang\s*=\s*[\"']?([\w-]+)", re.I)


class Page(NamedTuple):
    title: str
    text: str
    language: str
    charset: str
    links: list[str]


def read_page(source: str) -> Page:
    """Title, visible text by lines, language, charset and links of a page, however broken; each link once, in order.

    Attributes are read from the tags that are shown, not from comments or hidden elements, in time linear in the page.
    """
    # Beyond the last ">" no tag can close, and looking for its end from every "<" there would take quadratic time.
    end = source.rfind(">") + 1
    titles: list[str] = []
    links: dict[str, None] = {}
    first: dict[re.Pattern, str] = {}
    unclosed = False

    def shown(m: re.Match) -> str:
        nonlocal unclosed
        if m["hidden"]:
            unclosed = m.end("inner") == m.end()
            if m["hidden"].lower() == "title" and not titles:
                titles.append(" ".join(html.unescape(m["inner"]).split()))
            return "\n"
        tag = m[0]
        if tag.startswith("<!--"):
            unclosed = not tag.endswith("-->")
        elif found := _LINK.match(tag):
            links[html.unescape(next(filter(None, found.groups()), "")).strip()] = None
        else:
            for p in (_LANGUAGE, _CHARSET):
                if p not in first and (found := p.match(tag)):
                    first[p] = found[1]
        return "\n" if (m["tag"] or "").lower() in _BLOCK else ""

    text = _MARKUP.sub(shown, source[:end])
    if not unclosed:
        text += source[end:].partition("<!--")[0]
    lines = (" ".join(line.split()) for line in html.unescape(text).split("\n"))
    return Page("".join(titles), "\n".join(filter(None, lines)), first.get(_LANGUAGE, ""), first.get(_CHARSET, ""), [x for x in links if x])


def digest(block: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode()


def name(*parts: object) -> str:
    """Identifier of a record from what it is of."""
    return f"<urn:uuid:{uuid.uuid5(_SPACE, chr(0).join(map(str, parts)))}>"


def _field(value: object) -> str:
    """A header value: control characters, line breaks among them, would end it, and become spaces."""
    return re.sub(r"[\x00-\x1f\x7f]+", " ", str(value)).strip()


def write_record(kind: str, record_id: str, block: bytes, content_type: str, more: list[tuple[str, object]]) -> bytes:
    """One record; headers without a value are left out."""
    fields = [("WARC-Type", kind), ("WARC-Record-ID", record_id), *more, ("WARC-Block-Digest", digest(block)),
              ("Content-Type", content_type), ("Content-Length", len(block))]
    lines = "".join(f"{k}: {_field(v)}\r\n" for k, v in fields if v not in (None, ""))
    return b"WARC/1.1\r\n" + lines.encode() + b"\r\n" + block + b"\r\n\r\n"


def read_record(record: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and block of a record; a wrong length or digest is an error."""
    head, _, rest = record.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    headers = dict(line.split(": ", 1) for line in lines)
    block = rest[: int(headers["Content-Length"])]
    if not version.startswith("WARC/") or rest[len(block) :] != b"\r\n\r\n" or digest(block) != headers["WARC-Block-Digest"]:
        raise ValueError("not a whole record")
    return headers, block


def derivatives_of(
    record_id: str, uri: str | None, date: str, headers: list[tuple[str, str]], payload: bytes, info: str
) -> list[tuple[str, str, bytes]]:
    """``(type, identifier, record)`` of the metadata and the conversion of a response."""
    page, source = read_page(payload.decode("utf-8", "replace")), digest(payload)
    text_id, meta_id = name("conversion", record_id), name("metadata", record_id)
    text = page.text.encode()
    common = [("WARC-Warcinfo-ID", info), ("WARC-Date", date), ("WARC-Target-URI", uri), ("WARC-Refers-To", record_id),
              ("WARC-Refers-To-Target-URI", uri), ("WARC-Refers-To-Date", date)]
    told = [("derived-record", text_id), ("source-payload-digest", source), ("source-length", len(payload)),
            ("text-digest", digest(text)), ("title", page.title), ("language", page.language), ("charset", page.charset),
            *((f"source-header-{k}", v) for k, v in headers), *(("outlink", x) for x in page.links)]
    block = "".join(f"{_field(k)}: {_field(v)}\r\n" for k, v in told if v not in (None, "")).encode()
    meta = write_record("metadata", meta_id, block, "application/warc-fields", common)
    return [("metadata", meta_id, meta), ("conversion", text_id, write_record("conversion", text_id, text, "text/plain", common))]


def responses(pages: DataFrame, date: str, key: str = "page_id", url: str = "url", payload: str = "html") -> DataFrame:
    """Stored pages as responses ``(key, record_id, uri, date, headers, payload)``; named by key, URI and payload."""
    content = F.coalesce(F.col(payload), F.lit(""))
    named = F.md5(F.concat_ws("\0", F.coalesce(F.col(key).cast("string"), F.lit("")), F.coalesce(F.col(url), F.lit("")), F.md5(content)))
    shape = r"^(.{8})(.{4})(.{4})(.{4})(.{12})$"
    header = lambda k, v: F.struct(F.lit(k).alias("name"), v.alias("value"))
    return pages.select(
        F.col(key).alias("key"), F.concat(F.lit("<urn:uuid:"), F.regexp_replace(named, shape, "$1-$2-$3-$4-$5"), F.lit(">")).alias("record_id"),
        F.col(url).alias("uri"), F.lit(date).alias("date"),
        F.array(header("Content-Type", F.lit("text/html")), header("Content-Length", F.octet_length(content).cast("string"))).alias("headers"),
        F.encode(content, "utf-8").alias("payload"))


def derive(rows: DataFrame, info: str = "") -> DataFrame:
    """``(key, warc_type, record_id, refers_to, record)``: two records for every response.

    A null payload is empty and has an empty text; a null URI is left out of the headers; repeated responses give repeated records; an
    empty table gives no rows; other columns play no part. No shuffle: each response stands for itself.
    """
    small_batches(rows.sparkSession, BATCH_ROWS)
    rows = rows.select("key", "record_id", "uri", "date", "headers", "payload")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                headers = [(h["name"], h["value"]) for h in r["headers"] or [] if h]
                made = derivatives_of(r["record_id"], r["uri"], r["date"], headers, r["payload"] or b"", info)
                out += [(r["key"], kind, record_id, r["record_id"], record) for kind, record_id, record in made]
            kinds = [batch["key"].type, pa.string(), pa.string(), pa.string(), pa.binary()]
            columns = list(zip(*out)) or [()] * 5
            yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds)], ["key", "warc_type", "record_id", "refers_to", "record"])

    key = rows.schema["key"].dataType.simpleString()
    return rows.mapInArrow(run, f"key {key}, warc_type string, record_id string, refers_to string, record binary")


def header_of(record: Column, field: str) -> Column:
    """Value of a header of a record, or null."""
    head = F.substring_index(F.decode(record, "utf-8"), "\r\n\r\n", 1)
    found = F.regexp_extract(head, rf"\r\n{field}: ([^\r\n]*)", 1)
    return F.when(found != "", found)
