"""Exact, cached tokenization with a public tokenizer's file.

The ids of a text are those of the tokenizers library. A text of plain letters, digits and marks is cut into the pieces of the
pre-tokenizer, by string methods if blanks and single marks settle the pieces; others are cut at blanks, where the pre-tokenizers cut in any
case. The ids of each piece or chunk are remembered; a new one of plain characters goes straight to the library's merge model. A text with
unusual blanks or a possible special token is encoded whole.
"""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import tokenizers
from pyspark.sql import DataFrame, functions as F

from vitrina.llm.base import small_batches

# Chunks in a generation of a worker's memory; bounds its size, not the result.
CACHE_CHUNKS = 1 << 18

_LETTER = "A-Za-zÀ-ÖØ-öø-ÿ"
_ENDINGS = "'s|'t|'re|'ve|'m|'ll|'d"
# Blanks outside ASCII, and separators that some classes count as blanks.
_ODD = re.compile("[%s]|<\\|" % "".join(map(chr, (
    *range(0x1C, 0x20), 0x85, 0xA0, 0x1680, 0x180E, *range(0x2000, 0x200C), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF))))
_PLAIN = re.compile(f"[\x00-\x7f{_LETTER[6:]}]*")
_PLAIN_TEXT = re.compile(f"[\x00-\x1b\x20-\x7f{_LETTER[6:]}]*")
_LETTERS = re.compile(f" ?[{_LETTER}]+")
_KINDS = {
    # splits of the two public pre-tokenizers, for plain chunks
    "byte": re.compile(rf"{_ENDINGS}| ?[{_LETTER}]+| ?[0-9]+| ?[^\s{_LETTER}0-9]+|\s+(?!\S)|\s+", re.ASCII),
    "word": re.compile(rf"{_ENDINGS}|[{_LETTER}]+|[0-9]|[^\s{_LETTER}0-9]+", re.ASCII),
}
_CHUNK = re.compile(r" ?\S+|\s+(?!\S)|\s+", re.ASCII)
# A single one after a letter is always a piece of its own.
_MARKS = ".,;:!?"
# Marks in a row are one piece, so a text with them is not cut before each mark; with others after letters, too many chunks are new.
_ROW = re.compile(rf"[^\s{_LETTER}0-9](?:(?<=[^\s{_LETTER}0-9].)|(?<=[{_LETTER}][^{_MARKS}]))", re.ASCII)


def _byte_letters() -> dict[int, int]:
    """The public byte-level alphabet: printable Latin-1 stands for itself, other bytes for the letters from 256 on. It names every byte,
    as a missing one makes a translation slow."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    return {b: b for b in shown} | {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in shown)}


class OddText(Exception):
    """The text has a chunk that must not be encoded apart from its neighbours."""


class Encoder(dict):
    """Ids of texts; as a dict, the ids of recent chunks as little-endian bytes, with an older generation behind it."""

    def __init__(self, path: str):
        super().__init__()
        self.tokenizer = tokenizers.Tokenizer.from_file(path)
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size(True) <= 1 << 16 else "<u4")
        # the large model comes last in the file and is not parsed again
        head = self.tokenizer.to_str().partition('"model":')[0]
        self.kind = _kind(json.loads(head.rstrip(", \n") + "}"), self.tokenizer.model)
        self.model, self.letters = self.tokenizer.model, _byte_letters()
        self.tokenize = getattr(self.model, "tokenize", None)
        self.code = "H" if self.dtype.itemsize == 2 else "I"
        self.older: dict[str | bytes, bytes] = {}

    def __missing__(self, chunk: str | bytes) -> bytes:
        found = self.older.get(chunk)
        if found is None:
            found = self.fresh(chunk)
        if len(self) >= CACHE_CHUNKS:
            self.older = dict(self)
            self.clear()
        self[chunk] = found
        return found

    def fresh(self, key: str | bytes) -> bytes:
        chunk = key if isinstance(key, str) else key.decode()
        text = chunk.lower() if self.kind == "word" else chunk
        if text.isascii() and text.isalpha():
            return self.merged(text)
        if text.isascii() and text[0] == " " and text[1:].isalpha():
            return self.merged("\u0120" + text[1:])
        if _LETTERS.fullmatch(text):
            return self.merged(text.replace(" ", "\u0120") if text.isascii() else self.shown(text))
        if "<|" in chunk:
            raise OddText
        if chunk[-1] in _MARKS and chunk[-2:-1] < "\u0100" and chunk[-2:-1].isalpha():
            return self[key[:-1]] + self[key[-1:]]
        shown = chunk.isascii() and chunk.isprintable()
        if not shown and self.kind == "byte" and _ODD.search(chunk):
            raise OddText
        if not shown and not _PLAIN.fullmatch(chunk):
            return self.whole(chunk)
        return b"".join(self.merged(p.replace(" ", "\u0120") if shown else self.shown(p)) for p in _KINDS[self.kind].findall(text))

    def shown(self, piece: str) -> str:
        """The bytes of a piece in the letters of the model."""
        return piece.encode().decode("latin-1").translate(self.letters)

    def merged(self, piece: str) -> bytes:
        """Ids of one piece in the letters of the model."""
        return array(self.code, [t.id for t in self.tokenize(piece)]).tobytes()

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()

    def pieces(self, text: str) -> list[str]:
        """A plain text cut where the pre-tokenizer cuts, or at some of these places."""
        if self.kind == "word":
            text = text.lower()
            if not _ROW.search(text):
                for mark in _MARKS:
                    text = text.replace(mark, " " + mark)
                return text.split()
        return _KINDS[self.kind].findall(text)

    def encode(self, text: str | None) -> bytes:
        """Ids of the text as little-endian integers of ``dtype``; none for null."""
        if not text:
            return b""
        if self.kind is None:
            return self.whole(text)
        if "<|" not in text and _PLAIN_TEXT.fullmatch(text):
            chunks = self.pieces(text)
        else:  # bytes split at the six ASCII blanks only
            chunks = text.encode().split() if self.kind == "word" else _CHUNK.findall(text)
        try:
            return b"".join(map(self.__getitem__, chunks))
        except OddText:
            return self.whole(text)


def _kind(spec: dict, model: object) -> str | None:
    """Which of the two known ways the file cuts texts, if any."""
    if not isinstance(model, tokenizers.models.BPE) or model.dropout or model.ignore_merges:
        return None
    if any(not t["content"].startswith("<|") or t["lstrip"] or t["rstrip"] or t["normalized"] for t in spec["added_tokens"]):
        return None
    normal, split = spec["normalizer"], spec["pre_tokenizer"] or {}
    if normal is None and split.get("type") == "ByteLevel" and split["use_regex"] and not split["add_prefix_space"]:
        return "byte"
    steps = [n["type"] for n in (normal or {}).get("normalizers", [])]
    parts = split.get("pretokenizers", [])
    pattern = _ENDINGS + r"|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
    if steps == ["NFC", "Replace", "Lowercase"] and [p["type"] for p in parts] == ["Split", "ByteLevel"]:
        return "word" if parts[0]["pattern"].get("Regex") == pattern and not parts[1]["use_regex"] else None
    return None


def encoder(path: str) -> Encoder:
    """One encoder for all tasks of a worker, kept on a module that outlives a task's own copy of this one."""
    kept = vars(tokenizers).setdefault("_vitrina_encoders", {})
    if path not in kept:
        kept[path] = Encoder(path)
    return kept[path]


def forget() -> None:
    """Frees the chunks that the worker remembers, so that the stages behind have their memory."""
    for kept in vars(tokenizers).get("_vitrina_encoders", {}).values():
        kept.clear()
        kept.older = {}


def binaries(items: list[bytes]) -> pa.Array:
    """As ``pa.array`` of them, which would load pandas into the worker and take its memory."""
    places = np.array([0, *accumulate(map(len, items))], np.int32)
    return pa.Array.from_buffers(pa.binary(), len(items), [None, pa.py_buffer(places), pa.py_buffer(b"".join(items))])


def longs(items: list[int] | np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.int64(), len(items), [None, pa.py_buffer(np.array(items, np.int64))])


def token_table(docs: DataFrame, path: str, end_id: int, key: str = "doc_id") -> DataFrame:
    """``(doc_id, ids, n_tokens)`` of every row: ids as little-endian bytes, the end id last; a null text has the end id only."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(key).alias("doc_id"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        end = np.array([end_id], enc.dtype).tobytes()
        for batch in batches:
            ids = [enc.encode(t) + end for t in batch["text"].to_pylist()]
            sizes = longs([len(i) // enc.dtype.itemsize for i in ids])
            yield pa.record_batch([batch["doc_id"], binaries(ids), sizes], ["doc_id", "ids", "n_tokens"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, ids binary, n_tokens long")


def id_width(path: str) -> str:
    """numpy type of the stored ids."""
    return encoder(path).dtype.str
