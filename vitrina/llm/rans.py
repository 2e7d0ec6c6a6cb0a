"""Static range asymmetric numeral system for token ids: one shared frequency table, blocks of interleaved lanes.

All lanes of a block take one step at a time, so the coder works on whole vectors. A block starts with its sizes and checksums,
then the checkpoints: states of all lanes and the place in the word stream every ``CHECK_STEPS`` steps, from each of which a reader
can start without what lies before.
"""

from __future__ import annotations

import struct
import zlib
from dataclasses import dataclass
from functools import cached_property

import numpy as np

SCALE_BITS = 20
LANES = 1024
CHECK_STEPS = 256
LOW = np.uint64(1 << 31)  # states lie in [2^31, 2^63), words have 32 bits
_WORD = np.uint64(32)
_MAGIC = b"vRN1"
_HEAD = "<4sIIIIQII"  # magic, table, lanes, checkpoints, documents, tokens, words, checksum


@dataclass(frozen=True)
class Table:
    """Frequencies of all ids on a scale of ``2 ** SCALE_BITS``."""

    freq: np.ndarray

    @classmethod
    def of(cls, counts: np.ndarray) -> Table:
        """One for each id that occurs, the rest in proportion; what rounding leaves goes to the commonest id."""
        counts = np.asarray(counts, np.int64)
        used, total = int((counts > 0).sum()), int(counts.sum())
        if used > 1 << (SCALE_BITS - 1):
            raise ValueError("too many different ids for the scale")
        if not total:
            return cls(np.zeros(len(counts), np.int64))
        room = (1 << SCALE_BITS) - used
        shares = np.array([c * room // total for c in counts.tolist()], np.int64)  # Python integers don't overflow
        freq = np.where(counts > 0, 1 + shares, 0)
        freq[int(np.argmax(counts))] += (1 << SCALE_BITS) - int(freq.sum())
        return cls(freq)

    @cached_property
    def start(self) -> np.ndarray:
        return np.concatenate(([0], np.cumsum(self.freq)[:-1])).astype(np.uint64)

    @cached_property
    def symbols(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.freq), dtype=np.uint32), self.freq)

    @cached_property
    def freq64(self) -> np.ndarray:
        return self.freq.astype(np.uint64)

    @cached_property
    def number(self) -> int:
        return zlib.crc32(self.freq.astype("<u4").tobytes())


def encode(ids: np.ndarray, table: Table, docs: np.ndarray, sizes: np.ndarray, absent: np.ndarray) -> bytes:
    """A block: the ids of some documents one after another, with the documents' keys (``absent``: null) and sizes."""
    n = len(ids)
    if n and (ids.max() >= len(table.freq) or (table.freq[ids] == 0).any()):
        raise ValueError("an id has no frequency")
    lanes = max(1, min(LANES, n // 64))
    steps = -(-n // lanes)
    x = np.full(lanes, LOW, np.uint64)
    freq, start, room = table.freq64, table.start, np.uint64(63 - SCALE_BITS)
    mask32, bits = np.uint64(0xFFFFFFFF), np.uint64(SCALE_BITS)
    words: list[np.ndarray] = []
    written, checks = 0, []
    for s in range(steps - 1, -1, -1):
        a, b = s * lanes, min(n, (s + 1) * lanes)
        y, step = x[: b - a], ids[a:b]
        fs = freq[step]
        full = y >= fs << room
        out = (y[full] & mask32).astype("<u4")
        if len(out):
            words.append(out)
            written += len(out)
            y = np.where(full, y >> _WORD, y)
        q = y // fs
        x[: b - a] = (q << bits) + (y - q * fs) + start[step]
        if s % CHECK_STEPS == 0:
            checks.append((s, written, x.copy()))
    checks = [(s, written - w, state) for s, w, state in reversed(checks)]
    body = [np.asarray(docs, "<i8").tobytes(), np.asarray(absent, np.uint8).tobytes(), np.asarray(sizes, "<u4").tobytes()]
    for s, w, state in checks:
        body += [struct.pack("<II", s, w), state.astype("<u8").tobytes()]
    payload = b"".join(body + words[::-1])
    return struct.pack(_HEAD, _MAGIC, table.number, lanes, len(checks), len(docs), n, written, zlib.crc32(payload)) + payload


@dataclass(frozen=True)
class Block:
    """A block read back; ``ids`` decodes it, from any checkpoint on."""

    table: Table
    lanes: int
    tokens: int
    docs: np.ndarray
    absent: np.ndarray
    sizes: np.ndarray
    checks: list[tuple[int, int, np.ndarray]]
    words: np.ndarray

    @classmethod
    def read(cls, data: bytes, table: Table) -> Block:
        if len(data) < struct.calcsize(_HEAD):
            raise ValueError("the block is cut off")
        magic, number, lanes, n_checks, n_docs, tokens, n_words, crc = struct.unpack_from(_HEAD, data)
        body = memoryview(data)[struct.calcsize(_HEAD) :]
        if magic != _MAGIC or number != table.number:
            raise ValueError("not a block of this frequency table")
        if zlib.crc32(body) != crc:
            raise ValueError("the block's checksum is wrong")
        at = 0

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(body, kind, n, at)
            at += out.nbytes
            return out

        docs, absent, sizes = take("<i8", n_docs), take("u1", n_docs).astype(bool), take("<u4", n_docs)
        checks = []
        for _ in range(n_checks):
            s, w = take("<u4", 2).tolist()
            checks.append((s, w, take("<u8", lanes)))
        return cls(table, lanes, tokens, docs, absent, sizes, checks, take("<u4", n_words))

    def ids(self, checkpoint: int = 0, until: int | None = None) -> np.ndarray:
        """The ids from a checkpoint to the end, or to the checkpoint ``until``."""
        if not self.tokens:
            return np.zeros(0, np.uint32)
        first, at, state = self.checks[checkpoint]
        steps = -(-self.tokens // self.lanes)
        last = steps if until is None or until >= len(self.checks) else self.checks[until][0]
        out = np.empty((last - first) * self.lanes, np.uint32)
        x, slots, bits = state.astype(np.uint64), np.uint64((1 << SCALE_BITS) - 1), np.uint64(SCALE_BITS)
        freq, start, symbols = self.table.freq64, self.table.start, self.table.symbols
        for s in range(first, last):
            k = min(self.tokens - s * self.lanes, self.lanes)
            y = x[:k]
            slot = y & slots
            found = symbols[slot]
            y = freq[found] * (y >> bits) + slot - start[found]
            low = np.flatnonzero(y < LOW)
            if len(low):
                y[low] = (y[low] << _WORD) | self.words[at : at + len(low)]
                at += len(low)
            x[:k] = y
            out[(s - first) * self.lanes : (s - first) * self.lanes + k] = found
        return out[: min(last * self.lanes, self.tokens) - first * self.lanes]
