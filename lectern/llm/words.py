"""Words, word hashes and word windows of whole Arrow batches, as numpy arrays over UTF-8 bytes.

Everything here runs inside Spark tasks, a piece of about a megabyte at a time, so memory stays flat whatever the batch
size; one longer text is a piece of its own.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PIECE = 1 << 20
BASE = 0x9E3779B97F4A7C15
MASK = (1 << 64) - 1


def byte_table(separators) -> np.ndarray:
    """True for the bytes that belong to words."""
    table = np.ones(256, bool)
    table[list(separators)] = False
    return table


# Words of the form [^\x20\x09-\x0D]+ and [^\x00-\x2F\x3A-\x60\x7B-\x7F]+.
BLANK_SEPARATED = byte_table([0x20, *range(0x09, 0x0E)])
LETTERS_AND_DIGITS = byte_table([*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)])


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (one-to-one)."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all rows after each other, and the n + 1 row bounds; null rows are empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    bounds = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]] if len(texts) and data else np.zeros(0, np.uint8)
    return raw, (bounds - bounds[0] if len(texts) else np.zeros(1, np.int64))


def pieces(texts: pa.Array, limit: int = PIECE):
    """Row ranges (start, end) of about `limit` bytes each."""
    size = np.asarray(pc.fill_null(pc.binary_length(texts), 0)).astype(np.int64)
    group = (np.cumsum(size) - size) // limit
    cuts = np.flatnonzero(np.diff(group)) + 1
    edges = [0, *cuts.tolist(), len(size)]
    return [(a, b) for a, b in zip(edges, edges[1:], strict=False) if b > a]


class Spans(NamedTuple):
    """The words of some rows: the row and the byte range of each, its hash, and the bytes and bounds of the rows."""

    raw: np.ndarray
    bounds: np.ndarray
    row: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray

    def per_row(self) -> np.ndarray:
        return np.bincount(self.row, minlength=len(self.bounds) - 1)


class Words:
    """Reads words; made once per task, as it holds tables of powers."""

    def __init__(self, word_bytes: np.ndarray, lower: bool = False):
        self.word_bytes = word_bytes
        self.fold = np.arange(256, dtype=np.uint8)
        if lower:
            self.fold[65:91] += 32
        self.value = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(BASE))
        self._grow(PIECE)

    def _grow(self, size: int) -> None:
        base, inverse = np.uint64(BASE), np.uint64(pow(BASE, -1, 1 << 64))
        self.powers = np.cumprod(np.concatenate(([np.uint64(1)], np.full(size, base))))
        self.inverse = np.cumprod(np.concatenate(([np.uint64(1)], np.full(size, inverse))))

    def read(self, texts: pa.Array) -> Spans:
        raw, bounds = flat(texts)
        raw = self.fold[raw]
        inside = self.word_bytes[raw]
        first, last = inside.copy(), inside.copy()
        first[1:] &= ~inside[:-1]
        last[:-1] &= ~inside[1:]
        filled = np.diff(bounds) > 0
        heads, tails = bounds[:-1][filled], bounds[1:][filled] - 1
        first[heads] |= inside[heads]
        last[tails] |= inside[tails]
        start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
        row = np.searchsorted(bounds, start, "right") - 1
        if len(raw) >= len(self.powers):
            self._grow(len(raw))
        sums = np.concatenate(([np.uint64(0)], np.cumsum(self.value[raw] * self.powers[: len(raw)])))
        h = (sums[end] - sums[start]) * self.inverse[start] + (end - start).astype(np.uint64) * np.uint64(0xD1B54A32D192ED03)
        return Spans(raw, bounds, row, start, end, mix(h))


def combined(hashes: np.ndarray, k: int) -> np.ndarray:
    """A hash of every k consecutive values (positions 0 to n - k), order included."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out, factor = np.zeros(n, np.uint64), 1
    for j in range(k):
        factor = factor * BASE & MASK
        out += hashes[j : j + n] * np.uint64(factor)
    return mix(out)


def windows(spans: Spans, k: int) -> tuple[np.ndarray, np.ndarray]:
    """First word and hash of every k-word window that lies in one row."""
    whole = combined(spans.hash, k)
    at = np.flatnonzero(spans.row[: len(whole)] == spans.row[k - 1 :]) if len(whole) else np.zeros(0, np.int64)
    return at, whole[at]


def joined(spans: Spans, keep: np.ndarray) -> pa.Array:
    """The kept words of every row, joined by one blank."""
    row, start, end = spans.row[keep], spans.start[keep], spans.end[keep]
    later = np.zeros(len(row), bool)
    later[1:] = row[1:] == row[:-1]
    raw = spans.raw.copy()
    raw[start[later] - 1] = 0x20
    change = np.zeros(len(raw) + 1, np.int8)
    np.add.at(change, start - later, np.int8(1))
    np.add.at(change, end, np.int8(-1))
    inside = np.cumsum(change[:-1], dtype=np.int8) > 0
    at = np.concatenate(([0], np.cumsum(inside, dtype=np.int64)))[spans.bounds]
    return pa.LargeStringArray.from_buffers(len(spans.bounds) - 1, pa.py_buffer(at), pa.py_buffer(raw[inside]))


def packed(*columns: np.ndarray) -> bytes:
    """Arrays of one length, one after the other."""
    return b"".join(np.ascontiguousarray(c).tobytes() for c in columns)


def unpacked(payload: bytes, *kinds) -> list[np.ndarray]:
    kinds = [np.dtype(k) for k in kinds]
    n, at, out = len(payload) // sum(k.itemsize for k in kinds), 0, []
    for kind in kinds:
        out.append(np.frombuffer(payload, kind, n, at))
        at += n * kind.itemsize
    return out


def run_starts(*columns: np.ndarray) -> np.ndarray:
    """Start of every run of equal values in sorted columns."""
    n = len(columns[0])
    new = np.zeros(n, bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


def runs(*columns: np.ndarray) -> list[tuple[int, int]]:
    """(start, end) of every run of equal values in sorted columns."""
    at = run_starts(*columns).tolist()
    return list(zip(at, [*at[1:], len(columns[0])], strict=False))
