"""Arrow kernels for the few order-dependent folds that built-in expressions cannot do in linear time.

Each one takes and returns Arrow batches; text only enters the hash. The folds step through all rows of a batch
at once with numpy (position 0 of every row, then position 1, ...), so the cost per element is a few nanoseconds and
one very long row never turns into quadratic copying. A batch is worked on in slices of rows, so what a kernel needs
besides the batch is bounded, however large Spark makes its batches.
"""

from __future__ import annotations

import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType

# 32-bit FNV-1a.
FNV_BASIS, FNV_PRIME, MASK32 = 2166136261, 16777619, 0xFFFFFFFF
_FEW_ROWS = 96  # below this many live rows a plain loop is cheaper than numpy calls
# What a kernel works on at once: bytes of text, elements of lists in numpy folds, and in folds over Python objects.
TEXT_SLICE, LIST_SLICE, OBJECT_SLICE = 1 << 22, 1 << 20, 1 << 16


def cuts(sizes: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Rows [a, b) of slices of about `most` in all: a slice ends with the row that reaches it. At least one slice."""
    part = (np.cumsum(sizes) - sizes) // most
    starts = np.flatnonzero(np.diff(part)) + 1
    return list(zip([0, *starts.tolist()], [*starts.tolist(), len(sizes)], strict=True))


def by_slices(fold, most: int, *lists: pa.Array) -> pa.Array:
    """`fold` of list arrays of one length, slice by slice; the first list measures the rows."""
    parts = [fold(*(x.slice(a, b - a) for x in lists)) for a, b in cuts(bounds(lists[0])[1], most)]
    return parts[0] if len(parts) == 1 else pa.concat_arrays(parts)


def _ints(values: pa.Array) -> np.ndarray:
    return np.asarray(values.fill_null(0) if values.null_count else values).astype(np.int64, copy=False)


def bounds(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Start and length of every list, as absolute positions in its child array; null lists are empty."""
    offsets = np.asarray(lists.offsets).astype(np.int64)
    lengths = np.diff(offsets)
    if lists.null_count:
        lengths = np.where(np.asarray(lists.is_valid()), lengths, 0)
    return offsets[:-1], lengths


def _offsets(lengths: np.ndarray) -> np.ndarray:
    """List offsets of a batch. Spark bounds a batch by spark.sql.execution.arrow.maxBytesPerBatch (64 MB unless set)."""
    ends = np.concatenate(([0], np.cumsum(lengths)))
    if ends[-1] > np.iinfo(np.int32).max:
        raise OverflowError("a batch of more than 2^31 elements: lower spark.sql.execution.arrow.maxBytesPerBatch")
    return ends.astype(np.int32)


def _by_length(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row order from longest to shortest, and how many rows are still live at each position."""
    order = np.argsort(-lengths, kind="stable")
    longest = int(lengths.max()) if len(lengths) else 0
    live = np.searchsorted(-lengths[order], -np.arange(longest), side="left")
    return order, live


def _text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets of the rows in the bytes of the whole array, and those bytes."""
    wide = pa.types.is_large_string(texts.type)
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64 if wide else np.int32)
    data = texts.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8) if data else np.zeros(0, np.uint8)
    return offsets[texts.offset : texts.offset + len(texts) + 1].astype(np.int64), raw


def _utf16_units(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """UTF-16 code units of the rows between some offsets, with the start and length of every row."""
    edges = offsets - offsets[0]
    raw = raw[offsets[0] : offsets[-1]]
    if len(raw) and raw.max() >= 0x80:
        # A lead byte starts one unit, a four-byte lead starts two, a continuation byte starts none.
        weight = ((raw & 0xC0) != 0x80).astype(np.int8) + (raw >= 0xF0)
        edges = np.concatenate(([0], np.cumsum(weight, dtype=np.int64)))[edges]
        raw = np.frombuffer(raw.tobytes().decode("utf-8").encode("utf-16-le"), dtype=np.uint16)
    return raw, edges[:-1], np.diff(edges)


def _fnv_rows(texts: pa.Array) -> np.ndarray:
    if len(texts) == 0:
        return np.zeros(0, np.uint32)
    texts = pc.fill_null(texts, "") if texts.null_count else texts
    offsets, raw = _text_bytes(texts)
    slices = cuts(np.diff(offsets), TEXT_SLICE)
    return np.concatenate([_fnv_slice(raw, offsets[a : b + 1]) for a, b in slices])


def _fnv_slice(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    longest = int(np.diff(offsets).argmax())
    begin, end = int(offsets[longest]), int(offsets[longest + 1])
    if end - begin > TEXT_SLICE:  # on its own, as its units would not be bounded
        around = [offsets[: longest + 1], offsets[longest + 1 :]]
        head, tail = (_fnv_slice(raw, o) if len(o) > 1 else np.zeros(0, np.uint32) for o in around)
        return np.concatenate([head, [np.uint32(_fnv_long(raw[begin:end]))], tail])
    units, start, length = _utf16_units(raw, offsets)
    order, live = _by_length(length)
    at, size = start[order], length[order]
    state = np.full(len(start), FNV_BASIS, dtype=np.uint32)  # longest row first
    prime = np.uint32(FNV_PRIME)
    for position, count in enumerate(live.tolist()):
        if count < _FEW_ROWS:
            for row in range(count):
                units_left = units[at[row] : at[row] + size[row] - position]
                state[row] = _fnv_units(int(state[row]), units_left)
            break
        head, where = state[:count], at[:count]
        head ^= units.take(where)
        head *= prime
        where += 1
    out = np.empty_like(state)
    out[order] = state
    return out


def _fnv_units(state: int, units: np.ndarray) -> int:
    for unit in units.tolist():
        state = ((state ^ unit) * FNV_PRIME) & MASK32
    return state


def _fnv_long(raw: np.ndarray) -> int:
    """Hash of one text, taken in parts that end between two characters."""
    state, at = FNV_BASIS, 0
    while at < len(raw):
        end = min(at + TEXT_SLICE, len(raw))
        while end < len(raw) and raw[end] & 0xC0 == 0x80:
            end -= 1
        state = _fnv_units(state, _utf16_units(raw, np.array([at, end]))[0])
        at = end
    return state


def _hex8(state: np.ndarray) -> pa.Array:
    return pa.array([f"{h:08x}" for h in state.tolist()], type=pa.string())


@arrow_udf(StringType())
def fnv1a32(text: pa.Array) -> pa.Array:
    """32-bit FNV-1a over UTF-16 code units, as eight hex digits."""
    hashed = _hex8(_fnv_rows(text))
    return pc.if_else(text.is_valid(), hashed, pa.scalar(None, pa.string())) if text.null_count else hashed


@arrow_udf(ArrayType(StringType()))
def fnv1a32_each(texts: pa.Array) -> pa.Array:
    """`fnv1a32` of every element of a string array."""
    start, length = bounds(texts)
    flat = texts.flatten()
    return pa.ListArray.from_arrays(_offsets(length), _hex8(_fnv_rows(flat)))


def _nfkc(texts: pa.Array) -> pa.Array:
    if len(texts) == 0:
        return pa.array([], type=pa.string())
    parts = [_nfkc_slice(texts.slice(a, b - a)) for a, b in cuts(np.diff(_text_bytes(texts)[0]), TEXT_SLICE)]
    return parts[0] if len(parts) == 1 else pa.concat_arrays(parts)


def _nfkc_slice(texts: pa.Array) -> pa.Array:
    # Python's own tables: the Arrow normaliser of some versions leaves composed letters decomposed.
    return pa.array(
        [t if t is None or t.isascii() else unicodedata.normalize("NFKC", t) for t in texts.to_pylist()], type=pa.string()
    )


@arrow_udf(StringType())
def nfkc(text: pa.Array) -> pa.Array:
    return _nfkc(text)


@arrow_udf(ArrayType(StringType()))
def nfkc_each(texts: pa.Array) -> pa.Array:
    _, length = bounds(texts)
    return pa.ListArray.from_arrays(_offsets(length), _nfkc(texts.flatten()))


@arrow_udf(ArrayType(LongType()))
def sums_before(values: pa.Array) -> pa.Array:
    """For every element, the sum of the elements before it in its array."""
    return by_slices(_sums_before, LIST_SLICE, values)


def _sums_before(values: pa.Array) -> pa.Array:
    _, length = bounds(values)
    flat = _ints(values.flatten())
    exclusive = np.cumsum(flat) - flat
    first = np.cumsum(length) - length
    base = exclusive[np.minimum(first, max(len(exclusive) - 1, 0))] if len(exclusive) else np.zeros(len(first), np.int64)
    exclusive = exclusive - np.repeat(base, length)
    return pa.ListArray.from_arrays(_offsets(length), pa.array(exclusive))


def greedy_starts(max_chars: int, max_tokens: int):
    """A column function giving the 1-based positions at which greedy packing opens a new group.

    Arguments per row, all arrays of one length: item lengths, item tokens, length of the separator in front of each
    item, and a flag that forces a new group. An item joins the open group unless that would pass either limit.
    """

    @arrow_udf(ArrayType(IntegerType()))
    def starts(lens: pa.Array, toks: pa.Array, seps: pa.Array, forced: pa.Array) -> pa.Array:
        return by_slices(fold, LIST_SLICE, lens, toks, seps, forced)

    def fold(lens: pa.Array, toks: pa.Array, seps: pa.Array, forced: pa.Array) -> pa.Array:
        _, length = bounds(lens)
        first = np.cumsum(length) - length
        lens_v, toks_v, seps_v, force_v = (_ints(a.flatten()) for a in (lens, toks, seps, forced))
        opens = np.zeros(int(length.sum()), dtype=bool)
        chars = np.zeros(len(length), dtype=np.int64)
        tokens = np.zeros(len(length), dtype=np.int64)
        order, live = _by_length(length)
        for position, count in enumerate(live):
            rows = order[:count]
            if count < _FEW_ROWS:
                for row in rows:
                    at, end = int(first[row]) + position, int(first[row] + length[row])
                    c, t = int(chars[row]), int(tokens[row])
                    items = zip(*(v[at:end].tolist() for v in (lens_v, toks_v, seps_v, force_v)))
                    for k, (ln, tk, sp, fc) in enumerate(items, at):
                        if fc or (position == 0 and k == at) or c + sp + ln > max_chars or t + tk > max_tokens:
                            opens[k], c, t = True, ln, tk
                        else:
                            c, t = c + sp + ln, t + tk
                break
            at = first[rows] + position
            joined, total = chars[rows] + seps_v[at] + lens_v[at], tokens[rows] + toks_v[at]
            new = (joined > max_chars) | (total > max_tokens) | (force_v[at] != 0) | (position == 0)
            opens[at] = new
            chars[rows] = np.where(new, lens_v[at], joined)
            tokens[rows] = np.where(new, toks_v[at], total)
        where = np.flatnonzero(opens)
        owner = np.searchsorted(first + length, where, side="right")
        counts = np.bincount(owner, minlength=len(length))
        return pa.ListArray.from_arrays(_offsets(counts), pa.array((where - first[owner] + 1).astype(np.int32)))

    return starts
