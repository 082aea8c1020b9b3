"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

Patterns are the benchmark's word windows. For patterns of one length a shift table, indexed by a hash of the block of
words at the end of the search position, says how far the position may jump; where it says zero, a bucket of patterns
with that suffix is compared word by word. All documents of an Arrow batch are searched together: each stretch of words
is a lane with its own position, and one numpy step moves every lane by its own shift.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import free_name, stored, with_fields
from lectern.llm.words import BASE, LETTERS_AND_DIGITS, Words, pieces

PATTERN_BYTES = 2 << 20  # benchmark text searched for in one pass over the documents; its tables are some 30 times that
LANE = 128  # window starts per lane
TABLE_BITS = 18


class Patterns:
    """Search tables for the distinct word sequences of one length."""

    def __init__(self, words: np.ndarray, owners: list[list[int]], texts: list[bytes]):
        self.words, self.owners, self.texts = words, owners, texts  # words: one row of word hashes per pattern
        self.length = words.shape[1]
        self.block = min(2, self.length)
        self.most = self.length - self.block + 1
        self.shift = np.full(1 << TABLE_BITS, self.most, np.int64)
        for end in range(self.block, self.length + 1):  # later blocks allow smaller shifts
            slot = self.slots(words[:, end - self.block : end])
            np.minimum.at(self.shift, slot, self.length - end)
        suffix = self.slots(words[:, self.length - self.block :])
        self.order = np.argsort(suffix, kind="stable")
        self.suffix = suffix[self.order]

    def slots(self, block: np.ndarray) -> np.ndarray:
        h = block[:, 0].copy()
        for j in range(1, block.shape[1]):
            h = h * np.uint64(BASE) + block[:, j]
        return (h >> np.uint64(64 - TABLE_BITS)).astype(np.int64)

    def search(self, hashes: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(first word, pattern) of every occurrence inside one row; bounds are the rows' word bounds."""
        m, b = self.length, self.block
        starts = np.maximum(np.diff(bounds) - m + 1, 0)
        lanes = -(-starts // LANE)
        first = np.repeat(np.cumsum(lanes) - lanes, lanes)
        begin = np.repeat(bounds[:-1], lanes) + (np.arange(len(first)) - first) * LANE
        stop = np.minimum(begin + LANE, np.repeat(bounds[:-1] + starts, lanes))
        if not len(begin):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        block = hashes[: len(hashes) - b + 1].copy()
        for j in range(1, b):
            block = block * np.uint64(BASE) + hashes[j : len(hashes) - b + 1 + j]
        slot = (block >> np.uint64(64 - TABLE_BITS)).astype(np.int64)
        at, where, which = begin, [], []
        while len(at):
            here = slot[at + m - b]
            jump = self.shift[here]
            stay = np.flatnonzero(jump == 0)
            if len(stay):
                low = np.searchsorted(self.suffix, here[stay], "left")
                count = np.searchsorted(self.suffix, here[stay], "right") - low
                candidate = np.repeat(at[stay], count)
                pattern = self.order[np.repeat(low, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)]
                for j in range(m):  # word by word, the prefix first
                    same = hashes[candidate + j] == self.words[pattern, j]
                    candidate, pattern = candidate[same], pattern[same]
                where.append(candidate)
                which.append(pattern)
            at = at + np.maximum(jump, 1)
            live = at < stop
            at, stop = at[live], stop[live]
        return (np.concatenate(where), np.concatenate(which)) if where else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def compile_patterns(items: list[tuple[int, str | None]], window: int) -> list[Patterns]:
    """One search table per pattern length. items: (number of the item, text)."""
    reader = Words(LETTERS_AND_DIGITS, lower=True)
    spans = reader.read(pa.array([t for _, t in items], pa.large_string()))
    begin = np.concatenate(([0], np.cumsum(spans.per_row())))
    found: dict[int, dict[bytes, tuple[np.ndarray, list[int]]]] = {}
    for row, (number, _) in enumerate(items):
        a, b = int(begin[row]), int(begin[row + 1])
        for s in range(a, max(a, b - window) + (b > a)):
            e = min(s + window, b)
            text = b" ".join(spans.raw[i:j].tobytes() for i, j in zip(spans.start[s:e], spans.end[s:e], strict=True))
            owners = found.setdefault(e - s, {}).setdefault(text, (spans.hash[s:e], []))[1]
            if not owners or owners[-1] != number:
                owners.append(number)
    return [Patterns(np.stack([w for w, _ in p.values()]), [o for _, o in p.values()], list(p)) for _, p in sorted(found.items())]


def benchmark_parts(benchmark: DataFrame, key: str, text: str, limit: int):
    """The benchmark's items in parts of about `limit` bytes, fetched one after the other; keys as strings, or null."""
    part, size = [], 0
    rows = benchmark.filter(F.col(text).isNotNull()).select(F.col(key).cast("string").alias("k"), F.col(text).alias("t"))
    for row in rows.toLocalIterator():
        part.append((row.k, row.t))
        size += len(row.t)
        if size >= limit:
            yield part
            part, size = [], 0
    if part:
        yield part


def find_contamination(
    docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text",
    window: int = 10, pattern_bytes: int = PATTERN_BYTES,
) -> DataFrame:
    """(key, n_words, n_hit, items, n_items) per row: words of the text, words inside an occurrence, sorted ids of the
    items hit, number of the items hit.

    Patterns are `window` consecutive words of an item; an item of fewer words, but not none, is one pattern. A-Z are
    lower-cased; words are runs of letters, digits and non-ASCII characters. Null, empty and wordless texts have no
    words and no hits; items like that have no patterns. Items without an id hit words like any other and are one more item
    in n_items, all together, but are not listed. Repeated rows give repeated rows; items of one id count once. An empty benchmark hits nothing, an empty table gives an empty table.

    No row is shuffled. The benchmark is fetched in parts of about `pattern_bytes` of text, its search tables are built once
    on the driver and broadcast, and each part takes one pass over the documents. The rows are written between two passes,
    so one part's tables are alive at a time, however large the benchmark; it costs a write of the table per further part.
    """
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    marked, hit, items = search(rows, "text", benchmark, item_key, item_text, window, pattern_bytes)
    schema = with_fields(rows.select("key").schema, "n_words long, n_hit long, found array<string>")
    counted = marked.mapInArrow(hit_counter(hit, items), schema)
    listed = F.array_sort(F.array_compact(F.array_distinct("found"))).alias("items")
    return counted.select(F.col("key").alias(key), "n_words", "n_hit", listed, F.size(F.array_distinct("found")).cast("long").alias("n_items"))


def without_contaminated(
    docs: DataFrame, benchmark: DataFrame, text: str = "text", item_key: str = "item_id", item_text: str = "text", window: int = 10, pattern_bytes: int = PATTERN_BYTES
) -> DataFrame:
    """The rows, with all their columns, in which `find_contamination` finds no hit."""
    marked, hit, _ = search(docs, text, benchmark, item_key, item_text, window, pattern_bytes)
    return marked.filter(F.col(hit).isNull()).select(*[F.col(f"`{c}`") for c in docs.columns])


def search(docs: DataFrame, text: str, benchmark: DataFrame, item_key: str, item_text: str, window: int, pattern_bytes: int) -> tuple[DataFrame, str, str]:
    """The rows after a pass for each part, with two more columns, whose names are returned: a bit map of the words hit
    (null: none) and the items found."""
    hit, items = free_name(docs, "hit_words"), free_name(docs, "hit_items")
    out = docs.withColumn(hit, F.lit(None).cast("binary")).withColumn(items, F.array().cast("array<string>"))
    for i, part in enumerate(benchmark_parts(benchmark, item_key, item_text, pattern_bytes)):
        out = stored(out, "pass") if i else out
        tables = compile_patterns([(n, t) for n, (_, t) in enumerate(part)], window)
        shared = docs.sparkSession.sparkContext.broadcast(([k for k, _ in part], tables))
        out = out.mapInArrow(searcher(shared, text, hit, items), out.schema)
    return out, hit, items


def hit_words(maps: pa.Array, bounds: np.ndarray) -> np.ndarray:
    """The bit maps of all rows as one flag per word."""
    hit = np.zeros(int(bounds[-1]), bool)
    for i, bits in enumerate(maps):
        if bits.is_valid:
            a, b = int(bounds[i]), int(bounds[i + 1])
            hit[a:b] = np.unpackbits(np.frombuffer(bits.as_buffer(), np.uint8), count=b - a)
    return hit


def hit_counter(hit: str, items: str):
    """Counts the words of the rows, and those hit."""

    def count(batches):
        reader = Words(LETTERS_AND_DIGITS, lower=True)
        for batch in batches:
            for a, b in pieces(batch["text"]):
                rows = batch.slice(a, b - a)
                n_words = reader.read(rows["text"]).per_row()
                bounds = np.concatenate(([0], np.cumsum(n_words)))
                flags = np.concatenate(([0], np.cumsum(hit_words(rows[hit], bounds))))
                yield pa.RecordBatch.from_arrays([rows["key"], pa.array(n_words), pa.array(np.diff(flags[bounds])), rows[items]], ["key", "n_words", "n_hit", "found"])

    return count


def searcher(shared, text: str, hit_name: str, items_name: str):
    """One pass over the documents for one part of the benchmark: adds to the bit maps and item lists."""

    def run(batches):
        reader = Words(LETTERS_AND_DIGITS, lower=True)
        names, tables = shared.value
        for batch in batches:
            for a, b in pieces(batch[text]):
                rows = batch.slice(a, b - a)
                spans = reader.read(rows[text])
                bounds = np.concatenate(([0], np.cumsum(spans.per_row())))
                hit = hit_words(rows[hit_name], bounds)
                found: dict[int, set[str | None]] = {}
                for table in tables:
                    at, which = table.search(spans.hash, bounds)
                    for s, p in zip(at.tolist(), which.tolist(), strict=True):
                        e = s + table.length
                        # The occurrence itself, not only its hashes, must agree.
                        if b" ".join(spans.raw[i:j].tobytes() for i, j in zip(spans.start[s:e], spans.end[s:e], strict=True)) == table.texts[p]:
                            hit[s:e] = True
                            found.setdefault(int(spans.row[s]), set()).update(names[o] for o in table.owners[p])
                if found:
                    touched = np.bincount(spans.row[hit], minlength=b - a) > 0
                    maps = [np.packbits(hit[i:j]).tobytes() if t else None for i, j, t in zip(bounds[:-1], bounds[1:], touched, strict=True)]
                    lists = [list({*(old or []), *found.get(i, ())}) for i, old in enumerate(rows[items_name].to_pylist())]
                    for name, values in ((hit_name, maps), (items_name, lists)):
                        at = rows.schema.get_field_index(name)
                        rows = rows.set_column(at, rows.schema.field(at), pa.array(values, rows.schema.field(at).type))
                yield rows

    return run
