"""Substring dedup by seed and extend.

1. Documents are dealt out to places of some megabytes. Every window of `words` words has an anchor, the smallest hash
   among its k-word grams (winnowing); a place sends on its distinct anchors, which are joined by their hash. What is in
   one document only is gone after that.
2. An occurrence of a shared anchor is a seed. It is sent on with its context, the words that a window around the anchor
   can reach on either side. Equal contexts of one place cost one record, under their smallest document id.
3. All occurrences of an anchor meet and are extended together: those that agree in s words to the left and in the rest of
   the threshold to the right are a match of `words` words, for every s. Words are compared as bytes, hashes only bring
   occurrences together. A match counts where a smaller document id takes part.
4. Overlapping matches join into maximal repeats, whose words are cut out at the documents' places.

No pairs of documents are formed. An anchor that recurs with many different words around it (more than `hot`
occurrences) is extended where it stands: its windows travel as contexts of their own, dealt out by their own hash.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import shuffle_partitions
from lectern.llm.simhash import joined_words, within
from lectern.llm.words import BLANK_SEPARATED, PIECE, Spans, Words, combined, joined, mix, packed, pieces, run_starts, runs, unpacked, windows

PLACE_BYTES = 16 << 20  # text of one place
BUCKET_BYTES = 8 << 20  # contexts of one task group, if a text's contexts are as long as the text
HOT = 1 << 16  # occurrences of an anchor beyond which its windows are dealt out one by one


def anchors(hashes: np.ndarray, at: np.ndarray, words: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and first word of the anchors of the windows that start at `at`, each once: the smallest gram, the leftmost of equal ones."""
    if not len(at):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    grams = combined(hashes, gram)
    best, where = grams[at].copy(), at.copy()
    for j in range(1, words - gram + 1):
        other = grams[at + j]
        less = other < best
        best[less], where[less] = other[less], at[less] + j
    where = np.unique(where)
    return grams[where], where


class Contexts(NamedTuple):
    """Seeds with the words around them; each word is followed by one blank."""

    doc: np.ndarray
    first: np.ndarray  # number of the first word among the words of the place
    left: np.ndarray  # words before the anchor
    right: np.ndarray  # words after it
    size: np.ndarray  # bytes
    text: np.ndarray  # bytes of all contexts after each other
    key: np.ndarray  # hash by which they are dealt out

    def texts(self) -> pa.Array:
        return binaries(self.text, self.size)

    def begin(self) -> np.ndarray:
        return np.cumsum(self.size) - self.size

    def some(self, rows: np.ndarray, begin: np.ndarray) -> Contexts:
        text = gathered(self.text, begin[rows], self.size[rows])
        return Contexts(self.doc[rows], self.first[rows], self.left[rows], self.right[rows], self.size[rows], text, self.key[rows])


NO_CONTEXTS = Contexts(*(np.zeros(0, t) for t in (np.int64, np.int64, np.uint16, np.uint16, np.int64, np.uint8, np.uint64)))


def gathered(text: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The byte ranges after each other; positions are made for about a megabyte at a time."""
    ends = np.cumsum(size, dtype=np.int64)
    out = np.empty(int(ends[-1]) if len(ends) else 0, np.uint8)
    for i, j in runs((ends - size) // PIECE):
        out[ends[i] - size[i] : ends[j - 1]] = text[within(start[i:j], size[i:j])]
    return out


def binaries(text: np.ndarray, size: np.ndarray) -> pa.Array:
    """Byte ranges that lie after each other as an Arrow array."""
    bounds = np.concatenate(([0], np.cumsum(size, dtype=np.int64)))
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(bounds), pa.py_buffer(text)])


def smallest(texts: pa.Array, left: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Per row the smallest document among the rows of equal bytes and equal `left`."""
    code = np.asarray(texts.dictionary_encode().indices).astype(np.int64) << 32 | left
    _, code = np.unique(code, return_inverse=True)
    low = np.full(len(texts), np.iinfo(np.int64).max)
    np.minimum.at(low, code, doc)
    return low[code]


def in_order(group: pa.Table) -> pa.Table:
    """The rows of a place in an order that follows from their content, so words have the same numbers in every stage."""
    return group.take(pc.sort_indices(group, [("key", "ascending"), ("text", "ascending")])).combine_chunks()


def read(reader: Words, group: pa.Table):
    """(keys, spans, number of the first word) of each piece of a place."""
    keys, texts = group["key"], group["text"]
    first = 0
    for a, b in pieces(texts):
        spans = reader.read(texts.slice(a, b - a))
        yield keys.slice(a, b - a), spans, first
        first += len(spans.row)


def seeds_of(keys: pa.ChunkedArray, spans: Spans, words: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, first word and document of every anchor in rows with a key."""
    at, _ = windows(spans, words)
    at = at[np.asarray(keys.is_valid())[spans.row[at]]]
    h, where = anchors(spans.hash, at, words, gram)
    return h, where, np.asarray(keys.fill_null(0)).astype(np.int64)[spans.row[where]]


def contexts_of(spans: Spans, h: np.ndarray, where: np.ndarray, doc: np.ndarray, hot: np.ndarray, first: int, words: int, gram: int) -> Contexts:
    """The seeds at `where` with their contexts; those of hot anchors as one context per window."""
    reach = words - gram
    ends = np.cumsum(spans.per_row())
    begin, end = (ends - spans.per_row())[spans.row[where]], ends[spans.row[where]]
    left = np.minimum(where - begin, reach)
    right = np.minimum(end - where - gram, reach)
    # A hot anchor's windows start from `left` words before it to the last start that reaches over it.
    number = np.where(hot, left + right - reach + 1, 0)
    start = within((where - left)[hot], number[hot])
    window_hash = combined(spans.hash, words)[start] if len(start) else np.zeros(0, np.uint64)
    cold = ~hot
    at = np.concatenate(((where - left)[cold], start))
    left = np.concatenate((left[cold], np.zeros(len(start), np.int64)))
    right = np.concatenate((right[cold], np.full(len(start), reach)))
    body, word_start, word_end = joined_words(spans)
    from_byte = word_start[at]
    size = word_end[at + left + gram + right - 1] + 1 - from_byte
    return Contexts(
        np.concatenate((doc[cold], np.repeat(doc, number))), at + first, left.astype(np.uint16), right.astype(np.uint16), size,
        gathered(np.frombuffer(body, np.uint8), from_byte, size), mix(np.concatenate((h[cold], window_hash))),
    )


def joined_contexts(parts: list[Contexts]) -> Contexts:
    return Contexts(*(np.concatenate(x) for x in zip(*parts, strict=True))) if parts else NO_CONTEXTS


def record(c: Contexts) -> bytes:
    return packed(np.array([len(c.doc)]), c.doc, c.first, c.size.astype(np.uint32), c.left, c.right, c.text)


def read_record(payload: bytes) -> Contexts:
    n = int(np.frombuffer(payload, np.int64, 1)[0])
    at, out = 8, []
    for kind in (np.int64, np.int64, np.uint32, np.uint16, np.uint16):
        out.append(np.frombuffer(payload, kind, n, at))
        at += out[-1].nbytes
    doc, first, size, left, right = out
    return Contexts(doc, first, left, right, size.astype(np.int64), np.frombuffer(payload, np.uint8, offset=at), np.zeros(n, np.uint64))


def extended(c: Contexts, words: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """First and last + 1 word of each seed's match with smaller documents, within its context; 0 and 0 without one."""
    reach = words - gram
    counts = c.left.astype(np.int64) + c.right + gram
    after = np.flatnonzero(c.text == 0x20) + 1  # every word ends with its blank
    start = np.concatenate(([0], after))  # of each word, and the end of the last
    word = np.cumsum(counts) - counts  # number of each context's first word
    low, high = np.full(len(c.doc), 1 << 40), np.zeros(len(c.doc), np.int64)
    for s in range(reach + 1):
        rows = np.flatnonzero((c.left >= s) & (c.right >= reach - s))
        if not len(rows):
            continue
        skipped = c.left[rows].astype(np.int64) - s
        a = start[word[rows] + skipped]
        b = start[word[rows] + skipped + words]
        match = c.doc[rows] > smallest(binaries(gathered(c.text, a, b - a), b - a), np.zeros(len(rows), np.int64), c.doc[rows])
        rows, skipped = rows[match], skipped[match]
        low[rows] = np.minimum(low[rows], skipped)
        high[rows] = np.maximum(high[rows], skipped + words)
    return np.where(high > 0, low, 0), high


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 13, gram: int = 8, hot: int = HOT) -> DataFrame:
    """(key, n_words, n_removed, kept) per row; kept is what stays of the text, its words joined by one blank.

    A word goes if a window of `words` consecutive words covers it that also starts in a document of smaller key; windows
    are judged on the input. Words are separated by blanks and the control characters 9 to 13, otherwise unchanged.
    Null, empty and shorter texts have no window and lose nothing; null gives zero words and an empty text. Rows of a null
    key are neither source nor target. Repeated keys are one document: its rows take nothing from each other, and each
    loses the windows that it shares with a smaller key. `key` is an integer column. An empty table gives an empty table.
    `gram` (1 to `words`) and `hot` change the cost, not the result.
    """
    if not 1 <= gram <= words < 1 << 16:
        raise ValueError("an anchor has from one word to as many as a window, and a window at most 65,535")
    spark, key_type = docs.sparkSession, docs.schema[key].dataType
    docs = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    least = shuffle_partitions(spark)
    places = max(least, total // PLACE_BYTES)
    buckets = np.uint64(max(least, total // BUCKET_BYTES))

    def by_bucket(keys: np.ndarray) -> list[tuple[int, np.ndarray]]:
        bucket = (keys % buckets).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        return [(int(bucket[order[i]]), order[i:j]) for i, j in runs(bucket[order])]

    def table(names: list[str], kinds: list[pa.DataType], rows: list[tuple]) -> pa.Table:
        return pa.table([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], names)

    def seeds(group: pa.Table) -> pa.Table:
        """The place's distinct anchors with the logarithm of their number, by bucket."""
        place = group["place"][0].as_py()
        found = [seeds_of(keys, spans, words, gram)[0] for keys, spans, _ in read(Words(BLANK_SEPARATED), in_order(group))]
        h, n = np.unique(np.concatenate(found), return_counts=True)
        logs = np.ceil(np.log2(n)).astype(np.uint8)
        rows = [(b, place, packed(h[i], logs[i])) for b, i in by_bucket(mix(h))]
        return table(["bucket", "place", "payload"], [pa.int32(), pa.int32(), pa.binary()], rows)

    def share(group: pa.Table) -> pa.Table:
        """Anchors of more than one place, for each of them, and whether they are hot."""
        found = [unpacked(p, np.uint64, np.uint8) for p in group["payload"].to_pylist()]
        place = np.repeat(np.asarray(group["place"]), [len(f[0]) for f in found])
        h, logs = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.lexsort((place, h))
        h, place, number = h[order], place[order], np.int64(1) << logs[order].astype(np.int64)
        at = run_starts(h)
        count = np.diff(np.append(at, len(h)))
        busy = np.repeat(np.add.reduceat(number, at) > hot, count)
        several = np.repeat(count > 1, count)
        h, place, busy = h[several], place[several], busy[several].astype(np.uint8)
        order = np.argsort(place, kind="stable")
        h, place, busy = h[order], place[order], busy[order]
        return table(["place", "payload"], [pa.int32(), pa.binary()], [(int(place[i]), packed(h[i:j], busy[i:j])) for i, j in runs(place)])

    def contexts(doc_group: pa.Table, shared_group: pa.Table) -> pa.Table:
        """Seeds of the place with their contexts, by bucket; and what the place's own smaller documents settle."""
        kinds = [pa.int32(), pa.int32(), pa.bool_(), pa.binary()]
        names = ["bucket", "place", "settled", "payload"]
        if not doc_group.num_rows:
            return table(names, kinds, [])
        place = doc_group["place"][0].as_py()
        told = [unpacked(p, np.uint64, np.uint8) for p in shared_group["payload"].to_pylist()]
        known, busy = (np.concatenate(x) for x in zip(*told, strict=True)) if told else (np.zeros(0, np.uint64), np.zeros(0, np.uint8))
        order = np.argsort(known)
        known, busy = known[order], busy[order].astype(bool)
        doc_group = in_order(doc_group)
        reader = Words(BLANK_SEPARATED)
        found = [seeds_of(keys, spans, words, gram) for keys, spans, _ in read(reader, doc_group)]
        all_h, all_docs = (np.concatenate([f[i] for f in found]) for i in (0, 2))
        # Anchors of several documents of this place are shared as well.
        order = np.lexsort((all_docs, all_h))
        h, d = all_h[order], all_docs[order]
        local = np.unique(h[1:][(h[1:] == h[:-1]) & (d[1:] != d[:-1])])
        parts = []
        for (h, where, doc), (_, spans, first) in zip(found, read(reader, doc_group), strict=True):
            at = np.minimum(np.searchsorted(known, h), max(len(known) - 1, 0))
            told_of = known[at] == h if len(known) else np.zeros(len(h), bool)
            seed = np.flatnonzero(told_of | np.isin(h, local))
            if len(seed):
                is_hot = busy[at[seed]] & told_of[seed] if len(known) else np.zeros(len(seed), bool)
                parts.append(contexts_of(spans, h[seed], where[seed], doc[seed], is_hot, first, words, gram))
        c = joined_contexts(parts)
        low = smallest(c.texts(), c.left, c.doc)
        later = c.doc > low
        number = c.left[later].astype(np.int64) + c.right[later] + gram
        rows = [(int(i), place, True, packed(c.first[later][i::16], number[i::16])) for i in range(min(16, int(later.sum())))]
        left, begin = np.flatnonzero(~later), c.begin()
        rows += [(b, place, False, record(c.some(left[i], begin))) for b, i in by_bucket(c.key[left])]
        return table(names, kinds, rows)

    def extend(group: pa.Table) -> pa.Table:
        """Matches across places, as first word and number of words, by place; what is settled passes through."""
        settled = np.asarray(group["settled"])
        place, payloads = np.asarray(group["place"]), group["payload"]
        out = [(int(place[i]), payloads[int(i)].as_py()) for i in np.flatnonzero(settled)]
        mine = np.flatnonzero(~settled)
        if len(mine):
            parts = [read_record(payloads[int(i)].as_py()) for i in mine]
            place = np.repeat(place[mine], [len(p.doc) for p in parts])
            c = joined_contexts(parts)
            a, b = extended(c, words, gram)
            order = np.flatnonzero(b)
            order = order[np.argsort(place[order], kind="stable")]
            place, first, number = place[order], c.first[order] + a[order], (b - a)[order]
            out += [(int(place[i]), packed(first[i:j], number[i:j])) for i, j in runs(place)]
        return table(["place", "payload"], [pa.int32(), pa.binary()], out)

    def cut(doc_group: pa.Table, match_group: pa.Table) -> pa.Table:
        columns = {"key": pa.int64(), "n_words": pa.int64(), "n_removed": pa.int64(), "kept": pa.string()}
        out = [pa.table({name: pa.array([], kind) for name, kind in columns.items()})]
        matches = [unpacked(p, np.int64, np.int64) for p in match_group["payload"].to_pylist()]
        start, number = (np.concatenate(x) for x in zip(*matches, strict=True)) if matches else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        order = np.argsort(start, kind="stable")
        start, number = start[order], number[order]
        for keys, spans, first in read(Words(BLANK_SEPARATED), in_order(doc_group)) if doc_group.num_rows else []:
            n = len(spans.row)
            a, b = np.searchsorted(start, [first, first + n])  # a match lies in one row, so in one piece
            change = np.zeros(n + 1, np.int64)
            np.add.at(change, start[a:b] - first, 1)
            np.add.at(change, start[a:b] - first + number[a:b], -1)
            gone = np.cumsum(change[:-1]) > 0
            removed = np.bincount(spans.row[gone], minlength=len(keys))
            out.append(pa.table({"key": keys, "n_words": spans.per_row(), "n_removed": removed, "kept": joined(spans, ~gone).cast(pa.string())}))
        return pa.concat_tables(out)

    # Copies of one row spread over places by the input partition that they come from.
    place = F.pmod(F.xxhash64("key", "text", F.spark_partition_id()), F.lit(places)).cast("int")
    placed = docs.withColumn("place", place)
    sent = placed.groupBy("place").applyInArrow(seeds, "bucket int, place int, payload binary")
    shared = sent.groupBy("bucket").applyInArrow(share, "place int, payload binary")
    met = placed.groupBy("place").cogroup(shared.groupBy("place")).applyInArrow(contexts, "bucket int, place int, settled boolean, payload binary")
    slot = F.when(F.col("settled"), F.pmod(F.xxhash64("place", "bucket"), F.lit(int(buckets))).cast("int")).otherwise(F.col("bucket"))
    matches = met.withColumn("slot", slot).groupBy("slot").applyInArrow(extend, "place int, payload binary")
    kept = placed.groupBy("place").cogroup(matches.groupBy("place")).applyInArrow(cut, "key long, n_words long, n_removed long, kept string")
    return kept.select(F.col("key").cast(key_type).alias(key), "n_words", "n_removed", "kept")
