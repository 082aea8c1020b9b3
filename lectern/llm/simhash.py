"""SimHash near-dedup by multi-index hashing.

1. A text's fingerprint is the bitwise majority of the 64-bit hashes of its word shingles, repeats included.
2. Distinct fingerprints are cut into segments of 32 bits. Two fingerprints that differ in at most three bits differ in
   at most one bit of one segment. Every fingerprint stands in a table under each of its segments, and probes the table
   with the Hamming ball around each segment: of two segments that differ in one bit, the one that has the bit set asks
   for the other. Segments are known by one hash-partitioned join; what finds nothing is gone after it.
3. What meets at a table entry is compared over all 64 bits. A task sends on a spanning forest of the links it finds, not
   all links, so a cluster of near copies costs a row per fingerprint. An entry with many fingerprints is dealt out to
   tiles of bounded size, every pair of them in some tile.
4. Components of the links give the classes.

Equal texts share a fingerprint and cost one row from step 2 on.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import shuffle_partitions, shuffled_if_large, stored, with_fields
from lectern.llm.components import connected_components
from lectern.llm.words import BLANK_SEPARATED, Spans, Words, pieces

SEED = 42
SEGMENT = 32  # bits of a segment
TILE_ROWS = 8192  # fingerprints of one table entry that a task compares


def joined_words(spans: Spans) -> tuple[bytes, np.ndarray, np.ndarray]:
    """All words with one blank after each, and the start and end of each word in that."""
    size = spans.end - spans.start
    end = np.cumsum(size + 1) - 1
    start = end - size
    out = np.full(int(end[-1]) + 1 if len(end) else 0, 0x20, np.uint8)
    out[np.repeat(start - spans.start, size) + within(spans.start, size)] = spans.raw[within(spans.start, size)]
    return out.tobytes(), start, end


def within(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """All positions of the ranges of `size` from `start`, after each other."""
    return np.arange(int(size.sum())) + np.repeat(start - (np.cumsum(size) - size), size)


def fingerprints(reader: Words, texts: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Per row the number of shingles and the 64-bit fingerprint; 0 and 0 without words."""
    spans = reader.read(texts)
    per_row = spans.per_row()
    body, start, end = joined_words(spans)
    shingles = np.where(per_row == 0, 0, np.maximum(per_row - k + 1, 1))
    first = within(np.cumsum(per_row) - per_row, shingles)
    last = first + np.repeat(np.minimum(per_row, k), shingles) - 1
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(body[i:j], SEED) for i, j in zip(start[first].tolist(), end[last].tolist(), strict=True)), np.uint64, len(first))
    out = np.zeros(len(per_row), np.uint64)
    filled = np.flatnonzero(shingles)
    if len(filled):
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ends = np.cumsum(shingles[filled])
        ones = np.add.reduceat(bits, ends - shingles[filled], axis=0, dtype=np.int32)
        out[filled] = np.packbits(2 * ones > shingles[filled, None], axis=1, bitorder="little").view(np.uint64).ravel()
    return shingles, out


def fingerprint(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 3) -> DataFrame:
    """(key, fingerprint) per row, as a long; the bit of weight 2^63 is its sign. Whole texts are read, nothing is shuffled."""
    source = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))

    def mark(batches):
        reader = Words(BLANK_SEPARATED, lower=True)
        for batch in batches:
            for a, b in pieces(batch["text"]):
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([part["key"], pa.array(fingerprints(reader, part["text"], words)[1].view(np.int64))], ["key", "fingerprint"])

    return source.mapInArrow(mark, with_fields(source.select("key").schema, "fingerprint long")).withColumnRenamed("key", key)


def forest(entry: np.ndarray, prints: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """A label per row, equal where links within one entry lead from one row to another; rows come sorted by entry.

    Rows are compared with the next row of their entry, then with the one after, and so on, all entries of the task
    together. Rows that are connected already are not compared.
    """
    n = len(entry)
    label = np.arange(n)
    starts = np.concatenate(([0], np.flatnonzero(entry[1:] != entry[:-1]) + 1)) if n else np.zeros(0, np.int64)
    end = np.repeat(np.append(starts[1:], n), np.diff(np.append(starts, n)))  # of each row's entry
    live, shift = np.arange(n), 0
    while len(live):
        shift += 1
        live = live[live + shift < end[live]]
        near = live[label[live] != label[live + shift]]
        near = near[np.bitwise_count(prints[near] ^ prints[near + shift]) <= bits]
        while len(near):
            a, b = label[near], label[near + shift]
            low = np.minimum(a, b)
            np.minimum.at(label, a, low)
            np.minimum.at(label, b, low)
            while (label[label] != label).any():
                label = label[label]
            near = near[label[near] != label[near + shift]]
    return label, np.flatnonzero(label != np.arange(n))


def entries(prints: DataFrame, balls: bool) -> DataFrame:
    """(entry, print): each fingerprint's two table entries, or those that it probes around them."""

    def of(segment: int) -> Column:
        value = F.shiftrightunsigned("print", segment * SEGMENT).bitwiseAND(F.lit((1 << SEGMENT) - 1))
        tag = F.lit(segment << SEGMENT).cast("long")
        if not balls:
            return F.array(value + tag)
        bit = F.filter(F.array(*[F.lit(1 << b).cast("long") for b in range(SEGMENT)]), lambda b: value.bitwiseAND(b) != 0)
        return F.transform(bit, lambda b: value - b + tag)

    return prints.select(F.explode(F.concat(*[of(s) for s in range(64 // SEGMENT)])).alias("entry"), "print")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 3, bits: int = 3, tile_rows: int = TILE_ROWS) -> DataFrame:
    """(key, fingerprint, component_id) per row: 16 lowercase hex digits, and the smallest key reachable by links.

    Rows link where their fingerprints differ in at most `bits` (0 to 3) bits. Texts that are null, empty or without words
    have the fingerprint zero and link like any other. A-Z are lower-cased; words are separated by blanks and the control
    characters 9 to 13; texts of fewer than `words` words are one shingle. Rows with a null key take part; a component of
    null keys only has a null id. Repeated rows give repeated rows. An empty table gives an empty table. Other columns are
    not looked at.
    """
    if not 0 <= bits <= 3:
        raise ValueError("two segments with balls of one bit find differences of at most 3 bits")
    spark, key_type = docs.sparkSession, docs.schema[key].dataType
    rows = fingerprint(docs, key, text, words).select(F.col(key).alias("key"), F.col("fingerprint").alias("print"))
    rows = stored(rows, "fingerprints")
    sets = stored(rows.groupBy("print").agg(F.min("key").alias("low")), "distinct")
    prints = sets.select("print")

    table = entries(prints, balls=False)
    known = stored(table.groupBy("entry").agg(F.count("*").alias("own")), "table")
    # Spark sizes what an explode gives by the rows that go in, and would broadcast some sixteen probes of every print.
    probes = stored(entries(prints, balls=True).hint("merge").join(known.select("entry"), "entry"), "probes")
    asked = stored(probes.groupBy("entry").agg(F.count("*").alias("asking")), "asked")
    busy = known.join(shuffled_if_large(asked), "entry", "left").withColumn("rows", F.col("own") + F.coalesce("asking", F.lit(0)))
    busy = stored(busy.filter("rows > 1").select("entry", F.ceil(F.col("rows") / tile_rows).alias("blocks")), "busy")
    met = table.unionByName(probes).hint("merge").join(busy, "entry")
    mine = F.pmod(F.xxhash64("print"), F.col("blocks"))
    others = F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)
    # Entries of one block share tasks; a larger one has a tile for every pair of its blocks.
    tile = F.when(F.col("blocks") == 1, F.array(F.struct(F.lit(0).cast("long").alias("y"), F.lit(0).cast("long").alias("z")))).otherwise(
        F.transform(others, lambda other: F.struct(F.least(mine, other).alias("y"), F.greatest(mine, other).alias("z")))
    )
    met = met.select("entry", "print", "blocks", F.explode(tile).alias("tile"))
    total = busy.agg(F.count("*")).first()[0]
    groups = max(shuffle_partitions(spark), total // 50_000)
    shared = F.pmod(F.xxhash64("entry"), F.lit(groups))
    place = F.when(F.col("blocks") == 1, F.struct(shared.alias("x"), "tile")).otherwise(F.struct(F.col("entry").alias("x"), "tile"))
    met = met.select("entry", "print", "blocks", place.alias("place"))

    def compare(group: pa.Table) -> pa.Table:
        entry, found = np.asarray(group["entry"]), np.asarray(group["print"])
        order = np.lexsort((found, entry))
        entry, found = entry[order], found[order]
        label, linked = forest(entry, found.view(np.uint64), bits)
        return pa.table({"a": found[label[linked]], "b": found[linked]})

    links = met.groupBy((F.col("blocks") > 1).alias("large"), "place").applyInArrow(compare, "a long, b long")
    roots = connected_components(links).withColumnRenamed("node", "print")
    named = stored(shuffled_if_large(sets).join(roots, "print", "left").withColumn("root", F.coalesce("root", "print")), "roots")
    # Both sides lie in written tables, so adaptive execution can split a root that many fingerprints share.
    lowest = stored(named.groupBy("root").agg(F.min("low").alias("component_id")), "lowest")
    named = shuffled_if_large(named).join(shuffled_if_large(lowest), "root").select("print", "component_id")
    out = shuffled_if_large(rows).join(named, "print")
    digits = F.lpad(F.lower(F.hex("print")), 16, "0")
    return out.select(F.col("key").cast(key_type).alias(key), digits.alias("fingerprint"), "component_id")
