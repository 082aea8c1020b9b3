"""N-gram Jaccard join: size-banded tiles, hashed bitmap signatures, exact sorted-array intersection.

1. Every text becomes the set of its distinct word shingles (64-bit hashes, sorted). Equal sets are one class.
2. Sizes fall into bands such that linked sets lie in one band or in neighbouring ones. A pair of bands (a family) fixes
   how many shingles at most two linked sets can differ in; the hash range is cut into more parts than that, so at least
   one part is the same in both. Sets that agree in a part meet in a candidate group. A part takes some four to ten
   shingles together, so a passage that many documents share does not bring them all together. A set sends only its
   fullest parts, one more than linked sets can differ in, which still have one in common.
3. Each candidate group, however large, is cut into size-banded tiles. Inside a tile bit counts of hashed signatures
   bound the overlap from above; what passes is intersected exactly. Pairs that are connected already are skipped.
4. Components of the exact links give the classes.

Only candidates' texts and sets are shuffled. Equal sets and equal parts are combined inside each map batch, so one group of copies
sends one row per batch. No step forms all pairs of a group of copies as rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import may_match, shuffle_partitions, stored
from lectern.llm.components import connected_components
from lectern.llm.words import BASE, BLANK_SEPARATED, Words, combined, mix, packed, pieces, run_starts, runs, unpacked

BUCKET_BYTES = 16 << 20  # candidate keys of one task group
PORTION_BYTES = 8 << 20  # text whose equal keys are combined in a map task
KEY_BYTES = 6  # of a candidate key that are shuffled
CHUNK = 256  # candidates intersected at a time
COMMON = 100_000  # most frequent shingles that are left out when candidates are sought
COMMON_SHARE, COMMON_LEAST = 0.003, 8  # share of a map batch's documents, and their number, that make a shingle frequent


def shingle_sets(reader: Words, texts: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of all rows after each other, and n + 1 bounds. Fewer than k words: one shingle."""
    spans = reader.read(texts)
    per_row = spans.per_row()
    whole = combined(spans.hash, k)
    at = np.flatnonzero(spans.row[: len(whole)] == spans.row[k - 1 :]) if len(whole) else np.zeros(0, np.int64)
    rows, hashes = spans.row[at], whole[at]
    short = np.flatnonzero((per_row > 0) & (per_row < k))
    if len(short):
        begin = np.cumsum(per_row) - per_row
        extra = np.zeros(len(short), np.uint64)
        for j in range(k - 1):
            has = per_row[short] > j
            extra[has] = mix(extra[has] * np.uint64(BASE) + spans.hash[begin[short[has]] + j] + np.uint64(j + 1))
        rows, hashes = np.concatenate((rows, short)), np.concatenate((hashes, extra))
    order = np.lexsort((hashes, rows))
    rows, hashes = rows[order], hashes[order]
    at = run_starts(rows, hashes) if len(rows) else np.zeros(0, np.int64)
    rows, hashes = rows[at], hashes[at]
    return hashes, np.concatenate(([0], np.cumsum(np.bincount(rows, minlength=len(texts)))))


def portions(batches):
    """Record batches of about PORTION_BYTES of text each, which bounds what a task holds."""
    for batch in batches:
        for a, b in pieces(batch["text"], PORTION_BYTES):
            yield batch.slice(a, b - a)


def set_ids(hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """One 64-bit id per set; 0 for the empty set."""
    a = np.concatenate(([np.uint64(0)], np.cumsum(mix(hashes))))
    b = np.concatenate(([np.uint64(0)], np.cumsum(mix(hashes ^ np.uint64(BASE)))))
    size = np.diff(bounds).astype(np.uint64)
    ids = mix(mix(a[bounds[1:]] - a[bounds[:-1]]) + (b[bounds[1:]] - b[bounds[:-1]]) + size)
    return np.where(size > 0, ids, np.uint64(0)).view(np.int64)


class Bands:
    """Size bands and, per family (a band and the next), the number of parts."""

    def __init__(self, num: int, den: int):
        self.num, self.den, self.low, self.high = num, den, [1], [den // num]

    def reach(self, size: int) -> None:
        while self.high[-1] * self.num // self.den < size:
            self.low.append(self.high[-1] + 1)
            self.high.append(self.low[-1] * self.den // self.num)

    def of(self, sizes: np.ndarray) -> np.ndarray:
        self.reach(int(sizes.max()) + 1 if len(sizes) else 1)
        return np.searchsorted(np.array(self.low), sizes, "right") - 1

    def differences(self) -> np.ndarray:
        high = np.array(self.high, np.int64)
        return (high + high * self.den // self.num) * (self.den - self.num) // (self.den + self.num)


def parts_of(hashes, owner, n_sets, family, n_parts, enough, live, salt):
    """(key, set number) of the `enough` fullest parts of sets in their family, the part and set number of all filled ones,
    and how many parts of each set are filled.

    Of two linked sets take the one whose last part taken is the fuller: among its parts one is the same in both, and the
    other set takes all that are as full. So what two linked sets take has a part in common, as long as sets of too few
    filled parts take them all, and parts of a shingle or two, which unrelated sets share, are mostly left out.
    """
    use = live[owner]
    h, own = hashes[use], owner[use]
    part = ((h >> np.uint64(32)) * n_parts[own].astype(np.uint64)) >> np.uint64(32)
    if not len(h):
        none = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), none, part, none, np.zeros(n_sets, np.int64)
    at = run_starts(own, part)
    content = np.add.reduceat(mix(h ^ np.uint64(0xA5A5A5A5)), at)
    part, own = part[at], own[at]
    filled = np.bincount(own, minlength=n_sets)
    order = np.lexsort((part, -np.diff(np.append(at, len(h))), own))  # the same order of equal parts in all sets
    rank = np.arange(len(own)) - np.repeat(np.cumsum(filled) - filled, filled)
    taken = order[rank < enough[own]]  # `own` is sorted, so it is the same in that order
    tag = (family[own[taken]].astype(np.uint64) << np.uint64(40)) + part[taken] + np.uint64(salt << 56)
    return mix(content[taken] + mix(tag + np.uint64(BASE))), own[taken], part, own, filled


def part_keys(hashes: np.ndarray, bounds: np.ndarray, bands: Bands, common: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(key, set number) of the fullest parts of non-empty sets, for both families of each set.

    Shingles in `common` (any fixed list) are left out first, which cannot add to a difference. A set with more filled
    parts than linked sets can differ in needs no other keys. Sets that are too poor for that also meet by parts of their
    whole content, and those that are too poor even then by their empty parts.
    """
    sizes = np.diff(bounds)
    n = len(sizes)
    band = bands.of(sizes)
    most = bands.differences()
    parts = np.where(most == 0, 1, (most + 1) * 5 // 4 + 1)
    owner = np.repeat(np.arange(n), sizes)
    place = np.minimum(np.searchsorted(common, hashes), max(len(common) - 1, 0))
    rare = common[place] != hashes if len(common) else np.ones(len(hashes), bool)
    keys, sets = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for family in (band, band - 1):
        live = (family >= 0) & (sizes > 0)
        family = np.maximum(family, 0)
        n_parts, enough = parts[family], most[family] + 1
        k, own, _, _, filled = parts_of(hashes[rare], owner[rare], n, family, n_parts, enough, live, 1)
        poor = live & (filled < enough)
        whole, of, part, holder, full = parts_of(hashes, owner, n, family, n_parts, enough, poor, 2)
        keys += [k, whole]
        sets += [own, of]
        for i in np.flatnonzero(poor & (full < enough)):
            empty = np.setdiff1d(np.arange(n_parts[i]), part[holder == i].astype(np.int64)).astype(np.uint64)
            keys.append(mix(mix((np.uint64(family[i]) << np.uint64(40)) + empty + np.uint64((3 << 56) + 7))))
            sets.append(np.full(len(empty), i))
    return np.concatenate(keys), np.concatenate(sets)


def stars(keys: np.ndarray, ids: np.ndarray):
    """Per key the smallest id, and edges from it to the other ids of the key: (keys, centres), (a, b)."""
    order = np.lexsort((ids, keys))
    keys, ids = keys[order], ids[order]
    at = run_starts(keys)
    centre = np.repeat(ids[at], np.diff(np.append(at, len(keys))))
    other = ids != centre
    edges = np.unique(np.stack((centre[other], ids[other]), 1), axis=0) if other.any() else np.zeros((0, 2), np.int64)
    return (keys[at], ids[at]), edges


def planes(keys: np.ndarray) -> bytes:
    """The first KEY_BYTES bytes of sorted keys: all first bytes, then all second ones, which compresses.

    Keys of one bucket have the rest nearly in common. Two that do not only make a candidate more.
    """
    return keys.astype(">u8").view(np.uint8).reshape(-1, 8)[:, :KEY_BYTES].T.tobytes()


def from_planes(payload: bytes, n: int) -> np.ndarray:
    out = np.zeros((n, 8), np.uint8)
    out[:, :KEY_BYTES] = np.frombuffer(payload, np.uint8, n * KEY_BYTES).reshape(KEY_BYTES, n).T
    return out.view(">u8").ravel().astype(np.uint64)


def linked(data: np.ndarray, bounds: np.ndarray, group: np.ndarray, num: int, den: int) -> np.ndarray:
    """A label per set of a tile, equal where links lead from one to the other. Sets must be sorted by size.

    den * intersection >= num * union decides; only pairs of one candidate group are looked at.
    """
    sizes = np.diff(bounds)
    n = len(sizes)
    width = 64
    while width < 4096 and width < 4 * int(sizes[-1]) * (den - num) // den:
        width *= 2
    # Signature: every shingle flips one bit, so two signatures differ in no more bits than the sets in shingles.
    bits = np.zeros((n, width), bool)
    flat = np.repeat(np.arange(n), sizes) * width + (data % np.uint64(width)).astype(np.int64)
    bits.reshape(-1)[:] = np.bincount(flat, minlength=n * width) & 1
    signs = np.packbits(bits, axis=1).view(np.uint64)
    top = np.searchsorted(sizes, sizes * den // num, "right")
    label = np.arange(n)
    for r in range(n - 1):
        near = np.arange(r + 1, top[r])
        near = near[(label[near] != label[r]) & (group[near] == group[r])]
        if not len(near):
            continue
        differ = np.bitwise_count(signs[near] ^ signs[r]).sum(1, dtype=np.int64)
        total = sizes[near] + sizes[r]
        bound = (total - differ) // 2
        near = near[den * bound >= num * (total - bound)]
        mine = data[bounds[r] : bounds[r + 1]]
        while len(near):
            some, near = near[:CHUNK], near[CHUNK:]
            values = np.concatenate([data[bounds[c] : bounds[c + 1]] for c in some])
            place = np.minimum(np.searchsorted(mine, values), len(mine) - 1)
            ends = np.cumsum(sizes[some])
            common = np.add.reduceat(mine[place] == values, ends - sizes[some], dtype=np.int64)
            yes = some[den * common >= num * (sizes[some] + sizes[r] - common)]
            if len(yes):
                label[np.isin(label, label[yes])] = label[r]
                near = near[label[near] != label[r]]
    return label


def jaccard_join(
    docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 3, num: int = 9, den: int = 10, tile_rows: int = 2048
) -> DataFrame:
    """(key, n_shingles, component_id) per row: the size of its shingle set and the smallest key reachable by links.

    Two documents link when den * |intersection| >= num * |union|. A-Z are lower-cased, words are separated by blanks and
    the control characters 9 to 13. Texts that are null, empty or without words have the empty set, size 0, and link
    with nothing: component_id is their own key. Rows with a null key take part; a component of null keys only has a null
    id. Repeated rows give repeated rows. An empty table gives an empty table. Other columns are not looked at.
    """
    spark, key_type = docs.sparkSession, docs.schema[key].dataType
    docs = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))

    def summaries(batches):
        reader = Words(BLANK_SEPARATED, lower=True)
        for batch in batches:
            for a, b in pieces(batch["text"]):
                part = batch.slice(a, b - a)
                hashes, bounds = shingle_sets(reader, part["text"], words)
                yield pa.RecordBatch.from_arrays(
                    [part["key"], part["check"], pa.array(np.diff(bounds)), pa.array(set_ids(hashes, bounds))],
                    ["key", "check", "n_shingles", "set_id"],
                )

    marked = docs.select("key", F.xxhash64("text").alias("check"), "text")
    schema = marked.drop("text").withColumn("n_shingles", F.lit(0).cast("long")).withColumn("set_id", F.lit(0).cast("long")).schema
    rows = stored(marked.mapInArrow(summaries, schema), "sets")
    sets = rows.filter("set_id <> 0").groupBy("set_id").agg(
        F.min(F.struct("key", "check")).alias("one"), F.min("key").alias("low"), F.min("n_shingles").alias("n_shingles")
    )

    total = rows.agg(F.sum("n_shingles")).first()[0] or 0
    buckets = max(shuffle_partitions(spark), total * 5 // BUCKET_BYTES)  # some five bytes of keys per shingle

    def frequent(batches):
        reader = Words(BLANK_SEPARATED, lower=True)
        for batch in portions(batches):
            found = [shingle_sets(reader, batch["text"].slice(a, b - a), words)[0] for a, b in pieces(batch["text"])]
            shingles, count = np.unique(np.concatenate([np.zeros(0, np.uint64), *found]), return_counts=True)
            often = count >= max(COMMON_LEAST, COMMON_SHARE * len(batch))
            yield pa.RecordBatch.from_arrays([pa.array(shingles[often].view(np.int64)), pa.array(count[often])], ["shingle", "n"])

    totals = docs.select("text").mapInArrow(frequent, "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n"))
    top = totals.orderBy(F.desc("n"), "shingle").limit(COMMON).select("shingle").collect()
    common = spark.sparkContext.broadcast(np.sort(np.array([r[0] for r in top], np.int64).view(np.uint64)))

    def candidate_keys(batches):
        reader, bands = Words(BLANK_SEPARATED, lower=True), Bands(num, den)
        for batch in portions(batches):
            keys, ids = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
            for a, b in pieces(batch["text"]):
                hashes, bounds = shingle_sets(reader, batch["text"].slice(a, b - a), words)
                own = set_ids(hashes, bounds)
                k, s = part_keys(hashes, bounds, bands, common.value)
                keys.append(k)
                ids.append(own[s])
            (keys, centres), edges = stars(np.concatenate(keys), np.concatenate(ids))
            bucket = (keys % np.uint64(buckets)).astype(np.int32)
            order = np.argsort(bucket, kind="stable")
            bucket, keys, centres = bucket[order], keys[order], centres[order]
            cuts = runs(bucket)
            places, payloads = [int(bucket[i]) for i, _ in cuts], [planes(keys[i:j]) + packed(centres[i:j]) for i, j in cuts]
            kinds = [0] * len(places)
            if len(edges):
                places, kinds, payloads = [*places, int(edges[0, 1] % buckets)], [*kinds, 1], [*payloads, packed(edges[:, 0], edges[:, 1])]
            yield pa.RecordBatch.from_arrays(
                [pa.array(places, pa.int32()), pa.array(kinds, pa.int32()), pa.array(payloads, pa.binary())], ["bucket", "kind", "payload"]
            )

    def meet(group: pa.Table) -> pa.Table:
        keys, ids, edges = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros((0, 2), np.int64)]
        for kind, payload in zip(group["kind"].to_pylist(), group["payload"].to_pylist(), strict=True):
            if kind:
                edges.append(np.stack(unpacked(payload, np.int64, np.int64), 1))
            else:
                n = len(payload) // (KEY_BYTES + 8)
                keys.append(from_planes(payload, n))
                ids.append(np.frombuffer(payload, np.int64, n, n * KEY_BYTES))
        edges.append(stars(np.concatenate(keys), np.concatenate(ids))[1])
        edges = np.unique(np.concatenate(edges), axis=0)
        return pa.table({"a": edges[:, 0], "b": edges[:, 1]})

    met = docs.select("text").mapInArrow(candidate_keys, "bucket int, kind int, payload binary")
    met = met.groupBy("bucket").applyInArrow(meet, "a long, b long")
    groups = connected_components(met)

    # Candidates with their group, size band and tiles.
    bands = Bands(num, den)
    bands.reach(int(rows.agg(F.max("n_shingles")).first()[0] or 1) + 1)
    lows = F.array(*[F.lit(x) for x in bands.low])
    band = F.size(F.filter(lows, lambda low: low <= F.col("n_shingles"))) - 1
    found = groups.select(F.col("node").alias("set_id"), F.col("root").alias("group")).join(sets, "set_id")
    found = stored(found.select("set_id", "group", "one.key", "one.check", band.alias("band")), "candidates")
    count = found.count()
    of_group = found.groupBy("group").agg(F.count("*").alias("rows"))
    small = found.join(of_group.filter(F.col("rows") <= tile_rows), "group")
    few = max(1, 2 * count // tile_rows)
    small = small.select("set_id", "group", "key", "check", F.struct(F.lit(-1).alias("family"), F.pmod(F.xxhash64("group"), F.lit(few)).alias("x"), F.lit(0).cast("long").alias("y"), F.lit(0).cast("long").alias("z")).alias("tile"))
    large = found.join(of_group.filter(F.col("rows") > tile_rows), "group")
    large = large.withColumn("family", F.explode(F.array(F.col("band"), F.col("band") - 1)))
    blocks = large.groupBy("group", "family").agg(F.ceil(F.count("*") / tile_rows).alias("blocks"))
    large = large.join(blocks, ["group", "family"])
    mine = F.pmod(F.xxhash64("set_id"), F.col("blocks"))
    tile = F.transform(
        F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1),
        lambda other: F.struct(F.col("family"), F.col("group").alias("x"), F.least(mine, other).alias("y"), F.greatest(mine, other).alias("z")),
    )
    large = large.select("set_id", "group", "key", "check", F.explode(tile).alias("tile"))
    tiles = small.unionByName(large).groupBy("set_id", "group", "key", "check").agg(F.collect_set(F.xxhash64("tile")).alias("tiles"))
    # Texts of other rows than candidates are not shuffled.
    texts = may_match(marked, ["key", "check"], found, ["key", "check"], "wanted").filter("wanted")
    texts = texts.select(F.col("key").alias("k"), F.col("check").alias("c"), "text")
    texts = texts.join(tiles.hint("merge"), F.col("k").eqNullSafe(F.col("key")) & (F.col("c") == F.col("check"))).select("set_id", "group", "tiles", "text")

    def sets_of(batches):
        reader = Words(BLANK_SEPARATED, lower=True)
        for batch in batches:
            for a, b in pieces(batch["text"]):
                part = batch.slice(a, b - a)
                hashes, bounds = shingle_sets(reader, part["text"], words)
                content = pa.array([hashes[i:j].tobytes() for i, j in zip(bounds[:-1], bounds[1:], strict=True)], pa.binary())
                yield pa.RecordBatch.from_arrays([part["set_id"], part["group"], part["tiles"], content], ["set_id", "group", "tiles", "content"])

    content = texts.mapInArrow(sets_of, "set_id long, group long, tiles array<long>, content binary")
    content = content.select("set_id", "group", F.explode("tiles").alias("tile"), "content")

    def verify(group: pa.Table) -> pa.Table:
        ids, where = np.asarray(group["set_id"]), np.asarray(group["group"])
        _, one = np.unique(ids, return_index=True)
        content = group["content"]
        arrays = [np.frombuffer(content[int(i)].as_buffer(), np.uint64) for i in one]
        order = np.argsort([len(x) for x in arrays], kind="stable")
        arrays = [arrays[i] for i in order]
        ids, where = ids[one][order], where[one][order]
        bounds = np.concatenate(([0], np.cumsum([len(x) for x in arrays])))
        label = linked(np.concatenate(arrays), bounds, where, num, den)
        other = label != np.arange(len(label))
        return pa.table({"a": ids[label[other]], "b": ids[other]})

    links = content.groupBy("tile").applyInArrow(verify, "a long, b long")
    roots = connected_components(links).withColumnRenamed("node", "set_id")
    named = sets.select("set_id", "low").join(roots, "set_id", "left").withColumn("root", F.coalesce("root", "set_id"))
    # Both sides lie in written tables, so adaptive execution can split a root that many sets share.
    named = stored(named, "roots")
    lowest = stored(named.groupBy("root").agg(F.min("low").alias("component_id")), "lowest")
    named = named.join(lowest, "root").select("set_id", "component_id")
    out = rows.join(named, "set_id", "left")
    alone = F.when(F.col("set_id") == 0, F.col("key")).otherwise(F.col("component_id"))
    return out.select(F.col("key").cast(key_type).alias(key), "n_shingles", alone.alias("component_id"))
