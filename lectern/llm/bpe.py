"""Byte-level BPE by a global shuffle of distinct words.

Texts are cut into pre-tokens. A piece of some megabytes becomes one row: its distinct words, and for every document the
numbers of its words in order. The distinct words are exploded and shuffled by a hash of the word, so all pieces' copies
of a word meet and each distinct word is encoded once; the ids are joined back to every piece that has the word, and the
documents are reassembled by position. `encode_and_decode` looks the bytes of the ids up in the broadcast vocabulary, in
the task that has just joined them, as a join would shuffle every id once more; `decode` is the join with the token-byte
table for ids that come from elsewhere, and no query calls it. Words travel in lists, one per
piece and task group, as a row per word would cost several times its bytes; a word that is everywhere comes once per piece,
so no key is hot.
"""

from __future__ import annotations

import base64
import heapq
import zlib

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm.common import shuffle_partitions, stored, with_fields
from lectern.llm.words import pieces, runs

PIECE_BYTES = 32 << 20  # text of a piece, at most about
GROUP_BYTES = 16 << 20  # text per task group of words
MAX_TOKENS = 1 << 20  # the largest vocabulary that is broadcast


def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and ranks of a vocabulary file: base64 and rank per line."""
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}
    if len(ranks) > MAX_TOKENS:
        raise ValueError(f"{len(ranks)} tokens; at most {MAX_TOKENS} are broadcast")
    return ranks


def encode_word(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one pre-token: merge the pair of lowest rank, the leftmost of equals, until none is left."""
    if word in ranks:
        return [ranks[word]]
    n = len(word)
    end = list(range(1, n + 1))  # end of the part that starts here
    before = list(range(-1, n - 1))
    alive = [True] * n
    heap = [(ranks[word[i : i + 2]], i, i + 2) for i in range(n - 1) if word[i : i + 2] in ranks]
    heapq.heapify(heap)
    while heap:
        _, i, e = heapq.heappop(heap)
        if not alive[i] or end[i] >= n or end[end[i]] != e:
            continue
        alive[end[i]] = False
        end[i] = e
        if e < n:
            before[e] = i
            if (r := ranks.get(word[i : end[e]])) is not None:
                heapq.heappush(heap, (r, i, end[e]))
        if (p := before[i]) >= 0 and (r := ranks.get(word[p:e])) is not None:
            heapq.heappush(heap, (r, p, e))
    out, i = [], 0
    while i < n:
        out.append(ranks[word[i : end[i]]])
        i = end[i]
    return out


def token_table(spark: SparkSession, ranks: dict[bytes, int]) -> DataFrame:
    """(id, bytes) of every token."""
    return spark.createDataFrame([(i, bytearray(b)) for b, i in ranks.items()], "id int, bytes binary")


def decode(rows: DataFrame, tokens: DataFrame, key: str, ids: str = "ids") -> DataFrame:
    """(key, decoded) of rows with distinct keys: the bytes of all ids, by a join with the token-byte table.

    The table is broadcast, as a vocabulary has a fixed size. No ids, or null, decode to no bytes; an unknown id raises.
    """
    each = rows.select(key, F.posexplode_outer(ids).alias("pos", "id")).join(F.broadcast(tokens), "id", "left")
    each = each.withColumn("bytes", F.when(F.col("id").isNotNull() & F.col("bytes").isNull(), F.raise_error(F.lit("unknown token id"))).otherwise(F.col("bytes")))
    in_order = F.array_sort(F.collect_list(F.when(F.col("id").isNotNull(), F.struct("pos", F.hex("bytes").alias("hex")))))
    done = each.groupBy(key).agg(in_order.alias("parts"))
    return done.select(key, F.unhex(F.array_join(F.transform("parts", lambda p: p["hex"]), "")).alias("decoded"))


def gathered(slots: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Positions of the elements of the chosen lists, list after list."""
    size = (bounds[1:] - bounds[:-1])[slots]
    ends = np.cumsum(size)
    return np.repeat(bounds[slots] - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)


def codec() -> pa.Codec:
    return pa.Codec("zstd", compression_level=6)


def squeezed(values: np.ndarray) -> bytes:
    """Unsigned 32-bit numbers, the mostly empty high bytes apart from the low ones, compressed."""
    planes = np.ascontiguousarray(values.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()
    return len(values).to_bytes(8, "little") + codec().compress(planes, asbytes=True)


def unsqueezed(data: bytes) -> np.ndarray:
    n = int.from_bytes(data[:8], "little")
    planes = np.frombuffer(codec().decompress(data[8:], 4 * n), np.uint8).reshape(4, n)
    return np.ascontiguousarray(planes.T).view("<u4").reshape(-1).astype(np.int64)


def packed_words(words: pa.Array) -> bytes:
    """Lengths and UTF-8 bytes of words, compressed."""
    words = words.cast(pa.large_binary())
    bounds = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + len(words) + 1]
    raw = words.buffers()[2].slice(bounds[0], bounds[-1] - bounds[0]) if len(words) and bounds[-1] > bounds[0] else b""
    sizes = squeezed(np.diff(bounds).astype(np.uint32))
    return len(sizes).to_bytes(8, "little") + sizes + codec().compress(raw, asbytes=True)


def unpacked_words(data: bytes) -> list[bytes]:
    at = 8 + int.from_bytes(data[:8], "little")
    ends = np.cumsum(unsqueezed(data[8:at]))
    raw = codec().decompress(data[at:], int(ends[-1]) if len(ends) else 0, asbytes=True)
    return [raw[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=False)]


def encode_and_decode(docs: DataFrame, ranks: dict[bytes, int], pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ids, decoded) per row: token ids of the text without special tokens, and the bytes they decode to.

    A null text counts as empty; empty texts have no ids and no bytes. Repeated rows and null keys give rows like any
    other. An empty table gives an empty table. Other columns are not looked at.
    """
    spark, key_type = docs.sparkSession, docs.schema[key].dataType
    shared = spark.sparkContext.broadcast(ranks)
    source = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    total = source.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    homes = max(shuffle_partitions(spark), total // GROUP_BYTES)

    def cut(batches):
        find = regex.compile(pattern).findall
        for batch in batches:
            for a, b in pieces(batch["text"], PIECE_BYTES):
                numbers: dict[str, int] = {}
                counts, lists = [], []
                for t in batch["text"].slice(a, b - a):
                    mine = [numbers.setdefault(w, len(numbers)) for w in find(t.as_py() or "")]
                    counts.append(len(mine))
                    lists.append(np.array(mine, np.uint32))
                slots = np.concatenate(lists)
                # Frequent words get small numbers, which compress well.
                order = np.argsort(-np.bincount(slots, minlength=len(numbers)), kind="stable")
                renumber = np.empty(len(order), np.uint32)
                renumber[order] = np.arange(len(order), dtype=np.uint32)
                words = pa.array(list(numbers), pa.string()).take(pa.array(order))
                home = np.array([zlib.crc32(w.encode()) % homes for w in numbers], np.uint32)[order]
                by_home = np.argsort(home, kind="stable")
                cuts = runs(home[by_home])
                words = words.take(pa.array(by_home))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([batch["key"].slice(a, b - a).to_pylist()], pa.list_(batch["key"].type)),
                        pa.array([counts], pa.list_(pa.int32())),
                        pa.array([squeezed(renumber[slots])], pa.binary()),
                        pa.array([squeezed(home)], pa.binary()),
                        pa.array([[int(home[by_home[i]]) for i, _ in cuts]], pa.list_(pa.int32())),
                        pa.array([[packed_words(words.slice(i, j - i)) for i, j in cuts]], pa.list_(pa.binary())),
                    ],
                    ["keys", "counts", "slots", "home_of", "homes", "words"],
                )

    schema = with_fields(source.select(F.array("key").alias("keys")).schema, "counts array<int>, slots binary, home_of binary, homes array<int>, words array<binary>")
    # A piece's number is drawn once and kept by the written table, so a task that runs again cannot mix pieces up.
    rows = stored(source.mapInArrow(cut, schema).withColumn("piece", F.monotonically_increasing_id()), "pieces")

    def encode(group: pa.Table) -> pa.Table:
        known, table = shared.value, {}
        sizes, ids = [], []
        for words in group["words"].to_pylist():
            found = [table[w] if w in table else table.setdefault(w, encode_word(w, known)) for w in unpacked_words(words)]
            sizes.append(squeezed(np.array([len(x) for x in found], np.uint32)))
            ids.append(squeezed(np.array([i for x in found for i in x], np.uint32)))
        return pa.table({"piece": group["piece"], "home": group["home"], "sizes": pa.array(sizes, pa.binary()), "ids": pa.array(ids, pa.binary())})

    used = rows.select("piece", F.explode(F.arrays_zip("homes", "words")).alias("x")).select("piece", F.col("x.homes").alias("home"), F.col("x.words").alias("words"))
    encoded = used.groupBy("home").applyInArrow(encode, "piece long, home int, sizes binary, ids binary")

    def assemble(docs_of: pa.Table, words_of: pa.Table) -> pa.Table:
        token_bytes = [b""] * (max(shared.value.values(), default=-1) + 1)
        for token, i in shared.value.items():
            token_bytes[i] = token
        token_bounds = np.concatenate(([0], np.cumsum([len(x) for x in token_bytes])))
        token_raw = np.frombuffer(b"".join(token_bytes), np.uint8)
        order = np.argsort(np.asarray(words_of["home"]))
        sizes = [unsqueezed(words_of["sizes"][int(i)].as_py()) for i in order]
        ids = [unsqueezed(words_of["ids"][int(i)].as_py()) for i in order]
        sizes, ids = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (sizes, ids))
        keys, counts = docs_of["keys"][0].values, np.asarray(docs_of["counts"][0].values).astype(np.int64)
        slots, home_of = unsqueezed(docs_of["slots"][0].as_py()), unsqueezed(docs_of["home_of"][0].as_py())
        # Words arrived by home; find each number's ids.
        place = np.empty(len(home_of), np.int64)
        place[np.argsort(home_of, kind="stable")] = np.arange(len(home_of))
        bounds = np.concatenate(([0], np.cumsum(sizes)))
        ends = np.concatenate(([0], np.cumsum(counts)))
        edges = pieces_of(counts)
        out = []
        for a, b in edges:
            mine = place[slots[ends[a] : ends[b]]]
            values = ids[gathered(mine, bounds)]
            at = np.concatenate(([0], np.cumsum(sizes[mine])))[ends[a : b + 1] - ends[a]]
            raw_at = np.concatenate(([0], np.cumsum((token_bounds[1:] - token_bounds[:-1])[values])))[at]
            lists = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(values.astype(np.int32)))
            content = token_raw[gathered(values, token_bounds)]
            decoded = pa.LargeBinaryArray.from_buffers(pa.large_binary(), b - a, [None, pa.py_buffer(raw_at), pa.py_buffer(content)])
            out.append(pa.table({"key": keys.slice(a, b - a), "ids": lists, "decoded": decoded.cast(pa.binary())}))
        return pa.concat_tables(out)

    lists = rows.select(F.col("piece").alias("of"), "keys", "counts", "slots", "home_of")
    done = lists.groupBy("of").cogroup(encoded.groupBy("piece")).applyInArrow(assemble, with_fields(source.select("key").schema, "ids array<int>, decoded binary"))
    return done.select(F.col("key").cast(key_type).alias(key), "ids", "decoded")


def pieces_of(counts: np.ndarray, limit: int = 1 << 18) -> list[tuple[int, int]]:
    """Ranges of documents of about `limit` words each."""
    return runs((np.cumsum(counts) - counts) // limit)


def digests(encoded: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, n_tokens, ids_sha256, decoded_sha256) of encoded rows."""
    return encoded.select(
        key,
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
