"""Quality classifier: supervised subword embeddings.

Words, pairs of words and the character n-grams inside words are hashed into buckets. A document is the mean of its buckets' learned
vectors; a softmax over that mean gives the class. Training is stochastic gradient descent in numpy on a bounded sample
of labelled rows. The mean and the softmax's scores are linear, so for scoring each bucket's vector is reduced to the one
number by which it moves the score.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import stored, with_fields
from lectern.llm.words import BASE, BLANK_SEPARATED, Words, mix, pieces

BUCKET_BITS = 16
DIM = 16
EPOCHS = 8
RATE = 0.5
TRAIN_ROWS = 4000  # labelled rows the model is fitted on, about
TRAIN_BYTES = 256 << 20  # of their features, at most about
GRAMS = (3, 4)
REPEATED = np.uint64(0x5EED5EED5EED5EED)


class Model(NamedTuple):
    weight: np.ndarray  # per bucket: softmax score of class 1 less that of class 0
    bias: float


def buckets(reader: Words, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) of all words, word pairs, and character n-grams that do not span a gap between words.

    All pairs of a word and itself share one bucket, so repetition is seen whatever the word.
    """
    spans = reader.read(texts)
    rows, hashes = [spans.row], [spans.hash]
    if len(spans.row) > 1:
        near = np.flatnonzero(spans.row[1:] == spans.row[:-1])
        left, right = spans.hash[near], spans.hash[near + 1]
        rows.append(spans.row[near])
        hashes.append(np.where(left == right, REPEATED, mix(left * np.uint64(BASE) + right)))
    # Bytes of words, with one blank before each word and after each text.
    inside = reader.word_bytes[spans.raw]
    first = np.zeros(len(spans.raw), bool)
    first[spans.start] = True
    place = np.cumsum(inside) + np.cumsum(first)
    stream = np.full(int(place[-1]) + 1 if len(place) else 1, 0x20, np.uint8)
    stream[place[inside] - 1] = spans.raw[inside]
    owner = np.zeros(len(stream), np.int64)
    word_at = place[spans.start] - 2 if len(place) else np.zeros(0, np.int64)  # the blank before the word
    if len(word_at):
        owner = np.repeat(spans.row, np.diff(np.append(word_at, len(stream))))
        owner[-1] = -1  # as for other rows, the blank after the last word is not counted
    value = reader.value[stream]
    gap = stream == 0x20
    for n in GRAMS:
        m = len(stream) - n + 1
        if m <= 0:
            continue
        h = np.full(m, np.uint64(n))
        for j in range(n):
            h = h * np.uint64(BASE) + value[j : j + m]
        ok = owner[:m] == owner[n - 1 : n - 1 + m]
        for j in range(1, n - 1):
            ok &= ~gap[j : j + m]
        rows.append(owner[:m][ok])
        hashes.append(mix(h[ok]))
    return np.concatenate(rows), (np.concatenate(hashes) >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)


def fit(samples: list[tuple[bytes, bytes, int]], seed: int = 7) -> Model:
    """Gradient descent over (distinct buckets, their shares of the document, label), one document at a time."""
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / DIM, 1 / DIM, (1 << BUCKET_BITS, DIM)).astype(np.float32)
    output, bias = np.zeros((2, DIM), np.float32), np.zeros(2, np.float32)
    data = [(np.frombuffer(b, np.int32), np.frombuffer(s, np.float32), y) for b, s, y in samples]
    total, done = max(1, EPOCHS * len(data)), 0
    for _ in range(EPOCHS):
        for i in rng.permutation(len(data)):
            at, share, y = data[i]
            rate = np.float32(RATE * (1 - done / total))
            done += 1
            mean = share @ vectors[at] if len(at) else np.zeros(DIM, np.float32)
            score = output @ mean + bias
            p = np.exp(score - score.max())
            error = p / p.sum()
            error[y] -= 1
            back = error @ output
            output -= rate * np.outer(error, mean)
            bias -= np.float32(0.1) * rate * error
            if len(at):
                # A step for each bucket in proportion to its share, scaled up as shares are small.
                vectors[at] -= (rate * np.minimum(share * 100, 1))[:, None] * back
    weight = vectors @ (output[1] - output[0])
    return Model(weight.astype(np.float32), float(bias[1] - bias[0]))


def sampled(docs: DataFrame, labels: DataFrame, label: str, train_rows: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, text, y) of about `train_rows` labelled documents, chosen by a hash of the key."""
    known = labels.select(F.col(key).alias("key"), F.col(label).cast("int").alias("y")).filter("key is not null and y in (0, 1)")
    n = known.count()
    draw = F.pmod(F.xxhash64("key"), F.lit(1_000_000))
    few = known.filter(draw * F.lit(n) < F.lit(1_000_000 * train_rows)).distinct()
    return docs.select(F.col(key).alias("key"), F.col(text).alias("text")).join(F.broadcast(few), "key")


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", train_rows: int = TRAIN_ROWS, key: str = "doc_id", text: str = "text") -> Model:
    """Fit on a bounded sample. Without labelled rows the model is neutral: every score is 0.5.

    Of the rows that share a key and a label one counts, the one whose text has the smallest hash: a key on any number of
    rows gives one of the `train_rows`. The driver takes them in the order of their hashes until TRAIN_BYTES are full.
    """

    def features(batches):
        reader = Words(BLANK_SEPARATED)
        best: dict[tuple, int] = {}  # as many as there are keys in the sample
        for batch in batches:
            keep = []
            for i, (k, y, h) in enumerate(zip(batch["key"].to_pylist(), batch["y"].to_pylist(), batch["draw"].to_pylist(), strict=True)):
                if h < best.get((k, y), h + 1):
                    best[k, y] = h
                    keep.append(i)
            batch = batch.take(pa.array(keep, pa.int64()))
            for a, b in pieces(batch["text"]):
                rows, found = buckets(reader, batch["text"].slice(a, b - a))
                codes, counts = np.unique(rows * (1 << BUCKET_BITS) + found, return_counts=True)
                row, bucket = codes >> BUCKET_BITS, (codes & ((1 << BUCKET_BITS) - 1)).astype(np.int32)
                cuts = np.searchsorted(row, np.arange(b - a + 1))
                shares = []
                for i, j in zip(cuts[:-1], cuts[1:], strict=True):
                    shares.append((bucket[i:j].tobytes(), (counts[i:j] / max(1, counts[i:j].sum())).astype(np.float32).tobytes()))
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays(
                    [part["key"], part["y"], part["draw"], pa.array([s[0] for s in shares], pa.binary()), pa.array([s[1] for s in shares], pa.binary())],
                    ["key", "y", "draw", "bucket", "share"],
                )

    sample = sampled(docs, labels, label, train_rows, key, text).withColumn("draw", F.xxhash64("text"))
    schema = with_fields(sample.select("key", "y", "draw").schema, "bucket binary, share binary")
    first = stored(sample.mapInArrow(features, schema), "features")
    # One row per key and label: those of equal draw have equal texts.
    first = first.groupBy("key", "y").agg(F.min_by(F.struct("bucket", "share"), "draw").alias("x")).orderBy(F.xxhash64("key"), "key", "y")
    taken, size = [], 0
    for r in first.toLocalIterator():
        size += len(r["x"]["bucket"]) + len(r["x"]["share"])
        if taken and size > TRAIN_BYTES:
            break
        taken.append((r["key"], r["y"], bytes(r["x"]["bucket"]), bytes(r["x"]["share"])))
    taken.sort(key=lambda r: r[:3])
    return fit([(bucket, share, y) for _, y, bucket, share in taken])


def scores(reader: Words, model: Model, texts: pa.Array) -> np.ndarray:
    """Probability of class 1 of every text."""
    rows, found = buckets(reader, texts)
    total = np.bincount(rows, model.weight[found], len(texts))
    z = model.bias + total / np.maximum(np.bincount(rows, minlength=len(texts)), 1)
    return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def classify(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text", threshold: float = 0.5) -> DataFrame:
    """(key, score, predicted) per row: the probability of class 1, and 1 where it reaches the threshold.

    Whole texts are read, nothing is shuffled. Null, empty and blank texts have no bucket and get the score of the bias.
    Repeated rows and null keys give rows like any other; an empty table gives an empty table.
    """
    shared = docs.sparkSession.sparkContext.broadcast(tuple(model))
    source = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))

    def predict(batches):
        reader = Words(BLANK_SEPARATED)
        known = Model(*shared.value)
        for batch in batches:
            for a, b in pieces(batch["text"]):
                part = batch.slice(a, b - a)
                score = scores(reader, known, part["text"])
                yield pa.RecordBatch.from_arrays([part["key"], pa.array(score), pa.array((score >= threshold).astype(np.int32))], ["key", "score", "predicted"])

    schema = with_fields(source.select("key").schema, "score double, predicted int")
    return source.mapInArrow(predict, schema).withColumnRenamed("key", key)


def accepted(docs: DataFrame, model: Model, text: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows, with all their columns, whose score reaches the threshold; as `classify` scores them."""
    shared = docs.sparkSession.sparkContext.broadcast(tuple(model))

    def keep(batches):
        reader, known = Words(BLANK_SEPARATED), Model(*shared.value)
        for batch in batches:
            for a, b in pieces(batch[text]):
                part = batch.slice(a, b - a)
                yield part.filter(pa.array(scores(reader, known, part[text]) >= threshold))

    return docs.mapInArrow(keep, docs.schema)
