"""Language identification by rank-order n-gram profiles (out-of-place distance)."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm.common import with_fields

PROFILE = 400  # n-grams per profile
TRAIN_ROWS = 4000  # labelled rows per language that profiles are learned from, about
MAX_LANGUAGES = 2000  # profiles are broadcast; more languages are refused
UNKNOWN = "und"


class Profiles(NamedTuple):
    names: list[str]  # in order
    codes: np.ndarray  # sorted n-grams of all profiles
    ranks: np.ndarray  # one row per n-gram, one column per language; PROFILE where it is missing


def letter_table() -> np.ndarray:
    """Lower-case letter of every code point, 0 for what is no letter."""
    points = [chr(i) if not 0xD800 <= i < 0xE000 else " " for i in range(0x110000)]
    return np.array([ord(c.lower()[0]) if c.isalpha() else 0 for c in points], np.uint32)


def grams(text: str | None, letters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes and counts of the runs of one to three letters; a gap between words counts as one letter of its own."""
    points = letters[np.frombuffer((text or "").encode("utf-32-le", "replace"), np.uint32)]
    points = np.concatenate(([np.uint32(0)], points, [np.uint32(0)]))
    points = points[np.concatenate(([True], (points[1:] != 0) | (points[:-1] != 0)))].astype(np.int64)
    if len(points) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    one = points[points != 0]
    two = ((points[:-1] + 1) << 21) | points[1:]
    middle = points[1:-1] != 0
    three = (((points[:-2] + 1) << 42) | ((points[1:-1] + 1) << 21) | points[2:])[middle]
    return np.unique(np.concatenate((one, two, three)), return_counts=True)


def ranked(codes: np.ndarray, counts: np.ndarray, size: int) -> np.ndarray:
    """The most frequent codes, ties to the smaller code."""
    return codes[np.argsort(-counts, kind="stable")[:size]]


def learn_profiles(docs: DataFrame, lang: str = "lang", text: str = "text", key: str = "doc_id", size: int = PROFILE, train_rows: int = TRAIN_ROWS) -> Profiles:
    """Profiles of all non-null values of `lang`, from about `train_rows` rows of each, chosen by a hash of the key."""
    labelled = docs.select(F.col(key).alias("key"), F.col(lang).cast("string").alias("lang"), F.col(text).alias("text")).filter("lang is not null and text is not null")
    shares = labelled.groupBy("lang").agg(F.count("*").alias("rows")).limit(MAX_LANGUAGES + 1).collect()
    if len(shares) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    share = F.broadcast(docs.sparkSession.createDataFrame(shares, "lang string, rows long"))
    draw = F.pmod(F.xxhash64(F.coalesce(F.col("key").cast("string"), F.col("text"))), F.lit(1_000_000))
    sample = labelled.join(share, "lang").filter(draw * F.col("rows") < F.lit(1_000_000 * train_rows)).select("lang", "text")

    def count(batches):
        letters = letter_table()
        for batch in batches:
            found: dict[str, list] = {}
            for name, t in zip(batch["lang"].to_pylist(), batch["text"], strict=True):
                found.setdefault(name, []).append(grams(t.as_py(), letters))
            for name, parts in found.items():
                codes, back = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
                n = np.bincount(back, np.concatenate([p[1] for p in parts]), len(codes)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(codes), pa.string()), pa.array(codes), pa.array(n)], ["lang", "code", "n"])

    totals = sample.mapInArrow(count, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "code"))
    rows = totals.withColumn("rank", place).filter(F.col("rank") <= size).select("lang", "code", "rank").collect()
    names = sorted({r["lang"] for r in rows})
    codes = np.unique(np.array([r["code"] for r in rows], np.int64))
    ranks = np.full((len(codes), len(names)), PROFILE, np.int32)
    column = {name: i for i, name in enumerate(names)}
    for r in rows:
        ranks[np.searchsorted(codes, r["code"]), column[r["lang"]]] = r["rank"] - 1
    return Profiles(names, codes, ranks)


def distances(codes: np.ndarray, counts: np.ndarray, known: np.ndarray, ranks: np.ndarray) -> tuple[np.ndarray, int]:
    """Out-of-place distance to every language, and the number of n-grams it is summed over."""
    top = ranked(codes, counts, PROFILE)
    at = np.minimum(np.searchsorted(known, top), len(known) - 1)
    hit = known[at] == top
    of = ranks[at[hit]]
    apart = np.where(of == PROFILE, PROFILE, np.abs(of - np.flatnonzero(hit)[:, None]))
    return apart.sum(0, dtype=np.int64) + PROFILE * int((~hit).sum()), len(top)


def identify(docs: DataFrame, profiles: Profiles, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, lang_pred, score) per row.

    The document's most frequent n-grams are ranked; each costs the difference of its ranks in the document and in the
    language's profile, or the profile's size where it is missing. The smallest sum wins, ties go to the first name.
    score is the winner's share of closeness among all languages, between 0 and 1. Null texts, texts without letters,
    and every text when no profile was learned, give `und` with score 0. Whole texts are read; nothing is shuffled.
    """
    shared = docs.sparkSession.sparkContext.broadcast(tuple(profiles))
    source = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))

    def predict(batches):
        letters = letter_table()
        names, known, ranks = shared.value
        for batch in batches:
            langs, scores = [], []
            for t in batch["text"]:
                codes, counts = grams(t.as_py(), letters)
                if not len(codes) or not names:
                    langs.append(UNKNOWN)
                    scores.append(0.0)
                    continue
                away, n = distances(codes, counts, known, ranks)
                close = 1.0 - away / (PROFILE * n)
                best = int(np.argmin(away))
                total = float(close.sum())
                langs.append(names[best])
                scores.append(float(close[best]) / total if total > 0 else 0.0)
            yield pa.RecordBatch.from_arrays([batch["key"], pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["key", "lang_pred", "score"])

    schema = with_fields(source.select("key").schema, "lang_pred string, score double")
    return source.mapInArrow(predict, schema).withColumnRenamed("key", key)
