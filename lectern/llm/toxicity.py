"""Toxicity by a weighted lexicon, matched with an Aho-Corasick automaton.

Texts are folded first: lower case, homoglyphs and digits back to the letters they stand for, everything else to blanks.
The lexicon holds words and word beginnings with weights learned from labelled rows. A hit inside an exception phrase does
not count. The weights of a text's hits are summed, normalised by its length and turned into a probability.
"""

from __future__ import annotations

import math
from typing import NamedTuple

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import with_fields
from lectern.llm.quality import sampled

TRAIN_ROWS = 20000  # labelled rows the lexicon is learned from, about
LEXICON = 5000  # entries at most
STEM = (4, 5, 6)  # lengths of word beginnings
SUPPORT = 5  # toxic documents that an entry needs
UNTRAINED = -3.0  # bias of a lexicon that nothing was learned for
PURITY = 0.8  # share of toxic documents among those that hold an entry

# Letters that look like a Latin letter, and digits and signs that stand for one.
HOMOGLYPHS = {
    "a": "аαɑａ@4", "b": "ьвƅｂ8", "c": "сϲｃ", "d": "ԁｄ", "e": "еεҽｅ3€", "f": "ｆ", "g": "ɡｇ9", "h": "һհｈ", "i": "іιıｉ1|",
    "j": "јϳｊ", "k": "кκｋ", "l": "ӏⅼｌ", "m": "мⅿｍ", "n": "ոηｎ", "o": "оοօｏ0", "p": "рρｐ", "q": "ԛｑ", "r": "гｒ", "s": "ѕʂｓ5$",
    "t": "тτｔ7+", "u": "υսｕ", "v": "νѵｖ", "w": "ѡԝｗ", "x": "хχｘ", "y": "уүｙ", "z": "ᴢｚ2",
}


class Lexicon(NamedTuple):
    entries: dict[str, float]  # folded; " word " is a whole word, " stem" a word beginning
    exceptions: list[str]  # folded phrases whose hits do not count
    scale: float
    bias: float


def fold_table() -> np.ndarray:
    """Folded code point of every code point; a blank for what is no letter."""
    points = (chr(i) if not 0xD800 <= i < 0xE000 else " " for i in range(0x110000))
    table = np.array([ord(c.lower()[0]) if c.isalnum() else 32 for c in points], np.uint32)
    for letter, alike in HOMOGLYPHS.items():
        for c in alike:
            table[ord(c)] = table[ord(c.upper()[0])] = ord(letter)
    return table


def fold(text: str | None, table: np.ndarray) -> str:
    """Folded text with one blank at either end."""
    points = table[np.frombuffer((text or "").encode("utf-32-le", "replace"), np.uint32)]
    return " " + points.astype("<u4").tobytes().decode("utf-32-le", "replace") + " "


def evidence(words: set[str]) -> set[str]:
    """Whole words and word beginnings, as lexicon entries."""
    return {f" {w} " for w in words} | {f" {w[:n]}" for w in words for n in STEM if len(w) >= n}


def counted(sample: DataFrame, found) -> DataFrame:
    """(entry, toxic, clean): in how many toxic and clean documents each of `found(folded text)` occurs."""

    def count(batches):
        table, read = fold_table(), found()
        for batch in batches:
            seen: dict[str, list[int]] = {}
            for t, y in zip(batch["text"], batch["y"].to_pylist(), strict=True):
                for entry in read(fold(t.as_py(), table)):
                    seen.setdefault(entry, [0, 0])[y] += 1
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(seen), pa.string()), pa.array([n[1] for n in seen.values()], pa.int64()), pa.array([n[0] for n in seen.values()], pa.int64())],
                ["entry", "toxic", "clean"],
            )

    return sample.mapInArrow(count, "entry string, toxic long, clean long").groupBy("entry").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def scanner(entries: dict[str, float], exceptions: list[str]):
    """A function from folded text to its hits, as (start, end, entry, excepted)."""
    automaton = ahocorasick.Automaton()
    for e in entries:
        automaton.add_word(e, (len(e), e, False))
    for phrase in exceptions:
        automaton.add_word(phrase, (len(phrase), phrase, True))
    if len(automaton):
        automaton.make_automaton()

    def scan(text: str) -> list[tuple[int, int, str, bool]]:
        if not len(automaton):
            return []
        found = [(end + 1 - n, end + 1, e, x) for end, (n, e, x) in automaton.iter(text)]
        free = [(s, e) for s, e, _, x in found if x]
        return [(s, e, name, any(a <= s and e <= b for a, b in free)) for s, e, name, x in found if not x]

    return scan


def strength(text: str, entries: dict[str, float], scan) -> float:
    """Summed weights of the hits, one per word, divided by the logarithm of the length."""
    best: dict[int, float] = {}
    for start, _, entry, excepted in scan(text):
        if not excepted:
            best[start] = max(best.get(start, 0.0), entries[entry])
    return sum(best.values()) / math.log(16 + len(text)) if best else 0.0


def learn_lexicon(
    docs: DataFrame, labels: DataFrame, label: str = "toxic", train_rows: int = TRAIN_ROWS, exceptions: tuple[str, ...] = (), key: str = "doc_id", text: str = "text"
) -> Lexicon:
    """Entries, exception phrases and calibration from a bounded sample of labelled rows.

    An entry occurs in SUPPORT toxic documents and in few clean ones; beginnings stand for the longer entries they
    cover. Exception phrases are the given ones, and pairs of a word and a hit (in either order) that mostly clean documents hold.
    Without labelled rows the lexicon is empty and every score low.
    """
    sample = sampled(docs, labels, label, train_rows, key, text)
    strong = counted(sample, lambda: lambda t: evidence(set(t.split())))
    strong = strong.filter((F.col("toxic") >= SUPPORT) & (F.col("toxic") >= PURITY * (F.col("toxic") + F.col("clean"))))
    weight = F.log((F.col("toxic") + 0.5) / (F.col("clean") + 0.5)) + 1
    rows = strong.select("entry", weight.alias("weight")).orderBy(F.desc("weight"), "entry").limit(LEXICON).collect()
    entries: dict[str, float] = {}
    for entry, value in sorted(((r["entry"], r["weight"]) for r in rows), key=lambda x: (len(x[0]), x[0])):
        if not any(entry[:n] in entries for n in range(2, len(entry))):
            entries[entry] = float(value)

    def phrases():
        scan = scanner(entries, [])

        def read(t: str) -> set[str]:
            out = set()
            for start, end, _, _ in scan(t):
                stop = t.find(" ", max(end - 1, start + 1))
                before = t.rfind(" ", 0, max(start, 0)) if start > 0 else -1
                after = t.find(" ", stop + 1)
                if 0 <= before < start - 1:
                    out.add(t[before : stop + 1])
                if after > stop + 1:
                    out.add(t[start : after + 1])
            return out

        return read

    table = fold_table()
    free = [f" {' '.join(fold(p, table).split())} " for p in exceptions]
    if entries:
        calm = counted(sample, phrases).filter((F.col("clean") >= SUPPORT) & (F.col("clean") >= PURITY * (F.col("toxic") + F.col("clean"))))
        free += [r["entry"] for r in calm.orderBy(F.desc("clean"), "entry").limit(LEXICON).collect()]

    def strengths(batches):
        table, scan = fold_table(), scanner(entries, free)
        for batch in batches:
            values = [round(strength(fold(t.as_py(), table), entries, scan), 2) for t in batch["text"]]
            yield pa.RecordBatch.from_arrays([pa.array(values, pa.float64()), batch["y"]], ["x", "y"])

    points = sample.mapInArrow(strengths, "x double, y int").groupBy("x", "y").agg(F.count("*").alias("n")).orderBy("x", "y").collect()
    return Lexicon(entries, sorted(set(free)), *calibrate([(r["x"], r["y"], r["n"]) for r in points]))


def calibrate(points: list[tuple[float, int, int]]) -> tuple[float, float]:
    """Scale and bias of a logistic curve through (strength, label, count), by Newton steps with a slight pull to zero."""
    if not points:
        return 1.0, UNTRAINED
    x, y, n = (np.array(c, float) for c in zip(*points, strict=True))
    features = np.stack((x, np.ones_like(x)), 1)
    w = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(features @ w, -30, 30)))
        slope = features.T @ (n * (p - y)) + 0.05 * w
        curve = (features * (n * p * (1 - p))[:, None]).T @ features + 0.05 * np.eye(2)
        step = np.linalg.solve(curve, slope)
        w -= np.clip(step, -2, 2)
    return float(max(w[0], 0.0)), float(w[1])


def score_toxicity(docs: DataFrame, lexicon: Lexicon, key: str = "doc_id", text: str = "text", threshold: float = 0.3) -> DataFrame:
    """(key, score, predicted) per row: probability of toxicity, and 1 where it reaches the threshold.

    Whole texts are read, nothing is shuffled. Null and empty texts have no hits and get the score of the bias. Repeated
    rows and null keys give rows like any other; an empty table gives an empty table.
    """
    shared = docs.sparkSession.sparkContext.broadcast(tuple(lexicon))
    source = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))

    def predict(batches):
        entries, exceptions, scale, bias = shared.value
        table, scan = fold_table(), scanner(entries, exceptions)
        for batch in batches:
            scores = []
            for t in batch["text"]:
                folded = fold(t.as_py(), table)
                z = scale * strength(folded, entries, scan) + bias
                scores.append(1 / (1 + math.exp(-max(-500.0, min(500.0, z)))))
            predicted = [int(s >= threshold) for s in scores]
            yield pa.RecordBatch.from_arrays([batch["key"], pa.array(scores, pa.float64()), pa.array(predicted, pa.int32())], ["key", "score", "predicted"])

    schema = with_fields(source.select("key").schema, "score double, predicted int")
    return source.mapInArrow(predict, schema).withColumnRenamed("key", key)
