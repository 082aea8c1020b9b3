"""Periodic runs of words, by a suffix automaton with link-cut access.

A run is a longest stretch of words in which words `period` apart are identical and which holds its period twice. Per
stretch of a text:

1. Its suffix automaton is built; the suffix links form a tree with one node for every prefix.
2. The words are appended one after the other. Appending word i accesses the node of prefix i in a link-cut forest over
   that tree: the path to the root is cut into segments by the last end position at which their strings occurred before,
   and is then recoloured with i.
3. A segment holds the suffixes whose lengths lie in (low, high] and whose last end is e. If i - e lies in that range, the
   last i - e words stand twice in a row: a square, whose period is the smallest one. Squares are extended to runs.

Every word of a run of 12 or more words lies in a gram of six words that occurs twice within the run. So texts are cut
first into the stretches that such repeated grams cover; what is in no stretch is in no run, and prose that repeats nothing
costs one sort of its grams. The work in a stretch of n words is n log n steps, also where all words are equal.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import with_fields
from lectern.llm.words import BASE, BLANK_SEPARATED, Words, combined, joined, mix, pieces, run_starts

LEAST = 12  # words of a run
ROUNDS = 8  # times a text is cut anew at words that no repeated gram covers


def automaton(codes: list[int]) -> tuple[list[int], list[int], list[int]]:
    """Suffix automaton: (length of each state, its suffix link, state of each prefix); state 0 is the empty string."""
    step, link, length, last, prefix = [{}], [-1], [0], 0, []
    for c in codes:
        new = len(length)
        length.append(length[last] + 1)
        step.append({})
        link.append(0)
        p = last
        while p >= 0 and c not in step[p]:
            step[p][c] = new
            p = link[p]
        if p >= 0:
            q = step[p][c]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                twin = len(length)
                length.append(length[p] + 1)
                step.append(dict(step[q]))
                link.append(link[q])
                while p >= 0 and step[p].get(c) == q:
                    step[p][c] = twin
                    p = link[p]
                link[q] = link[new] = twin
        last = new
        prefix.append(new)
    return length, link, prefix


class Paths:
    """Link-cut forest over a fixed tree: coloured root paths, each a splay tree ordered by depth. Node 0 is no node."""

    def __init__(self, parent: list[int]):
        self.up = parent  # splay parent, or, at the root of a splay tree, the node above the path
        self.shallow, self.deep = [0] * len(parent), [0] * len(parent)
        self.colour = [-1] * len(parent)  # of a path, kept at the root of its splay tree

    def _rotate(self, x: int) -> None:
        up, shallow, deep = self.up, self.shallow, self.deep
        p = up[x]
        g = up[p]
        if shallow[p] == x:
            middle = shallow[p] = deep[x]
            deep[x] = p
        else:
            middle = deep[p] = shallow[x]
            shallow[x] = p
        if middle:
            up[middle] = p
        up[p], up[x] = x, g
        if shallow[g] == p:
            shallow[g] = x
        elif deep[g] == p:
            deep[g] = x

    def _splay(self, x: int) -> None:
        up, shallow, deep, colour = self.up, self.shallow, self.deep, self.colour
        while True:
            p = up[x]
            if not p or (shallow[p] != x and deep[p] != x):
                return
            g = up[p]
            if not g or (shallow[g] != p and deep[g] != p):
                self._rotate(x)
                colour[x] = colour[p]
                return
            above = up[g]
            ends = not above or (shallow[above] != g and deep[above] != g)
            self._rotate(p if (shallow[g] == p) == (shallow[p] == x) else x)
            self._rotate(x)
            if ends:
                colour[x] = colour[g]
                return

    def access(self, node: int, new: int) -> list[tuple[int, int]]:
        """Recolour the path from `node` to the root; (deepest node, old colour) of its segments, deepest first."""
        up, deep, colour = self.up, self.deep, self.colour
        found, below, x = [], 0, node
        while x:
            self._splay(x)
            rest = deep[x]
            if rest:
                colour[rest] = colour[x]
            deep[x] = below
            found.append((x, colour[x]))
            below, x = x, up[x]
        colour[below] = new
        return found


def runs_of(codes: list[int], least: int = LEAST) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of at least `least` words, by start and period."""
    length, link, prefix = automaton(codes)
    length = [0, *length]
    paths = Paths([0, *(x + 1 for x in link)])
    n, ends, out = len(codes), {}, []
    for i, state in enumerate(prefix):
        segments = paths.access(state + 1, i)
        for k in range(1, len(segments)):  # the first one is the new prefix itself
            node, end = segments[k]
            period = i - end
            if end < 0 or period > length[node] or (k + 1 < len(segments) and period <= length[segments[k + 1][0]]):
                continue
            if ends.get(period, -1) >= i:
                continue  # lies in the run found last with this period
            first, last = i - 2 * period + 1, i
            while first > 0 and codes[first - 1] == codes[first - 1 + period]:
                first -= 1
            while last + 1 < n and codes[last + 1] == codes[last + 1 - period]:
                last += 1
            ends[period] = last
            if last - first + 1 >= least:
                out.append((first, last - first + 1, period))
    out.sort(key=lambda r: (r[0], r[2]))
    return out


def stretches(hashes: np.ndarray, row: np.ndarray, gram: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """First and last + 1 word of the stretches of `least` or more words that can hold runs; rows are never mixed."""
    at, owner = np.arange(len(hashes)), row.astype(np.int64)  # words that are left, and the stretch each lies in
    for _ in range(ROUNDS):
        if len(at) < gram:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        h = combined(hashes[at], gram)
        whole = np.flatnonzero(owner[: len(h)] == owner[gram - 1 :])
        key = mix(h[whole] + mix(owner[whole].astype(np.uint64) * np.uint64(BASE) + np.uint64(1)))
        order = np.argsort(key)
        same = key[order][1:] == key[order][:-1]
        twice = np.zeros(len(key), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        change = np.zeros(len(at) + 1, np.int64)
        np.add.at(change, whole[twice], 1)
        np.add.at(change, whole[twice] + gram, -1)
        keep = np.flatnonzero(np.cumsum(change[:-1]) > 0)
        left, of = at[keep], owner[keep]
        new = np.ones(len(left), bool)
        new[1:] = (left[1:] != left[:-1] + 1) | (of[1:] != of[:-1])
        number = np.cumsum(new) - 1
        long = np.bincount(number, minlength=1)[number] >= least if len(left) else np.zeros(0, bool)
        settled = len(left) == len(at) and long.all()
        at, owner = left[long], number[long]
        if settled:
            break
    if not len(at):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first = run_starts(owner)
    return at[first], at[np.append(first[1:], len(at)) - 1] + 1


def find_runs(docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = LEAST) -> DataFrame:
    """(key, n_words, runs, kept) per row.

    runs holds (start, length, period) of every run of at least `least` words, ordered by start and period; words are
    numbered from 0. kept is the text without what runs repeat: a word goes where a run holds it behind the run's first
    `period` words; words that stay are joined by one blank. Words are separated by blanks and the control characters 9 to
    13 and are compared as they are written. Null, empty and blank texts have no words: no runs and an empty text.
    Repeated rows and null keys give rows like any other; an empty table gives an empty table; other columns are not looked at.

    Nothing is shuffled; a task holds about a megabyte of text, or one longer text, at a time.
    """
    gram = max(1, least // 2)
    source = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    run = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def find(batches):
        reader = Words(BLANK_SEPARATED)
        for batch in batches:
            for a, b in pieces(batch["text"]):
                spans = reader.read(batch["text"].slice(a, b - a))
                begin = np.searchsorted(spans.row, np.arange(b - a))
                found, change = [[] for _ in range(b - a)], np.zeros(len(spans.row) + 1, np.int64)
                for first, end in zip(*stretches(spans.hash, spans.row, gram, least), strict=True):
                    codes: dict[bytes, int] = {}
                    words = [spans.raw[i:j].tobytes() for i, j in zip(spans.start[first:end].tolist(), spans.end[first:end].tolist(), strict=True)]
                    for start, length, period in runs_of([codes.setdefault(w, len(codes)) for w in words], least):
                        row = int(spans.row[first])
                        found[row].append({"start": int(first - begin[row]) + start, "length": length, "period": period})
                        change[first + start + period] += 1
                        change[first + start + length] -= 1
                kept = joined(spans, np.cumsum(change[:-1]) == 0).cast(pa.string())
                yield pa.RecordBatch.from_arrays(
                    [batch["key"].slice(a, b - a), pa.array(spans.per_row()), pa.array(found, pa.list_(run)), kept], ["key", "n_words", "runs", "kept"]
                )

    schema = with_fields(source.select("key").schema, "n_words long, runs array<struct<start: bigint, length: bigint, period: bigint>>, kept string")
    return source.mapInArrow(find, schema).withColumnRenamed("key", key)
