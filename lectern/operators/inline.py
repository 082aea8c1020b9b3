"""Inline structure of markdown: emphasis, links, references, code spans.

Expressions cut the text of every block into tokens and describe each one by small integers; a kernel folds those with
the two stacks of CommonMark (delimiter runs, and brackets), as what a marker means depends on the markers around it. Link
labels cross into Python as hashes only. Expressions then put the text together.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import ArrayType, IntegerType

from lectern.functions import text as T
from lectern.functions.kernels import OBJECT_SLICE, bounds, cuts
from lectern.functions.plan import let, pin
from lectern.operators.html import decode_entities

PUNCTUATION = r"!-/:-@\[-`{-~"
LABEL = r"(?:[^\[\]\\]++|\\.)"
_TITLE = r"""(?:"(?:[^"\\]++|\\.)*+"|'(?:[^'\\]++|\\.)*+'|\((?:[^()\\]++|\\.)*+\))"""
_TARGET = r"(?:<(?:[^<>\n\\]++|\\.)*+>|(?!<)(?:[^\s()\\]++|\\.|\((?:[^\s()\\]++|\\.)*+\))*+)"
# One line that defines the target of a label; group 1 is the label.
DEFINITION = rf"""\A[ \t]*\[((?=[^\]]*[^\s\]]){LABEL}{{1,999}}+)\]:[ \t]*(?=[^\s]){_TARGET}(?:[ \t]+{_TITLE})?[ \t]*\z"""
# Group 1: a code span's fence; 2: its text; 3: what follows an opening bracket, up to the next bracket; 4: the label
# behind a closing one.
_TOKEN = (
    rf"(?s)\\[{PUNCTUATION}]|(`++)(.+?)(?<!`)\1(?!`)|`++"
    r"|<[a-zA-Z][a-zA-Z0-9+.-]{1,31}:[^\s<>]*>|<[^\s<>@]+@[^\s<>]+>|<!--.*?-->|</?[a-zA-Z][^<>]*>"
    rf"|!?\[(?=({LABEL}{{1,999}}+)\])|!?\["
    rf"|\]\(\s*{_TARGET}(?:\s+{_TITLE})?\s*\)|\]\[\]|\](?=\[({LABEL}{{1,999}}+)\])|\]"
    r"|\*++|_++| {2,}\n|\\\n|(?:[^\\`<!\[\]*_ ]++| (?! +\n))++|."
)
_MARKED = r"[!\[<`*_\\]|  \n"
EDGE = "\x00"  # between two nodes; a text cannot hold it

# Kinds of tokens, in the low bits of a token's code.
PLAIN, RUN, LINK, IMAGE, CLOSE, CLOSE_TARGET, CLOSE_SAME = range(7)
# What becomes of a token. From KEPT on: a run of which some characters are left, (left << 2) + edges on either side.
AS_IS, NODE_EDGE, DROPPED = 0, 1, 2
KEPT = 16


class _Run:
    """A run of `*` or `_` that may still open or close emphasis."""

    __slots__ = ("token", "left", "size", "star", "opens", "closes", "edges")

    def __init__(self, token: int, code: int):
        self.token, self.size = token, code >> 6
        self.left = self.size
        self.star, self.opens, self.closes = bool(code & 32), bool(code & 16), bool(code & 8)
        self.edges = 0  # 2: a node ends or begins on its left, 1: on its right


def _emphasis(runs: list[_Run], bottom: int) -> None:
    """Pair the runs above `bottom`, innermost first; they leave the stack."""
    stack: list[_Run] = runs[bottom:]
    del runs[bottom:]
    openers: list[_Run] = []
    none_below: dict[tuple, int] = {}  # kinds of closers for which no opener lies below this height
    for run in stack:
        while run.closes and run.left:
            kind = (run.star, run.opens, run.size % 3)
            at = len(openers) - 1
            low = none_below.get(kind, 0)
            while at >= low:
                o = openers[at]
                if o.star == run.star and o.left and not ((o.closes or run.opens) and (o.size + run.size) % 3 == 0 and (o.size % 3 or run.size % 3)):
                    break
                at -= 1
            if at < low:
                none_below[kind] = len(openers)
                break
            o = openers[at]
            used = 2 if o.left >= 2 and run.left >= 2 else 1
            o.left -= used
            run.left -= used
            o.edges |= 1
            run.edges |= 2
            del openers[at + 1 :]
            if not o.left:
                openers.pop()
            for k, height in none_below.items():
                none_below[k] = min(height, len(openers))
        if run.opens and run.left:
            openers.append(run)


def _resolve(codes: list[int], labels: list[int], defined: set[int]) -> list[int]:
    """What becomes of each token of one block; a label is the hash of what a bracket may refer to, 0 for nothing."""
    out = [AS_IS] * len(codes)
    runs: list[_Run] = []
    all_runs: list[_Run] = []
    brackets: list[tuple[int, bool, int]] = []  # (token, is image, height of the run stack)
    closed = 0  # no link may hold another one: brackets of links below this height are dead
    hidden = [0] * (len(codes) + 2)  # where images begin (1) and end (-1)
    skip_to = -1
    for i, code in enumerate(codes):
        kind = code & 7
        if i <= skip_to or kind == PLAIN:
            continue
        if kind == RUN:
            runs.append(_Run(i, code))
            all_runs.append(runs[-1])
        elif kind in (LINK, IMAGE):
            brackets.append((i, kind == IMAGE, len(runs)))
        elif brackets:
            start, image, height = brackets.pop()
            dead = not image and len(brackets) < closed
            closed = min(closed, len(brackets))
            if dead:
                continue
            last = i
            if kind == CLOSE and labels[i]:
                if labels[i] not in defined:
                    continue
                last = next(j for j in range(i + 1, len(codes)) if codes[j] & 7 >= CLOSE)
            elif kind != CLOSE_TARGET and labels[start] not in defined:
                continue
            _emphasis(runs, height)
            out[start] = out[i] = NODE_EDGE
            first = start + 1 if image else i + 1
            hidden[first] += 1
            hidden[last + 1] -= 1
            skip_to = last
            if not image:
                closed = len(brackets)
    _emphasis(runs, 0)
    for run in all_runs:
        if run.edges:
            out[run.token] = KEPT + (run.left << 2) + run.edges
    depth = 0
    for i in range(len(codes)):
        depth += hidden[i]
        if depth:
            out[i] = DROPPED
    return out


@arrow_udf(ArrayType(ArrayType(IntegerType())))
def resolved(codes: pa.Array, labels: pa.Array, defined: pa.Array) -> pa.Array:
    """What becomes of each token of each block, by document."""
    part = lambda a, b: _resolved_slice(*(x.slice(a, b - a) for x in (codes, labels, defined)))
    return pa.concat_arrays([part(a, b) for a, b in cuts(_n_tokens(codes), OBJECT_SLICE)])


def _n_tokens(codes: pa.Array) -> np.ndarray:
    """Number of tokens of each document."""
    first, n = bounds(codes)
    ends = np.asarray(codes.values.offsets).astype(np.int64) if len(codes.values) else np.zeros(1, np.int64)
    return ends[first + n] - ends[first]


def _resolved_slice(codes: pa.Array, labels: pa.Array, defined: pa.Array) -> pa.Array:
    rows = []
    for blocks, names, known in zip(codes.to_pylist(), labels.to_pylist(), defined.to_pylist(), strict=True):
        known = set(known or ())
        rows.append([_resolve(c, n, known) if c else [] for c, n in zip(blocks or (), names or (), strict=True)])
    return pa.array(rows, pa.list_(pa.list_(pa.int32())))


def label_key(label: Column) -> Column:
    """Labels match whatever their case and blanks; the hash is never 0."""
    return F.coalesce(F.nullif(F.xxhash64(F.lower(T.collapse_whitespace(label))), F.lit(0).cast("long")), F.lit(1).cast("long"))


def _code(tokens: Column) -> Column:
    """One integer per token."""

    def of(t: Column, i: Column) -> Column:
        # The blanks and punctuation on either side decide whether a run can open or close emphasis.
        before, after = F.right(F.get(tokens, i - 1), F.lit(1)), F.left(F.get(tokens, i + 1), F.lit(1))
        blank = lambda c: c.isNull() | c.rlike(rf"\A[{T.WS}]\z")
        mark = lambda c: F.coalesce(c.rlike(rf"\A[{PUNCTUATION}\p{{P}}\p{{S}}]\z"), F.lit(False))

        def run(sides: Column) -> Column:
            left = ~sides["a_blank"] & (~sides["a_mark"] | sides["b_blank"] | sides["b_mark"])
            right = ~sides["b_blank"] & (~sides["b_mark"] | sides["a_blank"] | sides["a_mark"])
            star = F.startswith(t, F.lit("*"))
            opens = left & (star | ~right | sides["b_mark"])
            closes = right & (star | ~left | sides["a_mark"])
            return F.length(t) * 64 + star.cast("int") * 32 + opens.cast("int") * 16 + closes.cast("int") * 8 + RUN

        sides = F.struct(blank(before).alias("b_blank"), mark(before).alias("b_mark"), blank(after).alias("a_blank"), mark(after).alias("a_mark"))
        return (
            F.when(t.rlike(r"\A[^!\[\]*_]|\A![^\[]|\A!\z"), PLAIN)
            .when(t.rlike(r"\A[*_]"), let(sides, run))
            .when(t == "[", LINK)
            .when(t == "![", IMAGE)
            .when(t == "][]", CLOSE_SAME)
            .when(F.startswith(t, F.lit("](")), CLOSE_TARGET)
            .when(t == "]", CLOSE)
            .otherwise(PLAIN)
        )

    return F.transform(tokens, of)


def _written(t: Column) -> Column:
    """The text of a token that stands for itself. A node of its own has an edge on both sides."""
    code = F.regexp_replace(F.regexp_replace(t, r"(?s)\A(`+)(.*)\1\z", "$2"), "&", "&amp;")
    return (
        F.when(t.rlike(r"(?s)\A(`++).+(?<!`)\1\z"), F.concat(F.lit(EDGE), code, F.lit(EDGE)))
        .when(t.rlike(r"(?s)\A(?:\\| {2,})\n\z"), F.lit(EDGE))
        .when(t == "\\&", F.lit("&amp;"))
        .when(t.rlike(rf"\A\\[{PUNCTUATION}]\z"), F.substring(t, 2, 1))
        .when(t.rlike(r"\A<(?:[a-zA-Z][a-zA-Z0-9+.-]{1,31}:[^\s<>]*|[^\s<>@]+@[^\s<>]+)>\z"), F.concat(F.lit(EDGE), F.regexp_replace(t, r"\A<|>\z", ""), F.lit(EDGE)))
        .when(t.rlike(r"(?s)\A<.+>\z"), F.concat(F.lit(EDGE), F.replace(t, F.lit("&"), F.lit("&amp;")), F.lit(EDGE)))
        .otherwise(t)
    )


def speakable(df: DataFrame, texts: str, definitions: str) -> DataFrame:
    """The array column `texts` (one text per block) with its inline markers resolved.

    Nodes are joined by one blank: a format, a link, a code span or a tag stands apart from the text around it. Link texts
    stay, images and targets go. `definitions` holds the `label_key` of every label that the document defines; a reference
    to any other label stays as it is written.
    """
    marked = lambda t: t.rlike(_MARKED)
    none = F.array().cast("array<string>")
    cut = lambda group: F.transform(texts, lambda t: F.when(marked(t), F.regexp_extract_all(t, F.lit(_TOKEN), F.lit(group))).otherwise(none))
    df = pin(df, "_tokens", cut(0))
    brackets = F.exists(texts, lambda t: F.contains(t, F.lit("[")))
    key = lambda a, b: F.when(a != "", label_key(a)).when(b != "", label_key(b)).otherwise(F.lit(0).cast("long"))
    labels = F.zip_with(cut(3), cut(4), lambda inside, behind: F.zip_with(inside, behind, key))
    zeros = F.transform("_tokens", lambda tokens: F.transform(tokens, lambda t: F.lit(0).cast("long")))
    # Pinned: long sums inside a kernel's arguments keep the optimiser from recognising the kernel.
    df = pin(df, "_codes", F.transform("_tokens", _code))
    df = pin(df, "_labels", F.when(brackets, labels).otherwise(zeros))
    df = df.withColumn("_fates", resolved("_codes", "_labels", definitions))

    def put(t: Column, fate: Column) -> Column:
        left = F.repeat(F.left(t, F.lit(1)), F.shiftright(fate - KEPT, 2))
        edge = lambda bit: F.when(fate.bitwiseAND(F.lit(bit)) != 0, EDGE).otherwise("")
        return (
            F.when(fate == AS_IS, _written(t))
            .when(fate == NODE_EDGE, EDGE)
            .when(fate == DROPPED, "")
            .otherwise(F.concat(edge(2), left, edge(1)))
        )

    def joined(text: Column, i: Column) -> Column:
        tokens = F.get(F.col("_tokens"), i)
        whole = F.array_join(F.zip_with(tokens, F.get(F.col("_fates"), i), put), "")
        apart = F.regexp_replace(whole, f"[{T.WS}{EDGE}]*{EDGE}[{T.WS}{EDGE}]*", " ")
        straight = lambda t: F.when(t.rlike(r"[ \t]\n|\n[ \t]"), F.regexp_replace(t, r"[ \t]+\n[ \t]*|\n[ \t]+", "\n")).otherwise(t)
        return decode_entities(let(F.when(F.size(tokens) > 0, apart).otherwise(text), straight))

    return pin(df, texts, F.transform(texts, joined)).drop("_tokens", "_codes", "_labels", "_fates")
