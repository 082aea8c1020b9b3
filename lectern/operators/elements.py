"""Element structure of pages: which tags belong together, and how much text lies in each container.

Expressions cut a page into tokens and describe each one by small integers; the two kernels here fold those integers, as
what a tag means depends on all tags before it. No text crosses into Python.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType

from lectern.functions.kernels import OBJECT_SLICE, by_slices

# Elements by how a parser of HTML treats them.
VOID = frozenset("area br col hr img input source track wbr".split())
FORMATTING = frozenset("a b big code em font i s small strike strong tt u".split())
CLOSES_PARAGRAPH = frozenset(
    "address article aside blockquote center details dialog dir div dl dd dt fieldset figcaption figure footer form h1 h2 h3 h4"
    " h5 h6 header hgroup hr li main menu nav ol p pre search section summary table ul".split()
)
SPECIAL = CLOSES_PARAGRAPH | frozenset(
    "area br button caption col colgroup img input select source tbody td textarea tfoot th thead tr track wbr".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
SCOPE_ENDS = frozenset("table td th caption".split())  # a search for an open element does not look past these
# An opening tag ends these open elements, unless one of the second set was opened since.
ENDS = {
    "li": ({"li"}, {"ol", "ul", "menu", "dir", *SCOPE_ENDS}),
    "dd": ({"dd", "dt"}, {"dl", *SCOPE_ENDS}),
    "dt": ({"dd", "dt"}, {"dl", *SCOPE_ENDS}),
    "option": ({"option"}, {"select", "datalist"}),
    "optgroup": ({"option", "optgroup"}, {"select"}),
    "rt": ({"rt", "rp"}, {"ruby"}),
    "rp": ({"rt", "rp"}, {"ruby"}),
    "td": ({"td", "th", "caption", "colgroup"}, {"table", "tr"}),
    "th": ({"td", "th", "caption", "colgroup"}, {"table", "tr"}),
    "tr": ({"tr", "caption", "colgroup"}, {"table", "tbody", "thead", "tfoot"}),
    "tbody": ({"tbody", "thead", "tfoot", "caption", "colgroup"}, {"table"}),
    "thead": ({"tbody", "thead", "tfoot", "caption", "colgroup"}, {"table"}),
    "tfoot": ({"tbody", "thead", "tfoot", "caption", "colgroup"}, {"table"}),
}
TABLE_PARTS = frozenset("table tbody thead tfoot tr td th caption colgroup".split())
SAME_FORMATTING = 3  # equal formatting elements that are opened again, at most
TEXT, SKIPPED = -1, -2  # codes of tokens that are no tag


class _Open:
    """An element that is open, or a formatting element that waits to be opened again."""

    __slots__ = ("name", "token", "slot", "open")

    def __init__(self, name: str, token: int, slot: int):
        self.name, self.token, self.slot, self.open = name, token, slot, True


class _Tree:
    """Folds the tags of one page into a balanced sequence: token number, or -1 - token number of what is closed."""

    def __init__(self):
        self.out: list[int] = []
        self.before: dict[int, list[int]] = {}  # closing tags that turn out to belong in front of an emitted tag
        self.after: dict[int, list[int]] = {}
        self.stack: list[_Open] = []
        self.at: dict[str, list[int]] = {}  # places in the stack by name
        self.active: list[_Open] = []  # formatting elements, open or to be opened again

    def last(self, *names: str) -> int:
        return max((self.at[n][-1] for n in names if self.at.get(n)), default=-1)

    def push(self, name: str, token: int) -> _Open:
        element = _Open(name, token, len(self.out))
        self.out.append(token)
        self.at.setdefault(name, []).append(len(self.stack))
        self.stack.append(element)
        return element

    def pop_to(self, depth: int) -> None:
        while len(self.stack) > depth:
            element = self.stack.pop()
            element.open = False
            self.at[element.name].pop()
            self.out.append(-1 - element.token)

    def end_paragraph(self) -> None:
        place = self.last("p")
        if place > self.last("button", *SCOPE_ENDS):
            self.pop_to(place)

    def reopen(self) -> None:
        """Formatting elements that were closed by the end of a block go on in the next one."""
        first = len(self.active)
        while first and not self.active[first - 1].open:
            first -= 1
        for i in range(first, len(self.active)):
            self.active[i] = self.push(self.active[i].name, self.active[i].token)

    def open(self, name: str, token: int, look: list[int], closed: bool) -> None:
        if name in CLOSES_PARAGRAPH:
            self.end_paragraph()
        if name in HEADINGS and self.stack and self.stack[-1].name in HEADINGS:
            self.pop_to(len(self.stack) - 1)
        if name in ENDS:
            ended, bounds = ENDS[name]
            place = min((self.at[n][-1] for n in ended if self.at.get(n) and self.at[n][-1] > self.last(*bounds)), default=-1)
            if place >= 0:
                self.pop_to(place)
        if name in TABLE_PARTS and name != "table":
            place = self.last("table")
            if place >= 0 and name in ("tr", "tbody", "thead", "tfoot"):
                keep = self.last("table", "tbody", "thead", "tfoot") if name == "tr" else place
                self.pop_to(keep + 1)
        if name == "a":
            for element in [e for e in self.active if e.name == "a"]:
                self.close("a", element)
        if name not in SPECIAL or name in ("br", "img", "input", "area", "wbr", "button", "select", "textarea"):
            self.reopen()
        if name in VOID:
            self.out.append(token)
            return
        element = self.push(name, token)
        if closed:
            self.pop_to(len(self.stack) - 1)
        elif name in FORMATTING:
            same = [e for e in self.active[-64:] if e.name == name and look[e.token] == look[token]]
            if len(same) >= SAME_FORMATTING:
                self.active.remove(same[0])
            self.active.append(element)

    def end(self, name: str) -> None:
        if name in VOID:
            return
        if name in FORMATTING:
            element = next((e for e in reversed(self.active) if e.name == name), None)
            if element is not None:
                self.close(name, element)
            return
        place = self.last(name)
        if place < 0:
            return
        if name in TABLE_PARTS:
            bound = self.last("table") if name != "table" else -1
        elif name in SPECIAL:
            bound = self.last(*SCOPE_ENDS)
        else:
            bound = self.last_special()
        if place > bound:
            self.pop_to(place)

    def last_special(self) -> int:
        depth = len(self.stack) - 1
        return depth if depth >= 0 and self.stack[depth].name in SPECIAL else max((p[-1] for n, p in self.at.items() if p and n in SPECIAL), default=-1)

    def close(self, name: str, element: _Open) -> None:
        """End a formatting element; a block that was opened inside it keeps the format up to here."""
        while element.open:
            place = next(i for i in reversed(range(len(self.stack))) if self.stack[i] is element)
            if place < self.last(*SCOPE_ENDS):
                return
            inner = next((i for i in range(place + 1, len(self.stack)) if self.stack[i].name in SPECIAL), None)
            if inner is None:
                self.pop_to(place)
                break
            # What is open between the format and the block ends in front of the block, and the format goes on inside it.
            block = self.stack[inner]
            ended = self.stack[place:inner]
            self.before.setdefault(block.slot, []).extend(-1 - e.token for e in reversed(ended))
            self.after.setdefault(block.slot, []).insert(0, element.token)
            for e in ended:
                e.open = False
            again = _Open(name, element.token, block.slot)
            self.stack[place : inner + 1] = [block, again]
            self.active[self.active.index(element)] = again
            element = again
            for places in self.at.values():
                while places and places[-1] >= place:
                    places.pop()
            for i in range(place, len(self.stack)):
                self.at.setdefault(self.stack[i].name, []).append(i)
        if element in self.active:
            self.active.remove(element)

    def finish(self) -> list[int]:
        self.pop_to(0)
        if not self.before and not self.after:
            return self.out
        flat = []
        for slot, op in enumerate(self.out):
            flat += [*self.before.get(slot, ()), op, *self.after.get(slot, ())]
        return flat


def balanced(names: tuple[str, ...]):
    """A column function that puts a page's tags in order.

    Arguments per row, arrays with one entry per token: a code (3 * number of the name in `names`, plus 0 for an opening,
    1 for a closing and 2 for an opening tag that closes itself; TEXT; SKIPPED) and a hash of the tag as written. The
    result lists what to write: a token's number, or -1 - the number of the opening token whose element ends.
    """
    lowered = [n.lower() for n in names]

    @arrow_udf(ArrayType(IntegerType()))
    def order(codes: pa.Array, looks: pa.Array) -> pa.Array:
        return by_slices(written, OBJECT_SLICE, codes, looks)

    def written(codes: pa.Array, looks: pa.Array) -> pa.Array:
        done = []
        for code, look in zip(codes.to_pylist(), looks.to_pylist(), strict=True):
            if code is None:
                done.append(None)
                continue
            tree = _Tree()
            for i, c in enumerate(code):
                if c == TEXT:
                    tree.reopen()
                    tree.out.append(i)
                elif c >= 0:
                    name = lowered[c // 3]
                    if c % 3 == 1:
                        tree.end(name)
                    else:
                        tree.open(name, i, look, c % 3 == 2)
            done.append(tree.finish())
        return pa.array(done, pa.list_(pa.int32()))

    return order


_BEST = StructType([StructField("points", LongType()), StructField("container", IntegerType()), StructField("first", IntegerType()), StructField("last", IntegerType())])


def _sums(values: np.ndarray) -> np.ndarray:
    return np.concatenate(([0], np.cumsum(values)))


class BlockTable:
    """The texts between a page's tags with running sums, so the text of any stretch is measured by two look-ups."""

    def __init__(self, size: np.ndarray, lead: np.ndarray, trail: np.ndarray, member: np.ndarray):
        """size: characters of each text, blanks at its ends left out and inner ones collapsed; lead, trail: whether it
        begins and ends with a blank (a blank text does both); member: which texts count at all."""
        n = len(size)
        filled = np.flatnonzero((size > 0) & member)
        gap = _sums((size == 0) & (lead | trail) & member)
        apart = np.zeros(n, np.int64)  # one blank between a text and the filled one before it
        if len(filled) > 1:
            p, q = filled[:-1], filled[1:]
            apart[q] = trail[p] | lead[q] | (gap[q] > gap[p + 1])
        self.total = _sums(np.where(member, size, 0) + apart)
        self.apart = np.append(apart, 0)
        # The first filled text at or after each place; n where there is none.
        self.next = np.append(filled, n)[np.searchsorted(filled, np.arange(n + 1))]

    def length(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Characters of the texts from `first` to `last`, both included, as one collapsed and trimmed text."""
        start = self.next[first]
        return np.where(start <= last, self.total[last + 1] - self.total[first] - self.apart[start], 0)


def in_links(tags: np.ndarray, link: int) -> np.ndarray:
    """Which of the texts around `tags` lie between an opening link tag and the next closing one."""
    n = len(tags)
    ends = np.flatnonzero(np.abs(tags) == link)
    state = np.zeros(n + 1, bool)
    if len(ends):
        opens = tags[ends] > 0
        closed_later = np.arange(len(ends)) < (np.flatnonzero(~opens)[-1] if (~opens).any() else 0)
        # The texts behind tag t are t + 1 up to the next link tag.
        stretch = np.diff(np.append(ends, n))
        state[ends[0] + 1 :] = np.repeat(opens & closed_later, stretch)
    return state


def containers(tags: np.ndarray, link: int) -> list[tuple[int, int, int]]:
    """(container, first text, last text) of every container, in the order of their ends.

    A closing tag ends the innermost open container of its name, and with it those left open inside; one that nothing
    opened is ignored. The end of the page ends what is still open.
    """
    open_: list[tuple[int, int]] = []
    count: dict[int, int] = {}
    found = []
    for t in np.flatnonzero((tags != 0) & (np.abs(tags) != link)).tolist():
        name = int(tags[t])
        if name > 0:
            open_.append((name, t + 1))
            count[name] = count.get(name, 0) + 1
        elif count.get(-name):
            while True:
                other, first = open_.pop()
                count[other] -= 1
                found.append((other, first, t))
                if other == -name:
                    break
    return found + [(name, first, len(tags)) for name, first in reversed(open_)]


def best_container(weights: dict[int, int], link: int):
    """A column function for the container with the most text outside links, times its weight.

    Arguments per row: one code per tag (the container's number, `link`, negative for closing tags, 0 for other tags) and
    one per text around the tags (four times its collapsed size, plus 2 if it begins and 1 if it ends with a blank). Of
    equal containers the one with the higher number wins, then the one that ends first.
    """
    weight = np.zeros(max(weights) + 1, np.int64)
    for number, w in weights.items():
        weight[number] = w

    @arrow_udf(_BEST)
    def best(tags: pa.Array, texts: pa.Array) -> pa.Array:
        out = []
        for tag, text in zip(tags, texts, strict=True):
            if not tag.is_valid or not text.is_valid:
                out.append(None)
                continue
            tag, text = np.asarray(tag.values, np.int64), np.asarray(text.values, np.int64)
            found = containers(tag, link)
            if not found:
                out.append(None)
                continue
            size, lead, trail = text >> 2, (text & 2) > 0, (text & 1) > 0
            name, first, last = np.array(found).T
            whole = BlockTable(size, lead, trail, np.ones(len(size), bool)).length(first, last)
            linked = BlockTable(size, lead, trail, in_links(tag, link)).length(first, last)
            points = (whole - 2 * linked) * weight[name]
            k = int(np.lexsort((np.arange(len(points)), -name, -points))[0])
            out.append({"points": int(points[k]), "container": int(name[k]), "first": int(first[k]), "last": int(last[k])})
        return pa.array(out, pa.struct([("points", pa.int64()), ("container", pa.int32()), ("first", pa.int32()), ("last", pa.int32())]))

    return best
