"""Markdown to speakable segments (a documented subset of CommonMark).

Three steps, all inside the document row: native expressions classify every line, a small integer kernel folds the
line classes into blocks (the only step that depends on earlier lines), and native expressions assemble block texts.

Covered: ATX and setext headings, paragraphs with lazy continuation, nested bullet and ordered lists, block quotes,
fenced and indented code, rules, HTML blocks (dropped), nested emphasis, code spans, links, reference links with their
definitions (one line each, not in quotes), images, autolinks, escapes and entities. Not covered: tables, tab stops inside
a line.
"""

from __future__ import annotations

from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, StructField, StructType

from lectern.functions import kernels as K
from lectern.functions import text as T
from lectern.functions.kernels import OBJECT_SLICE, by_slices
from lectern.functions.plan import let, pin
from lectern.operators import inline
from lectern.operators.documents import META_TYPE, OFFSET_TYPE, block, finish_segments
from lectern.policies import PLAIN_READING, ReadPolicy

BLANK, TEXT, HEADING, RULE, ITEM, QUOTE, HTML, FENCE, UNDERLINE, DEFINITION = range(10)
PARAGRAPH_BLOCK, HEADING_BLOCK, ITEM_BLOCK, QUOTE_BLOCK, CODE_BLOCK = range(5)
NO_ROLE, OPEN_TEXT, MORE_TEXT, MORE_CODE, HEAD, MARKER, OPEN_QUOTE, MORE_QUOTE, OPEN_CODE, DEFINED = range(10)

_FENCE = r"\A[ \t]*(?:(`{3,})[^`]*|(~{3,}).*)\z"
_HEADING = r"\A[ \t]*#{1,6}(?:[ \t].*)?\z"
_RULE = r"\A[ \t]*(?:(?:\*[ \t]*){3,}|(?:-[ \t]*){3,}|(?:_[ \t]*){3,})\z"
_ITEM = r"\A[ \t]*(?:[-+*]|[0-9]{1,9}[.)])(?:[ \t].*)?\z"
_MARKER = r"\A[ \t]*(?:[-+*]|[0-9]{1,9}[.)])(?:[ \t]+|\z)"
_QUOTE = r"\A[ \t]*>"
_BLOCK_TAG = (
    r"(?i)\A[ \t]*<(?:!--|[?]|![a-z]|/?(?:address|article|aside|blockquote|body|center|details|dialog|dd|dir|div|dl|dt|"
    r"fieldset|figcaption|figure|footer|form|frame|h[1-6]|head|header|hr|html|iframe|legend|li|link|main|menu|nav|"
    r"noframes|ol|optgroup|option|p|param|pre|script|search|section|style|summary|table|tbody|td|textarea|tfoot|th|"
    r"thead|title|tr|track|ul)(?=[\s/>]|\z))"
)
_LONE_TAG = r"\A[ \t]*</?[a-zA-Z][^<>]*>[ \t]*\z"

_BLOCKS = ArrayType(
    StructType(
        [StructField(n, IntegerType()) for n in ("kind", "first", "last", "depth", "ordinal")]
        + [StructField("ordered", BooleanType())]
    )
)
_LAYOUT = StructType([StructField("blocks", _BLOCKS), StructField("roles", ArrayType(IntegerType()))])


def _fold(codes: list[int], indents: list[int], args: list[int]) -> tuple[list[tuple], list[int]]:
    """Blocks (kind, first line, last line, depth, ordinal, ordered) and every line's role in its block."""
    roles = [NO_ROLE] * len(codes)
    blocks: list[list] = []
    items: list[tuple[int, int]] = []  # open list items: (content column, block)
    counts: list[tuple[bool, int]] = []  # per list level: (ordered, last ordinal)
    fence = html = in_code = flowing = False
    blank = True
    leaf = -1

    def reach(line: int) -> None:
        for _, owner in items:
            blocks[owner][2] = line
        if not items and leaf >= 0:
            blocks[leaf][2] = line

    for i, (code, indent, arg) in enumerate(zip(codes, indents, args)):
        if fence:
            reach(i)
            if code == FENCE and arg & 1 and (arg & 2) == (fence & 2) and arg >> 2 >= fence >> 2:
                fence = False
            else:
                roles[i] = MORE_CODE if in_code else OPEN_CODE
                in_code = True
            continue
        if code == BLANK:
            flowing = html = False
            blank = True
            continue
        if html:
            continue
        was_blank, blank = blank, False
        underline = code == UNDERLINE or (code == RULE and arg)
        if underline and flowing and not items and blocks[leaf][0] == PARAGRAPH_BLOCK:
            blocks[leaf][0], blocks[leaf][3] = HEADING_BLOCK, 1 if code == UNDERLINE else 2
            reach(i)
            flowing = False
            continue
        if code == UNDERLINE or code == DEFINITION and flowing:
            code = TEXT
        if flowing and (code == HTML and not arg or code == ITEM and not items and arg & 2 and not arg & 1):
            code = TEXT
        if flowing and code == TEXT:
            roles[i] = MORE_TEXT
            reach(i)
            continue
        while items and indent < items[-1][0]:
            items.pop()
        if not items and indent >= 4:
            if flowing:
                roles[i] = MORE_TEXT
                reach(i)
                continue
            grows = leaf >= 0 and blocks[leaf][0] == CODE_BLOCK and blocks[leaf][3] == 4 and not counts
            if not grows:
                counts, leaf = [], len(blocks)
                blocks.append([CODE_BLOCK, i, i, 4, 0, False])
            roles[i] = MORE_CODE if grows else OPEN_CODE
            reach(i)
            continue
        if code == ITEM:
            level, ordered = len(items), bool(arg & 2)
            number = counts[level][1] + 1 if level < len(counts) and counts[level][0] == ordered else 1
            counts[level:] = [(ordered, number)]
            blocks.append([ITEM_BLOCK, i, i, 0, number, ordered])
            items.append((arg >> 2, len(blocks) - 1))
            roles[i], flowing, leaf = MARKER, True, -1
            reach(i)
            continue
        if not items and code != QUOTE or was_blank and code == QUOTE and not items:
            leaf = -1
        if not items:
            counts = []
        if code == QUOTE:
            grows = not items and leaf >= 0 and blocks[leaf][0] == QUOTE_BLOCK
            if not grows and not items:
                leaf = len(blocks)
                blocks.append([QUOTE_BLOCK, i, i, 0, 0, False])
                flowing = False
            roles[i] = NO_ROLE if arg else MORE_QUOTE if flowing else OPEN_QUOTE
            flowing = not arg
            reach(i)
            continue
        flowing = code == TEXT
        if code == DEFINITION:
            roles[i] = DEFINED
        elif code == FENCE:
            fence, in_code = arg | 4, False
            if not items:
                leaf = len(blocks)
                blocks.append([CODE_BLOCK, i, i, 0, 0, False])
        elif code == TEXT:
            roles[i] = OPEN_TEXT
            if not items:
                leaf = len(blocks)
                blocks.append([PARAGRAPH_BLOCK, i, i, 0, 0, False])
        elif code == HEADING:
            roles[i] = HEAD
            if not items:
                leaf = len(blocks)
                blocks.append([HEADING_BLOCK, i, i, arg, 0, False])
        elif code == HTML:
            html = not items
            roles[i] = OPEN_TEXT if items else NO_ROLE
        reach(i)
        if code == HEADING and not items:
            leaf = -1
    return [tuple(b) for b in blocks], roles


@arrow_udf(_LAYOUT)
def block_layout(codes: pa.Array, indents: pa.Array, args: pa.Array) -> pa.Array:
    """The block structure of each row's lines; only small integers cross into Python."""
    return by_slices(_layout_slice, OBJECT_SLICE, codes, indents, args)


def _layout_slice(codes: pa.Array, indents: pa.Array, args: pa.Array) -> pa.Array:
    names = ("kind", "first", "last", "depth", "ordinal", "ordered")
    rows = [
        _fold(c or [], n or [], a or []) for c, n, a in zip(codes.to_pylist(), indents.to_pylist(), args.to_pylist())
    ]
    # Columns are built directly; a dictionary per block would cost more than the fold.
    columns = list(zip(*(b for r in rows for b in r[0]))) or [()] * len(names)
    kinds = [pa.int32()] * (len(names) - 1) + [pa.bool_()]
    flat = pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], list(names))
    ends = lambda part: pa.array([0, *accumulate(len(r[part]) for r in rows)], pa.int32())
    blocks = pa.ListArray.from_arrays(ends(0), flat)
    roles = pa.ListArray.from_arrays(ends(1), pa.array([x for r in rows for x in r[1]], pa.int32()))
    return pa.StructArray.from_arrays([blocks, roles], ["blocks", "roles"])


# One struct (code, indent, arg) per line. arg: fence length, kind and bareness; heading depth; whether a rule may
# underline a heading; an item's content column, order and whether it may interrupt a paragraph; a blank quote line.
_CLASSIFY = f"""transform(_lines, l -> case
  when l rlike r'\\A[ \\t]*\\z' then named_struct('code', {BLANK}, 'indent', 0, 'arg', 0)
  when l rlike r'{_FENCE}' then named_struct('code', {FENCE}, 'indent', @indent, 'arg',
    length(regexp_extract(l, r'\\A[ \\t]*(`+|~+)', 1)) * 4 + if(l rlike r'\\A[ \\t]*~', 2, 0) + if(l rlike r'\\A[ \\t]*(?:`+|~+)[ \\t]*\\z', 1, 0))
  when l rlike r'{_HEADING}' then named_struct('code', {HEADING}, 'indent', @indent, 'arg', length(regexp_extract(l, r'\\A[ \\t]*(#+)', 1)))
  when l rlike r'{_RULE}' then named_struct('code', {RULE}, 'indent', @indent, 'arg', if(l rlike r'\\A[ \\t]*-+[ \\t]*\\z', 1, 0))
  when l rlike r'{_ITEM}' then named_struct('code', {ITEM}, 'indent', @indent, 'arg',
    (@indent + length(@marker) + if(@gap between 1 and 4, @gap, 1)) * 4 + if(length(@marker) > 1, 2, 0)
    + if(length(@marker) = 1 or @marker in ('1.', '1)'), 1, 0))
  when l rlike r'{_QUOTE}' then named_struct('code', {QUOTE}, 'indent', @indent, 'arg', if(l rlike r'\\A[ \\t]*(?:>[ \\t]?)+[ \\t]*\\z', 1, 0))
  when l rlike r'\\A[ \\t]*=+[ \\t]*\\z' then named_struct('code', {UNDERLINE}, 'indent', @indent, 'arg', 0)
  when l rlike r'\\A[ \\t]*-{{2,}}[ \\t]*\\z' then named_struct('code', {RULE}, 'indent', @indent, 'arg', 1)
  when l rlike r'{_BLOCK_TAG}' then named_struct('code', {HTML}, 'indent', @indent, 'arg', 1)
  when l rlike r'{_LONE_TAG}' then named_struct('code', {HTML}, 'indent', @indent, 'arg', 0)
  when l rlike r'@definition' then named_struct('code', {DEFINITION}, 'indent', @indent, 'arg', 0)
  else named_struct('code', {TEXT}, 'indent', @indent, 'arg', 0) end)""".replace(
    "@indent", r"length(replace(regexp_extract(l, r'\A([ \t]*)', 1), '\t', '    '))"
).replace("@marker", r"regexp_extract(l, r'\A[ \t]*([-+*]|[0-9]{1,9}[.)])', 1)").replace(
    "@gap", r"length(regexp_extract(l, r'\A[ \t]*(?:[-+*]|[0-9]{1,9}[.)])([ \t]*)', 1))"
).replace("@definition", inline.DEFINITION.replace("'", r"\x27"))


def segment_markdown(df: DataFrame, raw: str = "raw", policy: ReadPolicy = PLAIN_READING) -> DataFrame:
    """Adds `segments`: headings, paragraphs, list items (an outer item also holds its inner items' text), quotes, and
    code when the policy asks for it. Offsets are UTF-16 positions in the raw text. Null text gives no segments."""
    text = F.coalesce(F.col(raw), F.lit(""))
    lined = df.withColumn("_raw", F.split(text, r"(?<=\n)|(?<=\r)(?!\n)"))
    lined = lined.withColumn("_lines", F.transform("_raw", lambda l: F.regexp_replace(l, r"[\r\n]+\z", "")))
    classed = lined.withColumn("_class", F.expr(_CLASSIFY))
    placed = classed.withColumn(
        "_layout",
        block_layout("_class.code", "_class.indent", "_class.arg"),
    ).withColumn("_at", K.sums_before(F.transform("_raw", lambda l: T.utf16_length(l))))

    def piece(line: Column, role: Column) -> Column:
        stripped = F.regexp_replace(line, r"\A[ \t]+", "")
        quoted = F.regexp_replace(line, r"\A[ \t]*(?:>[ \t]?)+", "")
        body = (
            F.when(role.isin(OPEN_CODE, MORE_CODE), line)
            .when(role == HEAD, F.regexp_replace(F.regexp_replace(line, r"\A[ \t]*#{1,6}[ \t]*", ""), r"(?:\A|[ \t]+)#+[ \t]*\z", ""))
            .when(role == MARKER, F.regexp_replace(line, _MARKER, ""))
            .when(role.isin(OPEN_QUOTE, MORE_QUOTE), F.regexp_replace(quoted, _MARKER + r"|\A[ \t]*#{1,6}[ \t]+|\A[ \t]+", ""))
            .otherwise(stripped)
        )
        gap = F.when(role.isin(MORE_TEXT, MORE_QUOTE, MORE_CODE), "\n").otherwise(" ")
        return F.when(role == NO_ROLE, "").otherwise(F.concat(gap, body))

    placed = pin(placed, "_pieces", F.transform("_lines", lambda l, i: piece(l, F.get(F.col("_layout.roles"), i))))
    wanted = F.filter(
        "_layout.blocks",
        lambda b: (b["kind"] != CODE_BLOCK) | F.lit(policy.include_code),
    )

    def gathered(b: Column) -> Column:
        joined = F.array_join(F.slice("_pieces", b["first"] + 1, b["last"] - b["first"] + 1), "")
        return F.when(b["kind"] != CODE_BLOCK, joined).otherwise("")

    placed = placed.withColumn("_wanted", wanted)
    defined = F.filter(F.transform("_lines", lambda l, i: F.when(F.get(F.col("_layout.roles"), i) == DEFINED, l)), lambda l: l.isNotNull())
    placed = placed.withColumn("_defined", F.transform(defined, lambda l: inline.label_key(F.regexp_extract(l, inline.DEFINITION, 1))))
    placed = inline.speakable(pin(placed, "_texts", F.transform("_wanted", gathered)), "_texts", "_defined")

    def made(b: Column, i: Column) -> Column:
        first, last = b["first"], b["last"]

        def speak(clean: Column) -> Column:
            return (
                F.when(b["kind"] == HEADING_BLOCK, T.heading_text(clean, b["depth"], policy.announce_headings))
                .when(b["kind"] == ITEM_BLOCK, T.list_prefix(clean, b["ordered"], b["ordinal"], policy.list_prefix))
                .otherwise(clean)
            )

        lines = F.array_join(F.slice("_pieces", first + 1, last - first + 1), "")
        code = F.when(b["depth"] == 4, F.regexp_replace(lines, r"(\A |\n)(?: {4}|\t)", "$1")).otherwise(lines)
        body = F.when(b["kind"] == CODE_BLOCK, code).otherwise(let(T.normalize_whitespace(F.get(F.col("_texts"), i)), speak))
        kind_name = F.element_at(
            F.array(*[F.lit(n) for n in ("paragraph", "heading", "list_item", "blockquote", "code")]), b["kind"] + 1
        )
        lead = F.length(F.regexp_extract(F.get("_lines", first), r"\A([ \t]*)", 1))
        offset = F.struct(
            (F.get("_at", first) + lead).cast("int").alias("start"),
            (F.get("_at", last) + T.utf16_length(F.get("_lines", last))).cast("int").alias("end"),
        ).cast(OFFSET_TYPE)
        language = F.nullif(F.regexp_extract(F.get("_lines", first), r"\A[ \t]*(?:`{3,}|~{3,})[ \t]*([^\s`]*)", 1), F.lit(""))
        meta = F.when(
            b["kind"].isin(HEADING_BLOCK, ITEM_BLOCK, CODE_BLOCK),
            F.struct(
                F.when(b["kind"] == HEADING_BLOCK, b["depth"]).alias("depth"),
                F.when(b["kind"] == ITEM_BLOCK, F.lit(True)).alias("is_list_item_boundary"),
                F.when((b["kind"] == CODE_BLOCK) & (b["depth"] == 0), language).alias("code_language"),
            ).cast(META_TYPE),
        )
        return block(i, "markdown", kind_name, body, offset, meta)

    done = finish_segments(placed, F.transform("_wanted", made))
    return done.drop("_raw", "_lines", "_class", "_layout", "_at", "_pieces", "_wanted", "_defined", "_texts")
