"""Text scalars. Whitespace, length and trimming follow the source application's UTF-16 string rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lectern.functions.plan import let

# The whitespace set that `\s` and trim() mean in the source application.
WS_CHARS = "\t\n\x0b\x0c\r " + "".join(
    chr(c) for c in (0x00A0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF)
)
# Inside a character class. The rare members sit behind one range test, which most letters fail at once.
WS = r"\t-\r \u00A0[\u1680-\uFEFF&&[\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF]]"


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def unify_newlines(text: Column | str) -> Column:
    return let(_c(text), lambda t: F.when(F.contains(t, F.lit("\r")), F.regexp_replace(t, r"\r\n?", "\n")).otherwise(t))


def js_trim(text: Column | str) -> Column:
    """Strip the full whitespace set at both ends; native `btrim` with a character set, no regex."""
    return F.btrim(_c(text), F.lit(WS_CHARS))


def normalize_whitespace(text: Column | str) -> Column:
    """Runs of blank characters become one space; newlines and no-break spaces inside survive."""
    squeeze = lambda t: F.when(t.rlike(r"  |[\t\f\x0B]"), F.regexp_replace(t, r"[\t\f\x0B ]+", " ")).otherwise(t)
    return js_trim(let(unify_newlines(text), squeeze))


def collapse_whitespace(text: Column | str) -> Column:
    return F.btrim(F.regexp_replace(_c(text), f"[{WS}]+", " "), F.lit(" "))


def utf16_length(text: Column | str) -> Column:
    """Length in UTF-16 code units (a character outside the basic plane counts twice)."""
    return F.shiftright(F.octet_length(F.encode(_c(text), "UTF-16BE")), 1).cast("int")


def count_words(text: Column | str) -> Column:
    return F.regexp_count(_c(text), F.lit(f"[^{WS}]+"))


def estimate_tokens(text: Column | str) -> Column:
    """The larger of the word count and a quarter of the trimmed length, rounded up."""
    return let(js_trim(text), lambda t: F.greatest(count_words(t), F.ceil(utf16_length(t) / F.lit(4.0)).cast("int")))


def ends_terminal(text: Column | str) -> Column:
    return js_trim(text).rlike(r"""[.!?]["')\]]*\z""")


def list_prefix(text: Column, ordered: Column, ordinal: Column, style: Column | str) -> Column:
    style = F.lit(style) if isinstance(style, str) else style
    return (
        F.when(style == "none", text)
        .when(ordered | (style == "numbered item"), F.concat(F.lit("Numbered item "), ordinal.cast("string"), F.lit(": "), text))
        .otherwise(F.concat(F.lit("Bullet: "), text))
    )


def heading_text(text: Column, depth: Column, announce: Column | bool) -> Column:
    announce = F.lit(announce) if isinstance(announce, bool) else announce
    return F.when(announce, F.concat(F.lit("Heading level "), depth.cast("string"), F.lit(": "), text)).otherwise(text)


def file_stem(title: Column | str) -> Column:
    """Blank or missing titles become `playback`; whitespace runs become dashes."""
    chosen = F.coalesce(F.nullif(_c(title), F.lit("")), F.lit("playback"))
    return F.lower(F.regexp_replace(chosen, f"[{WS}]+", "-"))


def looks_like_markdown(text: Column | str) -> Column:
    """Any line with a heading or list marker, or a code fence anywhere."""
    t = _c(text)
    # A line may also start after U+2028/U+2029, and the marker's own leading blanks may span lines.
    start = r"(?:\A|(?<=[\n\r\u2028\u2029]))"
    return (
        F.contains(t, F.lit("```"))
        | t.rlike(f"{start}[{WS}]{{0,3}}#{{1,6}}[{WS}]+")
        | t.rlike(f"{start}[{WS}]{{0,3}}(?:[-*+][{WS}]+|[0-9]+\\.[{WS}]+)")
    )


def number_text(value: Column) -> Column:
    """A double printed without a trailing `.0`."""
    return F.regexp_replace(value.cast("string"), r"\.0\z", "")


def sentences(text: Column) -> Column:
    """Array of trimmed, non-blank sentences."""
    parts = F.split(text, f"(?<=[.!?])[{WS}]+(?=[A-Z0-9\"'])")
    return F.filter(F.transform(parts, js_trim), lambda s: s != "")


def words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"[^{WS}]+"), F.lit(0))


def paragraphs(text: Column) -> Column:
    """Array of trimmed, non-blank paragraphs; a line break inside one becomes a space."""
    blocks = F.split(unify_newlines(text), f"\n[{WS}]*\n+")
    return F.filter(F.transform(blocks, lambda p: js_trim(F.when(F.contains(p, F.lit("\n")), F.regexp_replace(p, "\n+", " ")).otherwise(p))), lambda p: p != "")
