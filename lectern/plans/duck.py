"""Fragments of SQL for the comparing engine, whose regular expressions know no lookaround and no Unicode blanks."""

from __future__ import annotations

from lectern.functions.text import WS_CHARS
from lectern.policies import ChunkPolicy

WS = r"\t\n\v\f\r " + "".join(f"\\x{{{ord(c):04X}}}" for c in WS_CHARS[6:])
_CHARS = "concat(" + ", ".join(f"chr({ord(c)})" for c in WS_CHARS) + ")"


def trim(x: str) -> str:
    return f"trim({x}, {_CHARS})"


def collapse(x: str) -> str:
    return f"trim(regexp_replace({x}, '[{WS}]+', ' ', 'g'))"


def normalize(x: str) -> str:
    return trim(rf"regexp_replace(regexp_replace({x}, '\r\n?', chr(10), 'g'), '[\t\f\v ]+', ' ', 'g')")


def words(x: str) -> str:
    return f"list_filter(regexp_split_to_array({x}, '[{WS}]+'), lambda w: w <> '')"


def n_words(x: str) -> str:
    return f"len({words(x)})"


def tokens(x: str) -> str:
    t = trim(x)
    return f"greatest({n_words(t)}, cast(ceil(length({t}) / 4.0) as bigint))"


def min_duration(x: str, rate: str = "1e0") -> str:
    return f"case when {tokens(x)} <= 0 then 5e-2 else greatest(5e-2, {tokens(x)} / (2.6e0 * {rate}) * 25e-2) end"


def fnv(x: str) -> str:
    units = f"list_transform(string_split({x}, ''), lambda c: unicode(c)::bigint)"
    return f"printf('%08x', list_reduce(list_prepend(2166136261::bigint, {units}), lambda h, u: (xor(h, u) * 16777619) & 4294967295))"


def sentences(x: str) -> str:
    cut = f"string_split(regexp_replace({x}, '([.!?])[{WS}]+([A-Z0-9\"''])', concat('\\1', chr(1), '\\2'), 'g'), chr(1))"
    return f"list_filter(list_transform({cut}, lambda s: {trim('s')}), lambda s: s <> '')"


def segments(source: str, kind: str = "text") -> str:
    """CTE `seg(doc_id, position, segment_id, text)` from a table with doc_id and raw."""
    paragraph = trim(r"regexp_replace(p, '\n+', ' ', 'g')")
    ps = f"list_filter(list_transform(regexp_split_to_array(raw, '\\n[{WS}]*\\n+'), lambda p: {paragraph}), lambda p: p <> '')"
    return (
        f"par as (select doc_id, {ps} as ps from {source}), "
        f"pos as (select doc_id, unnest(range(len(ps))) as position, unnest(ps) as p from par), "
        f"nrm as (select doc_id, position, {normalize('p')} as text from pos), "
        f"seg as (select doc_id, position, concat('seg_', {fnv('concat(cast(position as varchar), chr(58), text)')}) as segment_id, "
        f"'{kind}' as kind, text from nrm)"
    )


def pieces(policy: ChunkPolicy, source: str = "seg", key: str = "doc_id") -> str:
    """CTE `pc(doc_id, piece_idx, position, text, n_chars, n_tokens)`: sentences, oversized ones packed by words."""
    return (
        f"sent as (select {key}, position, unnest(range(len(ss))) as si, unnest(ss) as s from (select {key}, position, {sentences('text')} as ss from {source})), "
        f"big as (select {key}, position, si, w, list_transform(w, lambda x: length(x)) as lens from (select *, {words('s')} as w from sent) "
        f"where length(s) > {policy.max_chars} or len(w) > {policy.max_tokens}), "
        f"pk as (select {key}, position, si, lens, 1::bigint as i, 0::bigint as g, lens[1]::bigint as c, 1::bigint as t from big union all "
        f"select {key}, position, si, lens, i + 1, case when f then g + 1 else g end, case when f then lens[i + 1] else c + 1 + lens[i + 1] end, "
        f"case when f then 1 else t + 1 end from (select *, c + 1 + lens[i + 1] > {policy.max_chars} or t + 1 > {policy.max_tokens} as f from pk where i < len(lens))), "
        f"cut as (select b.{key}, b.position, b.si, p.g, string_agg(b.w[p.i], ' ' order by p.i) as text from pk p join big b "
        f"on p.{key} = b.{key} and p.position = b.position and p.si = b.si group by all), "
        f"allp as (select {key}, position, si, 0 as g, s as text from sent where not (length(s) > {policy.max_chars} or {n_words('s')} > {policy.max_tokens}) "
        f"union all select {key}, position, si, g, text from cut), "
        f"pc as (select {key}, row_number() over (partition by {key} order by position, si, g) - 1 as piece_idx, position, text, "
        f"length(text) as n_chars, {n_words('text')} as n_tokens from allp)"
    )


def chunks(policy: ChunkPolicy) -> str:
    """CTE `ck(doc_id, piece_idx, chunk_idx)` and `ct(doc_id, chunk_idx, text)` from `pc`, with one-space separators."""
    return (
        "dl as (select doc_id, list(n_chars order by piece_idx) as lens, list(n_tokens order by piece_idx) as toks from pc group by doc_id), "
        "wk as (select doc_id, lens, toks, 1::bigint as i, 0::bigint as g, lens[1]::bigint as c, toks[1]::bigint as t from dl union all "
        "select doc_id, lens, toks, i + 1, case when f then g + 1 else g end, case when f then lens[i + 1] else c + 1 + lens[i + 1] end, "
        f"case when f then toks[i + 1] else t + toks[i + 1] end from (select *, c + 1 + lens[i + 1] > {policy.max_chars} or t + toks[i + 1] > {policy.max_tokens} as f "
        "from wk where i < len(lens))), "
        "ck as (select doc_id, i - 1 as piece_idx, g as chunk_idx from wk), "
        f"ct as (select doc_id, chunk_idx, {trim('string_agg(text, chr(32) order by piece_idx)')} as text, sum(n_tokens) as n_tokens, count(*) as n_pieces "
        "from ck join pc using (doc_id, piece_idx) group by doc_id, chunk_idx)"
    )


def decode_entities(x: str) -> str:
    for name, char in (("&copy;", 169), ("&middot;", 183), ("&quot;", 34), ("&amp;", 38)):
        x = f"replace({x}, '{name}', chr({char}))"
    return x


def page_text(x: str) -> str:
    """Body text of pages with a body element and no nested unread elements."""
    for tag in ("script", "style", "noscript", "template"):
        x = f"regexp_replace({x}, '(?is)<{tag}\\b[^>]*>.*?</{tag}\\s*>', '', 'g')"
    x = f"regexp_replace({x}, '(?s)<!--.*?-->', '', 'g')"
    x = f"regexp_replace({x}, '(?is)^.*?<body\\b[^>]*>', '')"
    return collapse(decode_entities(f"regexp_replace({x}, '<[^>]*>', '', 'g')"))


def page_title(x: str) -> str:
    return f"nullif({collapse(decode_entities(f'''regexp_extract({x}, '(?is)<title[^>]*>(.*?)</title>', 1)'''))}, '')"
