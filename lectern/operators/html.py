"""HTML pages to text, safe HTML, articles and asset references, as regular-expression passes over the page table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.functions.plan import let, pin
from lectern.operators.documents import block, finish_segments
from lectern.operators.elements import SKIPPED, TEXT, balanced, best_container

# Named character references that are decoded (the ampersand itself comes last).
ENTITIES = {
    "&nbsp;": "\u00a0", "&copy;": "©", "&reg;": "®", "&middot;": "·", "&quot;": '"', "&apos;": "'",
    "&lt;": "<", "&gt;": ">", "&laquo;": "«", "&raquo;": "»", "&deg;": "°", "&sect;": "§",
    "&para;": "¶", "&cent;": "¢", "&pound;": "£", "&yen;": "¥", "&euro;": "€",
    "&trade;": "™", "&times;": "×", "&ndash;": "–", "&mdash;": "—", "&lsquo;": "‘",
    "&rsquo;": "’", "&ldquo;": "“", "&rdquo;": "”", "&bull;": "•", "&hellip;": "…",
    "&larr;": "←", "&rarr;": "→", "&szlig;": "ß", "&auml;": "ä", "&ouml;": "ö",
    "&uuml;": "ü", "&eacute;": "é", "&egrave;": "è", "&agrave;": "à", "&ccedil;": "ç",
    "&ntilde;": "ñ",
}

# Comments and elements whose text is never read; an unclosed one runs to the end of the page.
UNREAD = r"(?is)<!--.*?(?:-->|\z)|<(script|style|noscript|template)\b[^>]*>.*?(?:</\1\s*>|\z)"
TAG = r"""(?s)</?[a-zA-Z](?:[^>"']++|"[^"]*+"|'[^']*+')*+>|</?[a-zA-Z][^>]*>|<[!?][^>]*>"""


_NUMERIC = r"&#([xX][0-9a-fA-F]+|[0-9]+);"


def _spell(code: Column) -> Column:
    """The character of a numeric reference; a replacement character when there is none."""
    is_hex = F.lower(F.left(code, F.lit(1))) == "x"
    digits = F.regexp_replace(code, r"\A[xX]?0*", "")  # any number of leading zeros
    point = F.when(F.length(digits) <= 8, F.when(is_hex, F.conv(digits, 16, 10)).otherwise(F.conv(digits, 10, 10))).cast("long")
    return let(
        point,
        lambda p: F.decode(
            F.unhex(F.lpad(F.hex(F.when(p.between(1, 0xD7FF) | p.between(0xE000, 0x10FFFF), p).otherwise(0xFFFD)), 8, "0")),
            "UTF-32",
        ),
    )


def _decode(text: Column) -> Column:
    codes = F.regexp_extract_all(text, F.lit(_NUMERIC), F.lit(1))
    zipped = F.arrays_zip(F.split(text, _NUMERIC).alias("p"), codes.alias("c"))
    spelled = F.array_join(F.transform(zipped, lambda z: F.concat(z["p"], F.when(z["c"].isNotNull(), _spell(z["c"])).otherwise(""))), "")
    table = F.array(*[F.array(F.lit(n), F.lit(c)) for n, c in ENTITIES.items()])
    numbered = F.when(F.contains(text, F.lit("&#")), spelled).otherwise(text)
    named = F.aggregate(table, numbered, lambda t, pair: F.replace(t, pair[0], pair[1]))
    return F.when(F.contains(text, F.lit("&")), F.replace(named, F.lit("&amp;"), F.lit("&"))).otherwise(text)


def decode_entities(text: Column) -> Column:
    """Named references from the table above and all numeric ones."""
    return let(text, _decode)


def plain_text(fragment: Column) -> Column:
    """Text of a fragment without its tags. Adjacent tags leave no space between their texts."""
    return T.collapse_whitespace(decode_entities(F.regexp_replace(fragment, TAG, "")))


def page_title(html: Column) -> Column:
    """Text of the first title element, collapsed; null when blank or absent."""
    inner = F.regexp_extract(html, r"(?is)<title\b[^>]*>(.*?)</title\s*>", 1)
    return F.nullif(T.collapse_whitespace(decode_entities(inner)), F.lit(""))


def body_text(html: Column) -> Column:
    """Text of the body without unread elements."""
    head = r"(?is)\A.*?<body\b[^>]*>|<head\b[^>]*>.*?</head\s*>|<title\b[^>]*>.*?</title\s*>"
    return plain_text(F.regexp_replace(F.regexp_replace(html, UNREAD, ""), head, ""))


def html_to_text(pages: DataFrame, html: str = "html") -> DataFrame:
    """Adds `title` and `text`."""
    return pages.withColumn("title", page_title(F.col(html))).withColumn("text", body_text(F.col(html)))


def segment_html(pages: DataFrame, html: str = "html") -> DataFrame:
    """A page becomes at most one segment: an article when it has a title, plain text otherwise."""
    read = html_to_text(pages, html)
    kind = F.when(F.col("title").isNotNull(), "url_article").otherwise("text")
    return finish_segments(read, F.transform(F.array("text"), lambda t, i: block(i, kind, "paragraph", t)))


# Elements dropped with their content, and the elements and attributes that safe HTML and SVG may hold.
DROPPED_WITH_CONTENT = ("script", "style", "iframe", "noscript", "noembed", "noframes", "template", "title", "xmp")
HTML_ELEMENTS = (
    "a", "abbr", "address", "area", "article", "aside", "audio", "b", "bdi", "bdo", "big", "blockquote", "br", "button",
    "canvas", "caption", "center", "cite", "code", "col", "colgroup", "data", "datalist", "dd", "del", "details", "dfn",
    "dialog", "dir", "div", "dl", "dt", "em", "fieldset", "figcaption", "figure", "font", "footer", "form", "h1", "h2",
    "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "i", "img", "input", "ins", "kbd", "label", "legend", "li", "main",
    "map", "mark", "menu", "meter", "nav", "ol", "optgroup", "option", "output", "p", "picture", "pre", "progress", "q",
    "rp", "rt", "ruby", "s", "samp", "search", "section", "select", "small", "source", "span", "strike", "strong", "sub",
    "summary", "sup", "table", "tbody", "td", "textarea", "tfoot", "th", "thead", "time", "tr", "track", "tt", "u", "ul",
    "var", "video", "wbr",
)
SVG_ELEMENTS = (
    "circle", "clippath", "defs", "desc", "ellipse", "g", "image", "line", "lineargradient", "marker", "mask", "path",
    "pattern", "polygon", "polyline", "radialgradient", "rect", "stop", "svg", "switch", "symbol", "text", "textpath",
    "tspan", "view",
)
SAFE_ATTRIBUTES = (
    "abbr", "accept", "align", "alt", "autocapitalize", "autocomplete", "autoplay", "axis", "bgcolor", "border",
    "cellpadding", "cellspacing", "checked", "cite", "class", "clear", "color", "cols", "colspan", "controls", "coords",
    "crossorigin", "cx", "cy", "d", "datetime", "decoding", "default", "dir", "disabled", "download", "draggable", "dx",
    "dy", "enctype", "face", "fill", "fill-opacity", "fill-rule", "font-family", "font-size", "font-weight", "for",
    "gradienttransform", "gradientunits", "headers", "height", "hidden", "high", "href", "hreflang", "id", "inputmode",
    "ismap", "itemid", "itemprop", "itemscope", "itemtype", "kind", "label", "lang", "list", "loading", "loop", "low",
    "max", "maxlength", "media", "method", "min", "minlength", "multiple", "muted", "name", "noshade", "nowrap",
    "offset", "open", "opacity", "optimum", "pattern", "placeholder", "playsinline", "points", "poster", "preload",
    "preserveaspectratio", "r", "readonly", "rel", "required", "rev", "reversed", "role", "rows", "rowspan", "rx", "ry",
    "scope", "selected", "shape", "size", "sizes", "span", "spellcheck", "src", "srclang", "srcset", "start", "step",
    "stop-color", "stop-opacity", "stroke", "stroke-linecap", "stroke-linejoin", "stroke-opacity", "stroke-width",
    "summary", "tabindex", "text-anchor", "title", "transform", "translate", "type", "usemap", "valign", "value",
    "viewbox", "width", "wrap", "x", "x1", "x2", "xlink:href", "xmlns", "y", "y1", "y2",
)
# Attributes whose values are never addresses.
ADDRESS_FREE_ATTRIBUTES = (
    "alt", "class", "for", "id", "label", "name", "pattern", "placeholder", "role", "summary", "title", "value", "xmlns",
)
# Fixed value: the accepted address forms; the follow set holds the range from `.` to `:`, so digits and slashes too.
ADDRESS = r"(?i)\A(?:(?:https?|mailto|tel|ftp):|[^a-z]|[a-z+.-]+(?:[^a-z+.-:]|\z))"
_HIDDEN = r"(?i)&(?:#|colon|tab|newline)"
_INVISIBLE = r"[\x00-\x20\u00A0\u1680\u180E\u2000-\u2029\u205F\u3000]"

_ATTRIBUTE = r"""[^\s/>=][^\s/>=]*+(?:\s*+=\s*+(?:"[^"]*+"|'[^']*+'|[^\s>"'][^\s>]*+)?+)?+"""
_TOKEN = (
    r"(?is)<!--.*?(?:-->|\z)"
    rf"|<({'|'.join(DROPPED_WITH_CONTENT)})(?=[\s/>])[^>]*>.*?(?:</\1(?=[\s/>])[^>]*>|\z)"
    r"|<[!?][^>]*(?:>|\z)|</(?![a-zA-Z])[^>]*(?:>|\z)|</[a-zA-Z][^>]*(?:>|\z)"
    rf"|<[a-zA-Z][^\s/>]*+(?:[\s/=]++|{_ATTRIBUTE})*+>"
    r"|[^<]+|<"
)


# Elements whose sources may hold the data themselves, and the attributes that name a source.
DATA_ELEMENTS, DATA_ATTRIBUTES = ("audio", "image", "img", "source", "track", "video"), ("href", "src", "xlink:href")


def _safe_attribute(a: Column, element: Column) -> Column:
    """(text, attributes removed, addresses removed) of one attribute as written in the page."""
    name = F.regexp_extract(a, r"\A[^\s=]+", 0)
    low = F.lower(name)
    given = F.regexp_extract(a, r"(?s)=\s*(.*)\z", 1)
    value = F.when(given.rlike(r"(?s)\A(?:\".*\"|'.*')\z"), F.substring(given, F.lit(2), F.length(given) - 2)).otherwise(given)
    allowed = (low.isin(*SAFE_ATTRIBUTES) | low.rlike(r"\A(?:data|aria)-[\w.-]+\z")) & ~low.rlike(r"\Aon") & (low != "style")
    bare = F.regexp_replace(value, _INVISIBLE, "")
    address = low.isin(*ADDRESS_FREE_ATTRIBUTES) | (bare == "") | (bare.rlike(ADDRESS) & ~value.rlike(_HIDDEN))
    address |= element.isin(*DATA_ELEMENTS) & low.isin(*DATA_ATTRIBUTES) & F.startswith(value, F.lit("data:"))
    text = F.concat(F.lit(" "), name, F.lit('="'), F.replace(value, F.lit('"'), F.lit("&quot;")), F.lit('"'))
    return F.struct(
        F.when(allowed & address, text).otherwise("").alias("text"),
        F.when(allowed, 0).otherwise(1).alias("attributes"),
        F.when(allowed & ~address, 1).otherwise(0).alias("addresses"),
    )


_ELEMENTS = (*HTML_ELEMENTS, *SVG_ELEMENTS)


def _safe_token(t: Column) -> Column:
    """One token of a page: its safe text, its element's name, its code for `balanced`, and what was removed from it."""
    name = F.regexp_extract(t, r"\A</?([a-zA-Z][^\s/>]*)", 1)
    low = F.lower(name)
    number = F.try_element_at(F.create_map(*[F.lit(x) for i, n in enumerate(_ELEMENTS) for x in (n, 3 * i)]), low)
    opening = t.rlike(r"\A<[a-zA-Z]")
    alone = low.isin(*SVG_ELEMENTS) & F.endswith(t, F.lit("/>"))
    inner = F.regexp_extract(t, r"(?s)\A<[a-zA-Z][^\s/>]*(.*)>\z", 1)
    parts = F.transform(F.regexp_extract_all(inner, F.lit(_ATTRIBUTE), F.lit(0)), lambda a: _safe_attribute(a, low))

    def made(text: Column | str, code: Column | int, elements: int = 0, attributes: Column | int = 0, addresses: Column | int = 0) -> Column:
        wrap = lambda x: x if isinstance(x, Column) else F.lit(x)
        fields = {"text": text, "code": code, "elements": elements, "attributes": attributes, "addresses": addresses}
        return F.struct(name.alias("name"), *[wrap(v).alias(k) for k, v in fields.items()])

    total = lambda of: lambda p: F.aggregate(p, F.lit(0), lambda n, x: n + x[of])
    tag = let(
        parts,
        lambda p: made(
            F.concat(F.lit("<"), name, F.array_join(F.transform(p, lambda x: x["text"]), ""), F.lit(">")),
            number + F.when(alone, 2).otherwise(0), 0, total("attributes")(p), total("addresses")(p),
        ),
    )
    return (
        F.when(~F.startswith(t, F.lit("<")), made(t, TEXT))
        .when(t == "<", made("&lt;", TEXT))
        .when(opening & number.isNotNull(), tag)
        .when(opening, made("", SKIPPED, 1))
        .when(number.isNotNull(), made("", number + 1))
        .otherwise(made("", SKIPPED))
    )


def sanitize_pages(pages: DataFrame, html: str = "html") -> DataFrame:
    """Adds `safe_html` and how many elements, attributes and unsafe addresses were removed.

    A page is cut once into tags and text, as a browser cuts it. Every tag is judged by itself: its name and each of its
    attributes must be on the allow-list, and it is written anew from what is left, so removing a part cannot bring a new
    tag about. Text between tags is never touched; a `<` that starts no tag is escaped. `data:` addresses stay in the
    sources of images, sound and video only.

    The result is balanced as a browser would balance it: a block ends an open paragraph, items, cells and rows end those
    before them, a format that a block's end interrupts goes on in the next block, crossed formats are closed and opened
    again, a closing tag that nothing opened is dropped, and what is still open ends with the page. Elements that a
    browser would add where a page leaves them out (a table's body, a paragraph for a lone closing tag) are not added.
    """
    done = pin(pages, "_tokens", F.transform(F.regexp_extract_all(html, F.lit(_TOKEN), F.lit(0)), _safe_token))
    order = balanced(_ELEMENTS)(F.transform("_tokens", lambda t: t["code"]), F.transform("_tokens", lambda t: F.hash(t["text"])))
    done = pin(done, "_order", order)
    removed = lambda of: F.coalesce(F.aggregate("_tokens", F.lit(0), lambda n, t: n + t[of]), F.lit(0))

    def written(i: Column) -> Column:
        ended = F.concat(F.lit("</"), F.get(F.col("_tokens"), -1 - i)["name"], F.lit(">"))
        return F.when(i >= 0, F.get(F.col("_tokens"), i)["text"]).otherwise(ended)

    return (
        done.withColumn("safe_html", F.array_join(F.transform("_order", written), ""))
        .withColumn("n_elements", removed("elements"))
        .withColumn("n_attributes", removed("attributes"))
        .withColumn("n_addresses", removed("addresses"))
        .drop("_tokens", "_order")
    )


def _meta(elements: Column, *names: str) -> Column:
    """First non-blank content of a meta element with one of the names, tried in order; its own quotes end a content."""

    def content(m: Column) -> Column:
        given = F.regexp_extract(m, r"""(?is)\bcontent\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", 1)
        return T.js_trim(F.regexp_replace(given, r"""\A["']|["']\z""", ""))

    def first(name: str) -> Column:
        named = F.filter(elements, lambda m: m.rlike(rf"""(?i)\b(?:name|property)\s*=\s*["']?{name}["'\s/>]"""))
        return F.get(F.filter(F.transform(named, content), lambda c: c != ""), F.lit(0))

    return F.coalesce(*[first(name) for name in names])


# Relative trust in each container when choosing the main text.
CONTAINER_WEIGHT = {"article": 10, "main": 9, "section": 6, "div": 5, "body": 3}
_CONTAINERS = sorted(CONTAINER_WEIGHT)  # of equal scores the container that comes later in the alphabet wins
_LINK = len(_CONTAINERS) + 1


def _tag_code(tag: Column) -> Column:
    """The number of a container, or of a link, negative for a closing tag; 0 for other tags."""
    name = F.lower(F.regexp_extract(tag, r"\A</?([a-zA-Z]+)(?=[\s/>])", 1))
    numbers = F.create_map(*[F.lit(x) for i, n in enumerate([*_CONTAINERS, "a"], 1) for x in (n, i)])
    return F.coalesce(F.try_element_at(numbers, name), F.lit(0)) * F.when(F.startswith(tag, F.lit("</")), -1).otherwise(1)


def _text_code(text: Column) -> Column:
    """Four times the size of a text, blanks collapsed and cut at its ends; plus 2 and 1 for a blank at either end."""
    return let(
        F.regexp_replace(text, f"[{T.WS}]+", " "),
        lambda t: F.length(F.btrim(t, F.lit(" "))) * 4 + F.startswith(t, F.lit(" ")).cast("int") * 2 + F.endswith(t, F.lit(" ")).cast("int"),
    )


def extract_articles(pages: DataFrame, html: str = "html") -> DataFrame:
    """Main-content extraction: score every container by its text without link text, keep the best.

    A page is cut once into its tags and the texts between them. Containers are balanced and may nest; running sums over
    the texts measure each one by a difference, so a page costs its length and its number of tags, however deep containers
    nest, and only the best one's text is put together. A page without containers has a null `container` and `text_content`.
    """
    readable = pages.withColumn("_readable", F.regexp_replace(F.col(html), UNREAD, ""))
    readable = pin(readable, "_tags", F.regexp_extract_all("_readable", F.lit(TAG), F.lit(0)))
    readable = pin(readable, "_texts", F.split("_readable", TAG, -1))
    bare = lambda fragment: F.btrim(F.regexp_replace(F.regexp_replace(fragment, TAG, ""), f"[{T.WS}]+", " "), F.lit(" "))
    weights = {i: CONTAINER_WEIGHT[n] for i, n in enumerate(_CONTAINERS, 1)}
    scored = readable.withColumn("_best", best_container(weights, _LINK)(F.transform("_tags", _tag_code), F.transform("_texts", _text_code)))
    metas = pin(scored, "_metas", F.filter("_tags", lambda t: t.rlike(r"(?i)\A<meta[\s/]")))
    inside = F.array_join(F.slice("_texts", F.col("_best.first") + 1, F.col("_best.last") - F.col("_best.first") + 1), "")
    text = F.btrim(F.regexp_replace(inside, f"[{T.WS}]+", " "), F.lit(" "))
    first_paragraph = F.regexp_extract("_readable", r"(?is)<p\b[^>]*>(.*?)(?=<p\b|</p|</article|\z)", 1)
    of = lambda *names: _meta(F.col("_metas"), *names)
    excerpt = F.coalesce(of("description", "og:description"), F.nullif(bare(first_paragraph), F.lit("")))
    return (
        metas.withColumn("title", page_title(F.col(html)))
        .withColumn("byline", decode_entities(of("author", "article:author")))
        .withColumn("excerpt", decode_entities(excerpt))
        .withColumn("site_name", decode_entities(of("og:site_name")))
        .withColumn("container", F.get(F.array(*[F.lit(n) for n in _CONTAINERS]), F.col("_best.container") - 1))
        .withColumn("text_content", decode_entities(F.when(F.col("_best").isNotNull(), text)))
        .drop("_readable", "_tags", "_texts", "_best", "_metas")
    )


def asset_refs(pages: DataFrame, html: str = "html", url: str = "url", path: str = "/assets/",
               extensions: tuple[str, ...] = ("js", "css"), key: str = "page_id") -> DataFrame:
    """Distinct script and stylesheet references per page, resolved against the page address.

    A page without any keeps one row with a null reference. Duplicates go inside the row, before exploding.
    """
    pattern = r"""(?i)<(?:script[^>]*\ssrc|link[^>]*\shref)=['"]([^'"]+)['"][^>]*>"""
    wanted = rf"(?i)\.(?:{'|'.join(extensions)})(?:\?|#|\z)"
    refs = F.array_distinct(
        F.filter(
            F.regexp_extract_all(html, F.lit(pattern), F.lit(1)),
            lambda r: ~F.startswith(r, F.lit("data:")) & F.contains(r, F.lit(path)) & r.rlike(wanted),
        )
    )
    return pages.select(key, url, F.explode_outer(refs).alias("ref")).withColumn("asset_url", resolve_url(F.col(url), F.col("ref")))


def resolve_url(base: Column, ref: Column) -> Column:
    """A reference resolved against a page address: absolute, protocol-relative, rooted, or relative to the folder."""

    def join(clean: Column) -> Column:
        scheme = F.regexp_extract(clean, r"\A([a-zA-Z][a-zA-Z0-9+.-]*:)", 1)
        origin = F.regexp_extract(clean, r"\A([a-zA-Z][a-zA-Z0-9+.-]*://[^/]*)", 1)
        folder = F.regexp_extract(clean, r"\A[a-zA-Z][a-zA-Z0-9+.-]*://[^/]*(/.*/|/)", 1)
        return (
            F.when(ref.rlike(r"\A[a-zA-Z][a-zA-Z0-9+.-]*:"), ref)
            .when(F.startswith(ref, F.lit("//")), F.concat(scheme, ref))
            .when(F.startswith(ref, F.lit("/")), F.concat(origin, ref))
            .when(F.startswith(ref, F.lit("?")), F.concat(clean, ref))
            .otherwise(F.concat(origin, F.when(folder == "", "/").otherwise(folder), ref))
        )

    return F.when(ref.isNotNull(), let(let(F.regexp_replace(base, r"[?#].*\z", ""), join), _without_dot_steps))


def _without_dot_steps(url: Column) -> Column:
    """An address whose path has no `.` or `..` step left; a step above the root stays at the root."""
    parts = r"(?s)\A([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)/([^?#]*)(.*)\z"
    steps = F.split(F.regexp_extract(url, parts, 2), "/")

    def walk(done: Column, step: Column) -> Column:
        up = F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))
        return F.when(step == ".", done).when(step == "..", up).otherwise(F.array_append(done, step))

    last = F.when(F.element_at(steps, -1).isin(".", ".."), F.array(F.lit(""))).otherwise(F.array().cast("array<string>"))
    path = F.array_join(F.concat(F.aggregate(steps, F.array().cast("array<string>"), walk), last), "/")
    clean = F.concat(F.regexp_extract(url, parts, 1), F.lit("/"), path, F.regexp_extract(url, parts, 3))
    return F.when(url.rlike(r"\A[a-zA-Z][a-zA-Z0-9+.-]*://[^?#]*/\.\.?(?:/|[?#]|\z)"), clean).otherwise(url)


def check_assets(refs: DataFrame, fetched: DataFrame, key: str = "page_id") -> DataFrame:
    """Report per reference: ok, failed with its status, or none found on the page.

    `fetched(asset_url, status)` has one row per address, so a hot asset only repeats the probe side of the join.
    """
    status = fetched.select("asset_url", "status")
    # Rows without a reference join nothing, and would otherwise all meet in one task.
    joined = refs.filter("asset_url is not null").join(status, "asset_url", "left").unionByName(
        refs.filter("asset_url is null").withColumn("status", F.lit(None).cast(status.schema["status"].dataType))
    )
    verdict = (
        F.when(F.col("ref").isNull(), "no_assets")
        .when(F.col("status").between(200, 299), "ok")
        .otherwise("failed")
    )
    return joined.select(key, "ref", "asset_url", "status", verdict.alias("verdict"))
