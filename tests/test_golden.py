"""Small cases with known results."""

import datetime
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from lectern.functions import net
from lectern.functions import numbers as N
from lectern.functions import text as T
from lectern.operators import audio, chunking, documents, guards, html, markdown, playback, quality, synthesis, telemetry
from lectern.plans import ingest
from lectern.policies import ChunkPolicy, ReadPolicy
from lectern.sources import readers, writers

PLAIN = "  First   paragraph has   extra spaces.\nStill same paragraph line.\n\n\nSecond paragraph\twith tabs.\n\nThird paragraph.  "
ARTICLE = "Lead paragraph with  extra spaces.\n\nBody paragraph line one.\nline two continues.\n\nClosing section."
MARKDOWN = (
    "#   Main   Title\n\nIntro paragraph   with extra   spaces.\n\n- First   item\n- Second item\n\n>  Quoted   thought\n\n"
    "```ts\nconst   a = 1;\n```\n"
)


def rows(spark, data, schema):
    return spark.createDataFrame(data, schema)


def segments_of(docs):
    return documents.explode_segments(docs, "doc_id").orderBy("position").collect()


def test_plain_text(spark):
    got = segments_of(documents.segment_text(rows(spark, [(1, PLAIN)], "doc_id int, raw string")))
    assert [(r.segment_id, r.text) for r in got] == [
        ("seg_b9d4dd52", "First paragraph has extra spaces. Still same paragraph line."),
        ("seg_e08e105e", "Second paragraph with tabs."),
        ("seg_f343bd5a", "Third paragraph."),
    ]


def test_article(spark):
    docs = rows(spark, [(1, "Sample Article", ARTICLE)], "doc_id int, title string, text_content string")
    got = segments_of(documents.segment_article(docs))
    assert [r.segment_id for r in got] == ["seg_f4bb0e1c", "seg_2c8ce5dc", "seg_74d629b7"]
    assert {r.kind for r in got} == {"url_article"}


def test_markdown(spark):
    docs = rows(spark, [(1, MARKDOWN)], "doc_id int, raw string")
    got = segments_of(markdown.segment_markdown(docs, policy=ReadPolicy(include_code=True)))
    assert [r.segment_id for r in got] == [
        "seg_ef5f654c", "seg_16cae2df", "seg_42c3865c", "seg_ca7b7963", "seg_9e8ed03e", "seg_7530ee5f",
    ]
    assert [(r.source_offset.start, r.source_offset.end) for r in got] == [(0, 16), (18, 56), (58, 72), (73, 86), (88, 107), (109, 133)]
    assert got[0].meta.depth == 1 and got[5].meta.code_language == "ts"
    assert len(segments_of(markdown.segment_markdown(docs))) == 5


def test_markdown_lists(spark):
    docs = rows(spark, [(1, "- first item\n- second item"), (2, "1. a\n2. b\n   - c\n\n   d\n")], "doc_id int, raw string")
    got = documents.explode_segments(markdown.segment_markdown(docs), "doc_id").orderBy("doc_id", "position").collect()
    assert [(r.doc_id, r.text) for r in got] == [(1, "first item"), (1, "second item"), (2, "a"), (2, "b c d"), (2, "c")]
    assert all(r.block_type == "list_item" and r.meta.is_list_item_boundary for r in got)
    loud = ReadPolicy(list_prefix="bullet")
    got = documents.explode_segments(markdown.segment_markdown(docs, policy=loud), "doc_id").orderBy("doc_id", "position").collect()
    assert [r.text for r in got][2:] == ["Numbered item 1: a", "Numbered item 2: b c d", "Bullet: c"]


def test_markdown_inline(spark):
    raw = "A **bold**. and `x` [l](u) ![i](v) <b>t</b> &amp; \\*no\\* r*** y***\nnext\n===\n\n<div>\ngone\n</div>\n\n~~~\n# no heading\n~~~\n"
    got = segments_of(markdown.segment_markdown(rows(spark, [(1, raw)], "doc_id int, raw string")))
    assert [(r.block_type, r.text) for r in got] == [("heading", "A bold . and x l <b> t </b> & *no* r*** y***\nnext")]


POLICY_CASES = [
    ((28, 10, "  ", ". "), "text", ["First sentence.", "Second sentence.", "Third sentence follows."]),
    ((80, 5, " ... ", ". "), "text", ["First sentence. ... Second sentence.", "Third sentence follows."]),
]


def nested(spark, segments):
    flat = [(1, i, *s) for i, s in enumerate(segments)]
    df = rows(spark, flat, "doc_id int, position int, segment_id string, kind string, block_type string, text string")
    df = df.withColumn("source_offset", F.lit(None).cast(documents.OFFSET_TYPE)).withColumn("meta", F.lit(None).cast(documents.META_TYPE))
    return documents.nest_segments(df)


@pytest.mark.parametrize("limits,kind,expected", POLICY_CASES)
def test_packing_limits(spark, limits, kind, expected):
    docs = nested(spark, [("a", kind, "paragraph", "First sentence. Second sentence."), ("b", "markdown", "paragraph", "Third sentence follows.")])
    got = chunking.explode_chunks(chunking.chunk_documents(docs, ChunkPolicy(*limits)), "doc_id").orderBy("chunk_idx").collect()
    assert [r.text for r in got] == expected


@pytest.mark.parametrize("block,expected", [("list_item", "buy milk. wash car"), ("paragraph", "buy milk wash car")])
def test_packing_separators(spark, block, expected):
    docs = nested(spark, [("a", "markdown", block, "buy milk"), ("b", "markdown", block, "wash car")])
    got = chunking.explode_chunks(chunking.chunk_documents(docs, ChunkPolicy(80, 20)), "doc_id").collect()
    assert [r.text for r in got] == [expected]


def test_preemptive_split(spark):
    long = "A" * 220 + ". " + "B" * 220 + "."
    df = rows(spark, [("seg-long", long), ("seg-short", "Short enough.")], "segment_id string, text string")
    got = {r.segment_id: r.text for r in chunking.preemptive_split(df).collect()}
    assert got == {"seg-long::chunk_0": "A" * 220 + ".", "seg-long::chunk_1": "B" * 220 + ".", "seg-short": "Short enough."}


def test_files(spark, tmp_path):
    cases = {
        "sample.html": b"\n<!doctype html><html><head><title>My Sample Article</title></head><body><h1>Hello World</h1>\n<p>First.</p></body></html>",
        "broken.htm": b"<html><head><title>Broken</title></head><body><div><p>Open tags only",
        "filtered.html": b"<html><head><title>F</title></head><body><h1>Readable</h1><script>alert(1)</script><style>x</style><noscript>no</noscript></body></html>",
        "notes.md": MARKDOWN.encode(),
        "article.txt": PLAIN.encode(),
        "report.pdf": b"%PDF-1.7",
        "binary.txt": b"\x00\x07",
        "bad.txt": b"ok \xff end",
    }
    for name, data in cases.items():
        (tmp_path / name).write_bytes(data)
    mime = {"html": "text/html;charset=utf-8", "htm": "text/html", "md": "application/octet-stream", "txt": "text/plain", "pdf": "application/pdf"}
    files = readers.read_files(spark, str(tmp_path), mime).select(
        F.col("name").alias("doc_id"), F.lit("file").alias("source_type"), "name", "mime", "raw", F.lit(None).cast("int").alias("status")
    )
    got = {r.doc_id: r for r in ingest.route_ingest(files).collect()}
    assert got["sample.html"].title == "My Sample Article" and got["sample.html"].segments[0].text == "Hello World First."
    assert got["broken.htm"].segments[0].text == "Open tags only"
    assert got["filtered.html"].segments[0].text == "Readable"
    assert len(got["notes.md"].segments) == 5 and got["notes.md"].title == "Untitled Source"
    assert len(got["article.txt"].segments) == 3
    assert got["bad.txt"].segments[0].text == "ok � end"
    assert (got["report.pdf"].error_code, got["report.pdf"].title) == ("UNSUPPORTED_FILE_TYPE", "Ingestion failed")
    assert got["binary.txt"].error_code == "BINARY_FILE_CONTENT" and not got["binary.txt"].segments
    assert readers.read_text(spark, str(tmp_path / "article.txt")).collect()[0].raw == PLAIN


def test_payload(spark):
    body = '{"article":{"title":"Fetched title","content":"<article><h1>Allowed</h1><script>alert(1)</script></article>"}}'
    data = [("a", "url", None, None, body, 200), ("b", "url", None, None, "{}", 404), ("c", "url", None, None, "{}", 422), ("d", "url", None, None, None, None)]
    docs = rows(spark, data, "doc_id string, source_type string, name string, mime string, raw string, status int")
    got = {r.doc_id: r for r in ingest.route_ingest(docs).collect()}
    assert got["a"].title == "Fetched title" and [s.text for s in got["a"].segments] == ["Allowed"]
    assert [got[k].error_code for k in "bcd"] == ["URL_EXTRACT_UNAVAILABLE", "URL_EXTRACT_FAILED", "URL_EXTRACT_UNAVAILABLE"]


UNSAFE = [
    "<h1>Preview</h1>\n<p><a href=\"javascript:alert('xss')\" onclick=\"alert('xss')\">click me</a></p>\n<script>alert('xss')</script>\n"
    "<svg><a xlink:href=\"javascript:alert('xss')\"><text>bad svg link</text></a></svg>",
    "<article>\n<h2>Readable body</h2>\n<img src=\"x\" onerror=\"alert('xss')\" />\n<iframe src=\"https://evil.example\"></iframe>\n"
    "<a href=\"javascript:alert('xss')\">bad uri</a><svg><g onload=\"alert(1)\"><a href=\"java\nscript:alert(1)\">p</a></g></svg></article>",
    "<h1 onclick='x'>k</h1><a href=JaVaScRiPt:x>z</a><a href='&#106;avascript:x'>z</a><a href=\"https://ok.example/a\" title=\"a:b\">ok</a><a href=\"/rel\">r</a>",
]


INLINE_CASES = {
    "a **bold *nested* text**": "a bold nested text",
    "*a **b***  ***c** d* e": "a b c d e",
    "**a*b** *a": "a*b *a",
    "a*b*c _d_e_ f__g__h": "a b c d_e f__g__h",
    "*foo**bar**baz* **foo*bar*baz**": "foo bar baz foo bar baz",
    '*(**foo**)* **foo"*bar*"foo**': '( foo ) foo" bar "foo',
    "_foo*_bar_baz_*": "_foo* bar_baz *",
    "** a**b ** c*": "** a**b ** c*",
    "[the *guide*][g] [G] [g][] [no][gone] ![img *x*][g] [x](http://a.b/c_d \"t\") [y](<a b>) ![z](q) end\n\n[g]: /url 'tit'\n[g]: /other": "the guide G g [no][gone] x y end",
    "[foo]: /u\n[bar]: <a b> \"t\"\ntext [foo] [Bar  ]": "text foo Bar",
    "para\n[foo]: /u [foo]": "para\n[foo]: /u [foo]",
    "- item [r]\n\n[r]: /x": "item r",
    "[foo][bar][baz]\n\n[baz]: /1": "[foo] bar",
    "[[x]]\n\n[x]: u": "[ x ]",
    "[a [b](u) c](v) ![a [b](u) *c*](v) t": "[a b c](v) t",
    "*[a*](u) [*em*](u)*b*": "* a* em b",
    "`a*b` *`c`d* <http://x.y/z_a_> <me@x.y> \\*lit\\* &amp; `&amp;` \\&amp;": "a*b c d http://x.y/z_a_ me@x.y *lit* & &amp; &amp;",
    "line  \nbreak\\\nsoft\n  x": "line break soft\nx",
    "# h *a* [r] #\n\n[r]: <>": "h a r",
    "[]: x [ ]: y [a]": "[]: x [ ]: y [a]",
    "[ö][Ö]\n\n[Ö]: x": "ö",
    "\\[a] \\![b](c)\n\n[a]: x": "[a] ! b",
}


def test_markdown_inline_structure(spark):
    got = documents.explode_segments(markdown.segment_markdown(rows(spark, [(c,) for c in INLINE_CASES], "raw string")), "raw").collect()
    assert {r.raw: r.text for r in got} == INLINE_CASES


@pytest.mark.parametrize("raw", [
    "*a " * 10_000, "[a " * 10_000, "a] " * 10_000, "*a_ " * 10_000, "[a][b] " * 10_000 + "\n\n[b]: x", "`a ``b " * 5_000, "*a **b " * 5_000 + "c** d* " * 5_000,
    "![a " * 5_000 + "](b) " * 5_000, "[" * 10_000 + "[a](b)" * 10_000, "[a](b \"x" * 5_000, "[a](" + "(x" * 5_000, "".join(f"[l{i}]: /x\n" for i in range(5_000)) + "\n" + "".join(f"[l{i}] " for i in range(5_000)),
])
def test_markdown_of_many_markers_finishes(spark, raw):
    start = time.monotonic()
    markdown.segment_markdown(rows(spark, [(raw,)], "raw string")).collect()
    assert time.monotonic() - start < 20


def test_sanitize(spark):
    df = rows(spark, list(enumerate(UNSAFE)), "page_id int, html string")
    got = {r.page_id: r.safe_html for r in html.sanitize_pages(df).collect()}
    for text in got.values():
        low = text.lower()
        assert "<script" not in low and "<iframe" not in low and "javascript:" not in low.replace("\n", "") and "&#106" not in low
        assert not re.search(r"\son\w+=", low)
    assert "<h1>Preview</h1>" in got[0] and "<article>" in got[1]
    assert 'href="https://ok.example/a"' in got[2] and 'title="a:b"' in got[2] and 'href="/rel"' in got[2]


def test_sanitize_reads_tags_as_browsers_do(spark):
    cases = {
        '<img src="x"onerror="alert(1)">': '<img src="x">',
        "<img src=x onerror=alert(1) <b>": '<img src="x">',
        "<scr<link>ipt>alert(1)</scr<link>ipt>": "ipt>alert(1)ipt>",
        "<p>set one=2 and 3 > 1</p>": "<p>set one=2 and 3 > 1</p>",
        "a < b <3 <": "a &lt; b &lt;3 &lt;",
        "<img src=x onerror=alert(1)": "&lt;img src=x onerror=alert(1)",
        "<a title='say \"hi\"' href='/x' target=_top data-n=1 disabled>": '<a title="say &quot;hi&quot;" href="/x" data-n="1" disabled=""></a>',
        "<SCRIPT x='>'>alert(1)</script >t": "t",
        "<style><img src=x onerror=alert(1)></style>t": "t",
        "<script>open to the end": "",
        "<!-- <b> --><b>x</b><!-- open": "<b>x</b>",
        "<custom-tag onclick=x>kept</custom-tag>": "kept",
        "<svg><linearGradient id=g></linearGradient><use href='#x'/></svg>": '<svg><linearGradient id="g"></linearGradient></svg>',
        "<a href='java\tscript:x'>y</a><a href='vbscript:x'>y</a><a href=' mailto:a@b'>y</a>": '<a>y</a><a>y</a><a href=" mailto:a@b">y</a>',
        "": "",
    }
    got = {r.html: r.safe_html for r in html.sanitize_pages(rows(spark, [(c,) for c in cases], "html string")).collect()}
    assert got == cases
    assert html.sanitize_pages(rows(spark, [(None,)], "html string")).first().safe_html is None


def test_articles_keep_nested_containers_whole(spark):
    main = "Main text of the page goes on and on. " * 3
    cases = {
        f"<body><div id=m><div>Intro.</div><div>{main}</div><p>Tail after.</p></div></body>": f"Intro.{main}Tail after.",
        f"<body><nav><a href=/>home</a></nav><article>{main}<article>Reply.</article> End.</article><div>x</div></body>": f"{main}Reply. End.",
        f"<body><div>{main}": main.strip(),
        f"<article>{main}</div></section></article><div>": main.strip(),
    }
    got = {r.html: r.text_content for r in html.extract_articles(rows(spark, [(c,) for c in cases], "html string")).collect()}
    assert got == {c: t.strip() for c, t in cases.items()}
    page = """<meta name="description" content="It's a long day"><meta content='He said "hi"' property='og:site_name'><meta name=author content="A > B">"""
    one = html.extract_articles(rows(spark, [(page,)], "html string")).first()
    assert (one.excerpt, one.site_name, one.byline, one.text_content) == ("It's a long day", 'He said "hi"', "A > B", None)


def test_sanitize_balances_as_browsers_do(spark):
    cases = {
        "<p>a<p>b": "<p>a</p><p>b</p>",
        "<b><i>x</b>y</i>": "<b><i>x</i></b><i>y</i>",
        "<b>1<p>2</b>3</p>": "<b>1</b><p><b>2</b>3</p>",
        "<p><b>A<br><p>B</p><p>C</p></article>": "<p><b>A<br></b></p><p><b>B</b></p><p><b>C</b></p>",
        "<ul><li>a<li>b<ul><li>c</ul><li>d</ul>": "<ul><li>a</li><li>b<ul><li>c</li></ul></li><li>d</li></ul>",
        "<table><tr><td>a<td>b<tr><td>c</table>d": "<table><tr><td>a</td><td>b</td></tr><tr><td>c</td></tr></table>d",
        "<td><div>a</table></td>b": "<td><div>a</div></td>b",
        "</div></p>x</b></br>": "x",
        "<div><span>a</div>b</span>": "<div><span>a</span></div>b",
        "<span><div>a</span>b": "<span><div>ab</div></span>",
        "<a href=/1>x<a href=/2>y": '<a href="/1">x</a><a href="/2">y</a>',
        "<b><b><b><b>x</p><div>y": "<b><b><b><b>x<div>y</div></b></b></b></b>",
        "<p><b><b><b><b>x<p>y": "<p><b><b><b><b>x</b></b></b></b></p><p><b><b><b>y</b></b></b></p>",
        "<b class=x>a<p>c</p>": '<b class="x">a<p>c</p></b>',
        "<dl><dt>a<dd>b<dt>c</dl>": "<dl><dt>a</dt><dd>b</dd><dt>c</dt></dl>",
        "<select><option>a<option>b</select>": "<select><option>a</option><option>b</option></select>",
        "<h1>a<h2>b</h2></h1>": "<h1>a</h1><h2>b</h2>",
        "<svg><circle /><g><path d=m /></svg>z": '<svg><circle></circle><g><path d="m"></path></g></svg>z',
        "<img src='data:image/png;base64,AA='><a href='data:text/html,x'>q</a>": '<img src="data:image/png;base64,AA="><a>q</a>',
        "<em><div><strong>x</em>y</strong></div>z": "<em></em><div><em><strong>x</strong></em><strong>y</strong></div>z",
        "<p>open <i>to the <custom>end": "<p>open <i>to the end</i></p>",
    }
    got = {r.html: r.safe_html for r in html.sanitize_pages(rows(spark, [(c,) for c in cases], "html string")).collect()}
    assert got == cases
    # What is balanced stays as it is, and every opened element is ended once, innermost first.
    again = {r.html: r.safe_html for r in html.sanitize_pages(rows(spark, [(c,) for c in cases.values()], "html string")).collect()}
    for text in cases.values():
        assert again[text] == text
        stack = []
        for slash, name in re.findall(r"<(/?)([a-z0-9]+)[^>]*>", text):
            if slash:
                assert stack.pop() == name
            elif name not in ("br", "img"):
                stack.append(name)
        assert not stack


def plain_best(page):
    """Every container of a page measured by itself."""
    weights = html.CONTAINER_WEIGHT
    page = re.sub(html.UNREAD.replace(r"\z", r"\Z"), "", page)
    pieces = re.split(r"(</?[a-zA-Z][^>]*>)", page)
    open_, found, at = [], [], 0
    bare = lambda t: " ".join(t.split())
    for i, piece in enumerate([*pieces, "</end>"]):
        m = re.match(r"<(/?)([a-z]+)", piece) if i % 2 or i == len(pieces) else None
        if m and m[2] in weights and not m[1]:
            open_.append((m[2], i + 1))
        elif m and (m[2] == "end" or m[1] and m[2] in [n for n, _ in open_]):
            while open_:
                name, start = open_.pop()
                inside = pieces[start:i]
                text = bare("".join(inside[::2]))
                links, on = [], False
                for k, x in enumerate(pieces):
                    on = x.startswith("<a ") or on and not x.startswith("</a>") if k % 2 else on
                    if k % 2 == 0 and on and start <= k < i and any(y.startswith("</a>") for y in pieces[k:]):
                        links.append(x)
                found.append((len(text) - 2 * len(bare("".join(links))), name, text))
                if name == m[2]:
                    break
    return max(((p * weights[n], n, t) for p, n, t in found), default=None)


def test_articles_against_a_search_of_every_container(spark):
    rng = random.Random(5)
    pages = []
    for _ in range(250):
        parts = []
        for _ in range(rng.randrange(30)):
            parts.append(rng.choice(["<div>", "</div>", "<article>", "</article>", "<section>", "</section>", "<main>", "</main>", "<a href=x>", "</a>", "<p>", "</p>", "\n", "  ", "one", " two ", "three\tfour", "é", ""]))
        pages.append("".join(parts))
    got = {r.html: (r.container, r.text_content) for r in html.extract_articles(rows(spark, [(p,) for p in set(pages)], "html string")).collect()}
    for page, (container, text) in got.items():
        best = plain_best(page)
        assert (container is None) == (best is None), page
        if best is not None:
            # Ties between containers of one name may go to either text.
            assert (container == best[1]), page
            assert text == best[2] or len(text) == len(best[2]), (page, text, best)


@pytest.mark.parametrize("page, words", [
    ("<div>" * 2000 + "text " * 5000 + "</div>" * 2000, 5000),
    ("<meta name=description content=" + "x" * 1_000_000 + "><body>hello world</body>", 2),
    ("<body>hello world <meta name=x " + "y" * 1_000_000, 5),
    ("<body>" + '<meta name="a content=b>' * 20_000, 0),
    ("<div>" * 2000 + "<p>some <a href=x>link</a> text</p>" * 58_000 + "</div>" * 2000, None),
])
def test_large_and_broken_pages_finish(spark, page, words):
    """Deep nesting, long attributes, tags that are never closed, 2 MiB of markup: linear work and no deep recursion."""
    df = rows(spark, [(page,)], "html string")
    start = time.monotonic()
    article = html.extract_articles(df).first()
    html.sanitize_pages(df).collect()
    assert time.monotonic() - start < 60
    if words is not None:
        assert len((article.text_content or "").split()) == words


def test_entities(spark):
    df = rows(spark, [("&lt;p&gt; &#65;&#x1F600;&#0; &nbsp;&amp;lt; R&D &#12",)], "t string")
    assert df.select(html.decode_entities(F.col("t"))).collect()[0][0] == "<p> A\U0001f600�  &lt; R&D &#12"


def test_links(spark):
    import base64

    code = base64.urlsafe_b64encode("héllo wörld?>".encode()).decode().rstrip("=")
    urls = [f"https://h/p?x=1&b64={code}", f"https://h/p#/r?text64={code}", f"https://h/?/p/?a=1~and~text_base64={code}", "https://h/p?b64=%%%", "https://h/p?q=1", "https://h/p?text64=&b64=" + code]
    got = readers.decode_link_text(rows(spark, [(i, u) for i, u in enumerate(urls)], "i int, url string")).orderBy("i").collect()
    assert [r.text for r in got] == ["héllo wörld?>"] * 3 + [None] * 3
    assert [r.param_key for r in got] == ["b64", "text64", "text_base64", "b64", None, "text64"]
    assert [r.error is None for r in got] == [True, True, True, False, True, False]


def test_addresses(spark):
    known = {
        "10.0.0.1": True, "172.31.255.255": True, "172.32.0.1": False, "8.8.8.8": False, "0.1.2.3": True, "169.254.1.1": True,
        "::1": True, "::": True, "fe80::1": True, "febf::1": True, "fec0::1": False, "fd00::1": True, "2001:db8::1": False,
        "::ffff:127.0.0.1": True, "::ffff:8.8.8.8": False, "1::2::3": True, "host": True, "256.1.1.1": True, "1:2:3:4:5:6:7:8": False,
    }
    df = rows(spark, [(a,) for a in known], "address string")
    got = {r.address: r.blocked for r in guards.flag_blocked(df, guards.cidr_ranges(spark)).collect()}
    assert got == known
    assert df.select(net.ipv6_to_hex(F.lit("1:2::7:8"))).first()[0] == "0001000200000000" + "0000000000070008"


def test_redirects_leave_http(spark):
    log = [("https://a/", 301, "ftp://b/"), ("https://c/", 302, "/d"), ("https://c/d", 200, None), ("https://e/", 301, "https://e/")]
    df = rows(spark, log, "url string, status int, location string").withColumn("content_type", F.lit("text/html")).withColumn("n_bytes", F.lit(1))
    got = {r.url: (r.final_url, r.hops, r.error_code, r.error_message) for r in guards.resolve_redirects(df).collect()}
    assert got["https://a/"][2:] == ("INVALID_URL", guards.MESSAGES["BAD_SCHEME"])
    assert got["https://c/"] == ("https://c/d", 1, None, None)
    assert got["https://e/"] == ("https://e/", 5, "UNREADABLE_CONTENT", guards.MESSAGES["TOO_MANY_REDIRECTS"])


def test_perf_classes(spark):
    data = [
        ("tts.runtime_downgrade", "x", "runtime-warning"), ("tts.synth_failure", "ORT WebGPU execution provider emitted a warning", "runtime-warning"),
        ("tts.synth_failure", "Audio playback failed: NotAllowedError", "fatal-playback-blocker"), ("tts.synth_failure", "Audio decode probe failed: empty blob.", "fatal-playback-blocker"),
        ("tts.synth_failure", "decode_error", "fatal-playback-blocker"), ("tts.synth_failure", "Network timeout", None), ("tts.synth_failure", "duration_too_short", "runtime-warning"),
        ("tts.first_audio", "decode_error", None),
    ]
    got = telemetry.classify_perf_event(rows(spark, data, "type string, reason string, want string")).collect()
    assert all(r.category == r.want for r in got)


def test_failures(spark):
    data = [("Failed to fetch https://huggingface.co/q8/resolve/main/model.onnx",), ("Failed to fetch https://huggingface.co/o/n/resolve/main/model.onnx",)]
    got = telemetry.classify_failure(rows(spark, data, "message string")).collect()
    assert got[0].code == "KOKORO_MODEL_ID_INVALID" and got[0].failure_message.endswith("like owner/name, got 'q8'.")
    assert got[1].code == "KOKORO_MODEL_FETCH_FAILED"


def test_manifest(spark, tmp_path):
    path = tmp_path / "m.json"
    path.write_text('{\n"artifacts": [{"id": "m:q8", "packageOrModelName": "p", "versionOrHash": "1", "license": "MIT", "sourceUrl": "u"}]\n}')
    manifest = readers.read_manifest(spark, str(path))
    used = rows(spark, [("m:q8",)], "id string")
    assert playback.manifest_check(used, manifest).first().passed
    assert not playback.manifest_check(rows(spark, [("other",)], "id string"), manifest).first().passed
    assert not playback.manifest_check(used.filter("false"), manifest).first().passed
    assert not playback.manifest_check(used, manifest.withColumn("license", F.lit(" "))).first().passed


def test_numbers(spark):
    one = spark.range(1)
    ask = lambda c: one.select(c.alias("v")).first().v
    assert [ask(N.format_clock(F.lit(x))) for x in (0.0, -3.0, float("nan"), 59.9, 61.0, 3601.0)] == ["0:00", "0:00", "0:00", "0:59", "1:01", "60:01"]
    assert ask(N.clamp_rate(F.lit(float("inf")))) == 1.0 and ask(N.clamp_rate(F.lit(9.0))) == 2.5
    assert ask(T.utf16_length(F.lit("a\U0001f600"))) == 3
    assert ask(N.min_duration_s(F.lit("  "), F.lit(1.0))) == 0.05
    assert [ask(N.js_round(F.lit(x))) for x in (-0.5, 0.5, 1.5, -1.5)] == [0, 1, 2, -1]
    assert ask(quality.playable_mime(F.lit(" Audio/Wave "))) == "audio/wav"


def test_synthesize_only_missing(spark):
    import pandas as pd

    seen = rows(spark, [("k1", "s1"), ("k2", "s2"), ("k2", "s2"), ("k3", "s3")], "cache_key string, segment_id string")
    cache = rows(spark, [("k1", "ready"), ("k3", "error")], "cache_key string, status string")

    def model(frames):
        for frame in frames:
            yield pd.DataFrame({"segment_id": frame["segment_id"], "ok": True})

    done = synthesis.synthesize_missing(seen, cache, model, "segment_id string, ok boolean")
    assert sorted(r.segment_id for r in done.collect()) == ["s2", "s3"]


def test_corpus_tables(spark, tmp_path):
    docs = rows(spark, [(1, "file", "a.txt", "text/plain", PLAIN, None), (2, "file", "b.pdf", "application/pdf", "x", None)],
                "doc_id int, source_type string, name string, mime string, raw string, status int")
    writers.write_corpus(ingest.corpus(docs), str(tmp_path / "c"))
    assert spark.read.parquet(str(tmp_path / "c/segments")).count() == 3
    assert spark.read.parquet(str(tmp_path / "c/chunks")).count() == 1
    assert [r.error_code for r in spark.read.parquet(str(tmp_path / "c/rejects")).collect()] == ["UNSUPPORTED_FILE_TYPE"]


def test_crawl_flow(spark):
    crawl = rows(spark, [("https://a.example/1", 301, "/2"), ("https://a.example/2", 200, None), ("https://b.example/", 200, None)], "url string, status int, location string")
    crawl = crawl.withColumn("content_type", F.lit("text/html")).withColumn("n_bytes", F.lit(9))
    dns = rows(spark, [("a.example", "93.184.216.34"), ("b.example", "10.0.0.1")], "host string, address string")
    page = "<html><head><title>T</title></head><body><nav><a href='/'>home</a></nav><article><p>Body text here.</p></article></body></html>"
    bodies = rows(spark, [("https://a.example/2", page), ("https://b.example/", page)], "url string, html string")
    got = ingest.read_crawl(crawl, dns, guards.cidr_ranges(spark), bodies).collect()
    assert sorted(r.url for r in got) == ["https://a.example/1", "https://a.example/2"]
    assert all([s.text for s in r.segments] == ["Body text here."] for r in got)


def test_stitch_small(spark):
    clips = rows(spark, [(1, 0, [[0.0, 1.0]], 2), (1, 1, [[0.5, -0.5, 1.0, 0.0], [1.0, 1.0, 1.0, 1.0]], 4), (2, 0, [[]], 8)],
                 "doc_id int, position int, channels array<array<float>>, sample_rate int")
    got = {(r.doc_id, r.position): r for r in audio.stitch_pcm(clips, block=1).collect()}
    assert got[1, 0].channels == [[0.0, 0.0, 0.0, 1.0]] * 2 and got[1, 0].n_samples == 4
    assert got[1, 1].start_sample == 4 and got[1, 1].channels[1] == [1.0] * 4
    assert got[2, 0].n_samples == 0 and got[2, 0].channels == [[]]
    samples = audio.quantize_pcm(rows(spark, [([[-2.0, 0.5], [1.0, -0.5]],)], "channels array<array<double>>")).first().samples16
    assert samples == [-32768, 32767, 16384, -16384]


def test_retry_rounds(spark, tmp_path):
    events = lambda df, fails, **more: [
        (r.segment_id, r.split_depth, r.attempt, r.delay_ms, r.outcome, r.chunk_count)
        for r in synthesis.retry_rounds(df, fails, "bad", str(tmp_path / "rounds"), **more).collect()
    ]
    plain = lambda text: F.contains(text, F.lit("zz"))
    # An over-long segment is split before its first attempt; its parts start at depth 1.
    long = rows(spark, [("s", " ".join(["abcdefghi"] * 60)), ("ok", "short")], "segment_id string, text string")
    got = events(long, plain)
    assert got[0][:5] == ("s", 0, None, None, "split") and got[0][5] >= 2
    assert got[1] == ("s", 0, None, None, "regenerated", got[0][5]) and len(got) == 2
    # A failing word run gives up after three attempts, and nothing is regenerated.
    one = rows(spark, [("w", "zz")], "segment_id string, text string")
    assert sorted(events(one, plain), key=str) == sorted(
        [("w", 0, 1, 180, "retry", None), ("w", 0, 2, 360, "retry", None), ("w", 0, 3, None, "exhausted", None)], key=str
    )
    # Sentences are halved until only the bad one is left; the good half does not make the whole good.
    two = rows(spark, [("t", "All is well. But zz is not.")], "segment_id string, text string")
    done = events(two, plain)
    assert [e for e in done if e[4] == "split"] == [("t", 0, 3, None, "split", 2)]
    assert {e[0] for e in done if e[4] == "exhausted"} == {"t::chunk_1"} and not [e for e in done if e[4] == "regenerated"]
    # Where the other runtime can speak the text, one downgrade is all.
    assert events(one, plain, other_fails=lambda text: F.lit(False)) == [("w", 0, 1, None, "downgrade", None)]
    both = events(one, plain, other_fails=plain)
    assert sorted(e[4] for e in both) == ["downgrade"] * 3 + ["exhausted"] + ["retry"] * 2


def test_hosts_of_every_hop_are_judged(spark):
    log = [
        ("https://a.example/1", 302, "http://10.0.0.1/x"), ("http://10.0.0.1/x", 302, "https://a.example/2"), ("https://a.example/2", 200, None),
        ("https://a.example/3", 301, "https://silent.example/"), ("https://a.example/4", 301, "/2"),
    ]
    crawl = rows(spark, [(*r, "text/html", 5) for r in log], "url string, status int, location string, content_type string, n_bytes int")
    dns = rows(spark, [("a.example", "93.184.216.34")], "host string, address string")
    ends = {r.url: (r.final_url, r.verdict, r.error_code) for r in guards.resolve_redirects(crawl, dns=dns, cidr=guards.cidr_ranges(spark)).collect()}
    assert ends == {
        "https://a.example/1": ("http://10.0.0.1/x", "error", "BLOCKED_HOST"),
        "http://10.0.0.1/x": ("http://10.0.0.1/x", "error", "BLOCKED_HOST"),
        "https://a.example/2": ("https://a.example/2", "ok", None),
        "https://a.example/3": ("https://silent.example/", "error", "UNREADABLE_CONTENT"),
        "https://a.example/4": ("https://a.example/2", "ok", None),
    }


def test_hosts_without_an_answer(spark):
    hosts = rows(spark, [("a.example",), ("b.example",), ("c.example",), ("10.0.0.1",)], "host string")
    dns = rows(spark, [("a.example", "93.184.216.34"), ("b.example", None)], "host string, address string")
    got = {r.host: (r.error_code, r.error_message) for r in guards.host_verdict(hosts, dns, guards.cidr_ranges(spark)).collect()}
    assert got["a.example"] == (None, None) and got["10.0.0.1"][0] == "BLOCKED_HOST"
    assert got["b.example"] == ("UNREADABLE_CONTENT", "Hostname resolved with no records.")
    assert got["c.example"] == ("UNREADABLE_CONTENT", "Unable to resolve hostname.")


def test_dot_steps_and_numeric_references_have_no_limit(spark):
    base = "https://h/a/b/c/d/e/f/g/h/i/x.html?q=/../z"
    refs = {"../" * 8 + "u.js": "https://h/a/u.js", "./" * 6 + "u.js": "https://h/a/b/c/d/e/f/g/h/i/u.js", "../" * 20 + "u.js": "https://h/u.js", "v/..": "https://h/a/b/c/d/e/f/g/h/i/", "/p/../q?x=/../y": "https://h/q?x=/../y"}
    df = rows(spark, [(base, r) for r in refs], "base string, ref string").select("ref", html.resolve_url(F.col("base"), F.col("ref")).alias("u"))
    assert {r.ref: r.u for r in df.collect()} == refs
    text = rows(spark, [("&#00000065;&#x000000000042;&#99999999999;&#xD800;",)], "t string").select(html.decode_entities(F.col("t"))).first()[0]
    assert text == "AB\ufffd\ufffd"


def test_audio_that_cannot_be_judged_is_not_good(spark):
    header = bytearray(b"RIFF\0\0\0\0WAVE")
    df = rows(spark, [(1, None, False), (2, header, True), (3, header, False)], "id int, header binary, decode_failed boolean").selectExpr(
        "*", "1000 as n_bytes", "'audio/wav' as mime", "cast(null as double) as duration_s", "0 as n_samples", "0D as rms"
    )
    assert {r.id: r.verdict for r in quality.validate_synth_output(df).collect()} == {1: "obvious_corruption_signal", 2: "decode_error", 3: None}


def walk(log, url, limit):
    """One address followed hop by hop."""
    at, hops = url, 0
    while True:
        status, location = log.get(at, (None, None))
        if status is None:
            return at, hops, "error", guards.MESSAGES["FETCH_FAILED"]
        if status != 301:
            return at, hops, "ok" if status == 200 else "error", None if status == 200 else f"Origin responded with status {status}."
        if not location:
            return at, hops, "error", guards.MESSAGES["NO_LOCATION"]
        if hops == limit:
            return at, hops, "error", guards.MESSAGES["TOO_MANY_REDIRECTS"]
        at, hops = location, hops + 1


@pytest.mark.parametrize("limit", [0, 1, 2, 3, 5, 6, 7])
def test_redirects_by_doubling(spark, limit):
    """Chains, cycles, lost targets and a target that a third of all redirects lead to."""
    rng = random.Random(limit)
    url = lambda i: f"https://r.example/{i}"
    log = {}
    for i in range(300):
        kind = rng.random()
        target = url(0) if kind < 0.3 else url(rng.randrange(330))
        log[url(i)] = (301, target) if kind < 0.85 else (301, "") if kind < 0.87 else (404, None) if kind < 0.92 else (200, None)
    for i in range(300, 312):
        log[url(i)] = (301, url(i + 1))
    df = rows(spark, [(u, s, t, "text/html", 10) for u, (s, t) in log.items()], "url string, status int, location string, content_type string, n_bytes int")
    got = {r.url: (r.final_url, r.hops, r.verdict, r.error_message) for r in guards.resolve_redirects(df, max_redirects=limit).collect()}
    assert got == {u: walk(log, u, limit) for u in log}


def test_redirects_to_an_invalid_address(spark):
    data = [("https://a.example/", 301, "https://b.example/", "text/html", 1), ("https://b.example/", 301, "ftp://c.example/", "text/html", 1)]
    df = rows(spark, data, "url string, status int, location string, content_type string, n_bytes int")
    got = {r.url: (r.final_url, r.hops, r.verdict, r.error_code) for r in guards.resolve_redirects(df).collect()}
    assert got == {"https://a.example/": ("ftp://c.example/", 2, "error", "INVALID_URL"), "https://b.example/": ("ftp://c.example/", 1, "error", "INVALID_URL")}


def test_rejected_events(spark):
    lines = [
        '{"session_id": 1, "seq": 2, "type": "tts.first_audio", "duration_ms": 5}', '{"session_id": 1, "seq": "x", "type": "tts.first_audio"}', '{"session_id": 1', "", "null", "[1]", "7",
        '{"seq": 1, "type": "a"}', '{"session_id": 1, "type": "  "}', '  {"session_id": 3, "type": "new", "deep": {"x": [1, 2]}}', None,
    ]
    judged = readers.judge_events(rows(spark, [(x,) for x in lines], "line string"))
    bad = {r.line: r.reject_reason for r in readers.rejected_events(judged).collect()}
    assert bad == {lines[1]: "malformed", lines[2]: "malformed", "": "malformed", "null": "malformed", "[1]": "malformed", "7": "malformed", lines[7]: "no_session", lines[8]: "no_type", None: "malformed"}
    good = readers.accepted_events(judged).select("session_id", "type", "duration_ms", F.expr("variant_get(payload, '$.deep.x[1]', 'int')").alias("x")).collect()
    assert sorted(map(tuple, good)) == [(1, "tts.first_audio", 5.0, None), (3, "new", None, 2)]


def test_corpus_updates_touch_changed_buckets_only(spark, tmp_path):
    docs = lambda texts: documents.document_fingerprint(documents.segment_text(rows(spark, list(texts.items()), "doc_id long, raw string"))).drop("raw")
    path = str(tmp_path / "c")
    texts = {i: f"Text {i}.\n\nMore." for i in range(60)}
    stored = lambda: {r.doc_id: r.fingerprint for r in spark.read.parquet(f"{path}/corpus").collect()}
    def files():
        found = {}
        for r in spark.read.parquet(f"{path}/corpus").select("bucket", F.input_file_name().alias("file")).distinct().collect():
            found.setdefault(r.bucket, set()).add(r.file)
        return found

    assert writers.update_corpus(docs(texts), path, buckets=8).count() == 60
    before = files()
    assert writers.update_corpus(docs(texts), path, buckets=8).count() == 0 and files() == before
    texts.update({5: "Other.", 99: "New."})
    changed = writers.update_corpus(docs({i: texts[i] for i in (4, 5, 6, 99)}), path, buckets=8).collect()
    assert {r.doc_id for r in changed} == {5, 99}
    assert stored() == {r.doc_id: r.fingerprint for r in docs(texts).collect()}
    after = files()
    assert {b for b in after if after[b] != before.get(b)} == {r.bucket for r in changed}


def test_profile_counts_utf16_units(spark):
    flat = rows(spark, [("text", "paragraph", "a\U0001f600b")], "kind string, block_type string, text string")
    assert {r.n_chars for r in documents.segment_profile(flat).collect()} == {4}


def test_merged_sketches_and_budgets(spark):
    rng = random.Random(2)
    start = datetime.datetime(2024, 5, 1)
    data = [(start + datetime.timedelta(minutes=i % 2880), "tts.segment_synth" if i % 3 else "tts.first_audio", rng.expovariate(1 / 300)) for i in range(30_000)]
    events = rows(spark, data, "event_ts timestamp, type string, duration_ms double")
    days = telemetry.sketched_budget(telemetry.rolled_up(telemetry.latency_sketches(events))).collect()
    assert len(days) == 4
    for day in days:
        kind = telemetry.BUDGETS[day.metric][0]
        values = sorted(v for t, k, v in data if k == kind and t.date() == day.starts.date())
        assert day.n == len(values)
        for got, p in ((day.p50, 0.5), (day.p95, 0.95)):
            assert abs(sum(v <= got for v in values) / len(values) - p) <= telemetry.RANK_ERROR
