"""Queries over documents and pages: scalars, segments, markdown, HTML, routing, chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions import hashing
from lectern.functions import kernels as K
from lectern.functions import text as T
from lectern.operators import chunking, documents, guards, html, markdown
from lectern.plans import duck, ingest
from lectern.plans.inputs import cte, derive, sql, table
from lectern.plans.registry import query
from lectern.policies import DEFAULT_CHUNKS, EXPRESSIVE_READING, PREEMPTIVE_CHUNKS, ReadPolicy
from lectern.session import work_folder
from lectern.sources import readers, writers

PARA = f"with recursive {cte('para_docs')}, {duck.segments('para_docs')}"
PIECES = f"{PARA}, {duck.pieces(DEFAULT_CHUNKS)}"
CHUNKS = f"{PIECES}, {duck.chunks(DEFAULT_CHUNKS)}"
RAW = "select doc_id, text as raw from documents"


def para_docs(spark: SparkSession, d: str) -> DataFrame:
    return derive(spark, d, "para_docs")


def para_segments(spark: SparkSession, d: str) -> DataFrame:
    return documents.explode_segments(documents.segment_text(para_docs(spark, d)), "doc_id")


def messy(spark: SparkSession, d: str) -> DataFrame:
    """Texts with mixed line ends, tabs, no-break spaces and outer blanks."""
    return sql(
        spark, d,
        "select doc_id, concat(chr(160), chr(9), replace(replace(text, '. ', concat('.', chr(13), chr(10), chr(9), ' ')), ', ', concat(',', chr(11), '  ')), chr(13), chr(160)) as raw from {documents}",
    )


MESSY = (
    "with m as (select doc_id, concat(chr(160), chr(9), replace(replace(text, '. ', concat('.', chr(13), chr(10), chr(9), ' ')), ', ', "
    "concat(',', chr(11), '  ')), chr(13), chr(160)) as raw from documents)"
)


# --- sources and sinks -------------------------------------------------------------------------------------------

def written_texts(spark, d, value):
    """One file per document, in a few folders of the shared folder; the first line of a file is the document's id."""
    rows = table(spark, d, "documents").select(F.pmod("doc_id", F.lit(64)).alias("bucket"), value.alias("value"))
    return writers.write_texts(rows, work_folder(spark, "texts"), "bucket", "value")


def file_id():
    return F.regexp_extract("raw", r"\A([0-9]+)\n", 1).cast("long").alias("doc_id")


@query("s1_read_text", "select doc_id, concat(doc_id, chr(10), text, chr(10)) as raw, length(text) + length(doc_id::varchar) + 2 as n_units from documents")
def _(spark, d):
    read = readers.read_text(spark, written_texts(spark, d, F.concat_ws("\n", F.col("doc_id").cast("string"), "text")))
    return read.select(file_id(), "raw", T.utf16_length("raw").alias("n_units"))


@query("s2_read_files", "select doc_id, concat(doc_id, chr(10), text, chr(65533), chr(10)) as raw, 'text/plain' as mime from documents")
def _(spark, d):
    marked = F.concat(F.lit("\ufeff"), F.col("doc_id").cast("string"), F.lit("\n"), "text")
    broken = F.concat(F.encode(marked, "UTF-8"), F.unhex(F.lit("FF"))).cast("string")
    return readers.read_files(spark, written_texts(spark, d, broken), {".txt": "text/plain"}).select(file_id(), "raw", "mime")


_ARTIFACTS = (
    "concat('part-', cast(p_partkey as varchar(20))) as id, p_name as packageOrModelName, cast(p_size as varchar(20)) as versionOrHash, p_brand as license, "
    "concat('https://parts.example/', cast(p_partkey as varchar(20))) as sourceUrl, p_type as attributionText"
)


@query("s7_read_manifest", f"select {_ARTIFACTS} from part")
def _(spark, d):
    """A manifest is one JSON text; here each lists a thousand parts, so their number grows with the table."""
    folder = work_folder(spark, "manifests")
    entries = sql(spark, d, f"select p_partkey div 1000 as manifest, {_ARTIFACTS} from {{part}}")
    rows = F.collect_list(F.struct(*[c for c in entries.columns if c != "manifest"])).alias("artifacts")
    entries.groupBy("manifest").agg(rows).select(F.to_json(F.struct("artifacts")).alias("value")).write.option("maxRecordsPerFile", 1).text(folder)
    return readers.read_manifest(spark, folder)


@query("s3_read_pages", "select page_id, url, length(html) as n_chars from pages")
def _(spark, d):
    return readers.read_pages(spark, f"{d}/pages.parquet").select("page_id", "url", F.length("html").alias("n_chars"))


_PAYLOAD_CASES = "case page_id % 5 when 0 then 'article' when 1 then 'top' when 2 then 'content' when 3 then 'empty' else 'both' end"


@query(
    "s4_resolve_payload",
    f"select page_id, case k when 'top' then null when 'content' then concat('T', cast(page_id as varchar)) else 'article title' end as title, "
    f"case k when 'empty' then '' when 'content' then {duck.trim('body')} else url end as text_content from (select *, {_PAYLOAD_CASES} as k, "
    "concat(url, ' & body') as body from pages)",
)
def _(spark, d):
    kind = F.expr(_PAYLOAD_CASES)
    none = F.lit(None).cast("string")
    article = F.struct(
        F.when(kind.isin("article", "empty", "both"), "article title").alias("title"),
        F.when(kind.isin("article", "both"), F.col("url")).when(kind == "empty", "").alias("textContent"),
        F.when(kind == "content", F.concat(F.lit("<div><script>x()</script><p onclick='y()'>"), "url", F.lit(" &amp; body</p></div>"))).alias("content"),
    )
    payload = F.to_json(
        F.struct(
            F.when(kind != "top", article).alias("article"),
            F.when(kind == "content", F.concat(F.lit("T"), F.col("page_id").cast("string"))).alias("title"),
            F.when(kind == "top", F.col("url")).when(kind == "both", "ignored").otherwise(none).alias("textContent"),
        )
    )
    return readers.resolve_payload(table(spark, d, "pages").select("page_id", payload.alias("payload"))).drop("payload")


@query(
    "s5_decode_link_text",
    "select doc_id, case doc_id % 3 when 0 then 'text64' when 1 then 'b64' else 'text_base64' end as param_key, "
    "case when doc_id % 8 <> 7 then text end as text, case when doc_id % 8 = 7 then concat('Unable to decode URL parameter \"', "
    "case doc_id % 3 when 0 then 'text64' when 1 then 'b64' else 'text_base64' end, '\" as base64 text.') end as error from documents",
)
def _(spark, d):
    return readers.decode_link_text(derive(spark, d, "link_urls")).drop("url")


@query("s8_write_corpus", f"{PARA} select kind, count(*) as n_segments, sum(length(text)) as n_chars from seg group by kind")
def _(spark, d):
    folder = work_folder(spark, "corpus")
    writers.write_corpus(documents.segment_text(para_docs(spark, d)).drop("raw", "lang"), folder)
    back = spark.read.parquet(f"{folder}/segments")
    return back.groupBy("kind").agg(F.count(F.lit(1)).alias("n_segments"), F.sum(F.length("text")).alias("n_chars"))


_RECENT_TEXT = "case when doc_id % 100 = 7 then concat(text, ' Changed') else text end"


@query(
    "s8_update_corpus",
    f"with para_docs as (select doc_id, lang, replace({_RECENT_TEXT}, chr(10), concat(chr(10), chr(10))) as raw from documents), {duck.segments('para_docs')}, "
    "n as (select doc_id, count(*)::int as n_segments, sum(length(text))::bigint as n_chars from seg group by doc_id) "
    "select doc_id, n_segments, n_chars, doc_id % 100 = 7 as changed, doc_id % 50 = 7 as rewritten from n",
)
def _(spark, d):
    """A corpus of all documents, then a run over them in which one in a hundred has changed."""
    folder = work_folder(spark, "corpus")
    made = lambda text: documents.document_fingerprint(documents.segment_text(
        table(spark, d, "documents").select("doc_id", F.regexp_replace(F.expr(text), "\n", "\n\n").alias("raw"))
    )).drop("raw")
    files = lambda: spark.read.parquet(f"{folder}/corpus").select("bucket", F.input_file_name().alias("file")).distinct()
    update = lambda text: writers.update_corpus(made(text), folder, bucket=F.col("doc_id") % 50)
    update("text")
    files().write.parquet(f"{folder}/before")
    changed = update(_RECENT_TEXT)
    fresh = files().join(spark.read.parquet(f"{folder}/before"), ["bucket", "file"], "left_anti").select("bucket").distinct()
    corpus = spark.read.parquet(f"{folder}/corpus")
    chars = F.aggregate(F.transform("segments", lambda s: F.length(s["text"]).cast("long")), F.lit(0).cast("long"), lambda a, b: a + b)
    out = corpus.select("doc_id", "bucket", F.size("segments").alias("n_segments"), chars.alias("n_chars")).filter("n_segments > 0")
    out = out.join(changed.select("doc_id", F.lit(True).alias("changed")), "doc_id", "left").join(fresh.withColumn("rewritten", F.lit(True)), "bucket", "left")
    return out.select("doc_id", "n_segments", "n_chars", F.coalesce("changed", F.lit(False)).alias("changed"), F.coalesce("rewritten", F.lit(False)).alias("rewritten"))


# --- scalars -----------------------------------------------------------------------------------------------------

@query("x1_unify_newlines", f"{MESSY} select doc_id, regexp_replace(raw, '\\r\\n?', chr(10), 'g') as text from m")
def _(spark, d):
    return messy(spark, d).select("doc_id", T.unify_newlines("raw").alias("text"))


@query("x2_js_trim", f"{MESSY} select doc_id, {duck.trim('raw')} as text from m")
def _(spark, d):
    return messy(spark, d).select("doc_id", T.js_trim("raw").alias("text"))


@query("x3_normalize_whitespace", f"{MESSY} select doc_id, {duck.normalize('raw')} as text from m")
def _(spark, d):
    return messy(spark, d).select("doc_id", T.normalize_whitespace("raw").alias("text"))


@query("x4_collapse_whitespace", f"{MESSY} select doc_id, {duck.collapse('raw')} as text from m")
def _(spark, d):
    return messy(spark, d).select("doc_id", T.collapse_whitespace("raw").alias("text"))


@query("x6_fnv1a32", f"select doc_id, {duck.fnv('text')} as hash from documents")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", K.fnv1a32("text").alias("hash"))


@query(
    "x7_segment_id",
    f"select conv_id, turn, concat('seg_', {duck.fnv('concat(cast(turn as varchar), chr(58), text)')}) as segment_id from conversations",
)
def _(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", hashing.segment_id(F.col("turn"), F.col("text")).alias("segment_id"))


@query("x8_count_words", f"select doc_id, {duck.n_words('text')} as n_words from documents")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", T.count_words("text").alias("n_words"))


@query("x9_estimate_tokens", f"select doc_id, {duck.tokens('text')} as n_tokens from documents")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", T.estimate_tokens("text").alias("n_tokens"))


@query(
    "x12_ends_terminal",
    f"select doc_id, regexp_matches({duck.trim('line')}, '[.!?][\"'')\\]]*\\z') as ends, line from (select doc_id, unnest(string_split(text, chr(10))) as line from documents)",
)
def _(spark, d):
    lines = table(spark, d, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    return lines.select("doc_id", T.ends_terminal("line").alias("ends"), "line")


@query(
    "x13_list_prefix",
    "select conv_id, turn, case when turn % 3 = 0 then text when role = 'user' or turn % 3 = 1 then concat('Numbered item ', cast(turn + 1 as varchar), ': ', text) "
    "else concat('Bullet: ', text) end as text from conversations",
)
def _(spark, d):
    style = F.expr("case turn % 3 when 0 then 'none' when 1 then 'numbered item' else 'bullet' end")
    text = T.list_prefix(F.col("text"), F.col("role") == "user", F.col("turn") + 1, style)
    return table(spark, d, "conversations").select("conv_id", "turn", text.alias("text"))


@query(
    "x14_heading_text",
    "select conv_id, turn, case when role = 'user' then concat('Heading level ', cast(turn % 6 + 1 as varchar), ': ', text) else text end as text from conversations",
)
def _(spark, d):
    text = T.heading_text(F.col("text"), F.col("turn") % 6 + 1, F.col("role") == "user")
    return table(spark, d, "conversations").select("conv_id", "turn", text.alias("text"))


@query(
    "x16_file_stem",
    f"select page_id, lower(regexp_replace(coalesce(nullif(t, ''), 'playback'), '[{duck.WS}]+', '-', 'g')) as stem from "
    f"(select page_id, case when page_id % 10 <> 0 then {duck.page_title('html')} else '' end as t from pages)",
)
def _(spark, d):
    title = F.when(F.col("page_id") % 10 != 0, html.page_title(F.col("html"))).otherwise("")
    return table(spark, d, "pages").select("page_id", T.file_stem(title).alias("stem"))


# --- routing and guards over files -------------------------------------------------------------------------------

_MD_RULES = (
    f"contains(raw, '```') or regexp_matches(raw, '(?m)^[{duck.WS}]{{0,3}}#{{1,6}}[{duck.WS}]+') or "
    f"regexp_matches(raw, '(?m)^[{duck.WS}]{{0,3}}(?:[-*+][{duck.WS}]+|[0-9]+\\.[{duck.WS}]+)')"
)


@query(
    "f1_detect_markdown",
    f"with {cte('md_docs')} select doc_id, 'marked' as origin, {_MD_RULES} as is_markdown from md_docs union all "
    f"select doc_id, 'plain', {_MD_RULES} from ({RAW})",
)
def _(spark, d):
    plain = table(spark, d, "documents").select("doc_id", F.lit("plain").alias("origin"), F.col("text").alias("raw"))
    marked = derive(spark, d, "md_docs").select("doc_id", F.lit("marked").alias("origin"), "raw")
    return marked.unionByName(plain).select("doc_id", "origin", T.looks_like_markdown("raw").alias("is_markdown"))


_ROUTE = (
    "case when regexp_matches(name, '(?i)\\.html?$') or starts_with(lower(mime), 'text/html') then 'html' "
    "when regexp_matches(name, '(?i)\\.md(own|arkdown)?$') then 'markdown' "
    "when mime = '' or starts_with(mime, 'text/') or mime in ('application/json', 'application/xml') then 'text' else 'UNSUPPORTED_FILE_TYPE' end"
)
_BINARY = f"({duck.trim('raw')} = '' or regexp_matches(raw, '[\\x00-\\x08\\x0E-\\x1F\\x7F]'))"


@query("f2_classify_file", f"with {cte('raw_files')} select doc_id, name, mime, {_ROUTE} as route from raw_files")
def _(spark, d):
    return guards.classify_file(derive(spark, d, "raw_files").drop("raw"))


@query(
    "f3_quarantine_binary",
    f"with {cte('raw_files')} select doc_id, case when {_BINARY} then 'BINARY_FILE_CONTENT' end as error_code, "
    f"case when {_BINARY} then '{guards.MESSAGES['BINARY_FILE_CONTENT']}' end as error_message from raw_files",
)
def _(spark, d):
    good, bad = guards.quarantine_binary(derive(spark, d, "raw_files"))
    columns = ["doc_id", "error_code", "error_message"]
    none = F.lit(None).cast("string")
    return good.select("doc_id", none.alias("error_code"), none.alias("error_message")).unionByName(bad.select(*columns))


def raw_docs(spark: SparkSession, d: str) -> DataFrame:
    """All three ways in: files, pasted texts, and extractor answers with their status."""
    files = derive(spark, d, "raw_files").select(
        F.concat(F.lit("f"), F.col("doc_id").cast("string")).alias("doc_id"), F.lit("file").alias("source_type"), "name", "mime", "raw",
        F.lit(None).cast("int").alias("status"),
    )
    pasted = derive(spark, d, "para_docs").select(
        F.concat(F.lit("t"), F.col("doc_id").cast("string")).alias("doc_id"), F.lit("text").alias("source_type"),
        F.lit(None).cast("string").alias("name"), F.lit(None).cast("string").alias("mime"), "raw", F.lit(None).cast("int").alias("status"),
    )
    payload = F.to_json(F.struct(F.col("url").alias("title"), html.body_text(F.col("html")).alias("textContent")))
    fetched = table(spark, d, "pages").select(
        F.concat(F.lit("u"), F.col("page_id").cast("string")).alias("doc_id"), F.lit("url").alias("source_type"),
        F.lit(None).cast("string").alias("name"), F.lit(None).cast("string").alias("mime"), payload.alias("raw"),
        F.expr("case page_id % 6 when 0 then 404 when 1 then 422 when 2 then 503 when 3 then null else 200 end").cast("int").alias("status"),
    )
    return files.unionByName(pasted).unionByName(fetched)


# Whole files are one paragraph here (their texts have no blank lines), so a file gives one segment.
_F4 = f"""with recursive {cte('raw_files', 'para_docs')}, {duck.segments('para_docs')},
fl as (select *, {_ROUTE} as r, {_BINARY} as bin from raw_files),
fo as (select concat('f', cast(doc_id as varchar)) as doc_id, case when bin and r <> 'UNSUPPORTED_FILE_TYPE' then 'BINARY_FILE_CONTENT' when r = 'UNSUPPORTED_FILE_TYPE' then r end as error_code,
 case when bin and r <> 'UNSUPPORTED_FILE_TYPE' then '{guards.MESSAGES['BINARY_FILE_CONTENT']}' when r = 'UNSUPPORTED_FILE_TYPE' then concat('Unsupported file type: ', coalesce(nullif(mime, ''), 'unknown')) end as m,
 r as route, 1::bigint as n, raw from fl),
po as (select concat('t', cast(doc_id as varchar)) as doc_id, null as error_code, null as m, 'text' as route, count(*) as n from seg group by 1),
uo as (select concat('u', cast(page_id as varchar)) as doc_id, case page_id % 6 when 0 then 'URL_EXTRACT_UNAVAILABLE' when 1 then 'URL_EXTRACT_FAILED' when 2 then 'URL_EXTRACT_UNAVAILABLE' when 3 then 'URL_EXTRACT_UNAVAILABLE' end as error_code,
 case page_id % 6 when 0 then '{ingest.UNAVAILABLE}' when 1 then '{ingest.EXTRACT_FAILED}' when 2 then '{ingest.UNAVAILABLE}' when 3 then '{ingest.UNAVAILABLE_NO_ANSWER}' end as m, url from pages)
select doc_id, coalesce(nullif(route, 'text'), 'text') as route, case when error_code is null then 'Untitled Source' else 'Ingestion failed' end as title,
 case when error_code is null then n else 0 end as n_segments, case when error_code is null then '' else 'INGEST_ERROR' end as warning, error_code, m as error_message from fo
union all select doc_id, route, 'Untitled Source', n, '', error_code, m from po
union all select doc_id, coalesce(error_code, 'url'), case when error_code is null then url else 'Ingestion failed' end, case when error_code is null then 1 else 0 end,
 case when error_code is null then 'URL_INGEST_MODE' else 'INGEST_ERROR' end, error_code, m from uo"""


@query("f4_route_ingest", _F4)
def _(spark, d):
    done = ingest.route_ingest(raw_docs(spark, d))
    return done.select(
        "doc_id", "route", "title", F.size("segments").alias("n_segments"), F.coalesce(F.get("warnings", F.lit(0))["code"], F.lit("")).alias("warning"),
        "error_code", "error_message",
    )


@query(
    "f6_drop_empty_segments",
    f"select doc_id, i - 1 as position, concat('seg_', {duck.fnv('concat(cast(i - 1 as varchar), chr(58), t)')}) as segment_id, t as text from "
    f"(select doc_id, i, {duck.normalize('l')} as t from (select doc_id, unnest(ls) as l, unnest(range(1, len(ls) + 1)) as i from "
    "(select doc_id, list_transform(string_split(text, chr(10)), lambda l, i: case when i % 3 = 0 then chr(9) else l end) as ls from documents))) where t <> ''",
)
def _(spark, d):
    lines = F.transform(F.split("text", "\n"), lambda l, i: F.when((i + 1) % 3 == 0, "\t").otherwise(l))
    docs = table(spark, d, "documents").select("doc_id", lines.alias("lines"))
    made = documents.finish_segments(docs, F.transform("lines", lambda l, i: documents.block(i, "text", "paragraph", l)))
    return documents.explode_segments(made, "doc_id").select("doc_id", "position", "segment_id", "text")


# --- segments ----------------------------------------------------------------------------------------------------

@query("u1_segment_text", f"{PARA} select doc_id, position, segment_id, kind, text from seg")
def _(spark, d):
    return para_segments(spark, d).select("doc_id", "position", "segment_id", "kind", "text")


@query(
    "u2_segment_article",
    f"with {cte('para_docs')}, {duck.segments('para_docs', 'url_article')} select doc_id, concat('Title ', lang) as title, position, segment_id, kind, seg.text from seg join documents using (doc_id)",
)
def _(spark, d):
    docs = para_docs(spark, d).select("doc_id", F.concat(F.lit("Title "), "lang").alias("title"), F.col("raw").alias("text_content"))
    return documents.explode_segments(documents.segment_article(docs), "doc_id", "title").select(
        "doc_id", "title", "position", "segment_id", "kind", "text"
    )


@query(
    "u3_html_to_text",
    f"with {cte('dirty_pages')} select page_id, title, text, case when title is null then 'text' else 'url_article' end as kind, "
    f"concat('seg_', {duck.fnv('concat(chr(48), chr(58), text)')}) as segment_id from (select page_id, {duck.page_title('html')} as title, {duck.page_text('html')} as text from dirty_pages)",
)
def _(spark, d):
    done = html.segment_html(derive(spark, d, "dirty_pages"))
    return documents.explode_segments(done, "page_id", "title").select("page_id", "title", "text", "kind", "segment_id")


_S1 = "html"
for _tag in ("script", "style", "iframe", "noscript", "title"):
    _S1 = f"regexp_replace({_S1}, '(?is)<{_tag}\\b[^>]*>.*?</{_tag}\\s*>', '', 'g')"
_S2 = f"regexp_replace(regexp_replace({_S1}, '(?s)<!.*?>', '', 'g'), '(?is)</?(html|head|body|link|meta)\\b[^>]*>', '', 'g')"
_S3 = f"regexp_replace({_S2}, '(?i)\\s(style|on[a-z]+)=\"[^\"]*\"', '', 'g')"
_PROBED = (
    "case page_id % 5 when 0 then '<img src=\"x\">' when 1 then '<img src=\"x\">' when 2 then 'ipt>alert(1)ipt>' when 3 then '<p>set one=2 and 3 > 1</p>' "
    "else '<b title=\"a>b\">x &lt; y</b><a>' end"
)


# The pages hold paragraphs of the form `<p><b>text<br>`, ended by the next `<p>`: the open <b>, three at most, go on in
# every later paragraph, and behind the article to the end of the page.
_OWN = "len(string_split(x, '<b>')) - 1"
_BALANCED = rf"""
clean as (select page_id, string_split(regexp_replace({_S3}, '(?i)\shref="javascript:[^"]*"', '', 'g'), '<p>') as parts from dirty_pages),
ended as (select page_id, list_transform(parts, lambda x: case when contains(x, '</article>') and not contains(x, '</p>') then replace(x, '</article>', '</p></article>') else x end) as parts from clean),
bold as (select page_id, parts, list_transform(parts, lambda x: {_OWN}) as own from ended),
ranked as (select *, list_transform(range(1, len(parts) + 2), lambda j: least(3, coalesce(list_sum(own[1:j - 1]), 0))::bigint) as n from bold),
made as (select page_id, n[len(n)] as open, array_to_string(list_transform(range(1, len(parts) + 1), lambda j: case when j = 1 then parts[1] else concat('<p>', repeat('<b>', n[j]),
  split_part(parts[j], '</p>', 1), repeat('</b>', n[j] + own[j]), '</p>', substr(parts[j], length(split_part(parts[j], '</p>', 1)) + 5)) end), '') as h from ranked),
tidy as (select page_id, concat(replace(h, '</article>', concat('</article>', repeat('<b>', open))), case when page_id % 5 = 4 then '</a>' else '' end, repeat('</b>', open)) as h from made)"""


@query(
    "u4_sanitize_pages",
    f"with {cte('dirty_pages')}, {_BALANCED} select page_id, replace(h, '<footer>', concat({_PROBED}, '<footer>')) as safe_html, "
    "len(regexp_extract_all(html, '(?is)<(script|style|iframe|noscript|title|html|head|body|link|meta)\\b')) + case when page_id % 5 = 2 then 1 else 0 end as n_elements, "
    "len(regexp_extract_all(html, '(?i)\\s(style|on[a-z]+)=\"[^\"]*\"')) + case page_id % 5 when 0 then 1 when 1 then 2 else 0 end as n_attributes, "
    "len(regexp_extract_all(html, '(?i)\\shref=\"javascript:')) + case when page_id % 5 = 4 then 1 else 0 end as n_addresses from dirty_pages join tidy using (page_id)",
)
def _(spark, d):
    return html.sanitize_pages(derive(spark, d, "unsafe_pages")).select("page_id", "safe_html", "n_elements", "n_attributes", "n_addresses")


_READ = "regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\\b[^>]*>.*?</script\\s*>', '', 'g'), '(?is)<style\\b[^>]*>.*?</style\\s*>', '', 'g'), '(?is)<noscript\\b[^>]*>.*?</noscript\\s*>', '', 'g'), '(?s)<!--.*?-->', '', 'g')"


def _plain(x: str) -> str:
    return duck.collapse(duck.decode_entities(f"regexp_replace({x}, '<[^>]*>', '', 'g')"))


def _bare(x: str) -> str:
    return duck.collapse(f"regexp_replace({x}, '<[^>]*>', '', 'g')")


_CANDIDATES = " union all ".join(
    f"select page_id, '{tag}' as container, {weight} as w, unnest(regexp_extract_all(r, '(?is)<{tag}\\b[^>]*>(.*?)(?:</{tag}\\s*>|\\z)', 1)) as f from rd"
    for tag, weight in html.CONTAINER_WEIGHT.items()
)
_U5 = f"""with {cte('dirty_pages')}, rd as (select page_id, html, {_READ} as r from dirty_pages), cd as ({_CANDIDATES}),
sc as (select page_id, container, {_bare('f')} as t, (length({_bare('f')}) - 2 * length({_bare("array_to_string(regexp_extract_all(f, '(?is)<a\\b[^>]*>(.*?)</a>', 1), '')")})) * w as points from cd),
bt as (select page_id, max(row(points, container, t)) as b from sc group by page_id)
select page_id, {duck.page_title('html')} as title, case when page_id % 4 = 2 then 'Ann O''Neil' end as byline,
case when page_id % 4 = 2 then 'It''s a long day' else nullif({_plain("regexp_extract(regexp_replace(regexp_replace(r, '(?is)<p\\b', chr(1) || '<p', 'g'), '(?is)</(p|article)', chr(1) || '</x', 'g'), '(?is)<p[^>]*>([^' || chr(1) || ']*)', 1)")}, '') end as excerpt,
case when page_id % 4 = 2 then 'The "Daily" > News' end as site_name, b[2] as container, concat(case when page_id % 4 = 1 then 'Inner note. ' else '' end, {duck.decode_entities('b[3]')}) as text_content from rd join bt using (page_id)"""


@query("u5_extract_articles", _U5)
def _(spark, d):
    return html.extract_articles(derive(spark, d, "article_pages")).select(
        "page_id", "title", "byline", "excerpt", "site_name", "container", "text_content"
    )


def _md_sql(with_code: bool, announce: bool, prefix: bool) -> str:
    keep = "" if with_code else "where i % 5 <> 0"
    heading = "concat('Heading level 2: ', t)" if announce else "t"
    item = "concat('Bullet: ', t)" if prefix else "t"
    body = duck.normalize("l")
    return f"""with ln as (select doc_id, unnest(string_split(text, chr(10))) as l, unnest(range(1, len(string_split(text, chr(10))) + 1)) as i from documents),
bl as (select doc_id, i, l, {body} as t,
 case i % 5 when 1 then 3 + length(l) when 2 then length(l) when 3 then 2 + length(l) when 4 then 2 + length(l) else 11 + length(l) end as n from ln),
so as (select *, sum(n + 2) over (partition by doc_id order by i) - n - 2 as s from bl),
nm as (select doc_id, i, s, n, row_number() over (partition by doc_id order by i) - 1 as position,
 case i % 5 when 1 then 'heading' when 2 then 'paragraph' when 3 then 'list_item' when 4 then 'blockquote' else 'code' end as block_type,
 case i % 5 when 1 then {heading} when 3 then {item} else t end as text from so {keep})
select doc_id, position, concat('seg_', {duck.fnv('concat(cast(position as varchar), chr(58), text)')}) as segment_id, block_type, text,
cast(s as bigint) as start_at, cast(s + n as bigint) as end_at from nm where text <> ''"""


def _marked(spark, d, policy):
    flat = documents.explode_segments(markdown.segment_markdown(derive(spark, d, "md_docs"), policy=policy), "doc_id")
    return flat.select(
        "doc_id", "position", "segment_id", "block_type", "text",
        F.col("source_offset.start").cast("bigint").alias("start_at"), F.col("source_offset.end").cast("bigint").alias("end_at"),
    )


@query("u6_segment_markdown", _md_sql(True, False, False))
def _(spark, d):
    return _marked(spark, d, ReadPolicy(include_code=True))


@query("u6_segment_markdown_expressive", _md_sql(False, True, True))
def _(spark, d):
    return _marked(spark, d, EXPRESSIVE_READING)


_INLINE = f"""with ln as (select doc_id, unnest(string_split(text, chr(10))) as l, unnest(range(0, len(string_split(text, chr(10))))) as i from inline_docs),
tx as (select doc_id, i, case i % 5 when 0 then concat('a bold nested ', {duck.trim('l')}, ' end')
 when 1 then concat('see the guide ', {duck.trim('l')}, ' and REF ', doc_id, ' and rEf ', doc_id, ' not [no such][gone]')
 when 2 then concat('both strong ', {duck.trim('l')}, ' a b tail snake_case_word 2 * 3')
 when 3 then concat('x y z ', {duck.trim('l')}, ' in link !')
 else concat('~', l, ' code *not* **open *esc*') end as text from ln)
select doc_id, row_number() over (partition by doc_id order by i) - 1 as position,
 case i % 5 when 3 then 'list_item' when 4 then 'blockquote' else 'paragraph' end as block_type, {duck.normalize('text')} as text from tx"""


@query("u6_inline_and_references", f"with {cte('inline_docs')}, {_INLINE.removeprefix('with ')}")
def _(spark, d):
    """Nested emphasis, links, and references to definitions before and after them."""
    docs = markdown.segment_markdown(derive(spark, d, "inline_docs"))
    return documents.explode_segments(docs, "doc_id").select("doc_id", "position", "block_type", "text")


@query(
    "k1_document_order",
    f"{PARA} select doc_id, string_agg(segment_id, ' ' order by position) as ids from seg group by doc_id",
)
def _(spark, d):
    docs = documents.segment_text(para_docs(spark, d))
    return docs.select("doc_id", F.array_join("segments.segment_id", " ").alias("ids")).filter("ids <> ''")


@query(
    "b1_union_routes",
    f"with recursive {cte('raw_files')}, {cte('para_docs')}, {duck.segments('para_docs')}, fl as (select *, {_ROUTE} as r, {_BINARY} as bin from raw_files) "
    "select case when r = 'markdown' then 'markdown' else 'text' end as kind, count(*) as n from fl where not bin and r <> 'UNSUPPORTED_FILE_TYPE' group by 1 having kind <> 'text' union all "
    "select 'text', (select count(*) from fl where not bin and r in ('text', 'html')) + (select count(*) from seg) union all "
    "select 'url_article', count(*) from pages where page_id % 6 in (4, 5)",
)
def _(spark, d):
    done = ingest.route_ingest(raw_docs(spark, d))
    return documents.explode_segments(done, "doc_id").groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


# --- document aggregates -----------------------------------------------------------------------------------------

_FP = (
    f"{PARA}, hp as (select doc_id, position, concat(segment_id, ':', {duck.fnv(duck.collapse('nfc_normalize(text)'))}) as part from seg), "
    "jn as (select doc_id, count(*) as n, string_agg(part, '|' order by position) as j from hp group by doc_id), "
    f"fp as (select doc_id, n as n_segments, concat(cast(n as varchar), ':', {duck.fnv('j')}) as fingerprint from jn)"
)


@query("a1_document_fingerprint", f"{_FP} select doc_id, n_segments, fingerprint from fp")
def _(spark, d):
    docs = documents.segment_text(para_docs(spark, d)).filter(F.size("segments") > 0)
    return documents.document_index(docs, "doc_id").select("doc_id", "n_segments", "fingerprint")


@query(
    "a2_duplicate_documents",
    f"{_FP} select fingerprint, count(*) as n_documents, min(doc_id) as first_doc from fp group by fingerprint having count(*) > 1",
)
def _(spark, d):
    docs = documents.segment_text(para_docs(spark, d)).filter(F.size("segments") > 0)
    return documents.duplicate_documents(documents.document_index(docs, "doc_id"))


@query(
    "a4_segment_profile",
    f"with ms as (select block_type, 'markdown' as kind, length(text) as c, {duck.n_words('text')} as w from ({_md_sql(True, False, False)})) "
    "select kind, block_type, count(*) as n_segments, sum(c) as n_chars, sum(w) as n_tokens from ms group by rollup (kind, block_type)",
)
def _(spark, d):
    docs = markdown.segment_markdown(derive(spark, d, "md_docs"), policy=ReadPolicy(include_code=True))
    return documents.segment_profile(documents.explode_segments(docs, "doc_id"))


@query(
    "x25_preview_rows",
    f"with md as ({_md_sql(False, False, False)}), {cte('para_docs')}, {duck.segments('para_docs')} "
    "select doc_id, position, block_type, start_at as start, end_at as end, text from md union all "
    "select doc_id, position, 'paragraph', 0, length(text), text from seg",
)
def _(spark, d):
    marked = documents.explode_segments(markdown.segment_markdown(derive(spark, d, "md_docs")), "doc_id")
    return documents.preview_rows(marked.unionByName(para_segments(spark, d)), "doc_id")


# --- pieces and chunks -------------------------------------------------------------------------------------------

@query(
    "u7_split_sentences",
    f"select doc_id, unnest(range(len(ss))) as idx, unnest(ss) as sentence from (select doc_id, {duck.sentences('text')} as ss from documents)",
)
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", F.posexplode(T.sentences(F.col("text"))).alias("idx", "sentence"))


_TURNS = "tn as (select conv_id as doc_id, turn as position, text from conversations)"


@query(
    "u8_split_oversized",
    "with recursive wl as (select doc_id, w, list_transform(w, lambda x: length(x)) as lens from (select doc_id, "
    f"{duck.words('text')} as w from documents) where len(w) > 0), "
    "pk as (select doc_id, lens, 1::bigint as i, 0::bigint as g, lens[1]::bigint as c, 1::bigint as t from wl union all "
    "select doc_id, lens, i + 1, case when f then g + 1 else g end, case when f then lens[i + 1] else c + 1 + lens[i + 1] end, case when f then 1 else t + 1 end "
    "from (select *, c + 1 + lens[i + 1] > 420 or t + 1 > 85 as f from pk where i < len(lens))) "
    "select doc_id, g as idx, string_agg(w[i], ' ' order by i) as text from pk join wl using (doc_id) group by doc_id, g",
)
def _(spark, d):
    split = chunking.split_array(table(spark, d, "documents").select("doc_id", "text"), F.array("text"), "parts", PREEMPTIVE_CHUNKS, cut="words")
    return split.select("doc_id", F.posexplode("parts.text").alias("idx", "text"))


@query("u9_split_segments", f"{PIECES} select doc_id, piece_idx, text, n_chars, n_tokens from pc")
def _(spark, d):
    docs = chunking.split_segments(documents.segment_text(para_docs(spark, d)))
    return chunking.explode_pieces(docs, "doc_id").select("doc_id", "piece_idx", "text", "n_chars", "n_tokens")


@query(
    "j1_pieces_with_segment",
    f"{PIECES} select pc.doc_id, piece_idx, segment_id, pc.text, seg.kind, length(seg.text) as segment_chars from pc join seg using (doc_id, position)",
)
def _(spark, d):
    docs = chunking.split_segments(documents.segment_text(para_docs(spark, d)))
    return chunking.explode_pieces(docs, "doc_id").select("doc_id", "piece_idx", "segment_id", "text", "kind", "segment_chars")


@query("w1_number_segments", f"{PARA} select doc_id, position, count(*) over (partition by doc_id) as n from seg")
def _(spark, d):
    docs = documents.segment_text(para_docs(spark, d)).withColumn("n", F.size("segments"))
    return documents.explode_segments(docs, "doc_id", "n").select("doc_id", "position", "n")


@query("w2_pack_chunks", f"{CHUNKS} select doc_id, piece_idx, chunk_idx from ck")
def _(spark, d):
    docs = chunking.chunk_documents(documents.segment_text(para_docs(spark, d)))
    return chunking.explode_pieces(docs, "doc_id").select("doc_id", "piece_idx", "chunk_idx")


@query(
    "w3_piece_separators",
    f"with recursive md as ({_md_sql(False, False, False)}), {duck.pieces(DEFAULT_CHUNKS, 'md')}, "
    "jn as (select pc.doc_id, piece_idx, pc.text, md.block_type as bt, md.text as st from pc join md using (doc_id, position)), "
    "lg as (select *, lag(bt) over w as pb, lag(st) over w as ps from jn window w as (partition by doc_id order by piece_idx)) "
    f"select doc_id, piece_idx, text, case when bt = 'list_item' and pb = 'list_item' and not regexp_matches({duck.trim('ps')}, '[.!?][\"'')\\]]*\\z') then '. ' else ' ' end as sep from lg",
)
def _(spark, d):
    docs = chunking.split_segments(markdown.segment_markdown(derive(spark, d, "md_docs")))
    return chunking.explode_pieces(docs, "doc_id").select("doc_id", "piece_idx", "text", "sep")


@query("a3_assemble_chunks", f"{CHUNKS} select doc_id, chunk_idx, concat('chunk_', cast(chunk_idx as varchar)) as chunk_id, text, length(text) as n_chars, n_tokens, n_pieces from ct")
def _(spark, d):
    docs = chunking.chunk_documents(documents.segment_text(para_docs(spark, d)))
    return chunking.explode_chunks(docs, "doc_id").select(
        "doc_id", "chunk_idx", "chunk_id", "text", "n_chars", "n_tokens", F.size("pieces").alias("n_pieces")
    )


@query(
    "w8_char_offsets",
    f"{CHUNKS} select doc_id, piece_idx, chunk_idx, coalesce(sum(n_chars + 1) over (partition by doc_id, chunk_idx order by piece_idx rows between unbounded preceding and 1 preceding), 0) as char_offset from ck join pc using (doc_id, piece_idx)",
)
def _(spark, d):
    docs = chunking.chunk_documents(documents.segment_text(para_docs(spark, d)))
    return chunking.explode_pieces(docs, "doc_id").select("doc_id", "piece_idx", "chunk_idx", "char_offset")


def retry_parts(policy, source: str = "select conv_id as doc_id, turn as position, text from conversations") -> str:
    """CTE `rt(doc_id, position, part_idx, text)` of the parts of `source(doc_id, position, text)` after a failure."""
    half = policy.halved()
    # Sentence pieces of texts with two or more sentences; word runs at half limits for the others.
    return (
        f"tn as ({source}), sn as (select *, len({duck.sentences('text')}) as ns from tn), many as (select doc_id, position, text from sn where ns >= 2), "
        f"{duck.pieces(policy, 'many')}, "
        f"ow as (select doc_id, position, {duck.words('text')} as w from sn where ns = 1), ol as (select *, list_transform(w, lambda x: length(x)) as lens from ow), "
        "op as (select doc_id, position, lens, 1::bigint as i, 0::bigint as g, lens[1]::bigint as c, 1::bigint as t from ol union all "
        "select doc_id, position, lens, i + 1, case when f then g + 1 else g end, case when f then lens[i + 1] else c + 1 + lens[i + 1] end, case when f then 1 else t + 1 end "
        f"from (select *, c + 1 + lens[i + 1] > {half.max_chars} or t + 1 > {half.max_tokens} as f from op where i < len(lens))), "
        "og as (select op.doc_id, op.position, g, string_agg(w[i], ' ' order by i) as text from op join ol on op.doc_id = ol.doc_id and op.position = ol.position group by all), "
        "rt as (select doc_id, position, row_number() over (partition by doc_id, position order by piece_idx) - 1 as part_idx, text from pc union all select doc_id, position, g, text from og)"
    )


_RETRY = retry_parts(PREEMPTIVE_CHUNKS)


@query("u10_split_for_retry", f"with recursive {_RETRY} select doc_id, position, part_idx, text from rt")
def _(spark, d):
    turns = table(spark, d, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("position"), "text")
    split = chunking.split_for_retry(turns, "text", "parts", PREEMPTIVE_CHUNKS)
    return split.select("doc_id", "position", F.posexplode("parts").alias("part_idx", "text"))


@query(
    "u11_preemptive_split",
    f"with recursive {_RETRY}, lg as (select doc_id, position, text, length({duck.trim('text')}) > 420 or {duck.tokens('text')} > 85 as big, (select count(*) from rt where rt.doc_id = tn.doc_id and rt.position = tn.position) as n from tn) "
    "select lg.doc_id, lg.position, concat(cast(lg.doc_id as varchar), '-', cast(lg.position as varchar), '::chunk_', cast(part_idx as varchar)) as segment_id, rt.text, true as was_split "
    "from lg join rt on lg.doc_id = rt.doc_id and lg.position = rt.position where big and n >= 2 union all "
    "select doc_id, position, concat(cast(doc_id as varchar), '-', cast(position as varchar)), text, false from lg where not (big and n >= 2)",
)
def _(spark, d):
    turns = table(spark, d, "conversations").select(
        F.col("conv_id").alias("doc_id"), F.col("turn").alias("position"),
        F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("segment_id"), "text",
    )
    return chunking.preemptive_split(turns).select("doc_id", "position", "segment_id", "text", "was_split")


@query(
    "flagship_chunks_by_language",
    f"{CHUNKS} select lang, count(*) as n_chunks, round(avg(length(ct.text)), 4) as avg_chars, max(length(ct.text)) as max_chars from ct join documents using (doc_id) group by lang",
)
def _(spark, d):
    return ingest.flagship(para_docs(spark, d))
