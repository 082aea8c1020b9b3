"""The three ways in (pasted text, files, extracted addresses) as one pass over the raw table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.operators import chunking, documents, guards, html, markdown
from lectern.policies import DEFAULT_CHUNKS, PLAIN_READING, ChunkPolicy, ReadPolicy
from lectern.sources.readers import resolve_payload

# Titles, and messages of extraction failures.
UNTITLED, FAILED = "Untitled Source", "Ingestion failed"
UNAVAILABLE_NO_ANSWER = "URL extraction is currently unavailable. Please try again later or use paste/upload instead."
UNAVAILABLE = "URL extraction service is unavailable right now. Please try again later or use paste/upload instead."
EXTRACT_FAILED = "We could not extract readable text from that URL. Verify the link and try another page."
URL_NOTE = ("URL_INGEST_MODE", "URL ingestion uses backend extraction.", "info")


def route_ingest(raw_docs: DataFrame, policy: ReadPolicy = PLAIN_READING) -> DataFrame:
    """Adds route, title, segments, warnings, error_code and error_message.

    Reads source_type (text, file, url), name, mime, raw and status. For `url` rows raw is the extractor's JSON answer
    and status its HTTP status (null: no answer). A failed document keeps no segments and one error warning.

    One scan serves all routes: the route decides per row which text is segmented, and rows of other routes pass empty
    text through the remaining steps.
    """
    source, status = F.col("source_type"), F.col("status")
    answered = F.when(status.isNull() | (status == 404) | (status >= 500), "URL_EXTRACT_UNAVAILABLE").when(
        (status < 200) | (status >= 300), "URL_EXTRACT_FAILED"
    ).otherwise("url")
    route = (
        F.when(source == "text", F.when(T.looks_like_markdown("raw"), "markdown").otherwise("text"))
        .when(source == "file", guards.file_route(F.col("name"), F.col("mime")))
        .otherwise(answered)
    )
    routed = raw_docs.withColumn("route", route)
    known = F.col("route").isin("html", "markdown", "text", "url")
    binary = known & (source == "file") & F.coalesce(guards.looks_binary(F.col("raw")), F.lit(True))
    kind_shown = F.coalesce(F.nullif("mime", F.lit("")), F.lit("unknown"))
    message = (
        F.when(binary, guards.MESSAGES["BINARY_FILE_CONTENT"])
        .when(F.col("route") == "UNSUPPORTED_FILE_TYPE", F.concat(F.lit("Unsupported file type: "), kind_shown))
        .when(status.isNull() & (source == "url"), UNAVAILABLE_NO_ANSWER)
        .when(F.col("route") == "URL_EXTRACT_UNAVAILABLE", UNAVAILABLE)
        .when(F.col("route") == "URL_EXTRACT_FAILED", EXTRACT_FAILED)
    )
    checked = routed.withColumn("error_code", F.when(binary, "BINARY_FILE_CONTENT").when(~known, F.col("route"))).withColumn(
        "error_message", message
    )
    good = F.col("error_code").isNull()
    opened = resolve_payload(checked.withColumn("_payload", F.when(good & (F.col("route") == "url"), F.col("raw"))), "_payload")
    page = F.when(good & (F.col("route") == "html"), F.col("raw"))
    titled = opened.withColumn("title", F.when(F.col("route") == "html", html.page_title(page)).otherwise(F.col("title")))
    plain = (
        F.when(good & (F.col("route") == "text"), F.col("raw"))
        .when(good & (F.col("route") == "url"), F.col("text_content"))
        .otherwise(html.body_text(page))
    )
    kind = F.when((F.col("route") == "url") | ((F.col("route") == "html") & F.col("title").isNotNull()), "url_article").otherwise("text")
    marked = markdown.segment_markdown(
        titled.withColumn("_md", F.when(good & (F.col("route") == "markdown"), F.col("raw"))), "_md", policy
    ).withColumnRenamed("segments", "_marked")
    both = documents.segment_text(marked.withColumn("_plain", plain).withColumn("_kind", kind), "_plain", F.col("_kind"))
    chosen = F.when(F.col("route") == "markdown", F.col("_marked")).otherwise(
        F.coalesce("segments", F.filter("_marked", lambda s: F.lit(False)))
    )

    def note(code: str, text, severity: str):
        text = F.lit(text) if isinstance(text, str) else text
        return F.array(F.struct(F.lit(code).alias("code"), text.alias("message"), F.lit(severity).alias("severity")))

    warnings = F.when(~good, note("INGEST_ERROR", F.col("error_message"), "error")).when(
        source == "url", note(*URL_NOTE)
    ).otherwise(F.array().cast(documents.WARNING_TYPE))
    title = F.when(~good, FAILED).otherwise(F.coalesce(F.nullif("title", F.lit("")), F.lit(UNTITLED)))
    out = both.withColumn("segments", chosen).withColumn("warnings", warnings).withColumn("title", title)
    return out.drop("_payload", "text_content", "_md", "_marked", "_plain", "_kind")


def corpus(raw_docs: DataFrame, read: ReadPolicy = PLAIN_READING, chunks: ChunkPolicy = DEFAULT_CHUNKS) -> DataFrame:
    """Raw documents to segments, fingerprint, pieces and chunks. Narrow from the scan to the result."""
    return chunking.chunk_documents(documents.document_fingerprint(route_ingest(raw_docs, read)), chunks)


def read_crawl(crawl: DataFrame, dns: DataFrame, cidr: DataFrame, bodies: DataFrame, folder: str | None = None) -> DataFrame:
    """Crawled addresses to article documents.

    Addresses are followed to their end and the host of every hop is checked first, on narrow rows; page bodies are
    joined only for addresses that passed. `bodies(url, html)`, `dns(host, address)`;
    `folder` as in `resolve_redirects`.
    """
    safe = guards.resolve_redirects(crawl, dns=dns, cidr=cidr, folder=folder).filter("verdict = 'ok'").select("url", "final_url")
    # Each body is read once, however many addresses lead to it.
    wanted = safe.select("final_url").distinct()
    pages = bodies.select(F.col("url").alias("final_url"), "html").join(wanted, "final_url", "left_semi")
    valid = guards.validate_article(html.extract_articles(pages).drop("html")).filter("error_code is null")
    return safe.join(documents.segment_article(valid.drop("error_code", "error_message")), "final_url")


def flagship(docs: DataFrame, policy: ChunkPolicy = DEFAULT_CHUNKS) -> DataFrame:
    """Chunk statistics per language of `docs(lang, raw)`: everything up to the last aggregation stays in its row."""
    chunked = chunking.chunk_documents(documents.segment_text(docs), policy)
    return (
        chunked.select("lang", F.explode("chunks.n_chars").alias("n_chars"))
        .groupBy("lang")
        .agg(F.count(F.lit(1)).alias("n_chunks"), F.round(F.avg("n_chars"), 4).alias("avg_chars"), F.max("n_chars").alias("max_chars"))
    )
