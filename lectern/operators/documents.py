"""Nested documents: one row per document with its ordered `segments` array.

Everything that depends on the order of one document's text runs inside its row, so these operators add no shuffle and
have no hot key: a document is a single input row, however many segments it has. `explode_segments` gives the flat
table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions import kernels as K
from lectern.functions import text as T
from lectern.functions.plan import pin

OFFSET_TYPE = "struct<start:int,end:int>"
META_TYPE = "struct<depth:int,is_list_item_boundary:boolean,code_language:string>"
SEGMENT_FIELDS = ("position", "segment_id", "kind", "block_type", "text", "source_offset", "meta")


def block(position: Column, kind: Column | str, block_type: Column | str, text: Column,
          offset: Column | None = None, meta: Column | None = None) -> Column:
    """One candidate segment; its text is normalised here."""
    kind = F.lit(kind) if isinstance(kind, str) else kind
    block_type = F.lit(block_type) if isinstance(block_type, str) else block_type
    return F.struct(
        position.cast("int").alias("position"),
        kind.alias("kind"),
        block_type.alias("block_type"),
        T.normalize_whitespace(text).alias("text"),
        (F.lit(None).cast(OFFSET_TYPE) if offset is None else offset).alias("source_offset"),
        (F.lit(None).cast(META_TYPE) if meta is None else meta).alias("meta"),
    )


def finish_segments(df: DataFrame, blocks: Column) -> DataFrame:
    """Drop empty blocks, keep the positions they used, and give every remaining one its content-derived id."""
    kept = df.withColumn("_blocks", F.filter(blocks, lambda b: b["text"] != ""))
    keyed = kept.withColumn(
        "_hash",
        K.fnv1a32_each(F.transform("_blocks", lambda b: F.concat(b["position"].cast("string"), F.lit(":"), b["text"]))),
    )
    segments = F.transform(
        "_blocks",
        lambda b, i: F.struct(
            b["position"].alias("position"),
            F.concat(F.lit("seg_"), F.get(F.col("_hash"), i)).alias("segment_id"),
            *[b[name].alias(name) for name in SEGMENT_FIELDS[2:]],
        ),
    )
    return pin(keyed, "segments", segments).drop("_blocks", "_hash")


def segment_text(df: DataFrame, raw: str = "raw", kind: str | Column = "text") -> DataFrame:
    """Paragraphs of plain or article text as segments, numbered after blank ones are dropped."""
    return finish_segments(df, F.transform(T.paragraphs(F.col(raw)), lambda p, i: block(i, kind, "paragraph", p)))


def segment_article(df: DataFrame, text: str = "text_content") -> DataFrame:
    return segment_text(df, text, kind="url_article")


def explode_segments(docs: DataFrame, *keys: str) -> DataFrame:
    """One row per segment; `idx` is the segment's place in its document after empty ones are gone."""
    cols = [F.col(k) for k in keys]
    flat = docs.select(*cols, F.posexplode("segments").alias("idx", "s"))
    return flat.select(*keys, "idx", *[F.col("s")[name].alias(name) for name in SEGMENT_FIELDS])


def nest_segments(segments: DataFrame, key: str = "doc_id") -> DataFrame:
    """Rebuild nested documents from a flat table. One document must fit in a row, as it did before exploding."""
    ordered = F.array_sort(F.collect_list(F.struct(*SEGMENT_FIELDS)))
    return segments.groupBy(key).agg(ordered.alias("segments"))


def document_fingerprint(docs: DataFrame) -> DataFrame:
    """Adds `fingerprint`: segment count and a hash over every segment's id and normalised text."""
    texts = docs.withColumn("_norm", K.nfkc_each(F.transform("segments", lambda s: s["text"])))
    hashed = texts.withColumn("_part", K.fnv1a32_each(F.transform("_norm", lambda t: T.collapse_whitespace(t))))
    joined = F.array_join(
        F.transform("segments", lambda s, i: F.concat(s["segment_id"], F.lit(":"), F.get(F.col("_part"), i))), "|"
    )
    count = F.size("segments").cast("string")
    out = hashed.withColumn("_whole", K.fnv1a32(joined))
    return out.withColumn("fingerprint", F.concat(count, F.lit(":"), F.col("_whole"))).drop("_norm", "_part", "_whole")


def document_index(docs: DataFrame, *keys: str) -> DataFrame:
    """The per-document header row: title, segment count, fingerprint, warnings."""
    known = set(docs.columns)
    printed = docs if "fingerprint" in known else document_fingerprint(docs)
    title = F.col("title") if "title" in known else F.lit(None).cast("string")
    warnings = F.col("warnings") if "warnings" in known else F.lit(None).cast(WARNING_TYPE)
    return printed.select(
        *keys, title.alias("title"), F.size("segments").alias("n_segments"), "fingerprint", warnings.alias("warnings")
    )


WARNING_TYPE = "array<struct<code:string,message:string,severity:string>>"


def duplicate_documents(indexed: DataFrame, key: str = "doc_id") -> DataFrame:
    """Fingerprints shared by several documents. Counts and the smallest key only, so a group of any size is safe."""
    return (
        indexed.groupBy("fingerprint")
        .agg(F.count(F.lit(1)).alias("n_documents"), F.min(key).alias("first_doc"))
        .filter("n_documents > 1")
    )


def segment_profile(segments: DataFrame) -> DataFrame:
    """Counts by kind and block type, with subtotals per kind and a grand total."""
    measured = segments.select(
        "kind", "block_type", T.utf16_length("text").alias("chars"), T.count_words("text").alias("tokens")
    )
    return (
        measured.rollup("kind", "block_type")
        .agg(
            F.count(F.lit(1)).alias("n_segments"),
            F.sum("chars").alias("n_chars"),
            F.sum("tokens").alias("n_tokens"),
        )
    )


def preview_rows(segments: DataFrame, *keys: str) -> DataFrame:
    """Display rows; a missing source offset is shown as the text's own range."""
    return segments.select(
        *keys,
        "position",
        "block_type",
        F.coalesce(F.col("source_offset.start"), F.lit(0)).alias("start"),
        F.coalesce(F.col("source_offset.end"), T.utf16_length("text")).alias("end"),
        "text",
    )
