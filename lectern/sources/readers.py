"""Readers: whole texts, files, pages, extractor payloads, links, telemetry, manifests."""

from __future__ import annotations

import os
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from lectern.functions import text as T
from lectern.operators.html import TAG, UNREAD, decode_entities, sanitize_pages
from lectern.schemas import MANIFEST_DDL, PAYLOAD_DDL, TELEMETRY


TASK_BYTES = 16 << 20


def few_tasks(rows: DataFrame, files: DataFrame) -> DataFrame:
    """`rows` of the scan `files` in tasks of about `TASK_BYTES`, with no shuffle.

    Spark counts 4 MB for the opening of a file, so millions of small files would make a task for every few of them.
    """
    size = int(files._jdf.queryExecution().analyzed().stats().sizeInBytes())
    least = 2 * rows.sparkSession.sparkContext.defaultParallelism
    return rows.coalesce(max(least, -(-size // TASK_BYTES)))


BATCH_BYTES = 4 << 20  # of files that a task hands on together


def visible(name: str) -> bool:
    """Whether Spark's readers look at a file or folder of this name."""
    return not (name.startswith("_") and "=" not in name or name.startswith(".") or name.endswith("._COPYING_"))


def mounted_folders(spark: SparkSession, path: str) -> list[str] | None:
    """The folders of a mounted file system that hold the files of `path`: itself, or its folders `column=value`.

    None for single files, patterns, other stores and other layouts, whose rules are left to Spark's readers.
    """
    scheme, _, rest = path.partition(":")
    if scheme == "file" and (rest[:3] == "///" or rest[:1] == "/" != rest[1:2]):
        top = "/" + rest.lstrip("/")
    elif ":" in path or not (spark.sparkContext._jsc.hadoopConfiguration().get("fs.defaultFS") or "file:").startswith("file:"):
        return None
    else:
        top = path
    top = os.path.abspath(top)
    if any(c in path for c in "*?[]{}\\") or not os.path.isdir(top):
        return None
    folders, files = [], False
    with os.scandir(top) as found:
        for entry in found:
            if visible(entry.name):
                if entry.is_dir():
                    folders.append(entry.name)
                else:
                    files = True
                if files and folders:
                    return None
    if files:
        return [top]
    parts = [name.partition("=") for name in folders]
    if not folders or not all(column and value for column, _, value in parts) or len({column for column, _, _ in parts}) > 1:
        return None
    return [f"{top}/{name}" for name in folders]


def in_uri(path: str) -> str:
    """The path as it stands in a URI of java.net: what is no legal character there, in percent."""
    legal = lambda c: c.isascii() and (c.isalnum() or c in "/-_.!~*'():@&=+$,;") or c >= "\xa0" and unicodedata.category(c)[0] != "Z"
    return "".join(c if legal(c) else "".join(f"%{b:02X}" for b in c.encode("utf-8", "replace")) for c in path)


def whole_files(spark: SparkSession, path: str) -> DataFrame | None:
    """(path, uri, content) of the files that are not empty, in tasks of about `TASK_BYTES`; None where `mounted_folders` is.

    Spark's readers hold the path, size and time of every file on the driver. Here tasks list the folders and names are
    dealt out to the tasks that read them, so the driver holds the folders only.
    """
    folders = mounted_folders(spark, path)
    if folders is None:
        return None
    least = 2 * spark.sparkContext.defaultParallelism
    places = spark.createDataFrame([(os.fsencode(f),) for f in folders], "folder binary").repartition(min(len(folders), least))

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[bytes, bool, int]]:
        for batch in batches:
            for folder in batch.column(0).to_pylist():
                with os.scandir(folder) as found:
                    for entry in found:
                        if visible(os.fsdecode(entry.name)):
                            inner = entry.is_dir()
                            size = 0 if inner else entry.stat().st_size
                            if inner or size:
                                yield entry.path, inner, size

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, inner, total = 0, False, 0
        for _, is_folder, size in listed(batches):
            n, inner, total = n + 1, inner or is_folder, total + size
        yield pa.RecordBatch.from_pydict({"n": [n], "inner": [inner], "bytes": [total]})

    def names(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        some = []
        for name, _, _ in listed(batches):
            some.append(name)
            if len(some) == 10_000:
                yield pa.RecordBatch.from_pydict({"file": pa.array(some, pa.binary())})
                some = []
        yield pa.RecordBatch.from_pydict({"file": pa.array(some, pa.binary())})

    def contents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch_of(files, texts):
            paths = [os.fsdecode(f).encode("utf-8", "replace").decode() for f in files]
            return pa.RecordBatch.from_pydict({"path": pa.array(paths, pa.string()), "uri": pa.array(map(in_uri, paths), pa.string()), "content": pa.array(texts, pa.binary())})

        files, texts, held = [], [], 0
        for batch in batches:
            for file in batch.column(0).to_pylist():
                with open(file, "rb") as f:
                    texts.append(f.read())
                files.append(file)
                held += len(texts[-1])
                if held >= BATCH_BYTES:
                    yield batch_of(files, texts)
                    files, texts, held = [], [], 0
        yield batch_of(files, texts)

    found = places.mapInArrow(measure, "n long, inner boolean, bytes long").agg(F.sum("n"), F.max("inner"), F.sum("bytes")).first()
    if found[1] or not found[0]:
        return None
    tasks = min(found[0], max(least, -(-found[2] // TASK_BYTES)))
    rows = places.mapInArrow(names, "file binary").repartition(tasks).mapInArrow(contents, "path string, uri string, content binary")
    return rows.select(F.concat(F.lit("file:"), "path").alias("path"), F.concat(F.lit("file://"), "uri").alias("uri"), "content")


def read_text(spark: SparkSession, path: str) -> DataFrame:
    """Whole text files, one document each: (path, name, raw)."""
    whole = whole_files(spark, path)
    if whole is not None:
        name = F.regexp_extract("uri", r"([^/]+)\z", 1)
        return whole.select(F.col("uri").alias("path"), name.alias("name"), F.col("content").cast("string").alias("raw"))
    files = spark.read.text(path, wholetext=True)
    name = F.regexp_extract(F.input_file_name(), r"([^/]+)\z", 1)
    return few_tasks(files.select(F.input_file_name().alias("path"), name.alias("name"), F.col("value").alias("raw")), files)


def read_files(spark: SparkSession, path: str, mime: dict[str, str] | None = None) -> DataFrame:
    """File bytes decoded as UTF-8 with replacement characters: (path, name, mime, raw). `mime` maps extensions to types."""
    whole = whole_files(spark, path)
    files = spark.read.format("binaryFile").load(path) if whole is None else whole
    name = F.url_decode(F.regexp_extract("path", r"([^/]+)\z", 1))
    table = {ext.lower().lstrip("."): kind for ext, kind in (mime or {}).items()}
    extension = F.lower(F.regexp_extract(name, r"\.([^.]*)\z", 1))
    kind = F.lit("")
    for ext, value in table.items():
        kind = F.when(extension == ext, value).otherwise(kind)
    rows = files.select("path", name.alias("name"), kind.alias("mime"), decode_bytes(F.col("content")).alias("raw"))
    return few_tasks(rows, files) if whole is None else rows


def decode_bytes(content: Column) -> Column:
    """UTF-8 text of bytes; a leading byte-order mark goes, invalid bytes become replacement characters."""
    return F.regexp_replace(F.make_valid_utf8(content.cast("string")), "\\A\ufeff", "")


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("page_id bigint, url string, html string").parquet(path)


def resolve_payload(df: DataFrame, payload: str = "payload") -> DataFrame:
    """Extractor JSON to `title` and `text_content`. The first non-null text wins, even when it is empty."""
    parsed = df.withColumn("_p", F.from_json(payload, PAYLOAD_DDL)).withColumn(
        "_content", F.coalesce("_p.article.content", F.lit(""))
    )
    safe = sanitize_pages(parsed, "_content")
    from_html = T.js_trim(decode_entities(F.regexp_replace(F.regexp_replace("safe_html", UNREAD, ""), TAG, "")))
    return (
        safe.withColumn("title", F.coalesce("_p.article.title", "_p.title"))
        .withColumn("text_content", F.coalesce("_p.article.textContent", "_p.textContent", from_html))
        .drop("_p", "_content", "safe_html", "n_elements", "n_attributes", "n_addresses")
    )


# Link parameters that may hold a document, in the order they are tried.
LINK_KEYS = ("text64", "b64", "text_base64")


def _param(query: Column, key: str) -> Column:
    """Decoded value of the first parameter with this name; null when absent. A plus sign stands for a space."""
    found = F.regexp_extract_all(query, F.lit(rf"(?:\A|&)({key})(?:=([^&]*))?(?=&|\z)"), F.lit(0))
    raw = F.regexp_replace(F.get(found, F.lit(0)), rf"\A&?{key}=?", "")
    # A stray percent sign is kept as it is, as browsers do.
    return F.try_url_decode(F.regexp_replace(raw, r"%(?![0-9a-fA-F]{2})", "%25"))


def decode_base64_text(value: Column) -> Column:
    """Text of a base64 value in either alphabet; null when it cannot be decoded."""
    normal = F.translate(F.regexp_replace(value, f"[{T.WS}]+", "+"), "-_", "+/")
    padded = F.rpad(normal, (F.ceil(F.length(normal) / F.lit(4.0)) * 4).cast("int"), "=")
    valid = padded.rlike(r"\A(?:[A-Za-z0-9+/]{4})*(?:[A-Za-z0-9+/]{2}==|[A-Za-z0-9+/]{3}=)?\z") & (value != "")
    text = F.make_valid_utf8(F.try_to_binary(padded, F.lit("base64")).cast("string"))
    return F.when(valid, F.regexp_replace(text, "\\A\ufeff", ""))


def decode_link_text(df: DataFrame, url: str = "url") -> DataFrame:
    """Adds `param_key`, `text` and `error`: the document carried in a link.

    Looks in the query, then in the query part of the fragment, then in the fallback route `?/path&...`.
    """
    link = F.col(url)
    search = F.regexp_extract(link, r"\A[^#?]*\?([^#]*)", 1)
    fragment = F.regexp_extract(link, r"\A[^#]*#[^?]*\?(.*)\z", 1)
    route = F.when(F.startswith(search, F.lit("/")), F.replace(F.substring(search, 2, 1 << 30), F.lit("~and~"), F.lit("&")))
    rerouted = F.regexp_extract(F.coalesce(route, F.lit("")), r"\A[^?#]*\?([^#]*)", 1)
    found = F.lit(None).cast("struct<key:string,value:string>")
    for query in (rerouted, fragment, search):
        for key in reversed(LINK_KEYS):
            value = _param(query, key)
            found = F.when(value.isNotNull(), F.struct(F.lit(key).alias("key"), value.alias("value"))).otherwise(found)
    text = decode_base64_text(F.col("_found.value"))
    failed = F.col("_found").isNotNull() & text.isNull()
    message = F.concat(F.lit('Unable to decode URL parameter "'), F.col("_found.key"), F.lit('" as base64 text.'))
    return (
        df.withColumn("_found", found)
        .withColumn("param_key", F.col("_found.key"))
        .withColumn("text", text)
        .withColumn("error", F.when(failed, message))
        .drop("_found")
    )


def read_telemetry(spark: SparkSession, path: str, streaming: bool = False, fmt: str = "json") -> DataFrame:
    reader = spark.readStream if streaming else spark.read
    return reader.schema(TELEMETRY).format(fmt).load(path)


# The event types whose fields the table of events has.
KNOWN_EVENTS = (
    "tts.model_load", "tts.first_audio", "tts.segment_synth", "tts.segment_retry", "tts.segment_regenerated", "tts.validation_code",
    "tts.synth_failure", "tts.export_build_outcome", "tts.queue_underrun", "tts.queue_transition", "tts.degraded_mode", "tts.runtime_downgrade",
)


def read_lines(spark: SparkSession, path: str, streaming: bool = False) -> DataFrame:
    """Lines of text as they are, in `line`; a reader of events that keeps what it cannot read."""
    reader = spark.readStream if streaming else spark.read
    return reader.text(path).withColumnRenamed("value", "line")


def judge_events(lines: DataFrame, line: str = "line") -> DataFrame:
    """Adds `event` (the typed fields), `payload` and `reject_reason` to JSON lines; works on streams too.

    reject_reason is `malformed` where a line is no JSON object or a field has another type, `no_session` or `no_type`
    where one of those is missing, null for good lines. Events of a type that is not known are good: `payload` keeps the whole
    of them as a variant, so that later versions can read their fields.
    """
    schema = StructType([*TELEMETRY.fields, StructField("_corrupt", StringType())])
    parsed = F.from_json(line, schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    judged = lines.withColumn("_e", parsed)
    kind = F.btrim(F.coalesce(F.col("_e.type"), F.lit("")))
    reason = (
        F.when(F.col("_e").isNull() | F.col("_e._corrupt").isNotNull() | ~F.startswith(F.ltrim(line), F.lit("{")), "malformed")
        .when(F.col("_e.session_id").isNull(), "no_session")
        .when(kind == "", "no_type")
    )
    judged = judged.withColumn("reject_reason", reason)
    good = F.col("reject_reason").isNull()
    unknown = F.when(good & ~kind.isin(*KNOWN_EVENTS), F.try_parse_json(line))
    event = F.struct(*[F.col(f"_e.{f.name}").alias(f.name) for f in TELEMETRY.fields])
    return judged.withColumn("event", F.when(good, event)).withColumn("payload", unknown).drop("_e")


def accepted_events(judged: DataFrame) -> DataFrame:
    return judged.filter("reject_reason is null").select("event.*", "payload")


def rejected_events(judged: DataFrame, line: str = "line") -> DataFrame:
    return judged.filter("reject_reason is not null").select(F.col(line).alias("line"), "reject_reason")


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Licence manifest entries, one row per artifact."""
    return spark.read.schema(MANIFEST_DDL).json(path, multiLine=True).selectExpr("inline(artifacts)")
