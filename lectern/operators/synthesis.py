"""Synthesis planning over segment tables: cache lookups, prefetch, retries, export outcome, the model call."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern import policies as P
from lectern.functions import hashing
from lectern.functions import numbers as N
from lectern.functions import text as T
from lectern.operators.chunking import split_for_retry
from lectern.policies import PREEMPTIVE_CHUNKS


def with_cache_key(segments: DataFrame, provider: Column, runtime: Column, dtype: Column, voice: Column, rate: Column) -> DataFrame:
    return segments.withColumn(
        "cache_key", hashing.cache_key(provider, runtime, dtype, F.col("segment_id"), F.col("text"), voice, rate)
    )


def queue_status(segments: DataFrame, cache: DataFrame) -> DataFrame:
    """Status of every segment; one that was never requested is idle without audio. `cache_key` is unique in the cache."""
    known = cache.select("cache_key", F.col("status").alias("_s"), F.col("audio_url").alias("_u"))
    return segments.join(known, "cache_key", "left").select(
        *segments.columns, F.coalesce("_s", F.lit("idle")).alias("status"), F.col("_u").alias("audio_url")
    )


def prefetch_plan(segments: DataFrame, cache: DataFrame, ahead: int = P.LOOKAHEAD) -> DataFrame:
    """For every segment, the next ones still to be requested: (doc_id, idx, next_idx, segment_id, cache_key).

    Looks ahead with an equi-join on (doc_id, idx), so a long document spreads over all tasks.
    """
    wanted = segments.select("doc_id", "idx", F.explode(F.sequence(F.col("idx") + 1, F.col("idx") + ahead)).alias("next_idx"))
    target = queue_status(segments.select("doc_id", F.col("idx").alias("next_idx"), "segment_id", "cache_key"), cache)
    return (
        wanted.join(target, ["doc_id", "next_idx"])
        .filter(~F.col("status").isin("ready", "loading"))
        .select("doc_id", "idx", "next_idx", "segment_id", "cache_key")
    )


def underruns(transitions: DataFrame, cache: DataFrame) -> DataFrame:
    """Transitions whose next segment is not ready."""
    status = cache.select("cache_key", F.col("status").alias("_s"))
    joined = transitions.join(status, "cache_key", "left")
    return joined.filter(F.coalesce("_s", F.lit("idle")) != "ready").drop("_s")


def retry_prefix_check(segments: DataFrame, cache: DataFrame, retries: DataFrame) -> DataFrame:
    """Retrying from a segment needs all earlier ones cached. Adds first_missing and the error text, or nulls."""
    missing = segments.join(cache.select("segment_id").distinct(), "segment_id", "left_anti")
    first = (
        missing.groupBy("doc_id")
        .agg(F.min("position").alias("_first"))
    )
    earlier = F.when(F.col("_first") < F.col("from_position"), F.col("_first"))
    return retries.join(first, "doc_id", "left").select(
        *retries.columns,
        earlier.alias("first_missing"),
        F.when(
            earlier.isNotNull(),
            F.concat(
                F.lit("Retry cache miss for segment "), (earlier + 1).cast("string"), F.lit(". Please rebuild from the start.")
            ),
        ).alias("error"),
    )


def _schedule(split: DataFrame, attempts: int, max_depth: int) -> DataFrame:
    """Attempt rows of failing segments with their `_parts`; other columns of `split` stay."""
    rows = split.withColumn(
        "_outcome", F.when((F.col("split_depth") < max_depth) & (F.size("_parts") >= 2), "split").otherwise("exhausted")
    ).select("*", F.explode(F.sequence(F.lit(1), F.lit(attempts))).alias("attempt"))
    last = F.col("attempt") == attempts
    others = [c for c in split.columns if c not in ("segment_id", "split_depth", "text", "reason", "_parts")]
    return rows.select(
        "segment_id",
        "split_depth",
        "attempt",
        F.when(~last, N.backoff_ms(F.col("attempt"), P.SYNTH_BACKOFF_MS)).alias("delay_ms"),
        F.when(last, F.col("_outcome")).otherwise("retry").alias("outcome"),
        F.when(last & (F.col("_outcome") == "split"), F.size("_parts")).alias("chunk_count"),
        F.when(last & (F.col("_outcome") == "exhausted"), F.concat(F.lit("regen_exhausted: "), "reason"))
        .otherwise(F.col("reason"))
        .alias("message"),
        *others,
    )


def _children(split: DataFrame, max_depth: int) -> DataFrame:
    parts = split.filter((F.col("split_depth") < max_depth) & (F.size("_parts") >= 2))
    others = [c for c in split.columns if c not in ("segment_id", "split_depth", "text", "_parts")]
    exploded = parts.select("segment_id", "split_depth", *others, F.posexplode("_parts").alias("_i", "_t"))
    return exploded.select(
        F.concat("segment_id", F.lit("::chunk_"), F.col("_i").cast("string")).alias("segment_id"),
        F.col("_t").alias("text"),
        *others,
        (F.col("split_depth") + 1).alias("split_depth"),
    )


def retry_schedule(failures: DataFrame, attempts: int = P.SYNTH_ATTEMPTS, max_depth: int = P.MAX_SPLIT_DEPTH) -> DataFrame:
    """Attempt rows of segments that keep failing: (segment_id, split_depth, attempt, delay_ms, outcome, chunk_count,
    message).

    The last attempt either splits the text and goes one level deeper or gives up. Reads segment_id, text, reason and
    split_depth.
    """
    needed = failures.select("segment_id", "text", "reason", "split_depth")
    return _schedule(split_for_retry(needed, "text", "_parts"), attempts, max_depth)


def retry_children(failures: DataFrame, max_depth: int = P.MAX_SPLIT_DEPTH) -> DataFrame:
    """The sub-segments that replace failing segments in the next round, one level deeper."""
    return _children(split_for_retry(failures, "text", "_parts"), max_depth)


def retry_rounds(
    segments: DataFrame, fails: Callable[[Column], Column], reason: str, folder: str, max_depth: int = P.MAX_SPLIT_DEPTH,
    other_fails: Callable[[Column], Column] | None = None,
) -> DataFrame:
    """All events of synthesising `segments(segment_id, text)` when `fails(text)` says which texts come out bad.

    Rows as in `retry_schedule`, with these outcomes: `split` of an over-long segment before any attempt (attempt null),
    `downgrade` of an attempt that is repeated on the other runtime, `retry`, `split` and `exhausted` after the
    attempts, and `regenerated` when all parts of a split came out well. `other_fails` judges the other runtime; without
    it there is none. Each of the at most max_depth + 2 levels is written once under `folder`, on shared storage, so no level is
    computed twice.
    """
    spark = segments.sparkSession
    named = segments.select("segment_id", "text", F.lit(reason).alias("reason"), F.lit(0).alias("split_depth"), F.array("segment_id").alias("line"))
    trimmed = T.js_trim(F.col("text"))
    long = (T.utf16_length(trimmed) > PREEMPTIVE_CHUNKS.max_chars) | (T.estimate_tokens(trimmed) > PREEMPTIVE_CHUNKS.max_tokens)
    cut = split_for_retry(named.withColumn("_long", F.when(long, trimmed)), "_long", "_parts", PREEMPTIVE_CHUNKS).drop("_long")

    def kept(df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{folder}/{name}")
        return spark.read.schema(df.schema).parquet(f"{folder}/{name}")

    first = kept(cut, "first")
    ahead = first.filter(F.size("_parts") >= 2)
    none = F.lit(None).cast("int")
    event = lambda df, attempt, outcome, count: df.select(
        "segment_id", "split_depth", attempt.alias("attempt"), F.lit(None).cast(delay).alias("delay_ms"), F.lit(outcome).alias("outcome"),
        count.alias("chunk_count"), F.when(F.lit(outcome == "downgrade"), F.lit(reason)).alias("message"), "line",
    )
    delay = _schedule(ahead, 1, max_depth).schema["delay_ms"].dataType
    out = event(ahead, none, "split", F.size("_parts"))
    below = lambda df: df.withColumn("line", F.array_append("line", F.col("segment_id")))
    later = below(_children(ahead, max_depth))
    level = first.filter(F.size("_parts") < 2).drop("_parts")
    for depth in range(max_depth + 1):
        bad = level.filter(fails(F.col("text")))
        if other_fails is not None:
            # One downgrade for each attempt; a text that the other runtime can speak needs no second attempt.
            tries = F.when(other_fails(F.col("text")), P.SYNTH_ATTEMPTS).otherwise(1)
            lowered = bad.select("*", F.explode(F.sequence(F.lit(1), tries)).alias("attempt"))
            out = out.unionByName(event(lowered, F.col("attempt"), "downgrade", none))
            bad = bad.filter(other_fails(F.col("text")))
        split = kept(split_for_retry(bad, "text", "_parts"), f"level_{depth}")
        out = out.unionByName(_schedule(split, P.SYNTH_ATTEMPTS, max_depth))
        children = below(_children(split, max_depth))
        level = children.unionByName(later) if depth == 0 else children
    lost = out.filter("outcome = 'exhausted'").select(F.explode("line").alias("segment_id")).distinct()
    well = out.filter("outcome = 'split'").join(lost, "segment_id", "left_anti")
    return out.unionByName(event(well, none, "regenerated", F.col("chunk_count"))).drop("line")


# Outcome texts of a full-document export.
NO_SEGMENTS = "No segments available to synthesize."
NATIVE_ONLY = (
    "Current voice/runtime only supports live native speech playback. Try a Kokoro voice for downloadable audio."
)


def export_outcome(docs: DataFrame, results: DataFrame) -> DataFrame:
    """Per document: status, segments built before the first failure, and the message.

    `results(doc_id, position, segment_id, ok, reason, native)` holds dense positions, so the first failing position is
    also the number of segments built; only counts and a minimum are aggregated.
    """
    failed = ~F.col("ok") | F.col("native")
    first = F.min(F.when(failed, F.struct("position", "segment_id", "reason", "native"))).alias("_f")
    summary = results.groupBy("doc_id").agg(F.count(F.lit(1)).alias("_n"), first)
    joined = docs.select("doc_id").join(summary, "doc_id", "left")
    total = F.coalesce("_n", F.lit(0))
    at = F.col("_f.position")
    message = F.concat(
        F.lit("Build failed at segment "), (at + 1).cast("string"), F.lit("/"), total.cast("string"), F.lit(" ("),
        F.col("_f.segment_id"), F.lit("): "), F.col("_f.reason"),
    )
    return joined.select(
        "doc_id",
        F.when((total == 0) | at.isNotNull(), "error").otherwise("ready").alias("status"),
        F.coalesce(at.cast("bigint"), total).alias("built_segments"),
        total.alias("total_segments"),
        F.col("_f.segment_id").alias("failed_segment_id"),
        at.alias("failed_segment_index"),
        F.when(total == 0, NO_SEGMENTS).when(F.col("_f.native"), NATIVE_ONLY).when(at.isNotNull(), message).alias("error"),
    )


def synthesize(segments: DataFrame, model: Callable[[Iterator], Iterator], schema: str) -> DataFrame:
    """Run a batch model over the segments: `model` maps an iterator of pandas frames to an iterator of result frames."""
    return segments.mapInPandas(model, schema)


def synthesize_missing(segments: DataFrame, cache: DataFrame, model: Callable[[Iterator], Iterator], schema: str) -> DataFrame:
    """Only segments without a ready result reach the model, each distinct request once."""
    return synthesize(pending_segments(segments, cache), model, schema)


def pending_segments(segments: DataFrame, cache: DataFrame) -> DataFrame:
    """The segments to synthesise: those without a ready result, one row per distinct request."""
    ready = cache.filter("status = 'ready'").select("cache_key")
    return segments.dropDuplicates(["cache_key"]).join(ready, "cache_key", "left_anti")


def estimated_tokens(segments: DataFrame) -> DataFrame:
    """Adds the synthesis token estimate and the shortest plausible duration at normal rate."""
    return segments.withColumn("est_tokens", T.estimate_tokens("text")).withColumn(
        "min_duration_s", N.min_duration_s(F.col("text"), F.lit(1.0))
    )
