"""Synthesis from the cache look-up to the outcome of every document, as one flow over tables."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.operators import synthesis
from lectern.session import written


class Build(NamedTuple):
    outcomes: DataFrame  # per document, as `synthesis.export_outcome`
    events: DataFrame  # attempts, splits and downgrades of what was synthesised, as `synthesis.retry_rounds`
    queue: DataFrame  # per segment: doc_id, position, segment_id, cache_key, source (cache, built, regenerated, failed)


def build_audio(
    docs: DataFrame, segments: DataFrame, cache: DataFrame, fails: Callable[[Column], Column], reason: str, folder: str,
    other_fails: Callable[[Column], Column] | None = None, native: Column | None = None,
) -> Build:
    """Build the audio of all segments of `docs`.

    `segments(doc_id, position, segment_id, text, cache_key)` has dense positions per document; `cache(cache_key, status)`
    says what is ready. Only requests that are not ready are synthesised, each distinct one once, with over-long texts
    split ahead, attempts repeated on the other runtime, and failing texts split further, level by level. A request is lost
    when a part of it is exhausted; a document fails at its first lost segment. `native` marks segments that no model can
    build. Every level is written once under `folder`, on shared storage. A request that very many segments share is one
    row until the last join, whose other side is unique per request.
    """
    queue = segments.select("doc_id", "position", "segment_id", "cache_key", (native if native is not None else F.lit(False)).alias("native"))
    pending = synthesis.pending_segments(segments, cache).select(F.col("cache_key").alias("segment_id"), "text")
    events = written(synthesis.retry_rounds(pending, fails, reason, folder, other_fails=other_fails), f"{folder}/events")
    request = F.substring_index("segment_id", "::chunk_", 1).alias("cache_key")
    ends = events.groupBy(request).agg(F.bool_or(F.col("outcome") == "exhausted").alias("_lost"), F.bool_or(F.col("outcome") == "split").alias("_parts"))
    ready = cache.filter("status = 'ready'").select("cache_key", F.lit(True).alias("_ready"))
    known = queue.join(ready, "cache_key", "left").join(ends, "cache_key", "left")
    lost = F.coalesce("_lost", F.lit(False))
    source = F.when(F.col("_ready"), "cache").when(lost, "failed").when(F.coalesce("_parts", F.lit(False)), "regenerated").otherwise("built")
    known = written(known.select(*queue.columns, source.alias("source")), f"{folder}/queue")
    results = known.select("doc_id", "position", "segment_id", (F.col("source") != "failed").alias("ok"), F.lit(f"regen_exhausted: {reason}").alias("reason"), "native")
    return Build(synthesis.export_outcome(docs, results), events, known.drop("native"))
