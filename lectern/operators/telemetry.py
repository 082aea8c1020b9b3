"""Telemetry classification and metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lectern import policies as P
from lectern.functions import text as T
from lectern.operators.quantiles import exact_percentiles

# Words that decide the class of a failure. The short runtime name also matches inside other words.
WARNING_WORDS = r"(?i)(webgpu|ort|onnxruntime|runtime downgrade|fallback to wasm|switched to wasm)"
FATAL_WORDS = r"(?i)(audio playback failed:|empty blob|decode(?:\s|_|-)error|decode probe failed)"


def debug_category(kind: Column, reason: Column) -> Column:
    """runtime-warning, fatal-playback-blocker, or null."""
    failure = kind == "tts.synth_failure"
    return (
        F.when(kind == "tts.runtime_downgrade", "runtime-warning")
        .when(failure & reason.rlike(FATAL_WORDS), "fatal-playback-blocker")
        .when(failure & reason.rlike(WARNING_WORDS), "runtime-warning")
    )


def classify_perf_event(events: DataFrame) -> DataFrame:
    """Adds category, severity and message; null for events nobody needs to see."""
    return (
        events.withColumn("category", debug_category(F.col("type"), F.col("reason")))
        .withColumn("severity", F.when(F.col("category") == "runtime-warning", "info").when(F.col("category").isNotNull(), "error"))
        .withColumn("message", F.when(F.col("category").isNotNull(), F.col("reason")))
    )


# Failure patterns and the advice given with each code.
FETCH_WORDS = r"(?i)failed to fetch|network|model|\b(url|uri)\b|http\s*(error|status|404|403|500)"
GPU_WORDS = r"(?i)navigator\.gpu|webgpu|adapter|requestadapter"
ONE_TOKEN_REPO = r"(?i)huggingface\.co/([^/?#\s]+)/(?:resolve|blob|raw|tree)/"
UNRESOLVED_MODULE = "Failed to resolve module specifier 'kokoro-js'"
UNKNOWN_FAILURE = "Unknown Kokoro failure."
HINTS = {
    "KOKORO_MODULE_RESOLUTION_FAILED": (
        "Verify `kokoro-js` is present in `dependencies`.",
        "Confirm build target supports ESM module resolution.",
        "Ensure import path is not transformed incorrectly by bundler.",
        "Check dynamic import chunk is emitted and served from correct `base` path on GitHub Pages.",
    ),
    "KOKORO_MODEL_ID_INVALID": (
        'Use a repo id in the form "owner/name", for example "onnx-community/Kokoro-82M-ONNX".',
    ),
    "KOKORO_MODEL_FETCH_FAILED": ("Check network connectivity and verify the Kokoro model URL is reachable.",),
    "WEBGPU_UNAVAILABLE": ("Use wasm fallback or run in a browser/device with WebGPU support.",),
}
MODULE_REASON = "Could not resolve the kokoro-js module during provider initialization."
MODULE_HINT = "Verify kokoro-js is installed/bundled and dynamic import path works on GitHub Pages base URL."


def classify_failure(failures: DataFrame) -> DataFrame:
    """Adds `code`, `failure_message` and `hints`; the first matching rule wins.

    Reads message, and optionally has_gpu, adapter_available, minimum_gb and memory_gb.
    """
    known = set(failures.columns)
    context = lambda name, kind: F.col(name) if name in known else F.lit(None).cast(kind)
    raw = F.coalesce(F.nullif("message", F.lit("")), F.lit(UNKNOWN_FAILURE))
    token = F.regexp_extract(raw, ONE_TOKEN_REPO, 1)
    rewritten = F.concat(F.lit("KOKORO_MODEL_ID_INVALID: Expected model repo id like owner/name, got '"), token, F.lit("'."))
    staged = failures.withColumn("failure_message", F.when(token != "", rewritten).otherwise(raw))
    message = F.col("failure_message")
    no_gpu = (F.coalesce(context("has_gpu", "boolean"), F.lit(True)) == F.lit(False)) | (
        F.coalesce(context("adapter_available", "boolean"), F.lit(True)) == F.lit(False)
    )
    minimum, memory = context("minimum_gb", "double"), context("memory_gb", "double")
    code = (
        F.when(F.contains(message, F.lit(UNRESOLVED_MODULE)), "KOKORO_MODULE_RESOLUTION_FAILED")
        .when(F.contains(message, F.lit("KOKORO_MODEL_ID_INVALID")), "KOKORO_MODEL_ID_INVALID")
        .when(message.rlike(FETCH_WORDS), "KOKORO_MODEL_FETCH_FAILED")
        .when(no_gpu | message.rlike(GPU_WORDS), "WEBGPU_UNAVAILABLE")
        .when(F.coalesce(memory < minimum, F.lit(False)), "DEVICE_MEMORY_TOO_LOW")
        .when(message != UNKNOWN_FAILURE, "KOKORO_WARMUP_FAILED")
        .otherwise("UNKNOWN")
    )
    coded = staged.withColumn("code", code)
    hints = F.lit(None).cast("array<string>")
    for name, lines in HINTS.items():
        hints = F.when(F.col("code") == name, F.array(*[F.lit(line) for line in lines])).otherwise(hints)
    memory_hint = F.array(F.concat(F.lit("Requires >= "), T.number_text(minimum), F.lit("GB device memory.")))
    return coded.withColumn("hints", F.when(F.col("code") == "DEVICE_MEMORY_TOO_LOW", memory_hint).otherwise(hints))


CONFIGURATION_CODES = ("KOKORO_MODULE_RESOLUTION_FAILED", "KOKORO_MODEL_ID_INVALID", "KOKORO_MODEL_FETCH_FAILED")


def fallback_bucket(fallbacks: DataFrame) -> DataFrame:
    """Adds bucket, shown_reason and shown_hint. Reads code (null: no error), failure_message, hints and intentional."""
    code = F.col("code")
    module = code == "KOKORO_MODULE_RESOLUTION_FAILED"
    return (
        fallbacks.withColumn(
            "bucket",
            F.when(F.col("intentional"), "Intentional mode").when(code.isin(*CONFIGURATION_CODES), "Configuration").otherwise("Capability"),
        )
        .withColumn("shown_reason", F.when(module, MODULE_REASON).otherwise(F.col("failure_message")))
        .withColumn("shown_hint", F.when(module, MODULE_HINT).otherwise(F.get("hints", F.lit(0))))
    )


def telemetry_counters(events: DataFrame, *keys: str) -> DataFrame:
    """Failure and fallback counts, per key when keys are given."""
    return events.groupBy(*keys).agg(
        F.count_if(F.col("type") == "tts.synth_failure").alias("synth_failures"),
        F.count_if(F.col("type") == "tts.degraded_mode").alias("fallback_activations"),
    )


def first_audio(events: DataFrame) -> DataFrame:
    """The first first-audio event of each session."""
    return (
        events.filter("type = 'tts.first_audio'")
        .groupBy("session_id")
        .agg(F.min(F.struct("seq", "duration_ms", "segment_id")).alias("f"))
        .select("session_id", F.col("f.seq").alias("seq"), F.col("f.duration_ms").alias("duration_ms"), F.col("f.segment_id").alias("segment_id"))
    )


# Budgets. All comparisons are strict; a metric without a limit for a statistic has none.
BUDGETS = {  # metric: (event type, p50 limit, p95 limit)
    "first_audio_ms": ("tts.first_audio", None, 2500.0),
    "segment_synth_ms": ("tts.segment_synth", 700.0, 1500.0),
    "model_load_ms": ("tts.model_load", None, 4000.0),
}
PEAK_MEMORY_LIMIT_MB = 1.2 * 1024
UNDERRUN_LIMIT = 0.01


def _limit(metric: Column, at: int) -> Column:
    out = F.lit(None).cast("double")
    for name, row in BUDGETS.items():
        if row[at] is not None:
            out = F.when(metric == name, F.lit(row[at])).otherwise(out)
    return out


def metric_values(events: DataFrame, *more: Column) -> DataFrame:
    """(metric, value) rows of the timed events, with `more` columns."""
    metric = F.lit(None).cast("string")
    for name, (kind, _, _) in BUDGETS.items():
        metric = F.when(F.col("type") == kind, name).otherwise(metric)
    kinds = [kind for kind, _, _ in BUDGETS.values()]
    return events.filter(F.col("type").isin(*kinds)).select(metric.alias("metric"), F.col("duration_ms").alias("value"), *more)


def latency_budget(events: DataFrame) -> DataFrame:
    """Exact p50 and p95 per metric against the budgets: (metric, n, p50, p95, within_budget)."""
    found = exact_percentiles(metric_values(events), "metric", "value", {"p50": 0.5, "p95": 0.95}, few_groups=True)
    holds = lambda name, at: F.coalesce(F.col(name) < _limit(F.col("metric"), at), F.lit(True))
    return found.withColumn("within_budget", holds("p50", 1) & holds("p95", 2))


SKETCH_K = 400  # of a sketch; its rank error is about 0.7 % then
RANK_ERROR = 0.02  # that no percentile of a merged sketch should pass


def latency_sketches(events: DataFrame, every: str = "hour") -> DataFrame:
    """(metric, starts, n, sketch) per metric and unit of time: some kilobytes each, whatever the number of events.

    Sketches merge, so stored hours give days and weeks without reading events again (`rolled_up`).
    """
    kind = F.lit(None).cast("string")
    for name, (event, _, _) in BUDGETS.items():
        kind = F.when(F.col("type") == event, name).otherwise(kind)
    timed = events.select(kind.alias("metric"), F.date_trunc(every, "event_ts").alias("starts"), F.col("duration_ms").cast("double").alias("value"))
    timed = timed.filter("metric is not null and value is not null")
    return timed.groupBy("metric", "starts").agg(F.count(F.lit(1)).alias("n"), F.kll_sketch_agg_double("value", SKETCH_K).alias("sketch"))


def rolled_up(sketches: DataFrame, every: str = "day") -> DataFrame:
    """Stored sketches merged per metric and longer unit of time."""
    starts = F.date_trunc(every, "starts").alias("starts")
    return sketches.groupBy("metric", starts).agg(F.sum("n").alias("n"), F.kll_merge_agg_double("sketch").alias("sketch"))


def sketched_budget(sketches: DataFrame) -> DataFrame:
    """p50 and p95 of each sketch against the budgets: (metric, starts, n, p50, p95, within_budget). Ranks are off by
    RANK_ERROR at most; `latency_budget` is exact."""
    at = lambda p: F.kll_sketch_get_quantile_double("sketch", F.lit(p))
    found = sketches.select("metric", "starts", "n", at(0.5).alias("p50"), at(0.95).alias("p95"))
    holds = lambda name, place: F.coalesce(F.col(name) < _limit(F.col("metric"), place), F.lit(True))
    return found.withColumn("within_budget", holds("p50", 1) & holds("p95", 2))


def memory_budget(events: DataFrame) -> DataFrame:
    """Peak memory against its budget: pass, fail, or informational when no event reported memory."""
    peak = events.filter("type = 'tts.model_load'").agg(
        F.count(F.lit(1)).alias("n_loads"), F.count("peak_memory_mb").alias("n_reported"), F.max("peak_memory_mb").alias("peak_mb")
    )
    verdict = F.when(F.col("peak_mb").isNull(), "informational").when(F.col("peak_mb") < PEAK_MEMORY_LIMIT_MB, "pass").otherwise("fail")
    return peak.withColumn("verdict", verdict)


def underrun_rate(transitions: DataFrame, *keys: str) -> DataFrame:
    """Underruns over transitions; null when there were none. Rows are transitions with `is_underrun`."""
    counted = transitions.groupBy(*keys).agg(
        F.count_if("is_underrun").alias("underruns"), F.count(F.lit(1)).alias("transitions")
    )
    rate = F.try_divide(F.col("underruns"), F.col("transitions"))
    return counted.withColumn("underrun_rate", rate).withColumn("within_budget", rate < UNDERRUN_LIMIT)


def degraded_transitions(events: DataFrame) -> DataFrame:
    """Counts by (from, to, code) and each one's share of all degraded-mode events."""
    counted = (
        events.filter("type = 'tts.degraded_mode'")
        .groupBy("provider_from", "provider_to", "fallback_code")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    return counted.withColumn("share", F.col("n") / counted.agg(F.sum("n")).scalar())


def retry_summary(events: DataFrame) -> DataFrame:
    """Retries, regenerations and validation codes per segment."""
    kind, code = F.col("type"), F.col("code")
    validation = lambda name: F.count_if((kind == "tts.validation_code") & (code == name)).alias(name)
    return (
        events.filter(kind.isin("tts.segment_retry", "tts.segment_regenerated", "tts.validation_code"))
        .groupBy("segment_id")
        .agg(
            F.count_if(kind == "tts.segment_retry").alias("retries"),
            F.count_if(kind == "tts.segment_regenerated").alias("regenerations"),
            validation("duration_too_short"),
            validation("regen_success"),
            validation("regen_exhausted"),
        )
    )


def recent_entries(classified: DataFrame, keep: int = P.RECENT_ENTRIES) -> DataFrame:
    """The last entries per session and category, newest first.

    The planner drops all but `keep` rows per group on the map side already, so a hot session costs no more than others.
    """
    newest = W.partitionBy("session_id", "category").orderBy(F.col("seq").desc())
    return (
        classified.filter("category is not null")
        .withColumn("rank", F.row_number().over(newest))
        .filter(F.col("rank") <= keep)
    )
