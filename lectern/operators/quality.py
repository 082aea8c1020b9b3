"""Checks of synthesis results: playable audio, suspicious output, short completions, encoder failures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern import policies as P
from lectern.functions import numbers as N
from lectern.functions import text as T

# Accepted audio types and the container signature.
WAV_TYPES = ("audio/wav", "audio/wave", "audio/x-wav")
RIFF, WAVE = "52494646", "57415645"


def _fixed3(value: Column) -> Column:
    return F.format_string("%.3f", value)


def probe_audio(results: DataFrame) -> DataFrame:
    """Adds `error`: null for playable audio and for results that carry none.

    Reads text, rate, n_bytes (null for spoken-only results) and duration_s (null when nothing could be decoded).
    """
    floor_s = N.min_duration_s(F.col("text"), F.col("rate"))
    duration = F.col("duration_s")
    bad = duration.isNotNull() & (~N.is_finite(duration) | (duration < floor_s))
    shown = F.when(N.is_finite(duration), _fixed3(duration)).otherwise("NaN")
    message = F.concat(
        F.lit("Audio decode probe failed: duration_too_short decoded="), shown, F.lit("s expected_min="), _fixed3(floor_s), F.lit("s.")
    )
    return results.withColumn(
        "error", F.when(F.col("n_bytes") == 0, "Audio decode probe failed: empty blob.").when(F.col("n_bytes").isNotNull() & bad, message)
    )


def playable_mime(mime: Column) -> Column:
    """Aliases, blank and generic types all count as WAV; other types stay as they are."""
    normal = F.lower(T.js_trim(F.coalesce(mime, F.lit(""))))
    return F.when(normal.isin("", "application/octet-stream", *WAV_TYPES), "audio/wav").otherwise(F.lower(mime))


def validate_synth_output(outputs: DataFrame) -> DataFrame:
    """Adds `verdict`: null when good, else the first failing check.

    Reads n_bytes, mime, header (at least 12 bytes; null counts as corrupt), duration_s, n_samples and rms, and
    optionally decode_failed, which tells that a decoder was there but could not read the audio. A null duration without
    it means that nothing could decode the audio here, which skips the last three checks.
    """
    failed = F.coalesce(F.col("decode_failed"), F.lit(False)) if "decode_failed" in outputs.columns else F.lit(False)
    mime = playable_mime(F.col("mime"))
    head = F.lower(F.hex(F.substring(F.col("header"), 1, 4)))
    tag = F.lower(F.hex(F.substring(F.col("header"), 9, 4)))
    duration, rms = F.col("duration_s"), F.col("rms")
    decoded = duration.isNotNull()
    verdict = (
        F.when(F.col("n_bytes") == 0, "empty_audio")
        .when(F.col("n_bytes") < P.MIN_AUDIO_BYTES, F.concat(F.lit("suspicious_size_"), F.col("n_bytes").cast("string")))
        .when(~F.lower(T.js_trim(mime)).isin(*WAV_TYPES), F.concat(F.lit("unsupported_mime_type_"), mime))
        .when(F.coalesce((head != RIFF) | (tag != WAVE), F.lit(True)), "obvious_corruption_signal")
        .when(failed, "decode_error")
        .when(decoded & (~N.is_finite(duration) | (duration < P.MIN_AUDIO_SECONDS)), "suspicious_duration")
        .when(decoded & (F.col("n_samples") == 0), "empty_decoded_audio")
        .when(decoded & (~N.is_finite(rms) | (rms < P.MIN_RMS)), "near_silent_audio")
    )
    return outputs.withColumn("verdict", verdict)


def flag_short_completion(playbacks: DataFrame) -> DataFrame:
    """Adds `short_completion` and `error`: audio that ended far too early for its text."""
    raw = F.col("duration_s")
    duration = F.when(N.is_finite(raw), raw).otherwise(0.0)
    ratio = F.when(duration > 0, F.try_divide(F.col("played_s"), duration)).otherwise(0.0)
    floor_s = N.min_duration_s(F.col("text"), F.col("rate"))
    short = (duration > 0) & (duration < floor_s) & (ratio < P.MIN_COMPLETION_RATIO)
    message = F.concat(
        F.lit("Audio playback failed: duration_too_short decoded="), _fixed3(duration), F.lit("s expected_min="), _fixed3(floor_s), F.lit("s.")
    )
    return playbacks.withColumn("short_completion", short).withColumn("error", F.when(short, message))


def failure_reason(message: Column) -> Column:
    return (
        F.when(F.contains(message, F.lit("duration_too_short")), "duration_too_short")
        .when(F.contains(message, F.lit("regen_exhausted")), "regen_exhausted")
        .otherwise(message)
    )


def is_wasm_failure(message: Column, runtime: Column) -> Column:
    lowered = F.lower(message)
    return F.contains(lowered, F.lit("wasm")) | F.contains(lowered, F.lit("webassembly")) | F.contains(F.lower(runtime), F.lit("wasm"))


# Fixed value: shown when a requested MP3 could not be made.
MP3_WARNING = "MP3 unavailable in this runtime; WAV provided instead."


def pick_audio_bundle(exports: DataFrame) -> DataFrame:
    """Adds `bundle` and `warning`. Reads format, mp3_ok, code, detail, diagnosis and failure."""
    wants = F.col("format") == "mp3"
    detail = F.coalesce("detail", "diagnosis")
    because = (
        F.when(F.col("code").isNotNull(), F.concat("code", F.lit(": "), detail))
        .otherwise(F.coalesce("failure", F.lit("init_failed")))
    )
    return exports.withColumn("bundle", F.when(wants & F.col("mp3_ok"), "mp3").otherwise("wav")).withColumn(
        "warning", F.when(wants & ~F.col("mp3_ok"), F.concat(F.lit(f"{MP3_WARNING} ("), because, F.lit(")")))
    )


def classify_encode_failure(failures: DataFrame) -> DataFrame:
    """Adds `reason`. Reads encoder (native or fallback), stage (init or encode) and message (null: no output bytes)."""
    message = F.coalesce("message", F.lit(""))
    native = F.col("encoder") == "native"
    unloadable = [F.contains(message, F.lit(word)) for word in ("load", "Worker", "SharedArrayBuffer")]
    reason = (
        F.when(native & (F.col("stage") == "init") & F.contains(message, F.lit("MPEGMode is not defined")), "unsupported_runtime")
        .when(native & (F.col("stage") == "init"), "init_failed")
        .when(native, "encode_failed")
        .when(unloadable[0] | unloadable[1] | unloadable[2], "unsupported_runtime")
        .otherwise("encode_failed")
    )
    return failures.withColumn("reason", reason)
