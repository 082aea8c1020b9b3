"""Playback positions, anchors, resume cursors, session states and the degrade state machine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lectern import policies as P
from lectern.functions import text as T
from lectern.operators.scan import BLOCK, running
from lectern.schemas import CURSOR_DDL


def resume_position(docs: DataFrame, cursors: DataFrame) -> DataFrame:
    """Where to resume each document: `docs(fingerprint)` and `cursors(fingerprint, cursor)` with JSON cursor text.

    A missing or corrupt cursor starts at the beginning; negative values are clamped.
    """
    joined = docs.join(cursors.select("fingerprint", "cursor"), "fingerprint", "left").withColumn(
        "_c", F.from_json("cursor", CURSOR_DDL)
    )
    at = lambda name: F.greatest(F.coalesce(F.col(f"_c.{name}"), F.lit(0.0)), F.lit(0.0)).cast("int")
    return joined.select(
        *docs.columns, at("segmentIndex").alias("segment_index"), at("charOffset").alias("char_offset")
    )


def clamp_index(index: Column, count: Column) -> Column:
    return F.greatest(F.least(index, count - 1), F.lit(0))


def active_anchor(positions: DataFrame, anchors: DataFrame) -> DataFrame:
    """As-of lookup. `positions(doc_id, playback_idx, char_offset, floor_idx)` get `active_idx` and `anchor_offset`.

    The active anchor is the highest-numbered one of the same playback segment at or before the position, but never
    below the floor. It depends on the place alone, so distinct places are looked up: they are made distinct on the map
    side first, and a segment has no more of them than characters, however many listeners it has. Places and anchors are
    merged into one ordered stream and the highest anchor so far is carried along; no pair of rows is ever formed.
    """
    place = ["doc_id", "playback_idx", "char_offset"]
    marks = anchors.groupBy(*place).agg(F.max("anchor_idx").alias("_anchor")).withColumn("_asked", F.lit(False))
    asks = positions.select(*place).distinct().withColumn("_anchor", F.lit(None).cast(dict(anchors.dtypes)["anchor_idx"])).withColumn("_asked", F.lit(True))
    so_far = W.partitionBy("doc_id", "playback_idx").orderBy("char_offset", "_asked").rowsBetween(W.unboundedPreceding, 0)
    best = marks.unionByName(asks).withColumn("_best", F.max("_anchor").over(so_far)).filter("_asked").select(*place, "_best")
    asked = positions.join(best, place).withColumn("active_idx", F.greatest(F.col("floor_idx").cast("int"), F.col("_best")).cast("bigint"))
    at = anchors.select("doc_id", F.col("anchor_idx").cast("bigint").alias("active_idx"), F.col("playback_idx").alias("_p"), F.col("char_offset").alias("_o"))
    same = F.col("_p") == F.col("playback_idx")
    relative = F.when(same, F.greatest(F.col("char_offset") - F.col("_o"), F.lit(0))).otherwise(F.col("char_offset"))
    return asked.join(at, ["doc_id", "active_idx"], "left").select(
        *positions.columns, "active_idx", relative.alias("anchor_offset")
    )


def next_anchor(anchors: DataFrame, block: int = 4096) -> DataFrame:
    """For every anchor the first later one in a later playback segment; null means finished.

    Anchors follow the order of their playback segments, as the builder of anchors guarantees.
    """
    first = anchors.groupBy("doc_id", "playback_idx").agg(F.min("anchor_idx").alias("_first"))
    later = running(first, ["doc_id"], "playback_idx", {"next_idx": ("min", F.col("_first"))}, block, reverse=True, inclusive=False)
    return anchors.join(later.select("doc_id", "playback_idx", "next_idx"), ["doc_id", "playback_idx"]).select(
        *anchors.columns, "next_idx"
    )


def highlight(controllers: DataFrame, segments: DataFrame) -> DataFrame:
    """Clamped segment, offset and the share of the segment already read.

    `controllers(doc_id, segment_index, char_offset)`, `segments(doc_id, idx, segment_id, text)`.
    """
    counts = segments.groupBy("doc_id").agg(F.count(F.lit(1)).alias("_n"))
    placed = controllers.join(counts, "doc_id", "left").withColumn(
        "idx", clamp_index(F.col("segment_index"), F.greatest(F.coalesce("_n", F.lit(0)), F.lit(1))).cast("int")
    )
    read = segments.select("doc_id", F.col("idx").cast("int").alias("idx"), "segment_id", T.utf16_length("text").alias("_len"))
    offset = F.greatest(F.col("char_offset"), F.lit(0))
    ratio = F.when(F.col("_len") > 0, F.least(F.lit(1.0), offset / F.col("_len"))).otherwise(0.0)
    rest = [c for c in controllers.columns if c not in ("doc_id", "segment_index", "char_offset")]
    return placed.join(read, ["doc_id", "idx"], "left").select(
        "doc_id", *rest, F.col("idx").alias("segment_index"), "segment_id", offset.alias("char_offset"), ratio.alias("ratio")
    )


def session_states(commands: DataFrame, block: int = BLOCK) -> DataFrame:
    """Player state after every command: (state, segment_index, char_offset, error).

    `commands(session_id, seq, action, state, index, char_offset, error)` with actions SET_STATE, SET_INDEX,
    SET_CHAR_OFFSET, SET_ERROR, RESET_ERROR. Changing the index zeroes the offset; an error is also a state.
    """
    action = F.col("action")
    latest = lambda when, value: ("max", F.when(when, F.struct(F.col("seq").alias("seq"), value.alias("v"))))
    moved = running(
        commands,
        ["session_id"],
        "seq",
        {
            "_state": latest(action.isin("SET_STATE", "SET_ERROR"), F.when(action == "SET_ERROR", "error").otherwise(F.col("state"))),
            "_index": latest(action == "SET_INDEX", F.col("index")),
            "_offset": latest(
                action.isin("SET_INDEX", "SET_CHAR_OFFSET"), F.when(action == "SET_INDEX", F.lit(0)).otherwise(F.col("char_offset"))
            ),
            "_error": latest(action.isin("SET_ERROR", "RESET_ERROR"), F.when(action == "SET_ERROR", F.col("error"))),
        },
        block,
    )
    return moved.select(
        "session_id",
        "seq",
        "action",
        F.coalesce("_state.v", F.lit("idle")).alias("state"),
        F.coalesce("_index.v", F.lit(0)).alias("segment_index"),
        F.coalesce("_offset.v", F.lit(0)).alias("char_offset"),
        F.col("_error.v").alias("error"),
    )


def running_underruns(transitions: DataFrame, block: int = BLOCK) -> DataFrame:
    """Running underrun and transition counts and rate per session, reported at each underrun.

    `transitions(session_id, seq, is_underrun)`.
    """
    counted = running(
        transitions,
        ["session_id"],
        "seq",
        {
            "queue_underruns": ("sum", F.col("is_underrun").cast("bigint")),
            "queue_transitions": ("sum", F.lit(1).cast("bigint")),
        },
        block,
    )
    return counted.filter("is_underrun").withColumn(
        "underrun_rate", F.try_divide(F.col("queue_underruns"), F.col("queue_transitions"))
    )


def degrade_state(results: DataFrame, limit: int = P.WASM_FAILURE_LIMIT, block: int = BLOCK) -> DataFrame:
    """Failure counter and latch per session. `results(session_id, seq, outcome)`, outcome ok, wasm, other or reset.

    A wasm failure counts up, success clears the count, other failures leave it. At the limit the session latches to
    the system voice; only a reset clears the latch. Adds wasm_failures and degraded.

    One pass per block finds what the block does to an unknown incoming count; a scan over the block summaries gives
    the count and latch that enter each block; joining them back needs no further shuffle of the rows.
    """
    wasm = (F.col("outcome") == "wasm").cast("bigint")
    clear = F.col("outcome").isin("ok", "reset")
    keys = ["session_id", "_block"]
    upto = W.partitionBy(*keys).orderBy("seq").rowsBetween(W.unboundedPreceding, 0)
    local = (
        results.withColumn("_block", F.floor(F.col("seq") / F.lit(block)).cast("bigint"))
        .withColumn("_cw", F.sum(wasm).over(upto))
        .withColumn("_clears", F.count_if(clear).over(upto))
        .withColumn("_base", F.max(F.when(clear, F.col("_cw"))).over(upto))
    )
    own = F.col("_cw") - F.col("_base")
    summary = local.groupBy(*keys).agg(
        F.max("_cw").alias("_total"),
        F.max("_base").alias("_last_base"),
        F.max(F.when(F.col("_clears") == 0, F.col("_cw"))).alias("_lead"),
        F.max(F.when(F.col("_clears") == 0, F.col("seq"))).alias("_lead_end"),
        F.max(F.when((F.col("_clears") > 0) & (own >= limit), F.col("seq"))).alias("_own_hit"),
        F.max(F.when(F.col("outcome") == "reset", F.col("seq"))).alias("_reset"),
    )
    past = W.partitionBy("session_id").orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    entering = (
        summary.withColumn("_before", F.coalesce(F.sum("_total").over(past), F.lit(0)))
        .withColumn("_cleared", F.coalesce(F.max(F.col("_before") + F.col("_last_base")).over(past), F.lit(0)))
        .withColumn("_in", F.col("_before") - F.col("_cleared"))
        .withColumn("_hit", F.coalesce("_own_hit", F.when(F.col("_in") + F.col("_lead") >= limit, F.col("_lead_end"))))
        .withColumn("_hit_in", F.max("_hit").over(past))
        .withColumn("_reset_in", F.max("_reset").over(past))
        .select(*keys, "_in", "_hit_in", "_reset_in")
    )
    joined = local.join(entering, keys).withColumn(
        "_raw", F.when(F.col("_clears") > 0, own).otherwise(F.col("_in") + F.col("_cw"))
    )
    hit = F.max(F.when(F.col("_raw") >= limit, F.col("seq"))).over(upto)
    reset = F.max(F.when(F.col("outcome") == "reset", F.col("seq"))).over(upto)
    done = joined.withColumn("_h", F.coalesce(hit, "_hit_in")).withColumn("_r", F.coalesce(reset, "_reset_in"))
    latched = F.col("_h").isNotNull() & (F.col("_r").isNull() | (F.col("_h") > F.col("_r")))
    return done.withColumn("degraded", latched).select(
        *results.columns,
        F.when(F.col("degraded"), F.lit(limit).cast("bigint")).otherwise(F.col("_raw")).alias("wasm_failures"),
        "degraded",
    )


# Voice identifiers that were renamed, the preferred default, and what a system voice looks like.
RENAMED_VOICES = {"Alloy": "af_alloy", "alloy": "af_alloy"}
NEURAL, SYSTEM = "kokoro", "web-speech"
PREFERRED_VOICE = "af_alloy"
SYSTEM_VOICE = r"(?i)\A(?:urn:[\w-]+:|com\.[\w.-]+|Microsoft\s|Google\s|Alex\z|Samantha\z)"
PRECISIONS = ("fp32", "fp16", "q8", "q4", "q4f16")


def renamed_voice(voice: Column) -> Column:
    out = voice
    for old, new in RENAMED_VOICES.items():
        out = F.when(voice == old, new).otherwise(out)
    return out


def default_voices(voices: DataFrame) -> DataFrame:
    """One row per provider: its first voice, or the preferred one of the neural provider when it is listed."""
    preferred = (F.col("provider") == NEURAL) & (F.col("id") == PREFERRED_VOICE)
    rank = F.struct((~preferred).alias("a"), F.col("ord").alias("b"))
    return voices.groupBy("provider").agg(F.min_by(F.struct("id", "name"), rank).alias("_d"))


def resolve_voice(prefs: DataFrame, voices: DataFrame) -> DataFrame:
    """Adds `resolved_voice` and `warning`. `prefs(provider, voice)`, `voices(provider, id, name, ord)`."""
    wanted = prefs.withColumn("_want", F.when(F.col("provider") == NEURAL, renamed_voice(F.col("voice"))).otherwise(F.col("voice")))
    listed = voices.select("provider", F.col("id").alias("_want"), F.lit(True).alias("_known")).distinct()
    joined = wanted.join(listed, ["provider", "_want"], "left").join(
        default_voices(voices), "provider", "left"
    )
    fallback = F.concat(F.lit(' for '), "provider", F.lit('; switched to "'), F.col("_d.name"), F.lit('".'))
    spoken = F.coalesce(F.nullif("voice", F.lit("")))
    warning = (
        F.when(F.col("_known"), None)
        .when(F.col("_d").isNull(), "No voices were returned by the active provider.")
        .when(spoken.isNotNull(), F.concat(F.lit('Selected voice "'), "voice", F.lit('" is unavailable'), fallback))
        .otherwise(F.concat(F.lit("No voice selected"), fallback))
    )
    return joined.select(
        *prefs.columns,
        F.when(F.col("_known"), F.col("_want")).otherwise(F.col("_d.id")).alias("resolved_voice"),
        warning.alias("warning"),
    )


def migrate_preferences(prefs: DataFrame, system_voices: DataFrame, neural_active: bool = True) -> DataFrame:
    """Stored preferences checked and brought up to date: `prefs(preferences, precision)` with JSON text.

    Adds provider, voice, rate, valid, changed, voice_migrated and precision_setting. Invalid rows stay, with nulls.
    """
    doc = F.try_parse_json("preferences")
    kind = lambda path: F.schema_of_variant(F.try_variant_get(doc, path, "variant"))
    valid = F.coalesce(
        (kind("$.voice") == "STRING") & (kind("$.provider") == "STRING") & kind("$.rate").rlike(r"\A(?:BIGINT|DOUBLE|DECIMAL)"),
        F.lit(False),
    )
    parsed = prefs.withColumn("valid", valid).select(
        "*",
        *[F.when(F.col("valid"), F.try_variant_get(doc, f"$.{n}", t)).alias(f"_{n}") for n, t in (("voice", "string"), ("rate", "double"), ("provider", "string"))],
    )
    known = F.col("_provider").isin(NEURAL, SYSTEM)
    provider = F.when(known, F.col("_provider")).otherwise(NEURAL if neural_active else SYSTEM)
    legacy = ~known & (provider == NEURAL) & F.col("_voice").rlike(SYSTEM_VOICE)
    moved = parsed.withColumn("provider", F.when(F.col("valid"), provider)).withColumn(
        "_moved", renamed_voice(F.when(legacy, "").otherwise(F.col("_voice")))
    )
    listed = system_voices.select(F.col("id").alias("_moved"), F.lit(True).alias("_listed")).distinct()
    first = system_voices.agg(F.min_by("id", "ord").alias("first")).scalar()
    matched = moved.join(listed, "_moved", "left")
    voice = F.when((F.col("provider") == SYSTEM) & F.col("_listed").isNull(), F.coalesce(first, F.col("_moved"))).otherwise(F.col("_moved"))
    stored = F.col("precision")
    precision = (
        F.when(stored.isNull() | stored.isin("", "auto"), "fp32").when(stored.isin(*PRECISIONS), stored).otherwise("auto")
    )
    final = matched.withColumn("voice", voice)
    differs = (F.col("voice") != F.col("_voice")) | (F.col("provider") != F.col("_provider"))
    return final.select(
        *prefs.columns,
        "provider",
        "voice",
        F.col("_rate").alias("rate"),
        "valid",
        F.coalesce(differs, F.lit(False)).alias("changed"),
        F.coalesce(F.col("voice") != F.col("_voice"), F.lit(False)).alias("voice_migrated"),
        precision.alias("precision_setting"),
    )


# Why a device runs in CPU mode.
UNSTABLE_NOTE = "WebGPU was previously marked unstable in this browser profile, so Kokoro was started in CPU mode."
NO_ADAPTER_NOTE = "WebGPU adapter is unavailable on this device/browser, so Kokoro is using CPU mode."


def select_runtime(devices: DataFrame, unstable: DataFrame) -> DataFrame:
    """Decision table per device: requested device, why the GPU is avoided, whether neural speech is used.

    `devices(profile_key, adapter_available, memory_gb, preferred_device, allow_unstable, minimum_gb)`; a null minimum
    means the default. `unstable(profile_key)` has one row per profile.
    """
    joined = devices.join(unstable.select("profile_key", F.lit(True).alias("_bad")), "profile_key", "left")
    floor_gb = F.coalesce("minimum_gb", F.lit(P.MIN_DEVICE_MEMORY_GB))
    enough = F.coalesce(F.col("memory_gb") >= floor_gb, F.lit(True))
    avoid = F.coalesce("_bad", F.lit(False)) & ~F.coalesce("allow_unstable", F.lit(False))
    adapter = F.col("adapter_available")
    device = F.coalesce("preferred_device", F.when(adapter & ~avoid, "webgpu").otherwise("wasm"))
    shown = T.number_text(floor_gb)
    reason = (
        F.when(device != "wasm", None)
        .when(avoid, "unstable_profile")
        .when(~adapter, "adapter_unavailable")
        .when(~enough, "memory_gate")
    )
    note = (
        F.when(device != "wasm", None)
        .when(avoid, UNSTABLE_NOTE)
        .when(~adapter, NO_ADAPTER_NOTE)
        .when(~enough, F.concat(F.lit("Device memory is below "), shown, F.lit("GB, so Kokoro is using CPU mode.")))
    )
    neural = enough & ((device == "wasm") | adapter)
    fallback = F.when(~enough, F.concat(F.lit("Insufficient device memory for Kokoro. Required "), shown, F.lit("GB."))).otherwise(
        "WebGPU adapter unavailable for requested device."
    )
    return joined.select(
        *devices.columns,
        device.alias("requested_device"),
        reason.alias("avoidance_reason"),
        note.alias("runtime_reason"),
        neural.alias("use_neural"),
        F.when(~neural, fallback).alias("fallback_message"),
    )


def unstable_profiles(events: DataFrame) -> DataFrame:
    """Latest mark per device profile: `events(profile_key, seq, action, reason, marked_at)`, action mark or clear.

    Malformed marks (no reason or time) are ignored; a clear removes the profile until it is marked again.
    """
    usable = events.filter(
        (F.col("action") == "clear") | ((F.col("action") == "mark") & F.col("reason").isNotNull() & F.col("marked_at").isNotNull())
    )
    last = usable.groupBy("profile_key").agg(F.max(F.struct("seq", "action", "reason", "marked_at")).alias("l"))
    return last.filter("l.action = 'mark'").select(
        "profile_key", F.col("l.reason").alias("reason"), F.col("l.marked_at").alias("marked_at")
    )


def missing_artifacts(usage: DataFrame, manifest: DataFrame) -> DataFrame:
    """Artifact ids in use that the licence manifest does not declare."""
    return usage.select("id").distinct().join(manifest.select("id"), "id", "left_anti")


REQUIRED_FIELDS = ("id", "packageOrModelName", "versionOrHash", "license", "sourceUrl")


def incomplete_artifacts(manifest: DataFrame) -> DataFrame:
    """Manifest entries with a blank required field, and which fields they lack."""
    blank = F.filter(
        F.array(*[F.when(T.js_trim(F.coalesce(c, F.lit(""))) == "", F.lit(c)) for c in REQUIRED_FIELDS]), lambda f: f.isNotNull()
    )
    return manifest.withColumn("missing_fields", blank).filter(F.size("missing_fields") > 0)


def manifest_check(usage: DataFrame, manifest: DataFrame) -> DataFrame:
    """One row: how many artifacts are used, missing or incomplete, and whether the check passes."""
    used = usage.select("id").distinct().select(F.lit(1).alias("used"), F.lit(0).alias("missing"), F.lit(0).alias("incomplete"))
    missing = missing_artifacts(usage, manifest).select(F.lit(0).alias("used"), F.lit(1).alias("missing"), F.lit(0).alias("incomplete"))
    broken = incomplete_artifacts(manifest).select(F.lit(0).alias("used"), F.lit(0).alias("missing"), F.lit(1).alias("incomplete"))
    row = used.unionByName(missing).unionByName(broken).agg(
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("used", "missing", "incomplete")]
    )
    return row.withColumn("passed", (F.col("used") > 0) & (F.col("missing") == 0) & (F.col("incomplete") == 0))
