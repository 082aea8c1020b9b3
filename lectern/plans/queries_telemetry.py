"""Queries over telemetry events."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.operators import playback, telemetry
from lectern.plans.inputs import cte, derive, sql
from lectern.plans.registry import query
from lectern.session import work_folder
from lectern.sources import readers

TEL = f"with {cte('telemetry')}"
_CATEGORY = (
    "case when type = 'tts.runtime_downgrade' then 'runtime-warning' when type <> 'tts.synth_failure' then null "
    "when regexp_matches(reason, '(?i)(audio playback failed:|empty blob|decode(?:\\s|_|-)error|decode probe failed)') then 'fatal-playback-blocker' "
    "when regexp_matches(reason, '(?i)(webgpu|ort|onnxruntime|runtime downgrade|fallback to wasm|switched to wasm)') then 'runtime-warning' end"
)


@query("s6_read_telemetry", f"{TEL} select session_id, seq, event_ts, type, segment_id, duration_ms, reason, is_underrun from telemetry")
def _(spark, d):
    folder = work_folder(spark, "telemetry")
    derive(spark, d, "telemetry").write.option("timestampNTZFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").json(folder)
    kept = "session_id", "seq", F.col("event_ts").cast("timestamp_ntz").alias("event_ts"), "type", "segment_id", "duration_ms", "reason", "is_underrun"
    return readers.read_telemetry(spark, folder).select(*kept)


# Lines as they arrive: every tenth is cut off, every tenth has a text for a number, and some lack a field.
_USER, _SEQ = "cast(user_id as varchar(20))", "cast(event_id as varchar(20))"


def _object(*fields: str, end: str = "chr(125)") -> str:
    """SQL of a JSON object; braces are spelt by number, as both engines' texts pass through a formatter."""
    return f"concat(chr(123), {", ',', ".join(fields)}, {end})"


def _field(name: str, value: str) -> str:
    return f"concat('\"{name}\":', {value})"


_ID, _NO = _field("session_id", _USER), _field("seq", _SEQ)
_LINES = (
    f"select event_id, case event_id % 10 when 3 then {_object(_ID, _NO, end="',\"type\":\"tts.mod'")}"
    f" when 4 then {_object(_ID, _field("duration_ms", "'\"fast\"'"), _field("type", "'\"tts.model_load\"'"))}"
    f" when 5 then concat('[', {_SEQ}, ']') when 6 then {_object(_NO, _field("type", "'\"tts.model_load\"'"))}"
    f" when 7 then {_object(_ID, _NO, _field("type", "'\" \"'"))}"
    f" when 8 then {_object(_ID, _NO, _field("type", "'\"tts.new_kind\"'"), _field("extra", _object(_field("a", _SEQ))))}"
    f" else {_object(_ID, _NO, _field("type", "'\"tts.segment_synth\"'"), _field("duration_ms", "cast(event_id % 977 as varchar(20))"))} end as line from {{events}}"
)
_JUDGED = f"""with l as ({_LINES.replace('{events}', 'events')}), e as (select * from l join events using (event_id))
select line, case event_id % 10 when 3 then 'malformed' when 4 then 'malformed' when 5 then 'malformed' when 6 then 'no_session' when 7 then 'no_type' end as reject_reason, case when event_id % 10 not in (3, 4, 5, 6, 7) then user_id end as session_id,
case when event_id % 10 not in (3, 4, 5, 6, 7) then event_id end as seq, case event_id % 10 when 3 then null when 4 then null when 5 then null when 6 then null when 7 then null when 8 then 'tts.new_kind' else 'tts.segment_synth' end as type,
case when event_id % 10 in (0, 1, 2, 9) then (event_id % 977)::double end as duration_ms, case when event_id % 10 = 8 then event_id end as extra from e"""


def _written_lines(spark, d):
    folder = work_folder(spark, "lines")
    sql(spark, d, _LINES).select("line").write.text(folder)
    return folder


def _one_table(rejects, events):
    extra = F.try_variant_get("payload", "$.extra.a", "bigint").alias("extra")
    fields = ("session_id", "seq", "type", "duration_ms")
    good = events.select(F.lit(None).cast("string").alias("line"), F.lit(None).cast("string").alias("reject_reason"), *fields, extra)
    bad = rejects.select("line", "reject_reason", *[F.lit(None).cast(good.schema[c].dataType).alias(c) for c in (*fields, "extra")])
    return good.unionByName(bad)


_SPLIT = f"select case when reject_reason is not null then line end as line, * exclude (line) from ({_JUDGED})"


@query("s6_rejected_events", _SPLIT)
def _(spark, d):
    """Good events and rejects of lines of which half are broken; unknown kinds keep their payload."""
    judged = readers.judge_events(readers.read_lines(spark, _written_lines(spark, d)))
    return _one_table(readers.rejected_events(judged), readers.accepted_events(judged))


@query("s6_stream_events", _SPLIT)
def _(spark, d):
    """The same lines as a stream into two tables."""
    from lectern.streaming import live

    out, mark = work_folder(spark, "events"), work_folder(spark, "mark")
    live.events_to(readers.read_lines(spark, _written_lines(spark, d), streaming=True), out, mark).awaitTermination()
    return _one_table(live.ingested(spark, out, "rejects", "events"), live.ingested(spark, out, "events", "events"))


@query(
    "f10_classify_perf_event",
    f"{TEL}, c as (select seq, reason, {_CATEGORY} as category from telemetry) select seq, category, case category when 'runtime-warning' then 'info' when 'fatal-playback-blocker' then 'error' end as severity, "
    "case when category is not null then reason end as message from c",
)
def _(spark, d):
    return telemetry.classify_perf_event(derive(spark, d, "telemetry")).select("seq", "category", "severity", "message")


_FAILURES = (
    "select event_id, case event_id % 10 when 0 then 'Failed to fetch https://huggingface.co/q8/resolve/main/model.onnx' when 1 then 'Failed to fetch https://huggingface.co/a/b/resolve/main/x.onnx' "
    "when 2 then concat('Failed to resolve module specifier ', chr(39), 'kokoro-js', chr(39), ' here') when 3 then 'KOKORO_MODEL_ID_INVALID: x' when 4 then 'navigator.gpu missing' when 5 then 'boom' "
    "when 6 then '' when 7 then 'HTTP status 500' when 8 then null else concat('odd ', event_type) end as message, "
    "case event_id % 4 when 0 then false when 1 then true end as has_gpu, case event_id % 3 when 0 then 4e0 end as minimum_gb, case event_id % 2 when 0 then 2e0 else 8e0 end as memory_gb, "
    "event_id % 13 = 0 as intentional from {events}"
)
_CLASSIFIED = f"""fl as ({_FAILURES.replace('{events}', 'events')}), r as (select *, coalesce(nullif(message, ''), 'Unknown Kokoro failure.') as raw from fl),
t as (select *, regexp_extract(raw, '(?i)huggingface\\.co/([^/?#\\s]+)/(?:resolve|blob|raw|tree)/', 1) as tok from r),
m as (select *, case when tok <> '' then concat('KOKORO_MODEL_ID_INVALID: Expected model repo id like owner/name, got ''', tok, '''.') else raw end as failure_message from t),
c as (select *, case when contains(failure_message, 'Failed to resolve module specifier ''kokoro-js''') then 'KOKORO_MODULE_RESOLUTION_FAILED' when contains(failure_message, 'KOKORO_MODEL_ID_INVALID') then 'KOKORO_MODEL_ID_INVALID'
 when regexp_matches(failure_message, '(?i)failed to fetch|network|model|\\b(url|uri)\\b|http\\s*(error|status|404|403|500)') then 'KOKORO_MODEL_FETCH_FAILED'
 when coalesce(not has_gpu, false) or regexp_matches(failure_message, '(?i)navigator\\.gpu|webgpu|adapter|requestadapter') then 'WEBGPU_UNAVAILABLE'
 when coalesce(memory_gb < minimum_gb, false) then 'DEVICE_MEMORY_TOO_LOW' when failure_message <> 'Unknown Kokoro failure.' then 'KOKORO_WARMUP_FAILED' else 'UNKNOWN' end as code from m),
h as (select *, case code when 'DEVICE_MEMORY_TOO_LOW' then 'Requires >= 4GB device memory.' {' '.join(f"when '{k}' then '{'|'.join(v)}'" for k, v in telemetry.HINTS.items())} end as hint from c)"""


@query("f11_classify_failure", f"with {_CLASSIFIED} select event_id, failure_message, code, coalesce(hint, '') as hints from h")
def _(spark, d):
    done = telemetry.classify_failure(sql(spark, d, _FAILURES))
    return done.select("event_id", "failure_message", "code", F.coalesce(F.array_join("hints", "|"), F.lit("")).alias("hints"))


@query(
    "f12_fallback_bucket",
    f"with {_CLASSIFIED} select event_id, case when intentional then 'Intentional mode' when code in ('KOKORO_MODULE_RESOLUTION_FAILED', 'KOKORO_MODEL_ID_INVALID', 'KOKORO_MODEL_FETCH_FAILED') then 'Configuration' else 'Capability' end as bucket, "
    f"case when code = 'KOKORO_MODULE_RESOLUTION_FAILED' then '{telemetry.MODULE_REASON}' else failure_message end as shown_reason, "
    f"case when code = 'KOKORO_MODULE_RESOLUTION_FAILED' then '{telemetry.MODULE_HINT}' else split_part(hint, '|', 1) end as shown_hint from h",
)
def _(spark, d):
    done = telemetry.fallback_bucket(telemetry.classify_failure(sql(spark, d, _FAILURES)))
    return done.select("event_id", "bucket", "shown_reason", "shown_hint")


@query("a5_telemetry_counters", f"{TEL} select session_id, count(*) filter (type = 'tts.synth_failure') as synth_failures, count(*) filter (type = 'tts.degraded_mode') as fallback_activations from telemetry group by session_id")
def _(spark, d):
    return telemetry.telemetry_counters(derive(spark, d, "telemetry"), "session_id")


@query(
    "a6_first_audio",
    f"{TEL} select session_id, min(seq) as seq, arg_min(duration_ms, seq) as duration_ms, arg_min(segment_id, seq) as segment_id from telemetry where type = 'tts.first_audio' group by session_id",
)
def _(spark, d):
    return telemetry.first_audio(derive(spark, d, "telemetry"))


@query(
    "a7_latency_budget",
    f"{TEL}, q as (select type, count(duration_ms) as n, quantile_cont(duration_ms, 5e-1) as p50, quantile_cont(duration_ms, 95e-2) as p95 from telemetry where type in ('tts.first_audio', 'tts.segment_synth', 'tts.model_load') group by type) "
    "select case type when 'tts.first_audio' then 'first_audio_ms' when 'tts.segment_synth' then 'segment_synth_ms' else 'model_load_ms' end as metric, n, round(p50, 6) as p50, round(p95, 6) as p95, "
    "case type when 'tts.first_audio' then p95 < 2500 when 'tts.segment_synth' then p50 < 700 and p95 < 1500 else p95 < 4000 end as within_budget from q",
)
def _(spark, d):
    done = telemetry.latency_budget(derive(spark, d, "telemetry"))
    return done.withColumn("p50", F.round("p50", 6)).withColumn("p95", F.round("p95", 6))


@query(
    "a7_latency_by_session",
    f"{TEL} select session_id, count(duration_ms) as n, round(quantile_cont(duration_ms, 5e-1), 6) as p50, round(quantile_cont(duration_ms, 95e-2), 6) as p95 from telemetry where type = 'tts.segment_synth' group by session_id",
)
def _(spark, d):
    from lectern.operators.quantiles import exact_percentiles

    timed = derive(spark, d, "telemetry").filter("type = 'tts.segment_synth'")
    done = exact_percentiles(timed, "session_id", "duration_ms", {"p50": 0.5, "p95": 0.95})
    return done.withColumn("p50", F.round("p50", 6)).withColumn("p95", F.round("p95", 6))


@query(
    "a7_latency_rollup",
    f"{TEL} select case type when 'tts.first_audio' then 'first_audio_ms' when 'tts.segment_synth' then 'segment_synth_ms' else 'model_load_ms' end as metric, date_trunc('day', event_ts)::timestamp as starts, "
    "count(duration_ms) as n, true as p50_close, true as p95_close from telemetry where type in ('tts.first_audio', 'tts.segment_synth', 'tts.model_load') and duration_ms is not null group by all",
)
def _(spark, d):
    """Daily percentiles from stored hourly sketches; their ranks among all values of the day are within the bound."""
    folder = work_folder(spark, "sketches")
    events = derive(spark, d, "telemetry")
    telemetry.latency_sketches(events).write.parquet(folder)
    days = telemetry.sketched_budget(telemetry.rolled_up(spark.read.parquet(folder)))
    values = telemetry.metric_values(events.filter("duration_ms is not null"), F.date_trunc("day", "event_ts").alias("starts"))
    met = values.join(days, ["metric", "starts"]).groupBy("metric", "starts")
    shares = met.agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.col("value") < F.col(p)).alias(f"{p}_below") for p in ("p50", "p95")], *[F.count_if(F.col("value") <= F.col(p)).alias(f"{p}_upto") for p in ("p50", "p95")])
    # A value that occurs often has many ranks; on days of few events one rank is more than the bound.
    close = lambda p, at: (F.col(f"{p}_below") <= F.ceil(F.col("n") * (at + telemetry.RANK_ERROR))) & (F.col(f"{p}_upto") >= F.floor(F.col("n") * (at - telemetry.RANK_ERROR)))
    return shares.select("metric", F.col("starts").cast("timestamp_ntz").alias("starts"), "n", close("p50", 0.5).alias("p50_close"), close("p95", 0.95).alias("p95_close"))


@query(
    "a7_memory_budget",
    f"{TEL}, p as (select count(*) as n_loads, count(*) filter (seq % 3 = 0) as n_reported, max(case when seq % 3 = 0 then round(duration_ms * 4, 3) end) as peak_mb from telemetry where type = 'tts.model_load') "
    "select n_loads, n_reported, peak_mb, case when peak_mb is null then 'informational' when peak_mb < 12288e-1 then 'pass' else 'fail' end as verdict from p",
)
def _(spark, d):
    peak = F.when(F.col("seq") % 3 == 0, F.round(F.col("duration_ms") * 4, 3))
    return telemetry.memory_budget(derive(spark, d, "telemetry").withColumn("peak_memory_mb", peak))


@query(
    "a8_underrun_rate",
    f"{TEL} select session_id, count(*) filter (is_underrun) as underruns, count(*) as transitions, round(count(*) filter (is_underrun) / count(*)::double, 9) as underrun_rate, count(*) filter (is_underrun) / count(*)::double < 1e-2 as within_budget from telemetry where type = 'tts.queue_transition' group by session_id",
)
def _(spark, d):
    moves = derive(spark, d, "telemetry").filter("type = 'tts.queue_transition'")
    return telemetry.underrun_rate(moves, "session_id").withColumn("underrun_rate", F.round("underrun_rate", 9))


_DEGRADED = f"dg as (select 'kokoro' as provider_from, case when event_id % 50 = 0 then 'other' else 'web-speech' end as provider_to, code as fallback_code from c)"


@query(
    "a9_degraded_transitions",
    f"with {_CLASSIFIED}, {_DEGRADED} select provider_from, provider_to, fallback_code, count(*) as n, round(count(*) / sum(count(*)) over (), 9) as share from dg group by all",
)
def _(spark, d):
    failed = telemetry.classify_failure(sql(spark, d, _FAILURES)).select(
        F.lit("tts.degraded_mode").alias("type"),
        F.lit("kokoro").alias("provider_from"),
        F.when(F.col("event_id") % 50 == 0, "other").otherwise("web-speech").alias("provider_to"),
        F.col("code").alias("fallback_code"),
    )
    return telemetry.degraded_transitions(failed).withColumn("share", F.round("share", 9))


_RETRIES = (
    "select concat('seg_', cast(event_id % 211 as varchar(20))) as segment_id, case event_type when 'click' then 'tts.segment_retry' when 'view' then 'tts.segment_regenerated' when 'signup' then 'tts.synth_failure' "
    "else 'tts.validation_code' end as type, case event_id % 3 when 0 then 'duration_too_short' when 1 then 'regen_success' else 'regen_exhausted' end as code from {events}"
)


@query(
    "a11_retry_summary",
    f"with r as ({_RETRIES.replace('{events}', 'events')}) select segment_id, count(*) filter (type = 'tts.segment_retry') as retries, count(*) filter (type = 'tts.segment_regenerated') as regenerations, "
    + ", ".join(f"count(*) filter (type = 'tts.validation_code' and code = '{c}') as {c}" for c in ("duration_too_short", "regen_success", "regen_exhausted"))
    + " from r where type <> 'tts.synth_failure' group by segment_id",
)
def _(spark, d):
    return telemetry.retry_summary(sql(spark, d, _RETRIES))


RECENT = (
    f"{TEL}, c as (select *, {_CATEGORY} as category from telemetry), k as (select *, row_number() over (partition by session_id, category order by seq desc) as rank from c where category is not null) "
)


@query("w4_recent_entries", f"{RECENT} select session_id, category, seq, segment_id, reason as message, rank from k where rank <= 20")
def _(spark, d):
    recent = telemetry.recent_entries(telemetry.classify_perf_event(derive(spark, d, "telemetry")))
    return recent.select("session_id", "category", "seq", "segment_id", "message", "rank")


@query("k2_last_per_group", f"{RECENT} select session_id, category, seq, rank from k where rank <= 3")
def _(spark, d):
    recent = telemetry.recent_entries(telemetry.classify_perf_event(derive(spark, d, "telemetry")), keep=3)
    return recent.select("session_id", "category", "seq", "rank")


@query(
    "w5_running_underruns",
    f"{TEL}, r as (select session_id, seq, is_underrun, sum(is_underrun::int) over w as u, count(*) over w as t from telemetry where type = 'tts.queue_transition' window w as (partition by session_id order by seq)) "
    "select session_id, seq, u as queue_underruns, t as queue_transitions, round(u / t::double, 9) as underrun_rate from r where is_underrun",
)
def _(spark, d):
    moves = derive(spark, d, "telemetry").filter("type = 'tts.queue_transition'").select("session_id", "seq", "is_underrun")
    done = playback.running_underruns(moves, block=1024)
    return done.drop("is_underrun").withColumn("underrun_rate", F.round("underrun_rate", 9))


# The state after each event in plain window SQL: failures since the last success or reset, and whether the limit was
# reached since the last reset.
DEGRADE = f"""with {cte('outcomes')}, a as (select *, sum((outcome in ('ok', 'reset'))::int) over w as g, sum((outcome = 'reset')::int) over w as e from outcomes window w as (partition by session_id order by seq)),
b as (select *, sum((outcome = 'wasm')::int) over (partition by session_id, g order by seq) as raw from a),
c as (select *, bool_or(raw >= 3) over (partition by session_id, e order by seq) as degraded from b)"""


@query("w6_degrade_state", f"{DEGRADE} select session_id, seq, outcome, case when degraded then 3 else raw end as wasm_failures, degraded from c")
def _(spark, d):
    return playback.degrade_state(derive(spark, d, "outcomes"), block=2048)


@query(
    "w9_session_states",
    f"""with {cte('commands')}, m as (select *, max(case when action in ('SET_STATE', 'SET_ERROR') then seq end) over w as s1, max(case when action = 'SET_INDEX' then seq end) over w as s2,
max(case when action in ('SET_INDEX', 'SET_CHAR_OFFSET') then seq end) over w as s3, max(case when action in ('SET_ERROR', 'RESET_ERROR') then seq end) over w as s4 from commands window w as (partition by session_id order by seq))
select m.session_id, m.seq, m.action, case when a.action = 'SET_ERROR' then 'error' else coalesce(a.state, 'idle') end as state, coalesce(b.index, 0) as segment_index,
case when c.action = 'SET_INDEX' then 0 else coalesce(c.char_offset, 0) end as char_offset, case when e.action = 'SET_ERROR' then e.error end as error
from m left join commands a on a.seq = s1 left join commands b on b.seq = s2 left join commands c on c.seq = s3 left join commands e on e.seq = s4""",
)
def _(spark, d):
    return playback.session_states(derive(spark, d, "commands"), block=2048)
