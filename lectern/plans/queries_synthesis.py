"""Queries over synthesis results, caches, clips, anchors and cursors."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.functions import hashing
from lectern.functions import numbers as N
from lectern.functions import text as T
from lectern.operators import audio, playback, quality, synthesis
from lectern.plans import duck
from lectern.plans.inputs import DERIVED, cte, derive, sql, table
from lectern.plans.queries_corpus import retry_parts
from lectern.plans.registry import query
from lectern.policies import DEFAULT_CHUNKS, PREEMPTIVE_CHUNKS
from lectern.session import work_folder

@query(
    "x10_clamp_rate",
    "select event_id, case when event_id % 5 = 0 then 1e0 when event_id % 5 = 1 then 5e-1 when event_id % 5 = 2 then 25e-1 else least(greatest(value / 20, 5e-1), 25e-1) end as rate from events",
)
def _(spark, d):
    raw = "case event_id % 5 when 0 then double('NaN') when 1 then -3e0 when 2 then 9e0 else value / 20 end"
    return sql(spark, d, f"select event_id, {raw} as r from {{events}}").select("event_id", N.clamp_rate(F.col("r")).alias("rate"))


@query("x11_min_duration", f"select doc_id, round({duck.min_duration('text', '15e-1')}, 9) as min_s from documents")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", F.round(N.min_duration_s(F.col("text"), F.lit(1.5)), 9).alias("min_s"))


_T = duck.trim("text")


@query(
    "x15_cache_key",
    f"select conv_id, turn, concat('p|webgpu|fp32|seg_', cast(turn as varchar), '|', cast(length({_T}) as varchar), ':', left({_T}, 24), ':', right({_T}, 24), '|', "
    "case when turn % 2 = 0 then 'af_alloy' else '' end, '|', case turn % 3 when 0 then '1' when 1 then '1.5' else '' end) as cache_key from conversations",
)
def _(spark, d):
    turn = F.col("turn")
    key = hashing.cache_key(
        F.lit("p"), F.lit("webgpu"), F.lit("fp32"), F.concat(F.lit("seg_"), turn.cast("string")), F.col("text"),
        F.when(turn % 2 == 0, "af_alloy"), F.when(turn % 3 == 0, 1.0).when(turn % 3 == 1, 1.5),
    )
    return table(spark, d, "conversations").select("conv_id", "turn", key.alias("cache_key"))


@query(
    "x17_format_clock",
    "select event_id, case when value - 5 <= 0 then '0:00' else concat(cast(cast(floor(floor((value - 5) * 10) / 60) as bigint) as varchar), ':', lpad(cast(cast(floor((value - 5) * 10) as bigint) % 60 as varchar), 2, '0')) end as clock from events",
)
def _(spark, d):
    return table(spark, d, "events").select("event_id", N.format_clock((F.col("value") - 5) * 10).alias("clock"))


@query(
    "x18_progress_percent",
    "select conv_id, turn, concat(cast(cast(floor(least(1e0, (turn + 1) / count(*) over (partition by conv_id)) * 100 + 5e-1) as bigint) as varchar), '%') as progress from conversations",
)
def _(spark, d):
    turns = table(spark, d, "conversations")
    counts = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"))
    return turns.join(counts, "conv_id").select("conv_id", "turn", N.progress_percent(F.col("turn"), F.col("n")).alias("progress"))


_SEG = "select conv_id as doc_id, turn as idx, concat('seg_', cast(conv_id as varchar(20)), '_', cast(turn as varchar(20))) as segment_id, text from {conversations}"


@query(
    "x19_highlight",
    "with c as (select conv_id, turn, turn * 2 - 3 as si, case when turn % 3 = 0 then -5 else turn * 40 end as co, count(*) over (partition by conv_id) as n from conversations), "
    "p as (select *, greatest(least(si, n - 1), 0) as i from c) select p.conv_id as doc_id, p.turn as ask, p.i as segment_index, "
    "concat('seg_', cast(p.conv_id as varchar), '_', cast(p.i as varchar)) as segment_id, greatest(co, 0) as char_offset, round(least(1e0, greatest(co, 0) / length(t.text)), 9) as ratio "
    "from p join conversations t on t.conv_id = p.conv_id and t.turn = p.i",
)
def _(spark, d):
    asks = sql(spark, d, "select conv_id as doc_id, turn as ask, turn * 2 - 3 as segment_index, case when turn % 3 = 0 then -5 else turn * 40 end as char_offset from {conversations}")
    return playback.highlight(asks, sql(spark, d, _SEG)).withColumn("ratio", F.round("ratio", 9))


@query(
    "x20_char_at_ratio",
    "select conv_id, turn, cast(floor(least(1e0, (turn + 1) * 3e0 / (4 + turn)) * length(text)) as bigint) as char_at, round(least(4e0 + turn, 7e0 / length(text) * (4 + turn)), 9) as seek_s from conversations",
)
def _(spark, d):
    turn, length = F.col("turn"), T.utf16_length("text")
    duration = (turn + 4).cast("double")
    return table(spark, d, "conversations").select(
        "conv_id", "turn", N.char_at_ratio((turn + 1) * 3.0, duration, length).alias("char_at"),
        F.round(N.seek_seconds(F.lit(7.0), duration, length), 9).alias("seek_s"),
    )


@query(
    "x21_peak_memory",
    "select event_id, case when event_id % 4 <> 0 then floor(greatest(coalesce(case when event_id % 3 <> 0 then event_id * 1000003 end, 0), event_id * 900001) / 1048576e0 * 10 + 5e-1) / 10 end as peak_mb from events where event_id > 0 union all select event_id, null from events where event_id = 0",
)
def _(spark, d):
    used = F.when((F.col("event_id") % 3 != 0) & (F.col("event_id") % 4 != 0), F.col("event_id") * 1000003)
    total = F.when(F.col("event_id") % 4 != 0, F.col("event_id") * 900001)
    return table(spark, d, "events").select("event_id", N.peak_memory_mb(used, total).alias("peak_mb"))


@query("x23_guard_repo_id", "select event_id, contains(case when event_id % 3 = 0 then event_type else concat('owner/', event_type) end, '/') as valid from events")
def _(spark, d):
    repo = F.when(F.col("event_id") % 3 == 0, F.col("event_type")).otherwise(F.concat(F.lit("owner/"), "event_type"))
    return table(spark, d, "events").select("event_id", N.guard_repo_id(repo).alias("valid"))


@query("x24_backoff", "select event_id, cast(180 * pow(2, event_id % 3) as bigint) as synth_ms, cast(200 * pow(2, event_id % 2) as bigint) as playback_ms from events")
def _(spark, d):
    event = F.col("event_id")
    return table(spark, d, "events").select(
        "event_id", N.backoff_ms(event % 3 + 1, 180).alias("synth_ms"), N.backoff_ms(event % 2 + 1, 200).alias("playback_ms")
    )


# --- plans and lookups -------------------------------------------------------------------------------------------

_CACHED = f"with {cte('synth_cache')}, sg as (select conv_id as doc_id, turn as idx, concat('seg_', cast(conv_id as varchar), '_', cast(turn as varchar)) as cache_key from conversations)"


def cached_segments(spark, d):
    return sql(spark, d, _SEG).withColumn("cache_key", F.col("segment_id"))


@query("j2_queue_status", f"{_CACHED} select doc_id, idx, cache_key, coalesce(status, 'idle') as status, audio_url from sg left join synth_cache using (cache_key)")
def _(spark, d):
    return synthesis.queue_status(cached_segments(spark, d).select("doc_id", "idx", "cache_key"), derive(spark, d, "synth_cache"))


@query(
    "w7_prefetch_plan",
    f"{_CACHED}, n as (select s.doc_id, s.idx, s.idx + k as next_idx from sg s, unnest([1, 2]) t(k)) "
    "select n.doc_id, n.idx, n.next_idx, s.cache_key as segment_id, s.cache_key from n join sg s on s.doc_id = n.doc_id and s.idx = n.next_idx left join synth_cache c on c.cache_key = s.cache_key "
    "where coalesce(c.status, 'idle') not in ('ready', 'loading')",
)
def _(spark, d):
    return synthesis.prefetch_plan(cached_segments(spark, d), derive(spark, d, "synth_cache"))


@query("j11_underruns", f"{_CACHED} select doc_id, idx, cache_key from sg left join synth_cache using (cache_key) where idx > 0 and coalesce(status, 'idle') <> 'ready'")
def _(spark, d):
    moves = cached_segments(spark, d).filter("idx > 0").select("doc_id", "idx", "cache_key")
    return synthesis.underruns(moves, derive(spark, d, "synth_cache"))


@query(
    "j12_retry_prefix_check",
    f"{_CACHED}, f as (select doc_id, min(idx) as m from sg where cache_key not in (select cache_key from synth_cache where status = 'ready') group by doc_id), "
    "r as (select conv_id as doc_id, max(turn) // 2 as from_position from conversations group by conv_id) "
    "select r.doc_id, from_position, case when m < from_position then m end as first_missing, "
    "case when m < from_position then concat('Retry cache miss for segment ', cast(m + 1 as varchar), '. Please rebuild from the start.') end as error from r left join f using (doc_id)",
)
def _(spark, d):
    segments = cached_segments(spark, d).select("doc_id", F.col("idx").alias("position"), "segment_id")
    cache = derive(spark, d, "synth_cache").filter("status = 'ready'").select(F.col("cache_key").alias("segment_id"))
    retries = sql(spark, d, "select conv_id as doc_id, max(turn) div 2 as from_position from {conversations} group by conv_id")
    return synthesis.retry_prefix_check(segments, cache, retries)


@query(
    "u12_retry_schedule",
    f"""with recursive {cte('synth_results')}, {retry_parts(DEFAULT_CHUNKS)}, np as (select doc_id, position, count(*) as n from rt group by all),
f as (select segment_id, text, position % 5 as split_depth, n, position % 5 < 3 and coalesce(n, 0) >= 2 as can from synth_results left join np using (doc_id, position) where not ok)
select segment_id, split_depth, attempt, case when attempt < 3 then cast(180 * pow(2, attempt - 1) as bigint) end as delay_ms,
case when attempt < 3 then 'retry' when can then 'split' else 'exhausted' end as outcome, case when attempt = 3 and can then n end as chunk_count,
case when attempt = 3 and not can then 'regen_exhausted: empty blob' else 'empty blob' end as message
from f, unnest([1, 2, 3]) t(attempt)""",
)
def _(spark, d):
    failures = derive(spark, d, "synth_results").filter("not ok").select(
        "segment_id", "text", (F.col("position") % 5).alias("split_depth"), F.lit("empty blob").alias("reason")
    )
    return synthesis.retry_schedule(failures)


def _rounds(other: int | None = None, where: str = "") -> str:
    """All retry events when texts of more than 250 characters come out bad; the levels unrolled."""
    keyed = "select segment_id as doc_id, 0 as position, text from"
    split = lambda policy, source: f"with recursive {retry_parts(policy, source)} select doc_id as segment_id, part_idx, text from rt"
    long = f"length({duck.trim('text')}) > {PREEMPTIVE_CHUNKS.max_chars} or {duck.tokens('text')} > {PREEMPTIVE_CHUNKS.max_tokens}"
    child = "select concat(segment_id, '::chunk_', cast(part_idx as varchar)) as segment_id, text from"
    ctes = [
        cte("synth_results"),
        f"base as (select segment_id, text from synth_results{where})",
        f"pp as ({split(PREEMPTIVE_CHUNKS, keyed + ' base where ' + long)})",
        "pn as (select segment_id, count(*) as n from pp group by segment_id having count(*) >= 2)",
        "b0 as (select * from base where segment_id not in (select segment_id from pn) and length(text) > 250)",
    ]
    for level in range(4):
        # What the other runtime can speak needs no second attempt and no split.
        ctes.append(f"x{level} as (select * from b{level}{f' where length(text) > {other}' if other else ''})")
        ctes.append(f"p{level} as ({split(DEFAULT_CHUNKS, f'{keyed} x{level}')})")
        ctes.append(f"n{level} as (select segment_id, count(*) as n from p{level} group by segment_id having count(*) >= 2)")
        if level < 3:
            more = f"{child} pp where segment_id in (select segment_id from pn) union all " if level == 0 else ""
            children = f"{more}{child} p{level} where segment_id in (select segment_id from n{level})"
            ctes.append(f"b{level + 1} as (select * from ({children}) where length(text) > 250)")
    tried = " union all ".join(
        f"select segment_id, {level} as split_depth, {'n' if level < 3 else 'null::bigint'} as n from x{level} left join n{level} using (segment_id)" for level in range(4)
    )
    lowered = "".join(
        f" union all select segment_id, {level}, attempt, null, 'downgrade', null, 'empty blob' from b{level}, unnest([1, 2, 3]) t(attempt) where attempt = 1 or length(text) > {other}"
        for level in range(4 if other else 0)
    )
    ctes += [
        f"tried as ({tried})",
        "turns as (select segment_id, split_depth, attempt, case when attempt < 3 then cast(180 * pow(2, attempt - 1) as bigint) end as delay_ms, "
        "case when attempt < 3 then 'retry' when n is not null then 'split' else 'exhausted' end as outcome, case when attempt = 3 then n end as chunk_count, "
        "case when attempt = 3 and n is null then 'regen_exhausted: empty blob' else 'empty blob' end as message from tried, unnest([1, 2, 3]) t(attempt))",
        f"ev as (select * from turns union all select segment_id, 0, null, null, 'split', n, null from pn{lowered})",
    ]
    return (
        f"with {', '.join(ctes)} select * from ev union all select segment_id, split_depth, null, null, 'regenerated', chunk_count, null from ev s where outcome = 'split' "
        "and not exists (select 1 from ev x where x.outcome = 'exhausted' and starts_with(x.segment_id, concat(s.segment_id, '::chunk_')))"
    )


@query("u12_retry_rounds", _rounds())
def _(spark, d):
    segments = derive(spark, d, "synth_results").select("segment_id", "text")
    return synthesis.retry_rounds(segments, lambda text: T.utf16_length(text) > 250, "empty blob", work_folder(spark, "retries"))


@query("u12_retry_rounds_downgrade", _rounds(other=300))
def _(spark, d):
    """Failing attempts are repeated on the other runtime, which speaks somewhat longer texts."""
    segments = derive(spark, d, "synth_results").select("segment_id", "text")
    return synthesis.retry_rounds(
        segments, lambda text: T.utf16_length(text) > 250, "empty blob", work_folder(spark, "retries"), other_fails=lambda text: T.utf16_length(text) > 300
    )


_NOT_READY = " where segment_id not in (select cache_key from sc where status = 'ready')"
_FLOW = f"""with sc as (select * from ({DERIVED['synth_cache'][0].replace('{conversations}', 'conversations')})), events as ({_rounds(other=300, where=_NOT_READY)}),
{cte('synth_results')}, ends as (select split_part(segment_id, '::chunk_', 1) as segment_id, bool_or(outcome = 'exhausted') as lost, bool_or(outcome = 'split') as parts from events group by 1),
q as (select doc_id, position, r.segment_id, doc_id % 17 = 0 as native, case when status = 'ready' then 'cache' when lost then 'failed' when parts then 'regenerated' else 'built' end as source
 from synth_results r left join sc on sc.cache_key = r.segment_id left join ends on ends.segment_id = r.segment_id)"""


def _flow(spark, d):
    from lectern.plans.synthesis_flow import build_audio

    segments = derive(spark, d, "synth_results").select("doc_id", "position", "segment_id", "text", F.col("segment_id").alias("cache_key"))
    docs = table(spark, d, "conversations").select(F.col("conv_id").alias("doc_id")).distinct()
    return build_audio(
        docs, segments, derive(spark, d, "synth_cache"), lambda text: T.utf16_length(text) > 250, "empty blob", work_folder(spark, "build"),
        other_fails=lambda text: T.utf16_length(text) > 300, native=F.col("doc_id") % 17 == 0,
    )


@query(
    "synthesis_flow_outcomes",
    f"""{_FLOW}, b as (select *, source = 'failed' or native as bad from q), s as (select doc_id, count(*) as n, min(position) filter (bad) as p from b group by doc_id)
select doc_id, case when p is not null then 'error' else 'ready' end as status, coalesce(p, n) as built_segments, n as total_segments, b.segment_id as failed_segment_id, p as failed_segment_index,
case when b.native then '{synthesis.NATIVE_ONLY}' when p is not null then concat('Build failed at segment ', cast(p + 1 as varchar), '/', cast(n as varchar), ' (', b.segment_id, '): regen_exhausted: empty blob') end as error
from s left join b using (doc_id) where p is null and b.position = 0 or b.position = p""".replace("b.segment_id as failed_segment_id", "case when p is not null then b.segment_id end as failed_segment_id"),
)
def _(spark, d):
    """Cache, model, other runtime, splits and retries, to one verdict per document."""
    return _flow(spark, d).outcomes


@query("synthesis_flow_queue", f"{_FLOW} select doc_id, position, segment_id, segment_id as cache_key, source from q")
def _(spark, d):
    return _flow(spark, d).queue


@query(
    "a10_export_outcome",
    f"""with {cte('synth_results')}, r as (select *, not ok or doc_id % 17 = 0 as bad from synth_results where doc_id % 29 <> 0),
s as (select doc_id, count(*) as n, min(position) filter (bad) as p from r group by doc_id)
select c.doc_id, case when coalesce(n, 0) = 0 or p is not null then 'error' else 'ready' end as status, coalesce(p, n, 0) as built_segments, coalesce(n, 0) as total_segments,
r.segment_id as failed_segment_id, p as failed_segment_index, case when coalesce(n, 0) = 0 then '{synthesis.NO_SEGMENTS}' when r.doc_id % 17 = 0 then '{synthesis.NATIVE_ONLY}'
when p is not null then concat('Build failed at segment ', cast(p + 1 as varchar), '/', cast(n as varchar), ' (', r.segment_id, '): empty blob') end as error
from (select distinct conv_id as doc_id from conversations) c left join s using (doc_id) left join r on r.doc_id = s.doc_id and r.position = s.p""",
)
def _(spark, d):
    # Documents divisible by 29 have no results, which feeds the branch of empty documents.
    results = derive(spark, d, "synth_results").filter("doc_id % 29 <> 0").select(
        "doc_id", "position", "segment_id", "ok", F.lit("empty blob").alias("reason"), (F.col("doc_id") % 17 == 0).alias("native")
    )
    docs = table(spark, d, "conversations").select(F.col("conv_id").alias("doc_id")).distinct()
    return synthesis.export_outcome(docs, results)


# --- quality -----------------------------------------------------------------------------------------------------

_MIN = duck.min_duration("text")


@query(
    "f13_probe_audio",
    f"with {cte('synth_results')} select segment_id, case when position % 7 = 3 then null when n_bytes = 0 then 'Audio decode probe failed: empty blob.' when position % 6 = 5 then "
    f"concat('Audio decode probe failed: duration_too_short decoded=NaNs expected_min=', printf('%.3f', floor({_MIN} * 1000 + 5e-1) / 1000), 's.') when duration_s < {_MIN} then "
    f"concat('Audio decode probe failed: duration_too_short decoded=', printf('%.3f', floor(duration_s * 1000 + 5e-1) / 1000), 's expected_min=', printf('%.3f', floor({_MIN} * 1000 + 5e-1) / 1000), 's.') end as error from synth_results",
)
def _(spark, d):
    rows = derive(spark, d, "synth_results").select(
        "segment_id", "text", F.lit(1.0).alias("rate"), F.when(F.col("position") % 7 != 3, F.col("n_bytes")).alias("n_bytes"),
        F.when(F.col("position") % 6 == 5, F.lit(float("nan"))).otherwise(F.col("duration_s")).alias("duration_s"),
    )
    return quality.probe_audio(rows).select("segment_id", "error")


@query(
    "f14_validate_synth_output",
    f"""with {cte('pcm_clips')}, s as (select clip_id, clip_id % 11 as k, sqrt(list_sum(list_transform(ch0, lambda x: x::double * x::double)) / 64) as rms, 64e0 / sample_rate as sec from pcm_clips)
select clip_id, case when k = 0 then 'empty_audio' when k = 1 then 'suspicious_size_40' when k = 2 then 'unsupported_mime_type_audio/mpeg' when k = 3 then 'obvious_corruption_signal' when k = 4 then 'suspicious_duration'
when k = 5 then 'empty_decoded_audio' when k = 6 then 'near_silent_audio' when k = 7 then null when k = 8 then 'decode_error' when k = 10 then 'obvious_corruption_signal' when rms < 1e-4 then 'near_silent_audio' end as verdict from s""",
)
def _(spark, d):
    clips = derive(spark, d, "pcm_clips").select("clip_id", (F.col("clip_id") % 11).alias("k"), F.array("ch0").alias("channels"), "sample_rate")
    rows = audio.clip_stats(clips).select(
        "clip_id",
        F.expr("case k when 0 then 0 when 1 then 40 else 1000 end").alias("n_bytes"),
        F.expr("case k when 2 then 'audio/MPEG' when 7 then '' when 8 then ' Audio/X-WAV ' when 9 then 'application/octet-stream' else 'audio/wav' end").alias("mime"),
        F.expr("case k when 3 then unhex('00494646000000005741564500') when 10 then cast(null as binary) else unhex('524946460000000057415645') end").alias("header"),
        (F.col("k") == 8).alias("decode_failed"),
        F.expr("case k when 4 then 0.01D when 7 then cast(null as double) else 1D end").alias("duration_s"),
        F.expr("case k when 5 then 0 else n_samples end").alias("n_samples"),
        F.expr("case k when 6 then 0D else rms end").alias("rms"),
    )
    return quality.validate_synth_output(rows).select("clip_id", "verdict")


@query(
    "f16_flag_short_completion",
    f"with {cte('synth_results')}, c as (select segment_id, duration_s > 0 and duration_s < {_MIN} and (position % 4) / 4e0 < 6e-1 as short, concat('Audio playback failed: duration_too_short decoded=', "
    f"printf('%.3f', floor(duration_s * 1000 + 5e-1) / 1000), 's expected_min=', printf('%.3f', floor({_MIN} * 1000 + 5e-1) / 1000), 's.') as m from synth_results) select segment_id, short as short_completion, case when short then m end as error from c",
)
def _(spark, d):
    rows = derive(spark, d, "synth_results").select(
        "segment_id", "text", F.lit(1.0).alias("rate"), "duration_s", (F.col("duration_s") * (F.col("position") % 4) / 4.0).alias("played_s")
    )
    return quality.flag_short_completion(rows).select("segment_id", "short_completion", "error")


@query(
    "f17_failure_reason",
    f"with {cte('telemetry')} select seq, case when contains(m, 'duration_too_short') then 'duration_too_short' when contains(m, 'regen_exhausted') then 'regen_exhausted' else m end as failure from "
    "(select seq, concat('Probe: ', reason, '.') as m from telemetry where reason is not null)",
)
def _(spark, d):
    rows = derive(spark, d, "telemetry").filter("reason is not null")
    return rows.select("seq", quality.failure_reason(F.concat(F.lit("Probe: "), "reason", F.lit("."))).alias("failure"))


@query(
    "f15_is_wasm_failure",
    f"with {cte('telemetry')} select seq, contains(lower(reason), 'wasm') or contains(lower(reason), 'webassembly') or seq % 5 = 0 as wasm_failure from telemetry where reason is not null",
)
def _(spark, d):
    runtime = F.when(F.col("seq") % 5 == 0, "WASM|q8").otherwise("webgpu|fp32")
    return derive(spark, d, "telemetry").filter("reason is not null").select("seq", quality.is_wasm_failure(F.col("reason"), runtime).alias("wasm_failure"))


@query(
    "f20_pick_audio_bundle",
    "select event_id, case when event_id % 3 <> 0 and event_id % 4 = 0 then 'mp3' else 'wav' end as bundle, case when event_id % 3 <> 0 and event_id % 4 <> 0 then concat('MP3 unavailable in this runtime; WAV provided instead. (', "
    "case event_id % 4 when 1 then 'encode_failed: boom' when 2 then 'init_failed: no encoder' else 'init_failed' end, ')') end as warning from events",
)
def _(spark, d):
    rows = sql(
        spark, d,
        "select event_id, case when event_id % 3 <> 0 then 'mp3' else 'wav' end as format, event_id % 4 = 0 as mp3_ok, case event_id % 4 when 1 then 'encode_failed' when 2 then 'init_failed' end as code, "
        "case event_id % 4 when 1 then 'boom' end as detail, 'no encoder' as diagnosis, cast(null as string) as failure from {events}",
    )
    return quality.pick_audio_bundle(rows).select("event_id", "bundle", "warning")


@query(
    "f21_classify_encode_failure",
    "select event_id, case when event_id % 2 = 0 then case when event_id % 3 <> 0 then 'encode_failed' when event_id % 5 = 0 then 'unsupported_runtime' else 'init_failed' end "
    "when event_id % 7 = 0 then 'encode_failed' when event_id % 5 in (1, 2, 3) then 'unsupported_runtime' else 'encode_failed' end as reason from events",
)
def _(spark, d):
    rows = sql(
        spark, d,
        "select event_id, case when event_id % 2 = 0 then 'native' else 'fallback' end as encoder, case when event_id % 3 = 0 then 'init' else 'encode' end as stage, case when event_id % 2 = 1 and event_id % 7 = 0 then null else "
        "case event_id % 5 when 0 then 'MPEGMode is not defined' when 1 then 'failed to load core' when 2 then 'Worker gone' when 3 then 'no SharedArrayBuffer' else 'out of memory' end end as message from {events}",
    )
    return quality.classify_encode_failure(rows).select("event_id", "reason")


# --- audio -------------------------------------------------------------------------------------------------------

def clips(spark, d):
    both = F.when(F.col("n_channels") == 1, F.array("ch0")).otherwise(F.array("ch0", "ch0"))
    return derive(spark, d, "pcm_clips").select("clip_id", "doc_id", "position", both.alias("channels"), "sample_rate")


@query(
    "p1_stitch_pcm",
    f"""with {cte('pcm_clips')}, m as (select doc_id, max(n_channels) as mc, max(sample_rate) as mr from pcm_clips group by doc_id),
s as (select doc_id, position, mc, mr, ch0, cast(ceil((64e0 / sample_rate) * mr) as bigint) as n from pcm_clips join m using (doc_id)),
o as (select *, coalesce(sum(n) over (partition by doc_id order by position rows between unbounded preceding and 1 preceding), 0) as a0 from s),
x as (select doc_id, position, a0 as start_sample, n as n_samples, mr as sample_rate, mc as n_channels,
 list_transform(range(n), lambda i: ch0[least(63, cast(floor(i / greatest(1, n - 1)::double * 63) as bigint)) + 1]) as ch from o)
select doc_id, position, start_sample, n_samples, sample_rate, n_channels, round(list_sum(list_transform(ch, lambda v, i: v::double * i)), 4) as weighted from x""",
)
def _(spark, d):
    done = audio.stitch_pcm(clips(spark, d), folder=work_folder(spark, "clips"))
    last = F.element_at("channels", -1)
    weighted = F.aggregate(F.transform(last, lambda v, i: v.cast("double") * (i + 1)), F.lit(0.0), lambda a, v: a + v)
    return done.select(
        "doc_id", "position", "start_sample", "n_samples", "sample_rate", F.size("channels").alias("n_channels"), F.round(weighted, 4).alias("weighted")
    )


@query(
    "p2_quantize_pcm",
    f"with {cte('pcm_clips')}, q as (select clip_id, n_channels, list_transform(ch0, lambda v: cast(floor(case when greatest(-1e0, least(1e0, v::double * 3)) < 0 then greatest(-1e0, v::double * 3) * 32768 else least(1e0, v::double * 3) * 32767 end + 5e-1) as bigint)) as s from pcm_clips) "
    "select clip_id, array_to_string(list_transform(range(64 * n_channels), lambda i: s[i // n_channels + 1]), ',') as samples from q",
)
def _(spark, d):
    loud = clips(spark, d).withColumn("channels", F.transform("channels", lambda ch: F.transform(ch, lambda v: v.cast("double") * 3)))
    return audio.quantize_pcm(loud).select("clip_id", F.array_join(F.transform("samples16", lambda v: v.cast("string")), ",").alias("samples"))


@query(
    "p3_clip_stats",
    f"with {cte('pcm_clips')} select clip_id, 64 * n_channels as n_samples, round(sqrt(list_sum(list_transform(ch0, lambda x: x::double * x::double)) / 64), 6) as rms, 64e0 / sample_rate as duration_s from pcm_clips",
)
def _(spark, d):
    return audio.clip_stats(clips(spark, d)).select("clip_id", "n_samples", F.round("rms", 6).alias("rms"), "duration_s")


@query(
    "p4_pending_segments",
    f"{_CACHED} select distinct cache_key from sg where cache_key not in (select cache_key from synth_cache where status = 'ready')",
)
def _(spark, d):
    return synthesis.pending_segments(cached_segments(spark, d), derive(spark, d, "synth_cache")).select("cache_key")


# --- positions ---------------------------------------------------------------------------------------------------

@query(
    "j3_resume_position",
    "select conv_id, case when conv_id % 5 in (0, 3) then 0 when conv_id % 5 = 1 then 3 else 2 end as segment_index, case when conv_id % 5 = 1 then 0 when conv_id % 5 in (2, 4) then conv_id % 100 else 0 end as char_offset from (select distinct conv_id from conversations)",
)
def _(spark, d):
    docs = sql(spark, d, "select distinct conv_id, concat('fp', cast(conv_id as varchar(20))) as fingerprint from {conversations}")
    cursors = sql(spark, d, _CURSORS)
    return playback.resume_position(docs, cursors).select("conv_id", "segment_index", "char_offset")


_CURSORS = (
    "select distinct concat('fp', cast(conv_id as varchar(20))) as fingerprint, case conv_id % 5 when 1 then concat(chr(123), '\"segmentIndex\":3,\"charOffset\":-7', chr(125)) when 3 then 'not json' "
    "else concat(chr(123), '\"segmentIndex\":2,\"charOffset\":', cast(conv_id % 100 as varchar(20)), chr(125)) end as cursor from {conversations} where conv_id % 5 <> 0"
)


@query(
    "j8_active_anchor",
    f"""with {cte('anchors')}, p as (select doc_id, anchor_idx as ask, playback_idx, (anchor_idx * 17) % 90 as char_offset, anchor_idx - anchor_idx % 2 as floor_idx from anchors),
b as (select p.doc_id, ask, any_value(p.playback_idx) as playback_idx, any_value(p.char_offset) as char_offset, any_value(floor_idx) as floor_idx, max(a.anchor_idx) as best from p left join anchors a on a.doc_id = p.doc_id and a.playback_idx = p.playback_idx and a.char_offset <= p.char_offset and a.anchor_idx >= p.floor_idx group by p.doc_id, ask),
c as (select *, coalesce(best, floor_idx) as active_idx from b) select c.doc_id, ask, c.playback_idx, c.char_offset, active_idx, case when a.playback_idx = c.playback_idx then greatest(c.char_offset - a.char_offset, 0) else c.char_offset end as anchor_offset
from c left join anchors a on a.doc_id = c.doc_id and a.anchor_idx = c.active_idx""",
)
def _(spark, d):
    anchors = derive(spark, d, "anchors")
    asks = anchors.select(
        "doc_id", F.col("anchor_idx").alias("ask"), "playback_idx", ((F.col("anchor_idx") * 17) % 90).cast("int").alias("char_offset"),
        (F.col("anchor_idx") - F.col("anchor_idx") % 2).alias("floor_idx"),
    )
    return playback.active_anchor(asks, anchors).drop("floor_idx")


@query(
    "j9_next_anchor",
    f"with {cte('anchors')} select a.doc_id, a.anchor_idx, a.playback_idx, a.char_offset, min(b.anchor_idx) as next_idx from anchors a left join anchors b on a.doc_id = b.doc_id and b.anchor_idx > a.anchor_idx and b.playback_idx > a.playback_idx group by all",
)
def _(spark, d):
    return playback.next_anchor(derive(spark, d, "anchors"))


@query("k4_clamp_index", "select event_id, greatest(least(event_id % 40 - 10, (event_id % 17) - 1), 0) as idx from events")
def _(spark, d):
    event = F.col("event_id")
    return table(spark, d, "events").select("event_id", playback.clamp_index(event % 40 - 10, event % 17).alias("idx"))


# --- voices, preferences, devices --------------------------------------------------------------------------------

VOICES = [
    ("kokoro", "bf_emma", "Emma", 0), ("kokoro", "af_alloy", "Alloy", 1), ("kokoro", "am_adam", "Adam", 2),
    ("web-speech", "urn:moz:a", "Moz A", 0), ("web-speech", "Google US", "Google US", 1),
]
_VOICES_SQL = "vs(provider, id, name, ord) as (values " + ", ".join(str(v) for v in VOICES) + ")"
_PREFS = (
    "select event_id, case event_id % 3 when 0 then 'web-speech' when 1 then 'kokoro' else 'silent' end as provider, "
    "case event_id % 5 when 0 then 'Alloy' when 1 then 'am_adam' when 2 then '' when 3 then 'Google US' else event_type end as voice from {events}"
)


@query(
    "j10_resolve_voice",
    f"""with {_VOICES_SQL}, p as ({_PREFS.replace('{events}', 'events')}), w as (select *, case when provider = 'kokoro' and voice = 'Alloy' then 'af_alloy' else voice end as want from p),
d as (select provider, arg_min(id, case when id = 'af_alloy' then -1 else ord end) as did, arg_min(name, case when id = 'af_alloy' then -1 else ord end) as dname from vs group by provider)
select event_id, w.provider, voice, coalesce(v.id, did) as resolved_voice, case when v.id is not null then null when did is null then 'No voices were returned by the active provider.'
 when voice <> '' then concat('Selected voice "', voice, '" is unavailable for ', w.provider, '; switched to "', dname, '".') else concat('No voice selected for ', w.provider, '; switched to "', dname, '".') end as warning
from w left join vs v on v.provider = w.provider and v.id = w.want left join d on d.provider = w.provider""",
)
def _(spark, d):
    voices = spark.createDataFrame(VOICES, "provider string, id string, name string, ord int")
    return playback.resolve_voice(sql(spark, d, _PREFS), voices)


@query(
    "k3_default_voice",
    f"with {_VOICES_SQL}, p as ({_PREFS.replace('{events}', 'events')}), d as (select provider, arg_min(id, case when id = 'af_alloy' then -1 else ord end) as id from vs group by provider) select provider, id as voice, count(*) as n from p join d using (provider) group by all",
)
def _(spark, d):
    voices = spark.createDataFrame(VOICES, "provider string, id string, name string, ord int")
    picks = playback.default_voices(voices).select("provider", F.col("_d.id").alias("voice"))
    users = sql(spark, d, _PREFS).groupBy("provider").agg(F.count(F.lit(1)).alias("n"))
    return users.join(picks, "provider")


_STORED = (
    "select event_id, case event_id % 7 when 0 then 'not json' when 1 then '<\"voice\":\"Alloy\",\"rate\":1,\"provider\":\"kokoro\">' when 2 then '<\"voice\":\"Google US\",\"rate\":1.5,\"provider\":\"old\">' "
    "when 3 then '<\"voice\":\"gone\",\"rate\":1.25,\"provider\":\"web-speech\">' when 4 then '<\"voice\":\"Google US\",\"rate\":2,\"provider\":\"web-speech\">' when 5 then '<\"voice\":5,\"rate\":1,\"provider\":\"kokoro\">' "
    "else '<\"voice\":\"am_adam\",\"rate\":\"1\",\"provider\":\"kokoro\">' end as p, case event_id % 6 when 0 then null when 1 then '' when 2 then 'auto' when 3 then 'q8' when 4 then 'fp16' else 'int3' end as precision from {events}"
)


@query(
    "f19_migrate_preferences",
    """select event_id, case event_id % 7 when 1 then 'kokoro' when 2 then 'kokoro' when 3 then 'web-speech' when 4 then 'web-speech' end as provider,
case event_id % 7 when 1 then 'af_alloy' when 2 then '' when 3 then 'urn:moz:a' when 4 then 'Google US' end as voice, case event_id % 7 when 1 then 1e0 when 2 then 15e-1 when 3 then 125e-2 when 4 then 2e0 end as rate,
event_id % 7 between 1 and 4 as valid, event_id % 7 between 1 and 3 as changed, event_id % 7 between 1 and 3 as voice_migrated,
case event_id % 6 when 3 then 'q8' when 4 then 'fp16' when 5 then 'auto' else 'fp32' end as precision_setting from events""",
)
def _(spark, d):
    stored = sql(spark, d, _STORED).select("event_id", F.translate("p", "<>", "{}").alias("preferences"), "precision")
    voices = spark.createDataFrame([(v[3], v[1]) for v in VOICES if v[0] == "web-speech"], "ord int, id string")
    return playback.migrate_preferences(stored, voices).drop("preferences", "precision")


_UNSTABLE = (
    f"{cte('profile_marks')}, us as (select profile_key, arg_max(action, seq) as a, arg_max(coalesce(reason, ''), seq) as reason, arg_max(coalesce(marked_at, ''), seq) as marked_at from profile_marks "
    "where action = 'clear' or (reason is not null and marked_at is not null) group by profile_key)"
)


@query("a12_unstable_profiles", f"with {_UNSTABLE} select profile_key, reason, marked_at from us where a = 'mark'")
def _(spark, d):
    return playback.unstable_profiles(derive(spark, d, "profile_marks"))


@query(
    "f18_select_runtime",
    f"""with {_UNSTABLE}, {cte('devices')}, j as (select dv.*, u.profile_key is not null and not allow_unstable as avoid, coalesce(minimum_gb, 4e0) as mg from devices dv left join (select profile_key from us where a = 'mark') u using (profile_key)),
k as (select *, coalesce(memory_gb >= mg, true) as enough, coalesce(preferred_device, case when adapter_available and not avoid then 'webgpu' else 'wasm' end) as dev from j)
select event_id, dev as requested_device, case when dev <> 'wasm' then null when avoid then 'unstable_profile' when not adapter_available then 'adapter_unavailable' when not enough then 'memory_gate' end as avoidance_reason,
case when dev <> 'wasm' then null when avoid then '{playback.UNSTABLE_NOTE}' when not adapter_available then '{playback.NO_ADAPTER_NOTE}' when not enough then concat('Device memory is below ', cast(mg::int as varchar), 'GB, so Kokoro is using CPU mode.') end as runtime_reason,
enough and (dev = 'wasm' or adapter_available) as use_neural, case when enough and (dev = 'wasm' or adapter_available) then null when not enough then concat('Insufficient device memory for Kokoro. Required ', cast(mg::int as varchar), 'GB.') else 'WebGPU adapter unavailable for requested device.' end as fallback_message from k""",
)
def _(spark, d):
    unstable = playback.unstable_profiles(derive(spark, d, "profile_marks"))
    done = playback.select_runtime(derive(spark, d, "devices"), unstable)
    return done.select("event_id", "requested_device", "avoidance_reason", "runtime_reason", "use_neural", "fallback_message")


MANIFEST = [("src0", "a", "1", "MIT", "u", None), ("src1", "b", "1", " ", "u", None), ("src2", "c", "1", "MIT", "u", "x")]


def manifest(spark):
    fields = ["id", "packageOrModelName", "versionOrHash", "license", "sourceUrl", "attributionText"]
    return spark.createDataFrame(MANIFEST, ", ".join(f"{f} string" for f in fields))


@query("j4_missing_artifacts", "select distinct source as id from documents where source not in ('src0', 'src1', 'src2')")
def _(spark, d):
    return playback.missing_artifacts(table(spark, d, "documents").select(F.col("source").alias("id")), manifest(spark))


@query(
    "b2_undeclared_ids",
    "select count(distinct source) as used, count(distinct source) filter (source not in ('src0', 'src1', 'src2')) as missing, 1 as incomplete, false as passed from documents",
)
def _(spark, d):
    return playback.manifest_check(table(spark, d, "documents").select(F.col("source").alias("id")), manifest(spark))
