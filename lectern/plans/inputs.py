"""Tables that the registered queries derive from the base tables, as SQL for Spark and for the comparing engine.

`{name}` stands for a base table. One text serves both engines where possible.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from lectern.functions.plan import spread

# name: (Spark SQL, SQL of the comparing engine or None when the same text works)
DERIVED: dict[str, tuple[str, str | None]] = {
    "para_docs": ("select doc_id, lang, replace(text, chr(10), concat(chr(10), chr(10))) as raw from {documents}", None),
    "md_docs": (
        "select doc_id, array_join(transform(split(text, chr(10)), (l, i) -> case (i + 1) % 5 when 1 then concat('## ', l)"
        " when 2 then l when 3 then concat('- ', l) when 4 then concat('> ', l)"
        " else concat('```sql', chr(10), l, chr(10), '```') end), concat(chr(10), chr(10))) as raw from {documents}",
        "select doc_id, array_to_string(list_transform(string_split(text, chr(10)), lambda l, i: case i % 5 when 1 then concat('## ', l)"
        " when 2 then l when 3 then concat('- ', l) when 4 then concat('> ', l)"
        " else concat('```sql', chr(10), l, chr(10), '```') end), concat(chr(10), chr(10))) as raw from {documents}",
    ),
    # Nested and adjacent formats, and references whose definitions come first (even ids) or last (odd ids).
    "inline_docs": (
        "select doc_id, case when doc_id % 2 = 0 then concat('[Ref  ', k, ']: <https://x.example/a b> \"t\"', chr(10), '[ref ', k, ']: /second', chr(10), body)"
        " else concat(body, chr(10), chr(10), '[REF ', k, ']: /only') end as raw from (select doc_id, cast(doc_id as varchar(20)) as k,"
        " array_join(transform(split(replace(text, '*', '+'), chr(10)), (l, i) -> case i % 5"
        " when 0 then concat('a **bold *nested* ', l, '** end')"
        " when 1 then concat('see [the *guide* ', l, '][ref ', cast(doc_id as varchar(20)), '] and [REF ', cast(doc_id as varchar(20)), '][] and [rEf ', cast(doc_id as varchar(20)), '] not [no such][gone]')"
        " when 2 then concat('***both* strong** ', l, ' *a **b***![alt *x*](/i.png)tail snake_case_word 2 * 3')"
        " when 3 then concat('- __x _y_ z__ ', l, ' [in *link*](</u v> \"t\")!')"
        " else concat('> ~', l, ' `code *not*` **open \\\\*esc\\\\*') end), concat(chr(10), chr(10))) as body from {documents})",
        "select doc_id, replace(text, '*', '+') as text from {documents}",
    ),
    "raw_files": (
        "select doc_id, concat('f', cast(doc_id as varchar(20)), case doc_id % 7 when 0 then '.txt' when 1 then '.md' when 2 then '.mdown'"
        " when 3 then '.markdown' when 4 then '.HTML' when 5 then '.pdf' else '' end) as name,"
        " case doc_id % 5 when 0 then '' when 1 then 'text/plain' when 2 then 'application/json' when 3 then 'application/pdf'"
        " else 'text/html;charset=utf-8' end as mime,"
        " case when doc_id % 17 = 0 then concat(chr(7), text) when doc_id % 19 = 0 then '   ' else text end as raw from {documents}",
        None,
    ),
    "dirty_pages": (
        "select page_id, url, replace(replace(replace(html, '<style>',"
        " '<script src=\"/assets/a.js\"></script><link rel=\"x\" href=\"/assets/b.css?v=1\"><style>'), '<article>',"
        " '<iframe src=\"https://evil.example\"></iframe><noscript>no</noscript><article onclick=\"x()\">'), '<footer>',"
        " '<a href=\"javascript:alert(1)\" style=\"a:b\">z</a><footer>') as html from {pages}",
        None,
    ),
    # Nested articles, and meta elements whose texts hold quotes of the other kind.
    "article_pages": (
        "select page_id, url, case page_id % 4 when 1 then replace(html, '<article onclick=\"x()\">', '<article onclick=\"x()\"><article>Inner note. </article>')"
        " when 2 then replace(html, '<title>', '<meta name=\"author\" content=\"Ann O&apos;Neil\"><meta content=\"It''s a long day\" name=\"description\">"
        "<meta property=''og:site_name'' content=''The \"Daily\" > News''><title>') else html end as html from {dirty_pages}",
        None,
    ),
    # Markup that sloppy sanitisers let through, or break.
    "unsafe_pages": (
        "select page_id, replace(html, '<footer>', concat(case page_id % 5 when 0 then '<img src=\"x\"onerror=\"alert(1)\">'"
        " when 1 then '<img src=x onerror=alert(1) <b>' when 2 then '<scr<link>ipt>alert(1)</scr<link>ipt>'"
        " when 3 then '<p>set one=2 and 3 > 1</p>' else '<b title=\"a>b\">x < y</b><a href=\"&#106;avascript:x\">' end, '<footer>')) as html from {dirty_pages}",
        None,
    ),
    # A seventh of the pages has no answer at all, which feeds the branch of failed lookups.
    "dns": (
        "select page_id, case page_id % 6 when 0 then concat('10.', cast(page_id % 256 as varchar(20)), '.0.1') when 1 then '192.168.1.9'"
        " when 2 then '172.31.255.255' when 3 then '172.32.0.1' when 4 then '::ffff:127.0.0.1' else 'fe80::1' end as address"
        " from {pages} where page_id % 7 <> 0 union all select page_id, '93.184.216.34' from {pages} where page_id % 7 <> 0",
        None,
    ),
    "crawl_log": (
        "select page_id, concat('https://c.example/', cast(page_id as varchar(20))) as url,"
        " case page_id % 10 when 0 then 404 when 1 then 301 when 2 then 302 when 3 then 503 else 200 end as status,"
        " case when page_id % 70 = 1 then 'http://10.0.0.1/x' when page_id % 70 = 2 then 'https://quiet.example/x' when page_id % 10 = 1 and page_id % 30 <> 1 then concat('https://c.example/', cast(page_id + 1 as varchar(20)))"
        " when page_id % 10 = 2 then concat('https://c.example/', cast(page_id + 10 as varchar(20))) end as location,"
        " case when page_id % 9 = 0 then 'application/pdf' else 'text/html; charset=utf-8' end as content_type,"
        " case when page_id % 11 = 0 then 3000000 else length(html) end as n_bytes from {pages}",
        None,
    ),
    "link_urls": (
        "select doc_id, concat('https://h.example/p', case doc_id % 5 when 0 then '#/r?' when 1 then '?/r?x=1~and~' else '?' end,"
        " case doc_id % 3 when 0 then 'text64' when 1 then 'b64' else 'text_base64' end, '=', case when doc_id % 8 = 7 then '%%%'"
        " else translate(regexp_replace(base64(encode(text, 'UTF-8')), '[\\\\r\\\\n]', ''), '+/=', '-_') end) as url from {documents}",
        "",
    ),
    "telemetry": (
        "select user_id as session_id, event_id as seq, ts as event_ts, case when event_id % 23 = 5 then 'tts.degraded_mode' when event_id % 29 = 7 then 'tts.runtime_downgrade'"
        " when event_id % 31 = 9 then 'tts.export_build_outcome' else case event_type when 'click' then 'tts.segment_synth'"
        " when 'view' then 'tts.first_audio' when 'signup' then 'tts.model_load' when 'error' then 'tts.synth_failure'"
        " else 'tts.queue_transition' end end as type, concat('seg_', cast(event_id % 50 as varchar(20))) as segment_id,"
        " value * 10 as duration_ms, case when event_id % 29 = 7 then 'probe failed on webgpu' when event_type = 'error' then case event_id % 6 when 0 then 'duration_too_short'"
        " when 1 then 'regen_exhausted' when 2 then 'Audio playback failed: NotAllowedError' when 3 then 'wasm out of memory'"
        " when 4 then 'WebGPU adapter lost' else 'timeout' end end as reason,"
        " case when event_type = 'purchase' then event_id % 20 = 0 end as is_underrun from {events}",
        None,
    ),
    "pcm_clips": (
        "select vec_id as clip_id, label as doc_id, vec_id as position, embedding as ch0, case when vec_id % 3 = 0 then 1 else 2 end as n_channels,"
        " case when vec_id % 2 = 0 then 8000 else 16000 end as sample_rate from {embeddings}",
        None,
    ),
    "synth_results": (
        "select conv_id as doc_id, turn as position, concat('seg_', cast(conv_id as varchar(20)), '_', cast(turn as varchar(20))) as segment_id,"
        " text, (conv_id * 31 + turn * 7) % 23 <> 0 as ok, length(text) / 4e0 / 2.6e0 * 25e-2 * (8e-1 + (turn % 5) / 10e0) as duration_s,"
        " case when (conv_id + turn) % 13 = 0 then 0 else 44 + length(text) * 100 end as n_bytes from {conversations}",
        None,
    ),
    "anchors": (
        "select conv_id as doc_id, turn as anchor_idx, cast(floor(turn / 2) as int) as playback_idx,"
        " case when turn % 2 = 0 then 0 else 40 end as char_offset from {conversations}",
        None,
    ),
    "synth_cache": (
        "select concat('seg_', cast(conv_id as varchar(20)), '_', cast(turn as varchar(20))) as cache_key,"
        " case (conv_id + turn) % 4 when 0 then 'ready' when 1 then 'loading' when 2 then 'queued' else 'error' end as status,"
        " case when (conv_id + turn) % 4 = 0 then concat('blob:', cast(conv_id as varchar(20)), '/', cast(turn as varchar(20))) end as audio_url"
        " from {conversations} where (conv_id * 3 + turn) % 5 <> 0",
        None,
    ),
    "outcomes": (
        "select user_id as session_id, event_id as seq, case event_type when 'click' then 'wasm' when 'view' then 'wasm' when 'signup' then 'ok'"
        " when 'error' then 'other' else case when event_id % 3 = 0 then 'reset' else 'wasm' end end as outcome from {events}",
        None,
    ),
    "commands": (
        "select user_id as session_id, event_id as seq, case event_type when 'click' then 'SET_STATE' when 'view' then 'SET_INDEX'"
        " when 'signup' then 'SET_CHAR_OFFSET' when 'error' then 'SET_ERROR' else 'RESET_ERROR' end as action,"
        " case when event_type = 'click' then case event_id % 4 when 0 then 'loading' when 1 then 'playing' when 2 then 'paused' else 'finished' end end as state,"
        " case when event_type = 'view' then cast(event_id % 9 as int) end as index,"
        " case when event_type = 'signup' then cast(event_id % 300 as int) end as char_offset,"
        " case when event_type = 'error' then concat('failure ', cast(event_id % 5 as varchar(20))) end as error from {events}",
        None,
    ),
    "devices": (
        "select event_id, concat('profile_', cast(user_id as varchar(20))) as profile_key, event_id % 3 <> 0 as adapter_available,"
        " event_id % 4 <> 0 as has_gpu, case event_id % 5 when 0 then null when 1 then 2e0 when 2 then 4e0 when 3 then 8e0 else 6e0 end as memory_gb,"
        " case event_id % 7 when 0 then 'webgpu' when 1 then 'wasm' end as preferred_device, event_id % 11 = 0 as allow_unstable,"
        " case when event_id % 6 = 0 then 8e0 end as minimum_gb from {events}",
        None,
    ),
    "profile_marks": (
        "select concat('profile_', cast(user_id as varchar(20))) as profile_key, event_id as seq,"
        " case when event_type = 'view' then 'clear' else 'mark' end as action,"
        " case when event_id % 13 <> 0 then concat('reason ', cast(event_id % 4 as varchar(20))) end as reason,"
        " case when event_id % 17 <> 0 then cast(event_id as varchar(20)) end as marked_at from {events}",
        None,
    ),
}
DERIVED["link_urls"] = (
    DERIVED["link_urls"][0],
    "select doc_id, concat('https://h.example/p', case doc_id % 5 when 0 then '#/r?' when 1 then '?/r?x=1~and~' else '?' end,"
    " case doc_id % 3 when 0 then 'text64' when 1 then 'b64' else 'text_base64' end, '=', case when doc_id % 8 = 7 then '%%%'"
    " else replace(replace(replace(to_base64(encode(text)), '+', '-'), '/', '_'), '=', '') end) as url from {documents}",
)


TEXT_TABLES = ("documents", "pages", "conversations")  # heavy work per row follows


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(df) if name in TEXT_TABLES else df


def sql(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    """Run SQL in which `{name}` stands for a base table or a derived one."""
    names = set(re.findall(r"\{(\w+)\}", text))
    frames = {n: derive(spark, sf_dir, n) if n in DERIVED else table(spark, sf_dir, n) for n in names}
    return spark.sql(text, **frames)


def derive(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return sql(spark, sf_dir, DERIVED[name][0])


def cte(*names: str) -> str:
    """`name as (...)` list of derived tables for the comparing engine."""
    parts = []
    for name in names:
        spark_sql, other = DERIVED[name]
        parts.append(f"{name} as ({re.sub(r'[{}]', '', other or spark_sql)})")
    return ", ".join(parts)
