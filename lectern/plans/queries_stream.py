"""Streaming queries: each reads a table as a stream in small steps, runs to the end, and returns the final table."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.plans.inputs import DERIVED, cte
from lectern.plans.queries_corpus import _F4, PARA, raw_docs
from lectern.plans.queries_telemetry import _CATEGORY, DEGRADE, RECENT, TEL
from lectern.plans.registry import query
from lectern.session import work_folder
from lectern.sources import writers
from lectern.streaming import live


BATCHES = 4  # at least
ROWS_PER_FILE, FILES_PER_BATCH = 500_000, 64  # at most
TEXTS_PER_FILE = 8_000  # whole texts are far wider rows: a batch needs enough files to keep all cores busy


def arrivals(df: DataFrame, key: str, late: int | None = None, after: DataFrame | None = None, per_file: int | None = None) -> DataFrame:
    """A stream of the rows of `df` in the order of an integer key.

    The rows are dealt out to files of bounded size by ranges of the key, in one parallel write, and the files are dated in
    that order; so the number of files, and of micro-batches of bounded size, grows with the rows. The range `late` comes
    behind all others, and the rows `after` in a last file.
    """
    spark = df.sparkSession
    low, high, rows = df.agg(F.min(key), F.max(key), F.count(F.lit(1))).first()
    ranges = file_count(rows, per_file)
    width = (high - low + 1) if rows else 1
    place = F.expr(f"cast(({key} - {low or 0}) * {ranges} div {width} as int)")
    dealt = df.withColumn("arrival", place)
    if after is not None:
        dealt = dealt.unionByName(after.withColumn("arrival", F.lit(ranges)))
    files = ranges + (after is not None)
    folder = work_folder(spark, "arrivals")
    dealt.repartitionById(files, "arrival").drop("arrival").write.parquet(folder)
    date_files(spark, folder, [late])
    per_batch = min(FILES_PER_BATCH, -(-files // BATCHES))
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", per_batch).parquet(folder)


def file_count(rows: int, per_file: int | None = None) -> int:
    return max(2 * BATCHES, -(-rows // (per_file or ROWS_PER_FILE)))


def date_files(spark: SparkSession, folder: str, late: list) -> None:
    """Modification times in the order of the files' numbers, those in `late` behind the other numbered ranges."""
    place, fs = live._folder(spark, folder)
    names = sorted(s.getPath().getName() for s in fs.listStatus(place) if s.getPath().getName().startswith("part-"))
    number = lambda name: int(name.split("-")[1])
    last = max(map(number, names), default=0)
    order = sorted(names, key=lambda n: (number(n) in late, number(n)) if number(n) < last or not any(x is not None for x in late) else (True, last + 1))
    start = int(time.time()) - len(order) - 60
    for i, name in enumerate(order):
        fs.setTimes(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}"), (start + i) * 1000, -1)


def as_stream(spark: SparkSession, d: str, name: str, late: int | None = None, after: DataFrame | None = None) -> DataFrame:
    """A derived table whose base table arrives in several micro-batches, in the order of its id."""
    base, key = ("documents", "doc_id") if name == "para_docs" else ("events", "event_id")
    per_file = TEXTS_PER_FILE if base == "documents" else ROWS_PER_FILE
    stream = arrivals(spark.read.parquet(f"{d}/{base}.parquet"), key, late, after, per_file)
    return spark.sql(DERIVED[name][0], **{base: stream})


def plain_times(df: DataFrame) -> DataFrame:
    """Window bounds without a zone, as the event times came."""
    return df.withColumn("window_start", F.col("window_start").cast("timestamp_ntz")).withColumn(
        "window_end", F.col("window_end").cast("timestamp_ntz")
    )


def finish(started) -> None:
    started.awaitTermination()


@query("t1_stream_segments", f"{PARA} select doc_id, position, segment_id, text from seg")
def _(spark, d):
    out, mark = work_folder(spark, "segments"), work_folder(spark, "mark")
    segments = live.stream_segments(as_stream(spark, d, "para_docs")).select("doc_id", "position", "segment_id", "text")
    finish(live.append_to(segments, out, mark))
    return spark.read.parquet(out)


@query("t2_stream_classify", f"{TEL}, c as (select *, {_CATEGORY} as category from telemetry) select session_id, seq, category, reason as message from c where category is not null")
def _(spark, d):
    out, mark = work_folder(spark, "classified"), work_folder(spark, "mark")
    finish(live.append_to(live.stream_classify(as_stream(spark, d, "telemetry")).select("session_id", "seq", "category", "message"), out, mark))
    return spark.read.parquet(out)


@query("t3_stream_counters", f"{TEL} select session_id, count(*) filter (type = 'tts.synth_failure') as synth_failures, count(*) filter (type = 'tts.degraded_mode') as fallback_activations from telemetry group by session_id")
def _(spark, d):
    out, mark = work_folder(spark, "counters"), work_folder(spark, "mark")
    finish(live.changes_to(live.stream_counters(as_stream(spark, d, "telemetry"), "session_id"), out, mark, "session_id"))
    return live.latest_changes(spark, out, "session_id")


@query(
    "t4_stream_first_audio",
    f"{TEL} select session_id, min(seq) as seq, arg_min(duration_ms, seq) as duration_ms, arg_min(segment_id, seq) as segment_id from telemetry where type = 'tts.first_audio' group by session_id",
)
def _(spark, d):
    out, mark = work_folder(spark, "first"), work_folder(spark, "mark")
    finish(live.changes_to(live.stream_first_audio(as_stream(spark, d, "telemetry")), out, mark, "session_id"))
    return live.latest_changes(spark, out, "session_id")


@query("t5_stream_recent", f"{RECENT} select session_id, category, seq, segment_id, reason as message from k where rank <= 20")
def _(spark, d):
    out, mark = work_folder(spark, "recent"), work_folder(spark, "mark")
    finish(live.changes_to(live.stream_recent(as_stream(spark, d, "telemetry")), out, mark, "session_id", "category"))
    return live.recent_rows(live.latest_changes(spark, out, "session_id", "category"))


@query(
    "t6_stream_degrade",
    f"{DEGRADE} select session_id, max(seq) as seq, arg_max(case when degraded then 3 else raw end, seq) as wasm_failures, arg_max(degraded, seq) as degraded from c group by session_id",
)
def _(spark, d):
    out, mark = work_folder(spark, "degrade"), work_folder(spark, "mark")
    finish(live.changes_to(live.stream_degrade(as_stream(spark, d, "outcomes")), out, mark, "session_id"))
    return live.latest_changes(spark, out, "session_id")


DERIVED["cursor_moves"] = (
    "select concat('doc_', cast(user_id as varchar(20))) as doc_key, event_id as seq, cast(event_id % 12 - 2 as int) as segment_index, cast(event_id % 90 - 20 as int) as char_offset from {events}",
    None,
)
_CURSOR = f"with {cte('cursor_moves')} select doc_key, max(seq) as seq, greatest(arg_max(segment_index, seq), 0) as segment_index, greatest(arg_max(char_offset, seq), 0) as char_offset from cursor_moves group by doc_key"


@query("s9_upsert_cursor", _CURSOR)
def _(spark, d):
    out, mark = work_folder(spark, "cursors"), work_folder(spark, "mark")
    finish(live.changes_to(writers.latest_cursors(as_stream(spark, d, "cursor_moves")), out, mark, "doc_key"))
    return live.latest_changes(spark, out, "doc_key")


@query("t7_latest_cursor", _CURSOR)
def _(spark, d):
    moves = spark.sql(DERIVED["cursor_moves"][0], events=spark.read.parquet(f"{d}/events.parquet"))
    return writers.latest_cursors(moves)


_LATE = "(select max(event_ts) - interval 10 minutes from telemetry)"


@query(
    "t8_stream_budget",
    f"{TEL}, w as (select time_bucket(interval 1 hour, event_ts) as window_start, count(duration_ms) filter (type = 'tts.segment_synth') as n_synth, quantile_disc(duration_ms, 0.5) filter (type = 'tts.segment_synth') as p50_ms, quantile_disc(duration_ms, 0.95) filter (type = 'tts.segment_synth') as p95_ms, count(*) filter (coalesce(is_underrun, false)) as underruns, "
    "count(*) filter (type = 'tts.queue_transition') as transitions from telemetry group by 1) select window_start, window_start + interval 1 hour as window_end, n_synth, p50_ms, p95_ms, underruns, transitions, "
    f"case when transitions > 0 then round(underruns / transitions::double, 9) end as underrun_rate from w where window_start + interval 1 hour <= {_LATE}",
)
def _(spark, d):
    out, mark = work_folder(spark, "budget"), work_folder(spark, "mark")
    finish(live.append_to(live.stream_budget(as_stream(spark, d, "telemetry")), out, mark))
    rate = F.round("underrun_rate", 9)
    return plain_times(spark.read.parquet(out).withColumn("underrun_rate", rate))


@query(
    "t8_stream_session_budget",
    f"""{TEL}, g as (select *, case when event_ts - lag(event_ts) over w < interval 30 minutes then 0 else 1 end as fresh from telemetry window w as (partition by session_id order by event_ts, seq)),
s as (select *, sum(fresh) over (partition by session_id order by event_ts, seq) as burst from g)
select session_id, min(event_ts) as window_start, max(event_ts) + interval 30 minutes as window_end, count(*) as n_events, count(*) filter (coalesce(is_underrun, false)) as underruns
from s group by session_id, burst having max(event_ts) + interval 30 minutes <= {_LATE}""",
)
def _(spark, d):
    out, mark = work_folder(spark, "bursts"), work_folder(spark, "mark")
    finish(live.append_to(live.stream_session_budget(as_stream(spark, d, "telemetry")), out, mark))
    return plain_times(spark.read.parquet(out))


@query(
    "t1_stream_routes",
    f"{_F4.replace('select doc_id, coalesce(nullif(route', 'select f.* exclude (warning, error_code, error_message, n_segments), n_segments::int as n_segments, error_code is null as accepted, error_code, error_message from (select doc_id, coalesce(nullif(route', 1)}) f",
)
def _(spark, d):
    """Files, pasted texts and extractor answers arrive mixed; the tables of all batches are put side by side."""
    out, mark = work_folder(spark, "ingested"), work_folder(spark, "mark")
    docs = raw_docs(spark, d).withColumn("n", F.crc32(F.col("doc_id").cast("binary")))
    finish(live.ingest_to(arrivals(docs, "n", per_file=TEXTS_PER_FILE).drop("n"), out, mark))
    index, rejects = live.ingested(spark, out, "documents"), live.ingested(spark, out, "rejects")
    counted = live.ingested(spark, out, "segments").groupBy("doc_id").agg(F.count(F.lit(1)).cast("int").alias("n_segments"))
    done = index.select("doc_id", "route", "title", "accepted").join(counted, "doc_id", "left").join(rejects.drop("v"), "doc_id", "left")
    return done.withColumn("n_segments", F.coalesce("n_segments", F.lit(0)))


DERIVED["timed_outcomes"] = (DERIVED["outcomes"][0].replace("event_id as seq,", "event_id as seq, ts as event_ts,"), None)
_IDLE = "interval 12 hours"
_BURSTS = f"""with {cte('timed_outcomes')}, g as (select *, case when event_ts - lag(event_ts) over w <= {_IDLE} then 0 else 1 end as fresh from timed_outcomes window w as (partition by session_id order by event_ts, seq)),
s as (select *, sum(fresh) over (partition by session_id order by event_ts, seq) as burst from g),
a as (select *, sum((outcome in ('ok', 'reset'))::int) over w as g, sum((outcome = 'reset')::int) over w as e from s window w as (partition by session_id, burst order by seq)),
b as (select *, sum((outcome = 'wasm')::int) over (partition by session_id, burst, g order by seq) as raw from a),
c as (select *, bool_or(raw >= 3) over (partition by session_id, burst, e order by seq) as degraded from b)
select session_id, min(event_ts) as begin, max(seq) as seq, arg_max(case when degraded then 3 else raw end, seq) as wasm_failures, arg_max(degraded, seq) as degraded from c group by session_id, burst"""


@query("t6_stream_degrade_bursts", _BURSTS)
def _(spark, d):
    """The degrade state of each burst of activity; timers drop the state of sessions that went idle."""
    out, mark = work_folder(spark, "bursts"), work_folder(spark, "mark")
    finish(live.changes_to(live.stream_degrade_bursts(as_stream(spark, d, "timed_outcomes")), out, mark, "session_id", "begin", rocksdb=True))
    return live.latest_changes(spark, out, "session_id", "begin").withColumn("begin", F.col("begin").cast("timestamp_ntz"))


@query(
    "t5_stream_recent_bursts",
    f"""{TEL}, c as (select *, {_CATEGORY} as category from telemetry), g as (select *, case when event_ts - lag(event_ts) over w <= {_IDLE} then 0 else 1 end as fresh from c where category is not null window w as (partition by session_id, category order by event_ts, seq)),
s as (select *, sum(fresh) over (partition by session_id, category order by event_ts, seq) as burst from g),
k as (select *, min(event_ts) over (partition by session_id, category, burst) as begin, row_number() over (partition by session_id, category, burst order by seq desc) as rank from s)
select session_id, category, begin, seq, segment_id, reason as message from k where rank <= 20""",
)
def _(spark, d):
    out, mark = work_folder(spark, "recent"), work_folder(spark, "mark")
    finish(live.changes_to(live.stream_recent_bursts(as_stream(spark, d, "telemetry")), out, mark, "session_id", "category", "begin", rocksdb=True))
    newest = live.latest_changes(spark, out, "session_id", "category", "begin")
    return live.recent_rows(newest, "begin").withColumn("begin", F.col("begin").cast("timestamp_ntz"))


# The second of all ranges arrives behind the others, then one event of a later day, which closes all windows. A batch
# leaves out rows whose window had closed by what came before the batch in front of it.
_LATE_ROWS = f"""{TEL}, b as (select min(seq) as low, max(seq) - min(seq) + 1 as width, greatest({2 * BATCHES}, ceil(count(*) / {ROWS_PER_FILE}.0)::bigint) as n from telemetry),
r as (select t.*, (seq - low) * n // width as range, n, least({FILES_PER_BATCH}, (n + {BATCHES}) // {BATCHES}) as per from telemetry t, b),
p as (select *, case when range = 0 then 0 when range = 1 then n - 1 else range - 1 end // per as batch from r),
m as (select batch, max(event_ts) as newest from p group by batch),
k as (select p.*, (select max(newest) from m where m.batch <= p.batch - 2) - interval 10 minutes as closed from p),
w as (select time_bucket(interval 1 hour, event_ts) as window_start, count(duration_ms) filter (type = 'tts.segment_synth') as n_synth, count(*) filter (coalesce(is_underrun, false)) as underruns, count(*) filter (type = 'tts.queue_transition') as transitions
 from k where closed is null or time_bucket(interval 1 hour, event_ts) + interval 1 hour > closed group by 1)
select window_start, window_start + interval 1 hour as window_end, n_synth, underruns, transitions from w"""


@query("t8_stream_late_rows", _LATE_ROWS)
def _(spark, d):
    """Windows of a stream in which a part of the rows arrives too late to count."""
    events = spark.read.parquet(f"{d}/events.parquet")
    later = events.agg(F.max("event_id") + 1, F.max("ts") + F.expr("interval 1 day")).toDF("event_id", "ts")
    closing = later.select(*[F.col(c).cast(t).alias(c) if c in later.columns else F.lit(None).cast(t).alias(c) for c, t in events.dtypes])
    out, mark = work_folder(spark, "budget"), work_folder(spark, "mark")
    stream = as_stream(spark, d, "telemetry", late=1, after=closing)
    finish(live.append_to(live.stream_budget(stream).select("window_start", "window_end", "n_synth", "underruns", "transitions"), out, mark))
    return plain_times(spark.read.parquet(out))
