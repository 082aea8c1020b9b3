"""Streams over arriving documents and telemetry.

Stateless operators are the batch ones applied to a stream; `ingest_to` routes, segments and fingerprints arriving
documents of every kind into several tables that agree after any crash. Aggregates use built-in streaming aggregation, which combines
on the map side first. The two order-dependent ones (last entries, degrade state) keep a few values per key in Spark's
state store; a micro-batch brings only its own rows of a key to one task, so `maxFilesPerTrigger` (or the source's like)
bounds what a hot session costs. Changed rows go to one folder per micro-batch; a repeated batch rewrites its own, readers
take committed folders only, and old folders are merged from time to time. State that belongs to a burst of activity
(`stream_degrade_bursts`, `stream_recent_bursts`) is dropped by an event-time timer once the session has been idle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from lectern import policies as P
from lectern.operators import documents, telemetry
from lectern.plans import ingest
from lectern.sources import readers

MERGE_AFTER = 50  # committed folders of changes before they are merged


def append_to(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Write an append-only stream to parquet, everything available now."""
    return (
        stream.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )


PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def changes_to(stream: DataFrame, path: str, checkpoint: str, *keys: str, rocksdb: bool = False) -> StreamingQuery:
    """Write the changed rows of a stream in update mode, one row per key, one folder per micro-batch.

    What is merged away stays until the next merge, so a reader that holds the older list of folders still finds them.
    `rocksdb` keeps the state of this query in RocksDB, which streams with timers need.
    """

    def save(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/v={batch_id}")
        spark = batch.sparkSession
        done = committed(spark, path)
        if len(done) > MERGE_AFTER:
            for kind, version in merged_away(spark, path):
                delete(spark, f"{path}/{kind}={version}")
            newest_changes(spark, path, done, *keys).write.mode("overwrite").parquet(f"{path}/upto={done[-1][1]}")

    writer = stream.writeStream.foreachBatch(save).outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True)
    conf = stream.sparkSession.conf
    before = conf.get(PROVIDER)
    try:
        if rocksdb:
            conf.set(PROVIDER, ROCKSDB)
        return writer.start()  # a query keeps the settings it was started with
    finally:
        conf.set(PROVIDER, before)


def _folder(spark: SparkSession, path: str):
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def delete(spark: SparkSession, path: str) -> None:
    place, fs = _folder(spark, path)
    fs.delete(place, True)


def committed(spark: SparkSession, path: str) -> list[tuple[str, int]]:
    """Committed folders that count, in order: the last merged one and the batches after it. Merging bounds the list."""
    found = _marked_folders(spark, path)
    merged = max((v for kind, v in found if kind == "upto"), default=-1)
    return sorted(((kind, v) for kind, v in found if v > merged or (kind, v) == ("upto", merged)), key=lambda x: x[1])


def merged_away(spark: SparkSession, path: str) -> list[tuple[str, int]]:
    """Committed folders that a merged one has replaced."""
    return sorted(set(_marked_folders(spark, path)) - set(committed(spark, path)))


def _marked_folders(spark: SparkSession, path: str) -> list[tuple[str, int]]:
    place, fs = _folder(spark, path)
    if not fs.exists(place):
        return []
    found = []
    for entry in fs.listStatus(place):
        kind, _, version = entry.getPath().getName().partition("=")
        marker = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(entry.getPath(), "_SUCCESS")
        if kind in ("v", "upto") and version.isdigit() and fs.exists(marker):
            found.append((kind, int(version)))
    return found


def newest_changes(spark: SparkSession, path: str, folders: list[tuple[str, int]], *keys: str) -> DataFrame:
    """Newest row per key of some folders."""
    parts = [spark.read.parquet(f"{path}/{kind}={version}").withColumn("_v", F.lit(version)) for kind, version in folders]
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    values = [c for c in rows.columns if c not in (*keys, "_v")]
    newest = F.max_by(F.struct(*values), F.col("_v")).alias("_n")
    grouped = rows.groupBy(*keys).agg(newest) if keys else rows.agg(newest)
    return grouped.select(*keys, "_n.*")


def latest_changes(spark: SparkSession, path: str, *keys: str) -> DataFrame:
    """Newest row per key of what `changes_to` has committed."""
    return newest_changes(spark, path, committed(spark, path), *keys)


def events_to(lines: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Arriving JSON lines into the tables `rejects` and `events`; `events` commits a batch for both, as in `ingest_to`."""

    def save(batch: DataFrame, batch_id: int) -> None:
        judged = readers.judge_events(batch)
        readers.rejected_events(judged).write.mode("overwrite").parquet(f"{path}/rejects/v={batch_id}")
        readers.accepted_events(judged).write.mode("overwrite").parquet(f"{path}/events/v={batch_id}")

    return lines.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


TABLES = ("segments", "rejects", "documents")  # the last one commits a batch


def ingest_to(raw_docs: DataFrame, path: str, checkpoint: str, policy: P.ReadPolicy = P.PLAIN_READING, key: str = "doc_id") -> StreamingQuery:
    """Arriving files, pasted texts and extractor answers into the tables `segments`, `rejects` and `documents`.

    `plans.ingest.route_ingest` has the columns and rules. Each micro-batch is routed once and written to a folder of its
    number in every table, `documents` last: that folder's marker commits the batch for all three. A batch that is
    repeated after a crash overwrites its own folders, so no table holds rows twice or without the others.
    """

    def save(batch: DataFrame, batch_id: int) -> None:
        spark, place = batch.sparkSession, lambda table: f"{path}/{table}/v={batch_id}"
        documents.document_fingerprint(ingest.route_ingest(batch, policy)).write.mode("overwrite").parquet(place("nested"))
        done = spark.read.parquet(place("nested"))
        good = F.col("error_code").isNull()
        done.filter(good).select(key, F.inline("segments")).write.mode("overwrite").parquet(place("segments"))
        done.filter(~good).select(key, "error_code", "error_message").write.mode("overwrite").parquet(place("rejects"))
        index = documents.document_index(done, key, "route").withColumn("accepted", F.col("warnings.severity").isNull() | ~F.array_contains("warnings.severity", "error"))
        index.write.mode("overwrite").parquet(place("documents"))
        delete(spark, place("nested"))

    return raw_docs.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def ingested(spark: SparkSession, path: str, table: str, last: str = TABLES[-1]) -> DataFrame:
    """Rows of one of the tables from all batches that the table written last has committed; `v` is the batch."""
    done = [v for kind, v in _marked_folders(spark, f"{path}/{last}") if kind == "v"]
    return spark.read.parquet(f"{path}/{table}").filter(F.col("v").isin(done))


def stream_segments(docs: DataFrame, raw: str = "raw", key: str = "doc_id") -> DataFrame:
    return documents.explode_segments(documents.segment_text(docs, raw), key)


def stream_classify(events: DataFrame) -> DataFrame:
    return telemetry.classify_perf_event(events).filter("category is not null")


def stream_counters(events: DataFrame, *keys: str) -> DataFrame:
    return telemetry.telemetry_counters(events, *keys)


def stream_first_audio(events: DataFrame) -> DataFrame:
    """First first-audio event per session; one small row of state per session."""
    first = F.min(F.struct("seq", "duration_ms", "segment_id")).alias("f")
    return events.filter("type = 'tts.first_audio'").groupBy("session_id").agg(first).select("session_id", "f.*")


RECENT = "session_id long, category string, seqs array<long>, segment_ids array<string>, messages array<string>"
RECENT_STATE = "seqs array<long>, segment_ids array<string>, messages array<string>"


def stream_recent(events: DataFrame, keep: int = P.RECENT_ENTRIES) -> DataFrame:
    """The last entries per session and category as arrays, newest first; at most `keep` of them are state of a group.

    One row per changed group and micro-batch, for `changes_to`; `recent_rows` lists the entries.
    """

    def add(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        old = dict(zip(("seq", "segment_id", "message"), state.get, strict=True)) if state.exists else {}
        rows = pd.DataFrame(old, columns=["seq", "segment_id", "message"])
        for frame in frames:
            new = frame[["seq", "segment_id", "message"]]
            rows = (pd.concat([rows, new]) if len(rows) else new).sort_values("seq", ascending=False).head(keep)
        lists = tuple([None if x is None or x != x else x for x in rows[c].tolist()] for c in ("seq", "segment_id", "message"))
        lists = ([int(x) for x in lists[0]], *lists[1:])
        state.update(lists)
        yield pd.DataFrame({"session_id": [key[0]], "category": [key[1]], "seqs": [lists[0]], "segment_ids": [lists[1]], "messages": [lists[2]]})

    shown = telemetry.classify_perf_event(events).filter("category is not null").select("session_id", "category", "seq", "segment_id", "message")
    return shown.groupBy("session_id", "category").applyInPandasWithState(add, RECENT, RECENT_STATE, "update", GroupStateTimeout.NoTimeout)


def recent_rows(recent: DataFrame, *keys: str) -> DataFrame:
    """One row per entry of `stream_recent`; `keys` are more columns to keep."""
    entries = F.arrays_zip(F.col("seqs").alias("seq"), F.col("segment_ids").alias("segment_id"), F.col("messages").alias("message"))
    return recent.select("session_id", "category", *keys, F.inline(entries))


DEGRADE = "session_id long, seq long, wasm_failures long, degraded boolean"
DEGRADE_STATE = "seq long, failures long, degraded boolean"


def degrade_fold(outcome: np.ndarray, count: int, latched: bool, limit: int) -> tuple[int, bool]:
    """Counter and latch after more outcomes, in their order. `playback.degrade_state` has the rules."""
    up = count + np.cumsum(outcome == "wasm")
    raw = up - np.maximum.accumulate(np.where(np.isin(outcome, ("ok", "reset")), up, 0))
    last_hit = np.flatnonzero(raw >= limit)[-1:]
    last_reset = np.flatnonzero(outcome == "reset")[-1:]
    if len(last_reset):
        return int(raw[-1]), bool(len(last_hit) and last_hit[0] > last_reset[0])
    return int(raw[-1]), bool(latched or len(last_hit))


def stream_degrade(results: DataFrame, limit: int = P.WASM_FAILURE_LIMIT) -> DataFrame:
    """Degrade state per session after all events so far, one row per changed session and micro-batch.

    State is a counter and a latch. The events of a session arrive in `seq` order across micro-batches; inside one they
    are sorted. `playback.degrade_state` has the rules.
    """

    def advance(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seq, count, latched = state.get if state.exists else (None, 0, False)
        rows = pd.concat(list(frames)).sort_values("seq")
        count, latched = degrade_fold(rows["outcome"].to_numpy(), count, latched, limit)
        seq = int(rows["seq"].iloc[-1]) if seq is None else max(int(seq), int(rows["seq"].iloc[-1]))
        state.update((seq, count, latched))
        yield pd.DataFrame({"session_id": [key[0]], "seq": [seq], "wasm_failures": [limit if latched else count], "degraded": [latched]})

    needed = results.select("session_id", "seq", "outcome")
    return needed.groupBy("session_id").applyInPandasWithState(advance, DEGRADE, DEGRADE_STATE, "update", GroupStateTimeout.NoTimeout)


class _Burst(StatefulProcessor):
    """Folds the rows of a key, burst by burst. A burst ends where the key has been idle for longer than `idle` micros.

    The gap itself is judged on the rows, so results do not depend on when timers fire; the timer drops the state of a
    burst that has ended, so what is kept is bounded by the sessions active of late. A call for a key is a few rows, so
    they stay plain rows, and all state of a key is one value: it is read once and written once.
    """

    COLUMNS = Row()  # of the result
    STATE = ""
    EMPTY: tuple = ()  # state of a burst that begins

    def __init__(self, idle: int):
        self.idle = idle
        # Read here, as workers have no session.
        self.schema = StructType.fromDDL(f"begin long, last long, timer long, {self.STATE}")

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.kept = handle.getValueState("kept", self.schema)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: N802, N803
        rows = sorted(rows, key=lambda r: (r["at"], r["seq"]))
        begin, last, timer, *state = self.kept.get() or (None, None, None)
        first = 0
        for end in range(1, len(rows) + 1):
            if end < len(rows) and rows[end]["at"] - rows[end - 1]["at"] <= self.idle:
                continue
            if begin is None or rows[first]["at"] - last > self.idle:
                begin, last, state = rows[first]["at"], rows[first]["at"], self.EMPTY
            last = max(rows[end - 1]["at"], last)
            state, row = self.fold(tuple(state), rows[first:end])
            yield self.COLUMNS(*key, begin, *row)
            first = end
        due = (last + self.idle) // 1000 + 1
        if due != timer:
            if timer is not None:
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(due)
        self.kept.update((begin, last, due, *state))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        self.kept.clear()
        return iter(())

    def close(self) -> None:
        pass


class _DegradeBurst(_Burst):
    COLUMNS = Row("session_id", "begin", "seq", "wasm_failures", "degraded")
    STATE = "seq long, failures long, degraded boolean"
    EMPTY = (-1, 0, False)

    def __init__(self, idle: int, limit: int):
        super().__init__(idle)
        self.limit = limit

    def fold(self, state, rows):
        seq, count, latched = state
        count, latched = degrade_fold(np.array([r["outcome"] for r in rows], object), count, latched, self.limit)
        seq = max(seq, *(r["seq"] for r in rows))
        return (seq, count, latched), (seq, self.limit if latched else count, latched)


class _RecentBurst(_Burst):
    COLUMNS = Row("session_id", "category", "begin", "seqs", "segment_ids", "messages")
    STATE = "seqs array<long>, segment_ids array<string>, messages array<string>"
    EMPTY = ([], [], [])

    def __init__(self, idle: int, keep: int):
        super().__init__(idle)
        self.keep = keep

    def fold(self, state, rows):
        new = [(r["seq"], r["segment_id"], r["message"]) for r in rows]
        newest = sorted([*zip(*state, strict=True), *new], key=lambda e: -e[0])[: self.keep]
        lists = tuple([e[i] for e in newest] for i in range(3))
        return lists, lists


def _with_instant(events: DataFrame, late: str) -> DataFrame:
    return _timed(events, late).withColumn("at", F.unix_micros("event_ts"))


def stream_degrade_bursts(results: DataFrame, idle: str = "12 hours", late: str = "10 minutes", limit: int = P.WASM_FAILURE_LIMIT) -> DataFrame:
    """Degrade state per session and burst of activity, one row per burst that a micro-batch has changed.

    Reads session_id, seq, event_ts and outcome. The counter and the latch start anew when a session was idle for longer
    than `idle`. Rows later than the watermark are left out. For `changes_to` with `rocksdb`.
    """
    needed = _with_instant(results.select("session_id", "seq", "event_ts", "outcome"), late)
    made = needed.groupBy("session_id").transformWithState(
        _DegradeBurst(_micros(idle), limit), "session_id long, begin long, seq long, wasm_failures long, degraded boolean", "Update", "EventTime"
    )
    return made.withColumn("begin", F.timestamp_micros("begin"))


def stream_recent_bursts(events: DataFrame, idle: str = "12 hours", late: str = "10 minutes", keep: int = P.RECENT_ENTRIES) -> DataFrame:
    """The last entries per session, category and burst of activity as arrays, newest first; see `stream_degrade_bursts`."""
    shown = telemetry.classify_perf_event(events).filter("category is not null").select("session_id", "category", "seq", "event_ts", "segment_id", "message")
    made = _with_instant(shown, late).groupBy("session_id", "category").transformWithState(
        _RecentBurst(_micros(idle), keep),
        "session_id long, category string, begin long, seqs array<long>, segment_ids array<string>, messages array<string>", "Update", "EventTime",
    )
    return made.withColumn("begin", F.timestamp_micros("begin"))


def _micros(interval: str) -> int:
    return int(pd.Timedelta(interval).value // 1000)


def _window_metrics(events: DataFrame, window: Column) -> DataFrame:
    timed = F.when(F.col("type") == "tts.segment_synth", F.col("duration_ms"))
    return (
        events.groupBy(window.alias("w"))
        .agg(
            F.count(timed).alias("n_synth"),
            F.percentile_approx(timed, [0.5, 0.95], 10000).alias("p"),
            F.count_if(F.coalesce("is_underrun", F.lit(False))).alias("underruns"),
            F.count_if(F.col("type") == "tts.queue_transition").alias("transitions"),
        )
        .select(
            F.col("w.start").alias("window_start"),
            F.col("w.end").alias("window_end"),
            "n_synth",
            F.get("p", F.lit(0)).alias("p50_ms"),
            F.get("p", F.lit(1)).alias("p95_ms"),
            "underruns",
            "transitions",
            F.try_divide(F.col("underruns"), F.col("transitions")).alias("underrun_rate"),
        )
    )


def _timed(events: DataFrame, late: str) -> DataFrame:
    """Event time as an instant (a timestamp without zone is read in the session's zone), with a watermark."""
    return events.withColumn("event_ts", F.col("event_ts").cast("timestamp")).withWatermark("event_ts", late)


def stream_budget(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Synthesis latency and underrun rate per tumbling window; rows later than the watermark are left out."""
    return _window_metrics(_timed(events, late), F.window("event_ts", width))


def stream_session_budget(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """The same per burst of activity of each listening session.

    Bursts are merged on the map side first, so a session with most of the events sends a few rows per task.
    """
    events.sparkSession.conf.set("spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition", "true")
    return (
        _timed(events, late)
        .groupBy("session_id", F.session_window("event_ts", gap).alias("w"))
        .agg(F.count(F.lit(1)).alias("n_events"), F.count_if(F.coalesce("is_underrun", F.lit(False))).alias("underruns"))
        .select("session_id", F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "n_events", "underruns")
    )
