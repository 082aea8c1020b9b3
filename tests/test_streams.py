"""Streams over several micro-batches, with a repeated batch and merged folders, against the batch operators."""

import datetime
import random
import shutil

import pytest
from pyspark.sql import functions as F

from lectern.operators import documents, playback
from lectern.plans import ingest
from lectern.sources import writers
from lectern.streaming import live


def arrivals(spark, tmp_path, data, schema, parts):
    folder = str(tmp_path / "in")
    size = -(-len(data) // parts)
    for i in range(parts):
        spark.createDataFrame(data[i * size : (i + 1) * size], schema).coalesce(1).write.mode("append").parquet(folder)
    return lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)


def run(query):
    query.awaitTermination()


def outcomes(n=400):
    rng = random.Random(3)
    pick = lambda: rng.choices(["wasm", "ok", "other", "reset"], [6, 1, 2, 1])[0]
    return [(0 if rng.random() < 0.9 else rng.randrange(1, 6), i, pick()) for i in range(n)]


@pytest.mark.parametrize("merge_after", [50, 2])
def test_degrade_over_batches_and_a_repeated_one(spark, tmp_path, monkeypatch, merge_after):
    monkeypatch.setattr(live, "MERGE_AFTER", merge_after)
    schema = "session_id long, seq long, outcome string"
    data = outcomes()
    stream = arrivals(spark, tmp_path, data, schema, 6)
    out, mark = str(tmp_path / "out"), str(tmp_path / "mark")
    run(live.changes_to(live.stream_degrade(stream()), out, mark, "session_id"))
    # The last batch is repeated, as after a crash before its commit.
    for name in ("5", ".5.crc"):
        (tmp_path / "mark" / "commits" / name).unlink()
    run(live.changes_to(live.stream_degrade(stream()), out, mark, "session_id"))
    want = playback.degrade_state(spark.createDataFrame(data, schema))
    want = want.groupBy("session_id").agg(F.max(F.struct("seq", "wasm_failures", "degraded")).alias("x")).select("session_id", "x.*")
    got = live.latest_changes(spark, out, "session_id")
    assert sorted(map(tuple, got.select(*want.columns).collect())) == sorted(map(tuple, want.collect()))


def test_uncommitted_folders_do_not_count(spark, tmp_path):
    moves = [(f"d{i % 3}", i, i % 7 - 2, i % 5 - 1) for i in range(60)]
    stream = arrivals(spark, tmp_path, moves, "doc_key string, seq long, segment_index int, char_offset int", 4)
    out = str(tmp_path / "out")
    run(live.changes_to(writers.latest_cursors(stream()), out, str(tmp_path / "mark"), "doc_key"))
    want = {(f"d{k}", s, max(s % 7 - 2, 0), max(s % 5 - 1, 0)) for k, s in ((0, 57), (1, 58), (2, 59))}
    assert {tuple(r) for r in live.latest_changes(spark, out, "doc_key").collect()} == want
    shutil.copytree(tmp_path / "out" / "v=0", tmp_path / "out" / "v=99")
    (tmp_path / "out" / "v=99" / "_SUCCESS").unlink()
    assert {tuple(r) for r in live.latest_changes(spark, out, "doc_key").collect()} == want


def start(seconds):
    return datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=seconds)


def test_timers_drop_the_state_of_idle_sessions(spark, tmp_path):
    """Results are those of the batch rule, cut at idle gaps; what is kept is bounded by the sessions active of late."""
    rng = random.Random(8)
    schema = "session_id long, seq long, event_ts timestamp, outcome string"
    data = []
    for part in range(8):  # each part has sessions of its own, and session 0 comes back after every idle gap
        for i in range(60):
            session = 0 if i % 5 == 0 else part * 10 + rng.randrange(1, 9)
            data.append((session, len(data), start(part * 90_000 + i * 7), rng.choice(["wasm", "wasm", "wasm", "ok", "other", "reset"])))
    stream = arrivals(spark, tmp_path, data, schema, 8)
    out = str(tmp_path / "out")
    query = live.changes_to(live.stream_degrade_bursts(stream(), idle="1 hours"), out, str(tmp_path / "mark"), "session_id", "begin", rocksdb=True)
    run(query)
    rows_kept = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    assert len(rows_kept) >= 8 and rows_kept[-1] <= 0.6 * max(rows_kept) and max(rows_kept) < 4 * 2 * 9
    cut = [(s * 1000 + int((t - start(0)).total_seconds()) // 90_000, i, o) for s, i, t, o in data]
    want = playback.degrade_state(spark.createDataFrame(cut, "session_id long, seq long, outcome string"))
    want = want.groupBy("session_id").agg(F.max(F.struct("seq", "wasm_failures", "degraded")).alias("x")).select("x.*").collect()
    got = live.latest_changes(spark, out, "session_id", "begin").select("seq", "wasm_failures", "degraded").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want))


def test_ingested_tables_agree_after_a_repeated_batch(spark, tmp_path):
    schema = "doc_id string, source_type string, name string, mime string, raw string, status int"
    data = [
        ("a", "file", "a.md", "", "# Title\n\nText *one* [r].\n\n[r]: /x", None), ("b", "file", "b.pdf", "application/pdf", "x", None), ("c", "text", None, None, "Plain.\n\nTwo.", None),
        ("d", "file", "d.html", "text/html", "<title>T</title><p>Page &amp; text", None), ("e", "url", None, None, '{"title":"U","textContent":"Fetched."}', 200), ("f", "url", None, None, "{}", 503),
    ]
    stream = arrivals(spark, tmp_path, data, schema, 3)
    out, mark = str(tmp_path / "out"), str(tmp_path / "mark")
    run(live.ingest_to(stream(), out, mark))
    tables = lambda: {t: sorted(map(str, live.ingested(spark, out, t).collect())) for t in live.TABLES}
    once = tables()
    for name in ("2", ".2.crc"):
        (tmp_path / "mark" / "commits" / name).unlink()
    run(live.ingest_to(stream(), out, mark))
    assert tables() == once
    whole = documents.document_fingerprint(ingest.route_ingest(spark.createDataFrame(data, schema)))
    assert sorted((r.doc_id, r.fingerprint) for r in live.ingested(spark, out, "documents").collect()) == sorted((r.doc_id, r.fingerprint) for r in whole.collect())
    assert live.ingested(spark, out, "segments").count() == whole.selectExpr("sum(if(error_code is null, size(segments), 0))").first()[0]
    assert {r.doc_id for r in live.ingested(spark, out, "rejects").collect()} == {"b", "f"}
    # A crash between the tables: the batch does not count in any of them.
    (tmp_path / "out" / "documents" / "v=1" / "_SUCCESS").unlink()
    assert {r.doc_id for t in live.TABLES for r in live.ingested(spark, out, t).collect()} == {"a", "b", "e", "f"}


def test_merged_folders_stay_for_readers_that_hold_their_list(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(live, "MERGE_AFTER", 2)
    moves = [(f"d{i % 3}", i, 1, 1) for i in range(80)]
    stream = arrivals(spark, tmp_path, moves, "doc_key string, seq long, segment_index int, char_offset int", 5)
    out = str(tmp_path / "out")
    run(live.changes_to(writers.latest_cursors(stream()), out, str(tmp_path / "mark"), "doc_key"))
    assert live.merged_away(spark, out) and {r.seq for r in live.latest_changes(spark, out, "doc_key").collect()} == {77, 78, 79}


def test_arrivals_grow_with_the_rows_and_come_in_order(spark, monkeypatch):
    from lectern.plans import queries_stream

    monkeypatch.setattr(queries_stream, "ROWS_PER_FILE", 10)
    monkeypatch.setattr(queries_stream, "FILES_PER_BATCH", 5)
    stream = queries_stream.arrivals(spark.range(1000).toDF("n").repartition(7), "n", late=1)
    batches = []
    run(stream.writeStream.foreachBatch(lambda df, i: batches.append(sorted(r.n for r in df.collect()))).trigger(availableNow=True).start())
    assert len(batches) == 20 and max(map(len, batches)) <= 60
    assert set(range(10, 20)) <= set(batches[-1]) and sorted(n for b in batches for n in b) == list(range(1000))
    in_order = [n for b in batches[:-1] for n in b]
    assert in_order == sorted(in_order)
