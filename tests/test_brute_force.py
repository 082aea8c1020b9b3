"""Order-dependent operators against plain Python on random data, with one session holding most rows."""

import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lectern.operators import chunking, documents, playback, quantiles, scan
from lectern.policies import ChunkPolicy


def sessions(kinds, weights, hot=2500, cold=60):
    rnd = random.Random(11)
    return [
        (sid, q * 3 + rnd.randrange(3), rnd.choices(kinds, weights)[0]) for sid in range(5) for q in range(hot if sid == 0 else cold)
    ]


@pytest.mark.parametrize("block", [5, 97, 1 << 16])
def test_degrade_state(spark, block):
    data = sessions(["ok", "wasm", "other", "reset"], [0.25, 0.45, 0.2, 0.1])
    want, state = {}, {}
    for sid, seq, kind in sorted(data):
        count, latched = state.get(sid, (0, False))
        if kind == "reset":
            count, latched = 0, False
        elif not latched:
            count = 0 if kind == "ok" else count + (kind == "wasm")
            latched = count >= 3
        state[sid] = want[sid, seq] = (count, latched)
    df = spark.createDataFrame(data, "session_id long, seq long, outcome string")
    got = {(r.session_id, r.seq): (r.wasm_failures, r.degraded) for r in playback.degrade_state(df, block=block).collect()}
    assert got == want


@pytest.mark.parametrize("block", [7, 1 << 16])
@pytest.mark.parametrize("reverse,inclusive", [(False, True), (False, False), (True, True), (True, False)])
def test_running(spark, block, reverse, inclusive):
    data = [(sid, seq, len(kind) * 7 % 5) for sid, seq, kind in sessions(["a", "bb", "ccc"], [1, 1, 1], 400, 20)]
    df = spark.createDataFrame(data, "session_id long, seq long, v long")
    got = scan.running(df, ["session_id"], "seq", {"s": ("sum", F.col("v")), "m": ("max", F.col("v"))}, block, reverse=reverse, inclusive=inclusive)
    seen = {}
    want = {}
    for sid, seq, v in sorted(data, reverse=reverse):
        past = seen.setdefault(sid, [])
        use = past + [v] if inclusive else past
        want[sid, seq] = (sum(use), max(use) if use else None)
        past.append(v)
    assert {(r.session_id, r.seq): (r.s, r.m) for r in got.collect()} == want


def test_percentiles_of_large_groups(spark, monkeypatch):
    monkeypatch.setattr(quantiles, "SMALL_GROUP", 1000)
    df = spark.range(60000).select(
        (F.col("id") % 2).cast("string").alias("g"), F.when(F.col("id") % 3 == 0, 4.0).otherwise(F.pmod(F.col("id") * 7919, F.lit(10007)) / 1000.0).alias("x")
    )
    got = {r.g: (r.n, round(r.a, 9), round(r.b, 9)) for r in quantiles.exact_percentiles(df, "g", "x", {"a": 0.5, "b": 0.95}).collect()}
    want = {r.g: (r.n, round(r.p[0], 9), round(r.p[1], 9)) for r in df.groupBy("g").agg(F.count("x").alias("n"), F.expr("percentile(x, array(0.5, 0.95))").alias("p")).collect()}
    assert got == want


def pack(lens, toks, policy):
    out, c, t = [], 0, 0
    for ln, tk in zip(lens, toks):
        if out and c + 1 + ln <= policy.max_chars and t + tk <= policy.max_tokens:
            out[-1].append(ln)
            c, t = c + 1 + ln, t + tk
        else:
            out.append([ln])
            c, t = ln, tk
    return [len(x) for x in out]


sentence = st.lists(st.text("abcde", min_size=1, max_size=9), min_size=1, max_size=30).map(lambda ws: " ".join(ws).capitalize() + ".")


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(sentence, min_size=1, max_size=8), min_size=1, max_size=6), st.integers(10, 90), st.integers(2, 12))
def test_chunks(spark, paragraphs, max_chars, max_tokens):
    policy = ChunkPolicy(max_chars, max_tokens)
    raw = "\n\n".join(" ".join(p) for p in paragraphs)
    df = spark.createDataFrame([(1, raw), (2, "")], "doc_id int, raw string").coalesce(1)
    docs = chunking.chunk_documents(documents.segment_text(df), policy)
    row = {r.doc_id: r for r in docs.select("doc_id", "pieces", "chunks").collect()}
    assert row[2].pieces == [] and row[2].chunks == []
    pieces, chunks = row[1].pieces, row[1].chunks
    assert " ".join(p.text for p in pieces) == " ".join(raw.split())
    for p in pieces:
        assert p.n_chars == len(p.text) and p.n_tokens == len(p.text.split())
        assert (p.n_chars <= max_chars and p.n_tokens <= max_tokens) or p.n_tokens == 1
    assert [p.text for c in chunks for p in c.pieces] == [p.text for p in pieces]
    assert [len(c.pieces) for c in chunks] == pack([p.n_chars for p in pieces], [p.n_tokens for p in pieces], policy)
    for c in chunks:
        assert c.text == " ".join(p.text for p in c.pieces) and c.n_chars == len(c.text)


def test_next_anchor_hot_document(spark):
    rnd = random.Random(3)
    data, p = [], 0
    for i in range(800):
        p += rnd.randrange(3) == 0
        data.append((1, i, p, 0))
    df = spark.createDataFrame(data, "doc_id int, anchor_idx int, playback_idx int, char_offset int")
    want = {i: next((j for _, j, q, _ in data[i + 1 :] if q > pi), None) for _, i, pi, _ in data}
    assert {r.anchor_idx: r.next_idx for r in playback.next_anchor(df, block=16).collect()} == want
