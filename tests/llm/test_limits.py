"""What is sent on, broadcast or held must stay in bounds, with nothing lost."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.llm import common, simhash
from lectern.llm import jaccard_join as J
from lectern.llm.common import may_match


def some_sets(rng, n):
    """Sets of hashes and a near copy of each, with a passage that all of the larger ones share."""
    passage, out = [rng.getrandbits(64) for _ in range(30)], []
    for _ in range(n):
        size = rng.choice([1, 2, 5, 9, 40, 300])
        one = {rng.getrandbits(64) for _ in range(size)} | set(passage if size >= 40 else [])
        gone = rng.sample(sorted(one), rng.randint(0, len(one) // 8))
        out += [one, (one - set(gone)) | {rng.getrandbits(64) for _ in range(rng.randint(0, len(one) // 9))}]
    return out


@pytest.mark.parametrize("num, den", [(8, 10), (9, 10)])
def test_sets_send_their_fullest_parts_and_still_meet(num, den):
    sets = some_sets(random.Random(5), 150)
    hashes = np.array([h for s in sets for h in sorted(s)], np.uint64)
    bounds = np.concatenate(([0], np.cumsum([len(s) for s in sets])))
    bands = J.Bands(num, den)
    keys, owner = J.part_keys(hashes, bounds, bands, np.zeros(0, np.uint64))
    assert (J.from_planes(J.planes(np.sort(keys)), len(keys)) == np.sort(keys) >> np.uint64(16) << np.uint64(16)).all()
    of = [set(keys[owner == i].tolist()) for i in range(len(sets))]
    links = [(i, j) for i in range(len(sets)) for j in range(i) if den * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j])]
    assert len(links) > 50 and all(of[i] & of[j] for i, j in links)
    most = bands.differences()
    for i, s in enumerate(sets):
        if len(s) >= 300:
            band = int(bands.of(np.array([len(s)]))[0])
            assert len(of[i]) == most[band] + 1 + most[band - 1] + 1


def test_unrelated_sets_with_a_common_passage_seldom_meet():
    rng = random.Random(6)
    passage = [rng.getrandbits(64) for _ in range(12)]
    sets = [sorted({rng.getrandbits(64) for _ in range(300)} | set(passage)) for _ in range(300)]
    bounds = np.concatenate(([0], np.cumsum([len(s) for s in sets])))
    keys, owner = J.part_keys(np.array([h for s in sets for h in s], np.uint64), bounds, J.Bands(8, 10), np.zeros(0, np.uint64))
    _, edges = J.stars(keys, owner)
    assert len(np.unique(edges)) < 100


def test_only_rows_without_a_partner_are_ruled_out(spark):
    rows = spark.range(3000).select(F.when(F.col("id") % 100 != 7, F.struct("id", F.lit(None).cast("string").alias("x"))).alias("key"), (F.col("id") % 5).alias("word"))
    others = rows.filter("word = 3 or key is null").select(F.col("key").alias("other"))
    got = may_match(rows, ["key"], others, ["other"], "maybe")
    assert set(got.columns) == {"key", "word", "maybe"}
    found = got.collect()
    assert len(found) == 3000 and all(r.maybe for r in found if r.word == 3 or r.key is None)
    assert sum(r.maybe for r in found) < 700
    none = may_match(rows, ["key"], others.limit(0), ["other"], "maybe")
    assert none.filter("maybe").count() == 0 and none.count() == 3000


def broadcast_rows(spark, make):
    """The result's rows, and the broadcast tables of all plans that were made on the way and of the result."""
    kept, plans = common.stored, []

    def stored(df, purpose):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return kept(df, purpose)

    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(simhash, "stored", stored)
        df = make()
    plans.append(df._jdf.queryExecution().executedPlan().toString())
    return df.collect(), sum("BroadcastExchange" in p and "explode" in p for p in plans)


def test_probes_are_not_broadcast(spark):
    docs = spark.range(200).select(F.col("id").alias("doc_id"), F.concat_ws(" ", F.lit("word"), F.xxhash64("id").cast("string"), (F.col("id") % 150).cast("string")).alias("text"))
    rows, broadcast = broadcast_rows(spark, lambda: simhash.near_duplicates(docs))
    assert len(rows) == 200 and len({r.doc_id for r in rows}) == 200 and not broadcast


def test_large_tables_are_not_broadcast(spark, monkeypatch, tmp_path):
    spark.range(1000).write.parquet(str(tmp_path / "t"))
    table = spark.read.parquet(str(tmp_path / "t"))
    plan = lambda: table.join(common.shuffled_if_large(table.select(F.col("id"), F.lit(1).alias("x"))), "id")._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan()
    monkeypatch.setattr(common, "BROADCAST_BYTES", 100)
    assert "BroadcastHashJoin" not in plan()
