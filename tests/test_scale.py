"""Work and memory that must not grow with the number of files or with the size of a batch."""

import collections
import random
import tracemalloc
import unicodedata

import pyarrow as pa
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from lectern.functions import kernels as K
from lectern.operators import inline
from lectern.plans import queries_stream
from lectern.sources import readers, writers
from lectern.streaming import live

FILES = 300


@pytest.fixture
def small_files(spark, tmp_path):
    rows = spark.createDataFrame([(i, i % 3 if i else None, f"{i}\ntext é" if i != 7 else None) for i in range(FILES)], "id int, b int, value string")
    path = writers.write_texts(rows.select("b", "value"), str(tmp_path / "texts"), "b", "value")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4m")
    yield path
    spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_one_text_file_per_row(small_files, tmp_path):
    files = sorted((tmp_path / "texts").glob("b=*/part-*.txt"))
    assert {f.parent.name for f in files} == {"b=0", "b=1", "b=2", "b=__HIVE_DEFAULT_PARTITION__"}
    assert sorted(f.read_text() for f in files) == sorted(f"{i}\ntext é\n" if i != 7 else "\n" for i in range(FILES))


@pytest.mark.parametrize("read", [readers.read_text, readers.read_files])
def test_many_small_files_make_few_tasks(spark, small_files, read):
    rows = read(spark, small_files)
    assert rows.rdd.getNumPartitions() <= 2 * spark.sparkContext.defaultParallelism
    got = rows.select("path", "name", "raw").collect()
    assert len({r.path for r in got}) == FILES and all(r.path.endswith(r.name) for r in got)
    assert sorted(r.raw for r in got) == sorted(f"{i}\ntext é\n" if i != 7 else "\n" for i in range(FILES))


def fnv(text: str) -> int:
    state, units = 2166136261, text.encode("utf-16-le")
    for i in range(0, len(units), 2):
        state = ((state ^ (units[i] | units[i + 1] << 8)) * 16777619) & 0xFFFFFFFF
    return state


@pytest.mark.parametrize("most", [7, 1000, 1 << 22])
def test_kernels_by_slices(monkeypatch, most):
    for name in ("TEXT_SLICE", "LIST_SLICE", "OBJECT_SLICE"):
        monkeypatch.setattr(K, name, most)
    rng = random.Random(1)
    texts = ["".join(rng.choice("ab\u00e9\ufb01\u6f22\U0001f600 ") for _ in range(rng.choice([0, 1, 5, 300]))) for _ in range(200)] + ["plain"] * 100
    assert K._fnv_rows(pa.array([None, *texts])).tolist() == [fnv(""), *map(fnv, texts)]
    assert K._nfkc(pa.array([None, *texts])[1:]).to_pylist() == [unicodedata.normalize("NFKC", t) for t in texts]
    lists = [None if i % 7 == 3 else list(range(rng.choice([0, 1, 4, 200]))) for i in range(100)]
    sums = [[sum(r[:i]) for i in range(len(r))] if r else [] for r in lists]
    assert K.by_slices(K._sums_before, K.LIST_SLICE, pa.array(lists, pa.list_(pa.int32()))).to_pylist() == sums
    tokens = pa.array([[[1], [2, 3]], None, [], [[], [4]]], pa.list_(pa.list_(pa.int32())))
    assert inline._n_tokens(tokens).tolist() == [3, 0, 0, 1] and inline._n_tokens(tokens[2:]).tolist() == [0, 1]


def test_hash_memory_is_bounded():
    texts = pa.array(["x" * 2_000 + "\u6f22"] * 12_000)
    tracemalloc.start()
    hashed = K._fnv_rows(texts).tolist()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(set(hashed)) == 1 and peak < 160 << 20  # 24 MB of text


class Handle:
    """One key's state and timers, counting the calls."""

    def __init__(self):
        self.calls, self.value, self.timers = collections.Counter(), None, set()

    def getValueState(self, name, schema):  # noqa: N802
        return self

    def get(self):
        self.calls["get"] += 1
        return self.value

    def update(self, value):
        self.calls["update"] += 1
        self.value = value

    def clear(self):
        self.value = None

    def registerTimer(self, at):  # noqa: N802
        self.calls["timer"] += 1
        self.timers.add(at)

    def deleteTimer(self, at):  # noqa: N802
        self.calls["timer"] += 1
        self.timers.remove(at)


def test_state_of_a_burst_is_read_and_written_once(spark):
    handle, fold = Handle(), live._RecentBurst(1000, keep=2)
    fold.init(handle)
    event = lambda at, seq: Row(at=at, seq=seq, segment_id=f"s{seq}", message=None)
    first = list(fold.handleInputRows((5, "a"), iter([event(900, 2), event(0, 1), event(5000, 3)]), None))
    assert [(r.session_id, r.category, r.begin, r.seqs, r.segment_ids) for r in first] == [(5, "a", 0, [2, 1], ["s2", "s1"]), (5, "a", 5000, [3], ["s3"])]
    assert handle.calls == {"get": 1, "update": 1, "timer": 1} and handle.timers == {7}
    second = list(fold.handleInputRows((5, "a"), iter([event(5500, 5), event(5400, 4)]), None))
    assert [(r.begin, r.seqs, r.messages) for r in second] == [(5000, [5, 4], [None, None])]
    assert handle.calls == {"get": 2, "update": 2, "timer": 1}
    list(fold.handleExpiredTimer((5, "a"), None, None))
    assert [(r.begin, r.seqs) for r in fold.handleInputRows((5, "a"), iter([event(5600, 6)]), None)] == [(5600, [6])]


def test_texts_arrive_in_more_files():
    assert queries_stream.file_count(1_000_000, queries_stream.TEXTS_PER_FILE) == 125


@pytest.mark.parametrize("read", [readers.read_text, readers.read_files])
def test_the_driver_holds_no_list_of_files(spark, small_files, tmp_path, read):
    (tmp_path / "texts" / "b=1" / "_left").write_bytes(b"no")
    (tmp_path / "texts" / "b=1" / "empty.txt").write_bytes(b"")
    (tmp_path / "texts" / "b=2" / "a b+%41.txt").write_bytes(b"\xff x")
    rows = read(spark, f"file://{small_files}")
    assert not rows.inputFiles()
    got = {r.path: (r.name, r.raw) for r in rows.select("path", "name", F.hex(F.col("raw").cast("binary")).alias("raw")).collect()}
    assert len(got) == FILES + 1
    if read is readers.read_text:
        assert got[f"file://{small_files}/b=2/a%20b+%2541.txt"] == ("a%20b+%2541.txt", "FF2078")
    else:
        assert got[f"file:{small_files}/b=2/a b+%41.txt"] == ("a b A.txt", "EFBFBD2078")


@pytest.mark.parametrize("read", [readers.read_text, readers.read_files])
def test_other_layouts_are_left_to_the_readers_of_spark(spark, tmp_path, read):
    for name in ("flat/1", "flat/sub/2", "deep/b=1/sub/3", "mixed/4", "mixed/b=1/5", "one/a=1/6"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(name[-1])
    found = lambda path: sorted(r.raw for r in read(spark, f"{tmp_path}/{path}").collect())
    assert [found(p) for p in ("flat", "deep", "mixed", "one", "flat/1", "fl*")] == [["1"], ["3"], ["5"], ["6"], ["1"], ["1"]]
