"""SimHash, periodic runs and whitening against brute-force versions, on awkward rows and on empty tables."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from lectern.llm import periodic, queries, simhash, whitening

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, key long, runs string, kept long, print binary, root int, n_words string, entry long"
EXTRA = (1, "r", 2, b"p", 3, "n", 4)
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def prose(seed, n, many=40):
    rng = random.Random(seed)
    return " ".join(f"w{rng.randrange(many)}" for _ in range(n))


def texts():
    base = prose(1, 300)
    out = [
        (1, base), (2, base.upper()), (3, None), (4, ""), (5, " \t\n\x0b"), (6, "one"), (7, "one two"), (8, "one  TWO"), (None, base), (None, None), (9, base), (9, base),
        (10, "a " * 30), (11, "a b " * 5 + "a"), (12, "a b " * 6), (13, prose(2, 5000, 3)), (14, " ".join([prose(3, 900)] * 4) + " w1"), (15, "x" * 60_000),
        (16, "ñ 中 😀 " * 9), (17, prose(4, 40) + " " + "p q r s t u v " * 3 + prose(5, 30)), (18, "A a " * 12), (19, "a b c d e f " * 2), (20, "a b c d e " * 2 + "a"),
    ]
    rng = random.Random(7)
    for i in range(60):
        words = base.split()
        for _ in range(rng.randrange(12)):
            words[rng.randrange(len(words))] = f"v{rng.randrange(99)}"
        out.append((100 + i, " ".join(words)))
    return out


@pytest.fixture(scope="module", autouse=True)
def small_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 4)
    yield
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, *EXTRA) for i, t in texts()], SCHEMA).repartition(3).cache()


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def fingerprint(text, k=3):
    ws = WORD.findall(lower(text))
    if not ws:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(ws[i : i + k]).encode(), 42) for i in range(max(1, len(ws) - k + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(rows, prints, bits=3):
    """(id, digits, smallest id reachable) of every row."""
    distinct = sorted(set(prints))
    root = {p: p for p in distinct}

    def top(p):
        while root[p] != p:
            p = root[p]
        return p

    for i, a in enumerate(distinct):
        for b in distinct[:i]:
            if (a ^ b).bit_count() <= bits:
                root[top(a)] = top(b)
    least = {}
    for (i, _), p in zip(rows, prints, strict=True):
        if i is not None:
            least[top(p)] = min(least.get(top(p), i), i)
    return Counter((i, f"{p:016x}", least.get(top(p))) for (i, _), p in zip(rows, prints, strict=True))


@pytest.mark.parametrize("tile", [8192, 4])
def test_simhash(docs, tile):
    got = Counter(tuple(r) for r in simhash.near_duplicates(docs, tile_rows=tile).collect())
    rows = texts()
    want = classes(rows, [fingerprint(t) for _, t in rows])
    assert got == want
    assert len({c for _, _, c in want}) < len({d for _, d, _ in want}), "some fingerprints link without being equal"


def test_fingerprint_hash_is_spark_s(spark):
    """The hash of a shingle is XXH64 with seed 42, which Spark's own xxhash64 computes too."""
    row = spark.sql("select xxhash64('one two thré') as h").first()
    assert row.h % 2**64 == xxhash.xxh64_intdigest("one two thré".encode(), 42)


@pytest.mark.parametrize(("bits", "tile"), [(3, 8192), (3, 16), (1, 8192), (0, 8192)])
def test_simhash_links_of_planted_fingerprints(spark, monkeypatch, bits, tile):
    """Fingerprints around a few centres, one of them with a third of all rows, fed in place of those of texts."""
    rng = random.Random(bits)
    centres = [rng.getrandbits(64) for _ in range(40)]
    prints = []
    for i in range(1500):
        p = centres[0] if i % 3 == 0 else rng.choice(centres)
        for _ in range(rng.randrange(7)):
            p ^= 1 << rng.randrange(64)
        prints.append(p)
    rows = [(i, None) for i in range(len(prints))]
    df = spark.createDataFrame([(i, p - (p >> 63 << 64)) for i, p in enumerate(prints)], "doc_id long, fingerprint long").repartition(4)
    monkeypatch.setattr(simhash, "fingerprint", lambda docs, key, text, words: docs)
    got = Counter(tuple(r) for r in simhash.near_duplicates(df, bits=bits, tile_rows=tile).collect())
    assert got == classes(rows, prints, bits)


def test_segments_of_one_entry_become_a_forest():
    rng = random.Random(3)
    centre = rng.getrandbits(64)
    prints = np.unique(np.array([centre ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for _ in range(800)], np.uint64))
    label, linked = simhash.forest(np.zeros(len(prints), np.int64), prints, 3)
    want = classes([(i, None) for i in range(len(prints))], prints.tolist())
    assert len(set(label.tolist())) == len({c for _, _, c in want})
    assert len(linked) == len(prints) - len(set(label.tolist()))


def test_simhash_of_an_empty_table(spark):
    found = simhash.near_duplicates(spark.createDataFrame([], SCHEMA))
    assert found.columns == ["doc_id", "fingerprint", "component_id"] and found.count() == 0


def brute_runs(words, least=12):
    found = {}
    for q in range(1, len(words) // 2 + 1):
        same = [words[i] == words[i - q] for i in range(q, len(words))] + [False]
        first = None
        for at, yes in enumerate(same):
            if yes and first is None:
                first = at
            elif not yes and first is not None:
                if at - first + q >= max(least, 2 * q):
                    found.setdefault((first, at - first + q), q)
                first = None
    return sorted((s, n, q) for (s, n), q in found.items())


def collapsed(words, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def test_runs_of_random_words():
    rng = random.Random(2)
    for _ in range(1500):
        n = rng.randrange(70)
        words = [rng.randrange(rng.choice([1, 2, 3, 5])) for _ in range(n)]
        if n and rng.random() < 0.4:
            p = rng.randrange(1, n + 1)
            words = [words[i % p] for i in range(n)]
        for least in (2, 12):
            assert sorted(periodic.runs_of(words, least)) == brute_runs(words, least)


def test_link_cut_access_gives_last_occurrences():
    """The colours of a root path are the last ends of the suffixes' earlier occurrences."""
    rng = random.Random(4)
    codes = [rng.randrange(2) for _ in range(80)]
    length, link, prefix = periodic.automaton(codes)
    paths = periodic.Paths([0, *(x + 1 for x in link)])
    for i, state in enumerate(prefix):
        segments = paths.access(state + 1, i)
        low = [length[node - 1] for node, _ in segments[1:]] + [0]
        for (node, end), below in zip(segments, low, strict=True):
            for size in range(below + 1, length[node - 1] + 1):
                ends = [e for e in range(size - 1, i) if codes[e - size + 1 : e + 1] == codes[i - size + 1 : i + 1]]
                assert end == (ends[-1] if ends else -1)


def test_find_runs(docs):
    got = Counter((r.doc_id, r.n_words, tuple(tuple(x) for x in r.runs), r.kept) for r in periodic.find_runs(docs).collect())
    want = Counter()
    for i, t in texts():
        words = WORD.findall(t or "")
        runs = brute_runs(words)
        want[i, len(words), tuple(runs), collapsed(words, runs)] += 1
    assert got == want
    assert sum(len(r) > 1 for _, _, r, _ in want) >= 1


def test_runs_of_an_empty_table(spark):
    found = periodic.find_runs(spark.createDataFrame([], SCHEMA))
    assert found.columns == ["doc_id", "n_words", "runs", "kept"] and found.count() == 0


def test_op12_by_its_contract(spark):
    import pyarrow.parquet as pq

    table = pq.read_table(f"{SF}/documents.parquet", columns=["doc_id", "text"]).to_pylist()
    want = set()
    for row in table:
        words = WORD.findall(row["text"] or "")
        n, h = len(words), zlib.crc32(str(row["doc_id"]).encode())
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
        runs = brute_runs(words)
        top = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else None
        own = (*top, 1000 * top[1] // top[2]) if top else (None,) * 4
        lines = "".join(f"{s},{m},{q}\n" for s, m, q in sorted(runs, key=lambda r: (r[0], r[2])))
        want.add((row["doc_id"], len(runs), *own, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(collapsed(words, runs).encode()).hexdigest()))
    got = {tuple(r) for r in queries.op12(spark, SF).collect()}
    assert got == want and any(w[1] for w in want)


def vectors():
    rng = np.random.default_rng(1)
    mixing = rng.normal(size=(6, 6))
    rows = [(i, (rng.normal(size=6) @ mixing).tolist(), 0.5, 1) for i in range(300)]
    rows += [(400 + i, rows[0][1], 0.5, 1) for i in range(150)]  # copies: a third of the rows, one vector of the fit list
    rows += [(600, None, 0.5, 1), (601, [1.0, None, 0.0, 0.0, 0.0, 0.0], 0.5, 1), (602, [float("nan")] * 6, 0.5, 1), (603, [float("inf")] + [0.0] * 5, 0.5, 1)]
    rows += [(604, [1.0, 2.0], 0.5, 1), (604, [1.0, 2.0], 0.5, 1), (None, rows[1][1], 0.5, 1), (605, [], 0.5, 1)]
    return rows


VECTORS = "vec_id long, embedding array<double>, whitened double, n int"


def test_whitening(spark):
    df = spark.createDataFrame(vectors(), VECTORS).repartition(3)
    got = whitening.whiten(df, components=4).collect()
    kept = [(i, v) for i, v, *_ in vectors() if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    ints = [[math.floor(64 * x) + 1000000 for x in [*v, *[0.0] * (6 - len(v))]] for _, v in kept]
    fit = np.array(sorted({tuple(x) for x in ints}))
    n, sums = len(fit), fit.sum(0)
    values, vecs = np.linalg.eigh(np.cov(fit.T.astype(float), bias=True))
    values, vecs = values[::-1], vecs[:, ::-1]
    assert len(got) == 4 * len(kept) and {r.n for r in got} == {n}
    assert max(r.identity_error for r in got) < 1e-9
    sign = {}
    by_row = Counter()
    for r in got:
        c = r.component - 1
        assert abs(r.explained - values[c] / values.sum()) < 1e-9 * r.explained
        by_row[r.vec_id, r.component, r.deviation] += 1
    assert by_row == Counter((i, c, sum((n * int(a) - int(s)) ** 2 for a, s in zip(x, sums, strict=True))) for (i, _), x in zip(kept, ints, strict=True) for c in range(1, 5))
    want = {i: (np.array(x) - sums / n) @ vecs / np.sqrt(values) for (i, _), x in zip(kept, ints, strict=True)}
    for r in got:
        w = want[r.vec_id][r.component - 1]
        s = sign.setdefault(r.component, 1 if w * r.whitened >= 0 else -1)
        assert abs(w * s - r.whitened) < 1e-7 * max(1, abs(w))


@pytest.mark.parametrize("seed", range(6))
def test_eigen(seed):
    rng = np.random.default_rng(seed)
    n = [1, 2, 7, 30, 64, 40][seed]
    spread = np.ones(n) * 3 if seed == 3 else rng.uniform(0, 5, n)
    if seed == 5:
        spread[:10] = 9  # a cluster of ten equal eigenvalues, and others very close to it
        spread[10:14] = 9 - 1e-9
    q = np.linalg.qr(rng.normal(size=(n, n)))[0]
    a = q @ np.diag(spread) @ q.T
    a = (a + a.T) / 2
    k = min(16, n)
    values, vectors_ = whitening.eigen(a, k)
    assert np.allclose(values, np.linalg.eigvalsh(a)[::-1][:k], rtol=0, atol=1e-12 * 9 * n)
    assert np.abs(vectors_.T @ vectors_ - np.eye(k)).max() < 1e-12
    assert np.abs(a @ vectors_ - vectors_ * values).max() < 1e-12 * 9 * n


def test_sturm_counts_and_tridiagonal_form():
    rng = np.random.default_rng(9)
    a = rng.normal(size=(20, 20))
    a = a + a.T
    d, e, q = whitening.tridiagonal(a)
    t = np.diag(d) + np.diag(e, 1) + np.diag(e, -1)
    assert np.allclose(q @ t @ q.T, a) and np.allclose(q.T @ q, np.eye(20))
    values = np.linalg.eigvalsh(a)
    xs = np.concatenate((values - 1e-6, values + 1e-6, [-99, 99]))
    assert (whitening.sturm_count(d, e * e, xs, 1e-30) == [(values < x).sum() for x in xs]).all()


def test_whitening_without_variance_and_of_an_empty_table(spark):
    for rows in ([], [(1, [1.0, 2.0], 0.5, 1), (2, [1.0, 2.0], 0.5, 1)], [(1, None, 0.5, 1)], [(1, [], 0.5, 1)]):
        found = whitening.whiten(spark.createDataFrame(rows, VECTORS))
        assert found.columns == ["vec_id", "n", "deviation", "component", "whitened", "explained", "identity_error"] and found.count() == 0
    flat = spark.createDataFrame([(i, [float(i), 5.0, 5.0], 0.5, 1) for i in range(10)], VECTORS)
    assert {r.component for r in whitening.whiten(flat).collect()} == {1}


def test_large_integers_stay_exact(spark):
    rows = [(i, [1e12 * i, -3e13 * (i % 3)], 0.5, 1) for i in range(5)]
    got = {r.vec_id: r.deviation for r in whitening.whiten(spark.createDataFrame(rows, VECTORS)).collect()}
    ints = [[math.floor(64 * x) + 1000000 for x in v] for _, v, *_ in rows]
    total = [sum(c) for c in zip(*ints, strict=True)]
    want = [sum((5 * a - s) ** 2 for a, s in zip(x, total, strict=True)) for x in ints]
    assert got == {i: (w if w < 2**63 else None) for i, w in enumerate(want)}


def test_op13_by_its_contract(spark):
    found = queries.op13(spark, SF)
    n = found.agg(F.countDistinct("vec_id")).first()[0]
    assert found.count() == 16 * n
    z = np.zeros((n, 16))
    at = {}
    for r in found.collect():
        z[at.setdefault(r.vec_id, len(at)), r.component - 1] = r.whitened
    assert np.abs(z.T @ z / n - np.eye(16)).max() < 1e-4
    assert Fraction(found.first().n) == n  # all vectors of this table differ
