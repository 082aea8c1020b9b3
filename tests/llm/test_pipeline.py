"""The pipeline's stages on a small table, and its last result against the stages' brute-force versions."""

import hashlib
import math
import random
from collections import Counter

import corpus_pipeline
import public_tokenizers
import pyarrow as pa
import tiktoken
from test_operators import components, contaminated, spans, texts

from lectern.llm import bpe, decontaminate, quality
from lectern.llm.common import table
from lectern.llm.words import BLANK_SEPARATED, Words

SF = "/root/testdata/sf0.001"


def test_stages_keep_the_columns_of_documents(spark):
    docs = table(spark, SF, "documents")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == columns, name
        assert out.count() <= docs.count()


def test_near_duplicates_and_secrets(spark):
    rows = [(i, t, "en", "s", len(t or "")) for i, t in texts()]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = sorted(r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, docs, SF).collect() if r.doc_id is not None)
    assert kept == sorted({doc for doc, _, low in components(texts(), 5, 8, 10) if doc is not None and doc == low})
    clean = corpus_pipeline.redact_secrets(spark, docs, SF).collect()
    assert len(clean) == len(rows)
    assert all(not spans(r.text) and (r.text is None or r.n_chars == len(r.text)) for r in clean)


def test_near_duplicates_goes_by_row(spark):
    a, b, c = (" ".join(f"{name}{i}" for i in range(40)) for name in "abc")
    rows = [
        (3, a), (5, a + " end"), (5, b), (5, b + " end"),  # one id, two texts: the copy of document 3 goes, b stays once
        (None, c), (None, c + " end"), (None, c), (None, b), (9, a),  # no id: one row of c, none of b
        (8, "short"), (8, "other"), (7, None), (None, None), (None, ""),
    ]
    docs = spark.createDataFrame([(i, t, "en") for i, t in rows], "doc_id long, text string, lang string").repartition(3)
    out = corpus_pipeline.drop_near_duplicates(spark, docs, SF)
    assert out.columns == docs.columns
    got = Counter((r.doc_id, r.text.split(" ")[0] if r.text else r.text) for r in out.collect())
    assert got == Counter([(3, "a0"), (5, "b0"), (None, "c0"), (8, "short"), (8, "other"), (7, None), (None, None), (None, "")])


def planted(folder, spark):
    """Documents with labelled junk, copies, near copies, benchmark passages and secrets, and the other tables."""
    rng = random.Random(11)
    good = [f"{a}{b}" for a in ("riv", "mont", "gar", "sol", "cam", "ber") for b in ("er", "ain", "den", "ar", "po", "lin", "ta")]
    junk = ["BUY$$$", "click###", "now%%%", "win***", "free&&&"]
    write = lambda words, n: " ".join(rng.choice(words) for _ in range(n))
    rows, labels = [], []
    for i in range(160):
        bad = i % 4 == 3
        rows.append((i, write(junk if bad else good, rng.randrange(40, 90)), "en", "src"))
        if i < 120:
            labels.append((i, int(not bad), 0))
    passage = write(good, 14)
    base = rows[0][1].split()
    near = [*base[:20], "changed", *base[21:]]
    rows += [
        (200, rows[1][1], "en", "src"), (201, rows[1][1].upper(), "en", "src"), (202, " ".join(near), "en", "src"), (203, " ".join([*near, "tail"]), "en", "src"),
        (204, f"{write(good, 30)} {passage.title()}! {write(good, 30)}", "en", "src"), (205, f"{write(good, 50)} token=abcdefgh12 end AKIAABCDEFGHIJKLMN", "en", "src"),
        (206, None, "en", "src"), (207, "", None, None), (208, "río niño 中文 😀 " + write(good, 40), "es", "src"), (1, write(good, 45), "en", "src"), (None, rows[2][1], "en", "src"),
    ]
    spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    items = [(7, passage), (8, "never said anywhere"), (9, None)]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return [(i, t) for i, t, *_ in rows], labels, items


def one_by_one(model, text):
    """The classifier's score of one text, word by word."""
    reader = Words(BLANK_SEPARATED)
    _, found = quality.buckets(reader, pa.array([text], pa.string()))
    z = model.bias + (sum(float(model.weight[b]) for b in found) / len(found) if len(found) else 0.0)
    return 1 / (1 + math.exp(-z))


def test_run_against_chained_brute_force_stages(spark, tmp_path):
    rows, labels, items = planted(tmp_path, spark)
    got = Counter(tuple(r) for r in corpus_pipeline.run(spark, str(tmp_path)).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect())

    model = quality.train(table(spark, str(tmp_path), "documents"), table(spark, str(tmp_path), "labels"))
    kept = [(i, t) for i, t in rows if one_by_one(model, t) >= 0.5]
    assert sum(y == 0 for _, y, _ in labels) <= len(rows) - len(kept) <= 45, "junk goes, and little else"

    numbered = [(n, t) for n, (_, t) in enumerate(kept)]
    group = {n: low for (n, _, low), _ in components(numbered, 5, 8, 10).items()}
    first = {}
    for n, (i, _) in enumerate(kept):
        rank = (i is None, i or 0, n)
        first[group[n]] = min(first.get(group[n], rank), rank)
    unique = [row for n, row in enumerate(kept) if first[group[n]][2] == n]
    assert {200, 201, 202, 203, None} & {i for i, _ in unique} == set()

    hits = contaminated(unique, items)
    clean = [(i, t) for i, t in unique if next(h for d, _, h, _ in contaminated([(i, t)], items)) == 0]
    assert sum(hits.values()) - len(clean) == 1 and 204 not in {i for i, _ in clean}

    def redacted(t):
        marks = sorted((int(a), int(b)) for _, a, b in (s.split(":") for s in spans(t).split(",") if s))
        out, at = [], 0
        for a, b in marks:
            out += [t[at:a], "[SECRET]"] if a >= at else []
            at = max(at, b)
        return "".join(out) + t[at:] if marks else t

    final = [(i, redacted(t)) for i, t in clean]
    assert "[SECRET]" in dict(final)[205] and "abcdefgh12" not in dict(final)[205]

    ranks = bpe.load_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = Counter()
    for i, t in final:
        ids = own.encode_ordinary(t or "")
        digest = lambda b: hashlib.sha256(b).hexdigest()
        want[i, len(ids), digest(",".join(map(str, ids)).encode()), digest((t or "").encode())] += 1
    assert got == want


def test_clashing_working_columns(spark):
    """Columns with the names of working columns come back as they were."""
    names = "doc_id long, text string, row string, hit_words string, hit_items string, HIT_WORDS_ string, key string, draw long, position string"
    rows = [(1, "a clean text", *"rhiwk", 5, "p"), (2, "the only here passage", *"RHIWK", 6, "q"), (3, "a clean text", *"xyzwv", 7, "s")]
    docs = spark.createDataFrame(rows, names)
    bench = spark.createDataFrame([(1, "only here")], "item_id long, text string")
    kept = decontaminate.without_contaminated(docs, bench, pattern_bytes=1)
    assert kept.columns == docs.columns and sorted(map(tuple, kept.collect())) == [rows[0], rows[2]]
    unique = corpus_pipeline.drop_near_duplicates(spark, docs, SF)
    assert unique.columns == docs.columns and sorted(map(tuple, unique.collect())) == rows[:2]


def test_many_parts_of_a_benchmark_are_searched_one_after_the_other(spark):
    docs = spark.createDataFrame([(i, f"start w{i} x{i} end") for i in range(30)], "doc_id long, text string")
    bench = spark.createDataFrame([(i, f"w{i} x{i}") for i in range(0, 12, 2)], "item_id long, text string").coalesce(1)
    found = decontaminate.find_contamination(docs, bench, pattern_bytes=1)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") <= 2
    assert sorted(r.doc_id for r in found.collect() if r.n_hit) == list(range(0, 12, 2))


def test_run(spark):
    out = corpus_pipeline.run(spark, SF).collect()
    assert 0 < len(out) < table(spark, SF, "documents").count()
    assert len({r.doc_id for r in out}) == len(out)
