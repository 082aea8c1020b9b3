"""One registered query per operator, over its whole table, with comparing SQL where SQL can say it."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm import bpe, decontaminate, language_id, periodic, quality, secrets, sharding, simhash, substring_dedup, topk, toxicity, whitening
from lectern.llm.common import ORACLES, QUERIES, held_out, query, remainder, table
from lectern.llm.jaccard_join import jaccard_join
from lectern.session import work_folder

__all__ = ["ORACLES", "QUERIES"]

LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def shingle_links(k: int, num: int, den: int, source: str = "documents") -> str:
    """CTEs `sized(doc_id, n)` and `reach(doc_id, root)` of the documents' shingle sets."""
    shingle = " || ' ' || ".join(f"ws[i + {j}]" for j in range(k))
    return rf"""
    cut as (select doc_id, list_filter(regexp_split_to_array({LOWER}, '[\x20\x09-\x0D]+'), lambda x: x <> '') as ws from {source}),
    shingles as (select distinct doc_id, unnest(case when len(ws) = 0 then []
        when len(ws) < {k} then [array_to_string(ws, ' ')]
        else list_transform(range(1, len(ws) - {k - 2}), lambda i: {shingle}) end) as s from cut),
    sized as (select doc_id, count(s) as n from cut left join shingles using (doc_id) group by doc_id),
    pairs as (select a.doc_id as x, b.doc_id as y, count(*) as c from shingles a join shingles b using (s)
        where a.doc_id < b.doc_id group by all),
    links as (select x, y from pairs join sized p on p.doc_id = x join sized q on q.doc_id = y
        where {den} * c >= {num} * (p.n + q.n - c)),
    reach as (select doc_id, doc_id as root from cut union
        select e.t, r.root from reach r join (select x as f, y as t from links union all select y, x from links) e on e.f = r.doc_id)"""


@query("op1_language_id")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    profiles = language_id.learn_profiles(docs.filter(remainder("doc_id", 4) != 2))
    found = language_id.identify(docs, profiles)
    return found.select("doc_id", held_out("doc_id", 4, 2), "lang_pred", "score")


OP2 = f"""with recursive {shingle_links(3, 90, 100)}
    select doc_id, n as n_shingles, min(root) as component_id from reach join sized using (doc_id) group by all"""


@query("op2_ngram_jaccard_join", OP2)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(table(spark, sf_dir, "documents"), words=3, num=90, den=100)


@query("op3_quality_classifier")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = quality.train(docs, labels.filter(remainder("doc_id", 3) != 1))
    found = quality.classify(docs, model)
    return found.select("doc_id", held_out("doc_id", 3, 1), "score", "predicted")


WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
OP4 = rf"""with words as (select doc_id, regexp_extract_all({LOWER}, '{WORDS}') as ws from documents),
    items as (select item_id, regexp_extract_all({LOWER}, '{WORDS}') as ws from benchmark),
    patterns as (select distinct item_id, unnest(case when len(ws) = 0 then [] when len(ws) < 10 then [ws]
        else list_transform(range(1, len(ws) - 8), lambda i: ws[i:i + 9]) end) as p from items),
    sizes as (select distinct len(p) as m from patterns),
    places as (select doc_id, m, unnest(range(1, len(ws) - m + 2)) as pos, ws from words, sizes where len(ws) >= m),
    hits as (select distinct doc_id, pos, m, item_id from (select doc_id, pos, m, ws[pos:pos + m - 1] as p from places) join patterns using (p)),
    covered as (select doc_id, count(distinct w) as n_hit from (select doc_id, unnest(range(pos, pos + m)) as w from hits) group by doc_id),
    found as (select doc_id, count(*) as n_items, string_agg(item_id::varchar, ',' order by item_id::varchar) as ids
        from (select distinct doc_id, item_id from hits) group by doc_id)
    select doc_id, len(ws)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
        sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
    from words left join covered using (doc_id) left join found using (doc_id)"""


@query("op4_benchmark_decontamination", OP4)
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        "n_items",
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


@query("op5_toxicity")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    lexicon = toxicity.learn_lexicon(docs, labels.filter(remainder("doc_id", 4) != 2))
    found = toxicity.score_toxicity(docs, lexicon)
    return found.select("doc_id", held_out("doc_id", 4, 2), "score", "predicted")


@query("op6_sharding")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard(table(spark, sf_dir, "documents"), shards=8)
    return placed.select("doc_id", "size", F.crc32(F.col("text").cast("binary")).alias("text_crc32"), "law", "shard", "slot", "grown_shard")


def found_spans(kind: str, pattern: str, group: int, least: int, needs: str) -> str:
    """CTE of (doc_id, kind, start, stop) for one rule; text between matches gives the positions."""
    return rf"""{kind} as (select doc_id, x.start as start, x.start + x.n as stop from (select doc_id, unnest(list_transform(range(1, len(whole) + 1), lambda i:
            {{'start': list_sum(list_transform(gaps[1:i], lambda g: length(g))) + coalesce(list_sum(list_transform(whole[1:i - 1], lambda w: length(w))), 0),
              'n': length(whole[i]), 'v': length(value[i])}})) as x
        from (select doc_id, regexp_extract_all(body, '{pattern}') as whole, regexp_extract_all(body, '{pattern}', {group}) as value,
            string_split_regex(body, '{pattern}') as gaps from bodies where regexp_matches(body, '{needs}'))) where x.v >= {least})"""


ANY_CASE = "|".join("".join(f"[{c}{c.upper()}]" for c in w) for w in ("password", "passwd", "secret", "token")) + "|[aA][pP][iI]_?[kK][eE][yY]"
ASSIGN = rf"""({ANY_CASE})["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""
OP7 = f"""with bodies as (select doc_id, coalesce(text, '') as body from documents),
    {found_spans("assign", ASSIGN, 2, 8, "[:=]")}, {found_spans("access", "AKIA[A-Z0-9]+", 0, 16, "AKIA")}, {found_spans("hex", "[0-9a-f]+", 0, 32, "[0-9a-f]{32}")},
    spans as (select doc_id, 0 as k, 'assign' as kind, start, stop from assign union all select doc_id, 1, 'access', start, stop from access
        union all select doc_id, 2, 'hex', start, stop from hex),
    listed as (select doc_id, count(*) filter (k = 0) as n_assign, count(*) filter (k = 1) as n_access, count(*) filter (k = 2) as n_hex,
        string_agg(concat(kind, ':', start::bigint, ':', stop::bigint), ',' order by start, k) as spans from spans group by doc_id)
    select doc_id, coalesce(n_assign, 0) as n_assign, coalesce(n_access, 0) as n_access, coalesce(n_hex, 0) as n_hex,
        sha256(coalesce(spans, '')) as base_sha256, coalesce(spans, '') as spans from bodies left join listed using (doc_id)"""


@query("op7_secret_scan", OP7)
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents as versions of paths, scanned with a ledger that is new to this run."""
    found = secrets.scan_versions(table(spark, sf_dir, "documents"), work_folder(spark, "ledger"))
    of = lambda kind: F.size(F.filter("findings", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    spans = secrets.span_text(F.col("findings"))
    return found.select("doc_id", of("assign"), of("access"), of("hex"), F.sha2(spans, 256).alias("base_sha256"), spans.alias("spans"))


@query("op8_byte_bpe")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = bpe.load_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    return bpe.digests(bpe.encode_and_decode(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN))


OP9 = """with x as (select vec_id, list_transform(embedding, lambda v: floor(256 * v::double)::bigint) as v from embeddings
        where embedding is not null and len(list_filter(embedding, lambda v: v is null or not isfinite(v))) = 0),
    s as (select q.vec_id as query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2]))::bigint as score
        from x q join x c on q.vec_id % 50 = 0 and c.vec_id <> q.vec_id),
    r as (select *, row_number() over (partition by query_id order by score desc, vec_id)::int as rank from s)
    select query_id, rank, vec_id, score from r where rank <= 5"""


@query("op9_exact_top_k", OP9)
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), every=50, k=5)


OP10 = r"""with cut as (select doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') as ws from documents),
    spots as (select doc_id, unnest(range(1, len(ws) - 11)) as pos, ws from cut),
    wins as (select doc_id, pos, array_to_string(ws[pos:pos + 12], ' ') as w from spots),
    low as (select w, min(doc_id) as first from wins group by w),
    gone as (select distinct doc_id, unnest(range(pos, pos + 13)) as i from wins join low using (w) where doc_id > first),
    words as (select doc_id, generate_subscripts(ws, 1) as i, unnest(ws) as word from cut),
    kept as (select doc_id, string_agg(word, ' ' order by i) as text, count(*) as n from words anti join gone using (doc_id, i) group by doc_id)
    select doc_id, len(ws)::bigint as n_words, (len(ws) - coalesce(n, 0))::bigint as n_removed, sha256(coalesce(kept.text, '')) as kept_sha256
    from cut left join kept using (doc_id)"""


@query("op10_substring_dedup", OP10)
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = substring_dedup.remove_repeats(table(spark, sf_dir, "documents"), words=13)
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


@query("op11_simhash_near_dedup")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), words=3, bits=3)


def with_periodic_tails(docs: DataFrame) -> DataFrame:
    """The documents (doc_id, text), a tenth of them with a text whose end repeats itself, by the rule of the query's contract."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    chosen = docs.select("doc_id", "text", F.when(h % 10 == 0, F.regexp_extract_all("text", F.lit(r"([^\x20\x09-\x0D]+)"), 1)).alias("ws"), F.floor(h / 10).alias("g"))
    n = F.size("ws")
    start = (F.col("g") % n).cast("int")
    sized = chosen.withColumn("a", F.when(n > 0, start))
    sized = sized.withColumn("p", (1 + F.floor((n - F.col("a")) / (3 + F.col("g") % 8))).cast("int"))
    block = F.slice("ws", F.col("a") + 1, F.col("p"))
    rest = n - F.col("a")
    tail = F.slice(F.flatten(F.array_repeat(block, F.ceil(rest / F.col("p")).cast("int"))), F.lit(1), rest)
    made = F.array_join(F.concat(F.slice("ws", F.lit(1), F.col("a")), tail), " ")
    return sized.select("doc_id", F.when(F.col("a").isNotNull(), made).otherwise(F.col("text")).alias("text"))


@query("op12_periodic_runs")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic.find_runs(with_periodic_tails(table(spark, sf_dir, "documents")))
    # Greatest length, then smallest start, then smallest period.
    ranked = F.transform("runs", lambda r: F.struct(r["length"], (-r["start"]).alias("start"), (-r["period"]).alias("period")))
    found = found.withColumn("best", F.array_max(ranked)).withColumn("period", -F.col("best.period"))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n"))), "")
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("best.start")).alias("start"),
        F.col("best.length").alias("length"),
        "period",
        F.floor(1000 * F.col("best.length") / F.col("period")).cast("long").alias("exponent_milli"),
        F.sha2(lines.cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("kept").cast("binary"), 256).alias("collapsed_sha256"),
    )


@query("op13_embedding_whitening")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"), components=16)
