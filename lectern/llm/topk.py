"""Exact top-k search: term-at-a-time accumulation over blocks.

Queries and candidates are dealt into blocks of bounded size, and every pair of blocks meets in one task group. There the
candidates become postings per dimension (row, weight); for each dimension the queries that have it scatter their weight
times the postings into a dense array of scores. A partition selection keeps each query's best of the block; the blocks'
lists are merged by a window. Every query row is scored against every row; nothing is pruned or approximated.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm.common import shuffle_partitions

ROWS, QUERIES_PER_BLOCK = 2048, 1024
NEVER = np.iinfo(np.int64).min


def postings(vectors: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(term, row, weight) of all components that are not zero, by term and row."""
    lists = vectors.combine_chunks()
    size = np.asarray(lists.value_lengths()).astype(np.int64)
    weight = np.asarray(lists.flatten()).astype(np.int64)
    row = np.repeat(np.arange(len(size)), size)
    term = np.arange(len(weight)) - np.repeat(np.cumsum(size) - size, size)
    keep = np.flatnonzero(weight)
    keep = keep[np.lexsort((row[keep], term[keep]))]
    return term[keep], row[keep], weight[keep]


def accumulate(queries: pa.ChunkedArray, rows: pa.ChunkedArray) -> np.ndarray:
    """Inner products of all queries and rows of two blocks, one dimension after the other."""
    scores = np.zeros((len(queries), len(rows)), np.int64)
    q_term, q_row, q_weight = postings(queries)
    c_term, c_row, c_weight = postings(rows)
    for t in np.intersect1d(q_term, c_term):
        q = slice(*np.searchsorted(q_term, [t, t + 1]))
        c = slice(*np.searchsorted(c_term, [t, t + 1]))
        places = c_row[c] if c.stop - c.start < len(rows) else slice(None)
        for i, w in zip(q_row[q].tolist(), q_weight[q], strict=True):
            scores[i, places] += w * c_weight[c]
    return scores


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Columns of the k highest scores, ties to the smaller id; scores of NEVER do not count."""
    found = np.flatnonzero(scores >= max(np.partition(scores, len(scores) - k)[len(scores) - k], NEVER + 1) if len(scores) > k else scores > NEVER)
    return found[np.lexsort((ids[found], -scores[found]))[:k]]


def top_k(vectors: DataFrame, every: int = 50, k: int = 5, key: str = "vec_id", vector: str = "embedding", scale: int = 256) -> DataFrame:
    """(query_id, rank, vec_id, score): the k rows of highest inner product for each row whose key is divisible by `every`.

    Components x become floor(scale * x). A query meets every row but those of its own key; ties go to the smaller key,
    equal rows keep their repetitions. Fewer than k other rows: all of them. Vectors that are null or hold a null or a
    non-finite component, and rows of null key, take no part. Missing dimensions of shorter vectors count as zero; an
    empty vector scores 0. Products and sums wrap like 64-bit integers. A repeated query row counts once.
    """
    x = F.col(vector).cast("array<double>")
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    rows = vectors.filter(F.col(key).isNotNull() & F.col(vector).isNotNull() & finite)
    rows = rows.select(F.col(key).cast("long").alias("id"), F.transform(x, lambda v: F.floor(v * scale).cast("long")).alias("v"))
    queries = rows.filter(F.col("id") % every == 0).distinct()
    n = rows.count()
    n_queries = queries.count()
    row_blocks = max(shuffle_partitions(vectors.sparkSession), -(-n // ROWS))
    query_blocks = max(1, -(-n_queries // QUERIES_PER_BLOCK))
    block = lambda n: F.pmod(F.xxhash64("id", "v"), F.lit(n)).cast("int")
    every_block = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = queries.select("id", "v", block(query_blocks).alias("q"), every_block(row_blocks).alias("c"))
    right = rows.select("id", "v", block(row_blocks).alias("c"), every_block(query_blocks).alias("q"))

    def search(asked: pa.Table, given: pa.Table) -> pa.Table:
        out = {"query_id": [], "nth": [], "vec_id": [], "score": []}
        if len(asked) and len(given):
            scores = accumulate(asked["v"], given["v"])
            query_ids, ids = np.asarray(asked["id"]), np.asarray(given["id"])
            scores[query_ids[:, None] == ids[None, :]] = NEVER
            nth = np.asarray(asked["nth"])
            for i, query in enumerate(query_ids.tolist()):
                for j in best(scores[i], ids, k).tolist():
                    for name, value in (("query_id", query), ("nth", int(nth[i])), ("vec_id", int(ids[j])), ("score", int(scores[i, j]))):
                        out[name].append(value)
        return pa.table({name: pa.array(values, pa.int64()) for name, values in out.items()})

    left = left.withColumn("nth", F.xxhash64("v"))
    found = left.groupBy("q", "c").cogroup(right.groupBy("q", "c")).applyInArrow(search, "query_id long, nth long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id", "nth").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
