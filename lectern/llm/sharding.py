"""Two-pass external shuffle into shards.

Pass one scatters the rows with a seeded hash of key and text, uniformly, into buckets that fit in memory. Copies of one
row would all hash alike; where they come to more than a part of a bucket, their position is hashed too. Pass two shuffles every bucket
(Spark's `shuffle` is a seeded Fisher-Yates permutation) and lays the buckets end to end; shards are equal stretches of
that order, so their row counts differ by one at most and a bucket is written to one or two shards only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm.common import shuffle_partitions, stored

BUCKET_BYTES = 32 << 20
HOT_PARTS = 2  # rows that hash alike are spread where they exceed this part, a half, of a bucket
MOST_STARTS = 4_000_000  # bucket starts that are broadcast, some 16 bytes each: 128 TB of text in buckets of 32 MB
ADDED = ["size", "law", "shard", "slot", "grown_shard"]


def shard(
    docs: DataFrame, shards: int = 8, seed: int = 20240, key: str = "doc_id", text: str = "text", bucket_bytes: int = BUCKET_BYTES
) -> DataFrame:
    """All rows with their columns, and size, law ('rows'), shard (from 0), slot (gapless from 0 in each shard), grown_shard (null).

    size is the UTF-8 length of the text plus 1; a null text counts nothing. Row counts of shards differ by one at most.
    Copies of a text scatter like any other rows; equal rows take different slots. A null key or text is hashed as null.
    One text longer than `bucket_bytes` makes one larger bucket. An empty table gives no rows. Columns of `docs` that have
    the name of an added column are replaced.

    A bucket is one partition; its rows are put in order of hash, key and text before they are permuted, so the result
    depends on the rows, the seed and the number of buckets only, but for rows of one key and text that together exceed
    a part of a bucket: those are dealt out by their position in the input, which is the same at every read of a file.
    Texts are shuffled once; what else is shuffled are hashes, sizes and counts.
    """
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns if c not in ADDED]).alias("row"))
    rows = rows.withColumn("size", F.coalesce(F.octet_length(f"row.{text}"), F.lit(0)).cast("long") + 1)
    rows = rows.withColumn("draw", F.xxhash64(F.lit(seed), f"row.{key}", f"row.{text}"))
    draws = stored(rows.groupBy("draw").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")), "draws")
    total, count = draws.agg(F.sum("bytes"), F.sum("n")).first()
    count = count or 0
    buckets = int(max(shuffle_partitions(docs.sparkSession), (total or 0) // bucket_bytes + 1))
    # Of these there are at most `HOT_PARTS` for each bucket.
    hot = draws.filter((F.col("n") > 1) & (F.col("bytes") * HOT_PARTS > bucket_bytes)).select("draw", F.lit(True).alias("hot"))
    few = hot.count()
    if few:
        rows = rows.withColumn("position", F.monotonically_increasing_id())
        rows = rows.join(F.broadcast(hot) if few <= MOST_STARTS else hot, "draw", "left")
        rows = rows.withColumn("draw", F.when(F.col("hot"), F.xxhash64("draw", "position")).otherwise(F.col("draw")))
    rows = rows.withColumn("bucket", F.pmod("draw", F.lit(buckets)).cast("int"))
    counted = rows if few else draws.withColumn("bucket", F.pmod("draw", F.lit(buckets)).cast("int"))
    starts = counted.groupBy("bucket").agg((F.count("*") if few else F.sum("n")).alias("n"))
    # One row per bucket, so this window holds as many rows as there are buckets.
    starts = starts.select("bucket", (F.sum("n").over(Window.orderBy("bucket")) - F.col("n")).alias("start"))
    # Broadcast, so that the texts are not shuffled again to meet the starts.
    starts = F.broadcast(starts) if buckets <= MOST_STARTS else starts
    scattered = rows.repartitionById(buckets, "bucket").sortWithinPartitions("draw", f"row.{key}", f"row.{text}")
    pile = scattered.groupBy("bucket").agg(F.collect_list(F.struct("row", "size")).alias("pile"))
    mixed = pile.select("bucket", F.posexplode(F.shuffle("pile", seed)).alias("pos", "item"))
    placed = mixed.join(starts, "bucket").withColumn("at", F.col("start") + F.col("pos"))
    n = F.lit(max(count, 1)).cast("long")
    number = F.expr(f"at * {shards} div {max(count, 1)}")
    return placed.withColumn("number", number).select(
        "item.row.*",
        F.col("item.size").alias("size"),
        F.lit("rows").alias("law"),
        F.col("number").cast("int").alias("shard"),
        (F.col("at") - F.floor((F.col("number") * n + (shards - 1)) / shards).cast("long")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


def write_shards(sharded: DataFrame, path: str) -> None:
    """One folder per shard; rows of a file lie in slot order."""
    sharded.sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
