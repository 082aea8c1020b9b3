"""Writers: corpus tables and the latest-cursor table."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from urllib.parse import unquote, urlsplit

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def write_corpus(docs: DataFrame, path: str, key: str = "doc_id") -> None:
    """Segments (partitioned by kind), chunks and rejects of nested documents as parquet tables under one folder.

    The nested documents are computed and written once; the flat tables are derived from that copy, which stays as
    `nested`.
    """
    docs.write.mode("overwrite").parquet(f"{path}/nested")
    docs = docs.sparkSession.read.schema(docs.schema).parquet(f"{path}/nested")
    if "error_code" in docs.columns:
        docs.filter("error_code is not null").select(key, "error_code", "error_message").write.mode("overwrite").parquet(
            f"{path}/rejects"
        )
        docs = docs.filter("error_code is null")
    docs.select(key, F.inline("segments")).write.mode("overwrite").partitionBy("kind").parquet(f"{path}/segments")
    if "chunks" in docs.columns:
        docs.select(key, F.inline("chunks")).write.mode("overwrite").parquet(f"{path}/chunks")


def write_texts(rows: DataFrame, path: str, bucket: str, value: str) -> str:
    """One text file per row, its line ended, in a folder `path/bucket=...`; the path.

    On a mounted file system Hadoop starts two processes per file to set modes, which takes milliseconds a file; the tasks
    write the files themselves there. A file is named by partition and row, so a repeated task writes its own files again.
    """
    where = urlsplit(path)
    if where.scheme not in ("", "file"):
        rows.write.partitionBy(bucket).option("maxRecordsPerFile", 1).text(path)
        return path
    top = unquote(where.path) if where.scheme else path

    def save(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = 0
        for batch in batches:
            task, folders, texts = (batch.column(i).to_pylist() for i in range(3))
            for folder in set(folders):
                os.makedirs(f"{top}/{folder}", exist_ok=True)
            for t, folder, text in zip(task, folders, texts, strict=True):
                with open(f"{top}/{folder}/part-{t:05d}-{n}.txt", "wb") as f:
                    f.write((text or b"") + b"\n")
                n += 1
        yield pa.RecordBatch.from_pydict({"n": pa.array([n], pa.int64())})

    name = F.concat(F.lit(f"{bucket}="), F.coalesce(F.col(bucket).cast("string"), F.lit("__HIVE_DEFAULT_PARTITION__")))
    rows.select(F.spark_partition_id(), name, F.col(value).cast("binary")).mapInArrow(save, "n long").agg(F.sum("n")).collect()
    return path


BUCKETS = 256


def update_corpus(docs: DataFrame, path: str, key: str = "doc_id", buckets: int = BUCKETS, bucket: Column | None = None) -> DataFrame:
    """Bring a stored corpus up to date with documents that may have changed; (key, bucket) of those that had.

    `docs` has a `fingerprint` (`documents.document_fingerprint`), which says whether a document is the same as the one
    stored under its key: unchanged ones are left alone by an anti-join of keys and fingerprints. Only the buckets of the
    others are read, merged and replaced; documents that are not among `docs` stay. `bucket` is an expression over the
    columns of `docs`; unset, keys are hashed into `buckets`.

    The merged buckets are written aside first, so a run that is lost halfway can be repeated: what it has replaced counts
    as unchanged then. Keys must be unique among `docs`; rows of null key are left out.
    """
    spark = docs.sparkSession
    place = F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int") if bucket is None else bucket.cast("int")
    new = docs.filter(F.col(key).isNotNull()).withColumn("bucket", place)
    stored, aside = f"{path}/corpus", f"{path}/aside-{uuid.uuid4().hex}"
    if not _exists(spark, stored):
        new.write.partitionBy("bucket").parquet(stored)
        return new.select(key, "bucket")
    old = spark.read.schema(new.schema).parquet(stored)
    changed = new.join(old.select(key, "fingerprint"), [key, "fingerprint"], "left_anti")
    changed.write.parquet(f"{aside}/changed")
    changed = spark.read.schema(new.schema).parquet(f"{aside}/changed")
    touched = [r[0] for r in changed.select("bucket").distinct().collect()]  # as many as there are buckets, at most
    kept = old.filter(F.col("bucket").isin(touched)).join(changed.select(key), key, "left_anti")
    kept.unionByName(changed).write.partitionBy("bucket").parquet(f"{aside}/merged")
    if touched:
        merged = spark.read.schema(new.schema).parquet(f"{aside}/merged")
        merged.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(stored)
    return changed.select(key, "bucket")


def _exists(spark: SparkSession, path: str) -> bool:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)


def latest_cursors(moves: DataFrame) -> DataFrame:
    """Last cursor per document key, never negative. Partial aggregation keeps one row per key and task.

    On a stream of moves this is a built-in streaming aggregation with one row of state per key, in update mode.
    """
    last = F.max(F.struct("seq", "segment_index", "char_offset")).alias("last")
    zero = F.lit(0)
    return moves.groupBy("doc_key").agg(last).select(
        "doc_key",
        F.col("last.seq").alias("seq"),
        F.greatest(F.col("last.segment_index"), zero).alias("segment_index"),
        F.greatest(F.col("last.char_offset"), zero).alias("char_offset"),
    )
