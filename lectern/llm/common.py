"""Helpers of the training-data operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lectern.session import work_folder

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, purpose: str) -> DataFrame:
    """The rows written to the shared folder and read back: they are computed once and outlive any executor."""
    path = work_folder(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


BROADCAST_BYTES = 1 << 20


def shuffled_if_large(table: DataFrame) -> DataFrame:
    """A written table as a side of a join: beyond `BROADCAST_BYTES` of files it is shuffled whatever the session's limit.

    Spark compares that limit with the size of the files; as a broadcast table they take the driver ten times as much.
    """
    size = int(table._jdf.queryExecution().analyzed().stats().sizeInBytes())
    return table.hint("merge") if size > BROADCAST_BYTES else table


MARKS = 1 << 23  # bits of a broadcast filter


def may_match(rows: DataFrame, keys: list[str], others: DataFrame, other_keys: list[str], name: str) -> DataFrame:
    """`rows` with a column `name`: false only where no row of `others` has these keys.

    The keys of `others` are hashed into `MARKS` bits, so a table of 2 MB at most is broadcast. Rows that cannot match need
    not be shuffled for a join; the others must still be joined. Keys must have the same types on both sides.
    """

    def bit(columns: list[str]) -> Column:
        return F.pmod(F.xxhash64(*columns), F.lit(MARKS))

    word, marks, place = (free_name(rows, n) for n in ("word", "marks", "place"))
    single = lambda at: f"shiftleft(1L, cast({at} % 64 as int))"
    found = others.select(bit(other_keys).alias(place)).groupBy(F.expr(f"{place} div 64").alias(word)).agg(F.expr(f"bit_or({single(place)})").alias(marks))
    rows = rows.withColumn(place, bit(keys)).withColumn(word, F.expr(f"{place} div 64")).join(F.broadcast(found), word, "left")
    return rows.withColumn(name, F.expr(f"coalesce({marks} & {single(place)}, 0L) <> 0")).drop(word, marks, place)


def free_name(df: DataFrame, name: str) -> str:
    """A name for a working column that no column of the table has, whatever its case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def with_fields(schema: StructType, ddl: str) -> StructType:
    """The schema with more fields."""
    return StructType([*schema.fields, *StructType.fromDDL(ddl).fields])


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def remainder(key: str, parts: int):
    """crc32 of the key as text, modulo `parts`: the fixed rule for held-out rows."""
    return F.crc32(F.col(key).cast("string").cast("binary")) % parts


def held_out(key: str, parts: int, part: int):
    """Whether a row is kept from training; a row without a key is never trained on, but is in no part either."""
    return F.coalesce(remainder(key, parts) == part, F.lit(False)).alias("held_out")
