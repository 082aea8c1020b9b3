"""A corpus pipeline: quality filter, near duplicates, benchmark decontamination, secrets, tokens."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm import bpe, decontaminate, quality, secrets
from lectern.llm.common import free_name, may_match, stored, table
from lectern.llm.jaccard_join import jaccard_join
from lectern.session import work_folder


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labelled ones, accepts.

    Null, empty and blank texts are scored like any other text without features. Rows without an id are judged by their
    text; without labelled rows the model is neutral and keeps every row. An empty table stays empty.
    """
    return quality.accepted(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of rows linked by five-word shingles at a similarity of 0.8 or more.

    Rows, not ids, are compared: rows of one id with different texts are different documents, and rows without an id take
    part. The row of the smallest id stays, rows without an id come last, and ties go to the row that was numbered first.
    Null, empty and blank texts have no words and link with nothing, so their rows all stay. An empty table stays empty.
    """
    number = free_name(docs, "row")
    # A row's number is drawn once and kept by the written table, so every later read sees the same one.
    rows = stored(docs.withColumn(number, F.monotonically_increasing_id()), "rows")
    # Null sorts before 1: rows with an id come first.
    keyed = rows.select(F.struct(F.when(F.col("doc_id").isNull(), 1).alias("last"), "doc_id", F.col(number).alias("row")).alias("key"), "text")
    groups = jaccard_join(keyed, key="key", words=5, num=8, den=10)
    dropped = stored(groups.filter("key.row <> component_id.row").select(F.col("key.row").alias(number)), "dropped")
    # Only texts of rows that may be dropped are shuffled.
    unsure = free_name(docs, "unsure")
    rows = may_match(rows, [number], dropped, [number], unsure)
    kept = rows.filter(F.col(unsure)).join(dropped.hint("merge"), number, "left_anti")
    return rows.filter(~F.col(unsure)).unionByName(kept).select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of the benchmark. Null, empty and wordless texts hold none and stay; so do all rows
    where the benchmark is empty. Rows without an id are judged by their text."""
    return decontaminate.without_contaminated(docs, table(spark, sf_dir, "benchmark"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets replaced in their texts; n_chars follows the new text. Null and empty texts stay as they
    are; rows without an id and repeated rows are kept like any other."""
    found = secrets.scan_versions(docs, work_folder(spark, "ledger"))
    changed = F.size("findings") > 0
    out = found.withColumn("text", secrets.redact("text"))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(changed, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document and what they decode to, as digests. A null text counts as empty: no ids, no bytes."""
    ranks = bpe.load_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    return bpe.digests(bpe.encode_and_decode(docs, ranks, public_tokenizers.PATTERN))


STAGES = [
    ("quality", keep_quality),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("secrets", redact_secrets),
    ("tokens", encode),
]
ORACLE_SQL = None  # SQL has neither the classifier nor the tokenizer; the tests compare with a brute-force version


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; each stage's rows are written to the shared folder before the next reads them."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


QUERIES = {"pipeline": run}
ORACLES = {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
