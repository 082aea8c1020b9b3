"""Secret scans with an incremental ledger of blobs.

Every version of every path is addressed by the SHA-256 of its content. The ledger records which (blob, rule version)
pairs have been scanned and what was found. A scan looks only at blobs that the ledger has not seen under the present
rules, appends them, and joins the findings back to all paths. All work is done by DataFrame functions.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions.plan import let

BLOCK = 256  # elements of an array that are folded one after the other
CHUNK = 4096  # code points of a text that are searched for a position


class Rule(NamedTuple):
    kind: str
    pattern: str
    group: int  # what must be long enough
    least: int


# The rules, in order. Access keys and hex runs carry their least length in the pattern, which leaves the
# same matches, as a shorter run holds no other match.
RULES = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    Rule("access", r"AKIA[A-Z0-9]{12,}", 0, 16),
    Rule("hex", r"[0-9a-f]{32,}", 0, 32),
)
LEDGER = "blob string, rule_version string, findings array<struct<start:int,kind_no:int,kind:string,end:int>>"
FINDINGS = "array<struct<start:int,kind_no:int,kind:string,end:int>>"


def rule_version(rules=RULES) -> str:
    """A name for a set of rules that changes with it."""
    return "|".join(f"{r.kind}~{r.pattern}~{r.group}~{r.least}" for r in rules)


def running(values: Column, combine) -> Column:
    """`combine` of every element of an array of ints with all before it, in time linear in the array's length.

    Appending to an array copies it, so blocks are folded apart and then take on what the blocks before them came to.
    """

    def fold(v: Column) -> Column:
        last = lambda done, x: F.coalesce(combine(F.get(done, F.size(done) - 1), x), x)
        return F.aggregate(v, F.array().cast("array<int>"), lambda done, x: F.array_append(done, last(done, x)))

    def joined(blocks: Column) -> Column:
        totals = fold(F.transform(blocks, lambda b: F.get(b, F.size(b) - 1)))
        carry = lambda t: lambda b, i: F.transform(b, lambda x: F.coalesce(combine(F.get(t, i - 1), x), x))
        return let(totals, lambda t: F.flatten(F.transform(blocks, carry(t))))

    def cut(v: Column) -> Column:
        starts = F.when(F.size(v) > 0, F.sequence(F.lit(1), F.size(v), F.lit(BLOCK))).otherwise(F.array().cast("array<int>"))
        return let(F.transform(starts, lambda at: fold(F.slice(v, at, F.lit(BLOCK)))), joined)

    return let(values, cut)


def spans_of(text: Column, rule: Rule, number: int) -> Column:
    """Matches of a rule, leftmost and without overlap, in code points. Text between matches gives their positions."""
    whole = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)) if rule.group else whole
    gaps = F.split(text, rule.pattern, -1)

    def placed(sizes: Column) -> Column:
        ends = running(F.transform(sizes, lambda s: s["gap"] + s["len"]), lambda a, b: a + b)
        spans = F.zip_with(sizes, ends, lambda s, end: F.struct(
            (end - s["len"]).alias("start"), F.lit(number).alias("kind_no"), F.lit(rule.kind).alias("kind"), end.alias("end"), s["value"].alias("value")))
        long = F.filter(spans, lambda s: s["value"] >= rule.least)
        return F.transform(long, lambda s: F.struct(s["start"].alias("start"), s["kind_no"].alias("kind_no"), s["kind"].alias("kind"), s["end"].alias("end"))).cast(FINDINGS)

    matches = F.zip_with(whole, value, lambda w, v: F.struct(F.length(w).alias("len"), F.length(v).alias("value")))
    # There is one gap more than there are matches; the last one has no match behind it.
    sizes = F.zip_with(gaps, matches, lambda g, m: F.struct(F.length(g).alias("gap"), m["len"].alias("len"), m["value"].alias("value")))
    found = let(F.filter(sizes, lambda s: s["len"].isNotNull()), placed)
    return F.when(F.size(whole) > 0, found).otherwise(F.array().cast(FINDINGS))


def find_secrets(text: Column, rules=RULES) -> Column:
    """All findings of a text in order of start, then of rule; a null text has none."""
    found = F.concat(*[spans_of(text, r, i) for i, r in enumerate(rules)])
    return F.array_sort(F.coalesce(found, F.array().cast(FINDINGS)))


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """The ledger's rows; a ledger that does not exist yet is made empty."""
    spark.range(0).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in spark.createDataFrame([], LEDGER).schema]).write.mode("append").parquet(path)
    return spark.read.schema(LEDGER).parquet(path)


def scan_versions(versions: DataFrame, ledger: str, content: str = "text", rules=RULES) -> DataFrame:
    """All rows and columns of `versions` plus `findings`, sorted spans in code points; `ledger` is a folder all executors share.

    A null content counts as empty and has no findings. Rows of equal content are scanned once, whatever their number,
    and again only when the rules change. A column named findings is replaced. An empty table scans nothing.
    Only blobs with findings are joined back; a blob with very many paths is split by the adaptive join.
    """
    spark, version = versions.sparkSession, rule_version(rules)
    body = F.coalesce(F.col(content), F.lit(""))
    blob = F.sha2(body.cast("binary"), 256)
    seen = read_ledger(spark, ledger).filter(F.col("rule_version") == version).select("blob")
    contents = versions.select(blob.alias("blob"), body.alias("body")).groupBy("blob").agg(F.first("body").alias("body"))
    unseen = contents.join(seen, "blob", "left_anti")
    unseen.select("blob", F.lit(version).alias("rule_version"), find_secrets(F.col("body"), rules).alias("findings")).write.mode("append").parquet(ledger)
    known = spark.read.schema(LEDGER).parquet(ledger).filter((F.col("rule_version") == version) & (F.size("findings") > 0))
    known = known.groupBy(F.col("blob").alias("found_blob")).agg(F.first("findings").alias("found_here"))
    rows = versions.select(F.struct(*[versions[c] for c in versions.columns if c != "findings"]).alias("row"), blob.alias("blob"))
    joined = rows.join(known, F.col("blob") == F.col("found_blob"), "left")
    return joined.select("row.*", F.coalesce("found_here", F.array().cast(FINDINGS)).alias("findings"))


def span_text(findings: Column) -> Column:
    """kind:start:end of all findings, comma-joined."""
    return F.concat_ws(",", F.transform(findings, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])))


def redact(text: str, findings: str = "findings", mark: str = "[SECRET]") -> Column:
    """The text column with every finding replaced; findings that overlap are replaced as one.

    The text is cut once into chunks of CHUNK code points, as reading a string from a far position takes as long as the
    position is far.
    """
    body = F.col(text)

    def between(chunks: Column, start: Column, end: Column) -> Column:
        first = F.floor(start / CHUNK).cast("int")
        some = F.slice(chunks, first + 1, F.floor((end - 1) / CHUNK).cast("int") - first + 1)
        return F.when(end > start, F.substring(F.array_join(some, ""), start - first * CHUNK + 1, end - start)).otherwise(F.lit(""))

    def replaced(chunks: Column, reached: Column) -> Column:
        def piece(s: Column, i: Column) -> Column:
            at = F.coalesce(F.get(reached, i - 1), F.lit(0))  # the end of all findings before
            return F.when(s["start"] >= at, F.concat(between(chunks, at, s["start"]), F.lit(mark))).otherwise(F.lit(""))

        last = F.get(reached, F.size(reached) - 1)
        return F.concat(F.array_join(F.transform(F.col(findings), piece), ""), between(chunks, last, F.length(body)))

    ends = running(F.transform(F.col(findings), lambda s: s["end"]), F.greatest)
    chunks = F.regexp_extract_all(body, F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0))
    done = let(chunks, lambda c: let(ends, lambda e: replaced(c, e)))
    return F.when(F.size(findings) > 0, done).otherwise(body)
