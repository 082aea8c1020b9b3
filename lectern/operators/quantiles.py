"""Exact percentiles that do not gather a group's values in one place."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SMALL_GROUP = 100_000  # groups up to this size keep all their distinct values
ACCURACY = 100_000  # the sketch is off by at most one rank in this many
BINS = 4096  # of a bracket
MARGIN = 5e-5  # wide enough for the sketch error and the two neighbouring ranks of a group above SMALL_GROUP


def exact_percentiles(df: DataFrame, group: str, value: str, probs: dict[str, float], few_groups: bool = False) -> DataFrame:
    """(group, n, one column per probability), interpolated between the two nearest ranks.

    `few_groups` states that the groups come from a short fixed list, so their brackets may be broadcast; otherwise the
    join follows the sizes measured at run time.

    Groups of up to SMALL_GROUP values keep all their distinct values with counts, which are ranked by one window. In a
    larger one a mergeable sketch first brackets each percentile. A second pass counts what lies below the bracket and
    keeps only the distinct values inside it, with their counts. A value shared by a third of all rows is one row by then.
    Counts of equal bins of the bracket then tell which bin holds the rank sought, so a task ranks one bin in 4096 of a
    bracket that holds about one in ten thousand rows. Whether there are larger groups is asked first.
    """
    clean = df.filter(F.col(value).isNotNull()).select(group, F.col(value).cast("double").alias("_x"))
    large = clean.groupBy(group).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > SMALL_GROUP).select(group)
    if large.isEmpty():
        return _ranked(clean, group, probs)
    few = F.broadcast(large) if few_groups else large
    same = clean[group].eqNullSafe(large[group])
    small = clean.join(few, same, "left_anti")
    return _ranked(small, group, probs).unionByName(_bracketed(clean.join(few, same, "left_semi"), group, probs, few_groups))


def _columns(probs: dict[str, float]) -> list:
    """One column per probability from the values `_f<i>` and `_c<i>` at the ranks below and above."""
    out = []
    for i, (name, p) in enumerate(probs.items()):
        place = F.lit(p) * (F.col("n") - 1)
        part = place - F.floor(place)
        out.append((F.col(f"_f{i}") + (F.col(f"_c{i}") - F.col(f"_f{i}")) * part).alias(name))
    return out


def _ranked(clean: DataFrame, group: str, probs: dict[str, float]) -> DataFrame:
    """All distinct values of a group ranked at once."""
    counted = clean.groupBy(group, "_x").agg(F.count(F.lit(1)).alias("_k"))
    upto = F.sum("_k").over(W.partitionBy(group).orderBy("_x"))
    ranked = counted.withColumn("_upto", upto).withColumn("n", F.sum("_k").over(W.partitionBy(group)))
    picks = []
    for i, p in enumerate(probs.values()):
        for side, turn in (("f", F.floor), ("c", F.ceil)):
            picks.append(F.min(F.when(F.col("_upto") > turn(F.lit(p) * (F.col("n") - 1)), F.col("_x"))).alias(f"_{side}{i}"))
    found = ranked.groupBy(group).agg(F.max("n").alias("n"), *picks)
    return found.select(group, "n", *_columns(probs))


def _bracketed(clean: DataFrame, group: str, probs: dict[str, float], few_groups: bool) -> DataFrame:
    edges = [max(0.0, min(1.0, p + s)) for p in probs.values() for s in (-MARGIN, MARGIN)]
    sketch = clean.groupBy(group).agg(
        F.count(F.lit(1)).alias("n"), F.percentile_approx("_x", edges, ACCURACY).alias("_e")
    )
    brackets = sketch.select(
        group,
        "n",
        *[
            F.when(F.col("n") > SMALL_GROUP, F.get("_e", F.lit(2 * i + side))).otherwise(F.lit(limit)).alias(f"_{edge}{i}")
            for i in range(len(probs))
            for side, edge, limit in ((0, "lo", float("-inf")), (1, "hi", float("inf")))
        ],
    )
    within = clean.join(F.broadcast(brackets) if few_groups else brackets, group)
    inside = [F.col("_x").between(F.col(f"_lo{i}"), F.col(f"_hi{i}")) for i in range(len(probs))]
    kept = reduce(lambda a, b: a | b, inside)
    # Rows outside every bracket are reduced to counts before the shuffle; the rest become (value, count) pairs.
    counted = within.groupBy(
        group, F.when(kept, F.col("_x")).alias("_x"),
    ).agg(
        F.count(F.lit(1)).alias("_c"),
        *[F.count_if(F.col("_x") < F.col(f"_lo{i}")).alias(f"_b{i}") for i in range(len(probs))],
        *[F.first(f"_{e}{i}").alias(f"_{e}{i}") for i in range(len(probs)) for e in ("lo", "hi")],
        F.first("n").alias("n"),
    )
    below = counted.groupBy(group).agg(F.max("n").alias("n"), *[F.sum(f"_b{i}").alias(f"_b{i}") for i in range(len(probs))])
    brackets_of = F.array(*[F.struct(F.lit(i).alias("i"), F.col(f"_lo{i}").alias("lo"), F.col(f"_hi{i}").alias("hi")) for i in range(len(probs))])
    held = F.filter(brackets_of, lambda b: F.col("_x").between(b["lo"], b["hi"]))
    items = counted.filter("_x is not null").select(group, "_x", "_c", F.explode(held).alias("b")).select(group, "_x", "_c", "b.*")
    # A bracket is cut into equal bins; their counts tell which bin holds a rank, and only that bin's values are ranked.
    width = F.col("hi") - F.col("lo")
    finite = (F.abs("lo") < float("inf")) & (F.abs("hi") < float("inf")) & (width > 0)
    place = F.least(F.floor((F.col("_x") - F.col("lo")) / width * BINS), F.lit(BINS - 1))
    items = items.withColumn("_bin", F.when(finite, place).otherwise(F.lit(0)).cast("int")).select(group, "i", "_bin", "_x", "_c")
    bins = items.groupBy(group, "i", "_bin").agg(F.sum("_c").alias("_n"))
    upto = F.sum("_n").over(W.partitionBy(group, "i").orderBy("_bin"))
    bins = bins.withColumn("_upto", upto).withColumn("_before", F.col("_upto") - F.col("_n"))
    ranks = [
        F.struct(F.lit(i).alias("i"), F.lit(side).alias("side"), (turn(F.lit(p) * (F.col("n") - 1)) - F.col(f"_b{i}")).cast("long").alias("rank"))
        for i, p in enumerate(probs.values())
        for side, turn in (("f", F.floor), ("c", F.ceil))
    ]
    sought = below.select(group, F.explode(F.array(*ranks)).alias("r")).select(group, "r.*")
    chosen = bins.join(sought, [group, "i"]).filter("rank >= _before and rank < _upto")
    chosen = chosen.select(group, "i", "_bin", "side", (F.col("rank") - F.col("_before")).alias("_left"))
    reached = F.sum("_c").over(W.partitionBy(group, "i", "side").orderBy("_x"))
    hits = items.join(chosen, [group, "i", "_bin"]).withColumn("_reached", reached).filter("_reached > _left")
    picks = [F.min(F.when((F.col("i") == i) & (F.col("side") == side), F.col("_x"))).alias(f"_{side}{i}") for i in range(len(probs)) for side in "fc"]
    found = below.select(group, "n").join(hits.groupBy(group).agg(*picks), group)
    return found.select(group, "n", *_columns(probs))
