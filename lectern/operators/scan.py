"""Running values per key that stay even when one key holds most of the rows.

A plain window over a session puts the whole session into one task. Here a session is cut into blocks of its order
column; each block is scanned by itself, one summary row per block is scanned per session, and the summary is joined
back on (key, block). The big table is shuffled once, on (key, block).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Width of a block in units of the order column. A hot session of N rows makes about N / BLOCK summary rows.
BLOCK = 1 << 16

_FOLD = {"sum": F.sum, "max": F.max, "min": F.min}


def _combine(kind: str, carried: Column, local: Column) -> Column:
    if kind == "sum":
        return F.coalesce(carried, F.lit(0)) + F.coalesce(local, F.lit(0))
    return F.greatest(carried, local) if kind == "max" else F.least(carried, local)


def running(df: DataFrame, keys: list[str], order: str, values: dict[str, tuple[str, Column]], block: int = BLOCK,
            tie: list[str] | None = None, reverse: bool = False, inclusive: bool = True) -> DataFrame:
    """Adds one running value per entry of `values`: name -> ("sum" | "max" | "min", expression).

    `order` is numeric; `tie` breaks equal values. `reverse` scans from the end. With `inclusive=False` the row itself
    is left out. Max and min may run over structs, which gives "latest non-null" when the struct starts with the order.
    """
    at = F.floor(F.col(order) / F.lit(block)).cast("bigint")
    cut = df.withColumn("_block", -at if reverse else at)
    for name, (_, value) in values.items():
        cut = cut.withColumn(f"_v_{name}", value)
    first = [F.col(c).desc() if reverse else F.col(c) for c in [order, *(tie or [])]]
    inside = W.partitionBy(*keys, "_block").orderBy(*first).rowsBetween(W.unboundedPreceding, 0 if inclusive else -1)
    local = cut
    for name, (kind, _) in values.items():
        local = local.withColumn(f"_l_{name}", _FOLD[kind](f"_v_{name}").over(inside))
    totals = cut.groupBy(*keys, "_block").agg(*[_FOLD[kind](f"_v_{name}").alias(f"_t_{name}") for name, (kind, _) in values.items()])
    before = W.partitionBy(*keys).orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    carried = totals.select(
        *keys, "_block", *[_FOLD[kind](f"_t_{name}").over(before).alias(f"_c_{name}") for name, (kind, _) in values.items()]
    )
    joined = local.join(carried, [*keys, "_block"])
    return joined.select(
        *df.columns, *[_combine(kind, F.col(f"_c_{name}"), F.col(f"_l_{name}")).alias(name) for name, (kind, _) in values.items()]
    )
