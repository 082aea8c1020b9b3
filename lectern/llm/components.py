"""Connected components of an edge table, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import shuffled_if_large, stored


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node of `edges`; nodes of one component, and only those, share a root.

    Each round maps every node to the smallest node among itself and its neighbours and contracts the edges. Node ids
    should be hash values: with ids in random order a round removes a constant share of the nodes even on long chains, so
    the rounds grow with the logarithm of the longest chain. A hub costs one partial minimum per task. Every round's
    tables are written to the shared folder, so no lineage grows and no driver or task holds the graph.

    Empty edges give no rows; null ends and self loops are dropped.
    """
    edges = edges.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).filter("a < b").distinct()
    edges = stored(edges, "edges")
    steps = []
    while True:
        both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        step = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low"))
        step = stored(step.select("node", F.least("node", "low").alias("root")), "step")
        steps.append(step)
        left = step.select(F.col("node").alias("a"), F.col("root").alias("ra"))
        right = step.select(F.col("node").alias("b"), F.col("root").alias("rb"))
        moved = edges.join(shuffled_if_large(left), "a").join(shuffled_if_large(right), "b")
        moved = moved.select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).filter("a < b")
        edges = stored(moved.distinct(), "edges")
        if edges.isEmpty():
            break
    found = steps[0]
    for step in steps[1:]:
        step = step.select(F.col("node").alias("root"), F.col("root").alias("further"))
        found = found.join(shuffled_if_large(step), "root", "left").select("node", F.coalesce("further", "root").alias("root"))
    return found
