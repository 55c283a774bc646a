"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from polysafe.llm.common import cut, parts_for

#: Edges of a partition at least: a round's table takes files and tasks by its rows, whatever the number of shuffle partitions.
EDGES = 4096


def _star(edges: DataFrame, larger: bool) -> DataFrame:
    """Every node's neighbours (the larger ones, or itself and the smaller ones) hung on the least of them."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    near = both if larger else both.where("b < a")
    least = near.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    hung = near.join(least, "a")
    out = hung.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")) if larger else (
        hung.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b"))))
    return out.where("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """``node, component`` (the least reachable node) of every node of ``edges`` (``a, b``, longs).

    Only table operations; the number of rounds grows with the logarithm of a
    component's size.  An edge from a node to itself is ignored, an empty
    table gives no rows.  ``edges`` is counted first, so it should be stored.
    """
    now = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    now = cut(now.coalesce(parts_for(edges.count(), EDGES)))

    def state(df: DataFrame):
        return df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()

    seen = state(now)
    while seen[0]:
        now = cut(_star(_star(now, larger=True), larger=False).coalesce(parts_for(seen[0], EDGES)))
        if (then := state(now)) == seen:
            break
        seen = then
    out = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return out.unionByName(out.select(F.col("component").alias("node"), "component").distinct()).coalesce(parts_for(seen[0], EDGES))
