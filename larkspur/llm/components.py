"""Connected components of an edge table, by alternating star contraction.

Large-star links every larger neighbour of a node to the node's smallest
neighbour; small-star does the same for the smaller ones. Both are a grouped
minimum (combined map-side) and an equi-join, so a node with very many links is
pre-aggregated before the shuffle and split by AQE in the join. The loop ends
when the edge set no longer changes: every node then hangs on the smallest node
of its component. Nothing but two numbers per round reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def _signature(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return tuple(row)


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.join(low, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    low = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(low, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(low.select("a", F.col("m").alias("b"))).distinct()


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) for each node that has an edge; root is the component's smallest node.

    ``edges`` has two columns of one orderable type; their order, self links,
    repeats and nulls don't matter (null ends are dropped). No edges: no rows.
    """
    x, y = edges.columns
    ends = edges.select(F.greatest(x, y).alias("a"), F.least(x, y).alias("b"), F.col(x).alias("x"), F.col(y).alias("y"))
    state = cut(ends.filter("x is not null and y is not null and a <> b").select("a", "b").distinct())
    seen = _signature(state)
    for _ in range(max_rounds):
        if not seen[0]:
            break
        state = cut(_small_star(_large_star(state)))
        now = _signature(state)
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    nodes = state.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return nodes.unionByName(nodes.select(F.col("root").alias("node"), "root").distinct())
