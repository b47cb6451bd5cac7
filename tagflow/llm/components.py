"""Connected components of a link table by alternating large-star and small-star steps.

Cases: links with a null end and links of a node to itself are ignored, repeated ones and both directions count once, an
empty table gives an empty result. Only the two named columns are read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from tagflow.llm.common import spread_join, written
from tagflow.storage import cut


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, root (the smallest node reachable) for every node that has a link to another.

    Each step is two joins on pre-aggregated minima, written to the shared folder; the links of a node of very many are
    dealt over salts. Only counts reach the driver. Nulls and self-links are ignored; repeated links count once.
    """
    both = links.select(F.least(a, b).alias("lo"), F.greatest(a, b).alias("hi")).where("lo < hi").distinct()
    edges = written(both)
    state = (edges.count(), None)
    while True:
        seen = Observation()  # counted while they are written
        starred = small_star(large_star(edges, state[0]), state[0])
        edges = cut(starred.observe(seen, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("lo", "hi").cast("decimal(38,0)")).alias("sum")), "zstd", edges)
        now = (seen.get["n"], seen.get["sum"])
        if now == state:
            return edges.select(F.col("hi").alias("node"), F.col("lo").alias("root"))
        state = now


def large_star(edges: DataFrame, total: int) -> DataFrame:
    """Every larger neighbour of a node is linked to the smallest neighbour, or the node."""
    around = edges.select(F.col("lo").alias("u"), F.col("hi").alias("v")).unionByName(edges.select(F.col("hi").alias("u"), F.col("lo").alias("v")))
    least = around.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
    out = spread_join(around.where("v > u"), least.drop("n"), "u", least, 2 * total).select(F.least("u", "m").alias("lo"), F.col("v").alias("hi"))
    return out.distinct()


def small_star(edges: DataFrame, total: int) -> DataFrame:
    """A node and its smaller neighbours are linked to the smallest of them."""
    least = edges.groupBy("hi").agg(F.min("lo").alias("m"), F.count("*").alias("n"))
    moved = spread_join(edges, least.drop("n"), "hi", least, total).where("lo <> m").select(F.col("m").alias("lo"), F.col("lo").alias("hi"))
    return moved.unionByName(least.select(F.col("m").alias("lo"), "hi")).distinct()
