"""Connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowlens.sources.scratch import materialize


# links whose nodes are broadcast to them; the nodes of more are joined by a shuffle
BROADCAST_LINKS = 100_000


def _large_star(edges: DataFrame, few: bool) -> DataFrame:
    """Every larger neighbour of a node is linked to the smallest of the node's neighbourhood."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    # repeated links do no harm to the small star that follows
    return both.where("v > u").join(F.broadcast(least) if few else least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame, few: bool) -> DataFrame:
    """A node and its smaller neighbours are linked to the smallest of them. Edges are (larger, smaller)."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    below = edges.join(F.broadcast(least) if few else least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return below.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(u, v) links of comparable nodes -> (u, v): v is the smallest node of u's component, v < u.

    A node with a third of all links is a star centre: its smallest neighbour is found by a
    combined aggregate and brought back by a join that splits skewed keys.
    """
    now = materialize(
        edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges"
    )
    links, settled = _about(now)
    while not settled:
        few = links <= BROADCAST_LINKS
        now = materialize(_small_star(_large_star(now, few), few), "edges")
        links, settled = _about(now)
    return now


def _about(edges: DataFrame) -> tuple[int, bool]:
    """The number of different links (larger, smaller), and whether they are stars around smallest nodes:
    a node that has a smaller neighbour has one only, and no larger one."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("below"), F.lit(0).alias("above"))
    ends = ends.unionByName(edges.select(F.col("v").alias("node"), F.lit(0).alias("below"), F.lit(1).alias("above")))
    nodes = ends.groupBy("node").agg(F.sum("below").alias("below"), F.max("above").alias("above"))
    unsettled = (F.col("below") > 1) | ((F.col("below") > 0) & (F.col("above") > 0))
    links, left = nodes.agg(F.sum("below"), F.count(F.when(unsettled, 1))).first()
    return links or 0, not left
