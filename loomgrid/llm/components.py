"""Connected components of a table of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialise


def connected_components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """node and component (its smallest reachable node) of every node in links (a, b).

    Each step replaces a node's links by links to its least neighbour; minima are pre-aggregated and joined back,
    so that a node with very many links is not gathered in one task. Steps are written to the shared folder.
    """
    edges = materialise(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v"))
    for done in range(rounds):
        both = edges.select(F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("e")).select("e.u", "e.v")
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("e"))
        after = materialise(small.select(F.col("e.v").alias("u"), F.col("e.m").alias("v")).where("u > v").distinct())
        discard(edges)
        edges = after
        if not done:
            continue  # one round seldom settles all
        ends = edges.select(F.explode(F.array(F.struct(F.col("u").alias("node"), F.lit(1).alias("below"), F.lit(0).alias("above")), F.struct(F.col("v").alias("node"), F.lit(0).alias("below"), F.lit(1).alias("above")))).alias("e"))
        ends = ends.groupBy("e.node").agg(F.sum("e.below").alias("below"), F.max("e.above").alias("above"))
        if ends.where("below > 1 OR below = 1 AND above = 1").isEmpty():  # stars: every node has one link up, to a node that has none
            break
    else:
        raise RuntimeError("components did not settle")
    out = edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
    out._loomgrid_path = edges._loomgrid_path  # who reads this may discard it
    return out
