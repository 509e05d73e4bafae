"""Connected components of links by alternating large and small stars, with every step's result written."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Workspace


def _star(edges: DataFrame, keep: Workspace, large: bool) -> DataFrame:
    """Link the neighbours of each node to the least of them and the node: the larger ones in a large star (of all
    neighbours), the smaller ones and the node itself in a small star (of smaller neighbours)."""
    both = edges.union(edges.select("v", "u")) if large else edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    # Written, so that the join below reads two plain tables and the planner can split a hub's rows.
    least = keep.save(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")), "least")
    met = both.join(least, "u")
    if large:
        out = met.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = met.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    done = keep.save(out.where("u <> v").distinct(), "star")
    keep.drop(least)
    return done


def components(edges: DataFrame, keep: Workspace) -> DataFrame:
    """``edges`` (a, b: long) to (node, component): every node that has an edge to another, with the least node of
    its component. Loops, repeated edges and nulls add nothing."""
    now = keep.save(edges.select(F.col("a").alias("u"), F.col("b").alias("v")).where("u <> v").distinct(), "edges")
    seen = None
    while True:
        large = _star(now, keep, True)
        small = _star(large, keep, False)
        keep.drop(now, large)
        now = small
        sign = tuple(now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if sign == seen:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        seen = sign
