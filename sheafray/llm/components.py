"""Connected components of a link table, by alternating stars.

Each round hooks every node's larger neighbours to its least neighbour, then
its smaller ones; links only move towards the least node of a component and
never join two components. It ends, after a number of rounds that grows with
the logarithm of the longest path, when every node hangs on one root. Nothing
but a single row, if any is left to do, reaches the driver. A node with very
many links is only ever a join key whose other side has one row, written
before the join, so that adaptive execution can split it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

_MOST_ROUNDS = 60


def _oriented(links: DataFrame) -> DataFrame:
    return links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()


def _round(stars: DataFrame) -> DataFrame:
    """One large-star and one small-star step; (u, v) with u > v."""
    both = stars.unionByName(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = materialize(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "links-least")
    large = materialize(both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct(), "links-large")
    least = materialize(large.groupBy("u").agg(F.min("v").alias("m")), "links-least")
    small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(least.select("u", F.col("m").alias("v")))
    return materialize(small.distinct(), "links")


def _settled(stars: DataFrame) -> bool:
    """Whether every node hangs on one root that hangs on none."""
    sides = stars.select(F.col("u").alias("n"), F.lit(1).alias("down"), F.lit(0).alias("up")).unionByName(stars.select(F.col("v").alias("n"), F.lit(0).alias("down"), F.lit(1).alias("up")))
    return not sides.groupBy("n").agg(F.sum("down").alias("down"), F.max("up").alias("up")).where("down > 1 or (down = 1 and up = 1)").head(1)


def partial_components(links: DataFrame) -> DataFrame:
    """(node, component) after one round: nodes with the same component are
    connected; connected ones may still have different ones."""
    stars = _round(materialize(_oriented(links), "links"))
    every = stars.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(stars.select(F.col("v").alias("node"), F.col("v").alias("component")))
    return every.groupBy("node").agg(F.min("component").alias("component"))


def components(links: DataFrame) -> DataFrame:
    """``links`` has long columns a, b; the result one row (node, component)
    for each node that has a link, component being its least node."""
    stars = materialize(_oriented(links), "links")
    for _ in range(_MOST_ROUNDS):
        if _settled(stars):
            return stars.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(stars.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        stars = _round(stars)
    raise RuntimeError("components did not settle")
