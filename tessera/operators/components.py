"""Connected components over edge tables of any size and shape."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.session import stage_table, unstage


def _mark(edges: DataFrame) -> tuple:
    """A fingerprint of an edge set that doesn't depend on order."""
    return tuple(edges.agg(F.count(F.lit(1)), F.coalesce(F.bit_xor(F.xxhash64("u", "v")), F.lit(0))).first())


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """``node``, ``component`` (the smallest node reachable) of every node on an edge.

    Alternating large-star and small-star (Kiveris et al. 2014): each node's neighbours are linked to
    the smallest of them until every component is a star, in a number of rounds that grows with the
    logarithm of the input for paths as well. Minima are pre-aggregated before each shuffle, each half of a
    round is a written table, and nothing but a count and a hash of the edges reaches the driver. Null ends
    are left out; loops make their node a component of its own.
    """
    pairs = edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).where("a is not null and b is not null")
    now = stage_table(pairs.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    before = _mark(now)
    while True:
        last = now
        proper = now.where("u <> v")
        both = proper.select("u", "v").unionByName(proper.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        loops = now.where("u = v").select("u", "v")
        large = stage_table(large.unionByName(loops), "large-star")
        proper = large.where("u <> v")
        least = proper.groupBy("u").agg(F.min("v").alias("m"))
        small = proper.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        now = stage_table(small.unionByName(large.where("u = v").select("u", "v")).distinct(), "small-star")
        unstage(last, large)
        after = _mark(now)
        if after == before:
            break
        before = after
    proper = now.where("u <> v")
    roots = proper.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    members = proper.select(F.col("u").alias("node"), F.col("v").alias("component"))
    alone = now.where("u = v").select(F.col("u").alias("node")).join(proper.select(F.col("u").alias("node")).unionByName(proper.select(F.col("v").alias("node"))), "node", "left_anti")
    return members.unionByName(roots).unionByName(alone.select("node", F.col("node").alias("component")))
