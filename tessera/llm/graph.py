"""Connected components over a table of links, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, few_files


def _star(links: DataFrame, large: bool) -> DataFrame:
    """Large: every larger neighbour of u is tied to the smallest of u and its neighbours. Small: every smaller one, and u itself."""
    if large:
        sides = links.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(links.select(F.col("b").alias("u"), F.col("a").alias("v")))
    else:
        sides = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    least = sides.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
    tied = sides.join(least, "u")
    if large:
        tied = tied.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        tied = tied.select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return tied.where("a <> b").distinct()


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """``links`` (a, b: long, any order, repeats and loops allowed) -> ``node``, ``component``: the smallest node reachable.

    Nodes without a link to another are not listed. Every round is written to the shared folder and the one before is
    dropped, so lineage stays short and a lost executor costs one round. Stars need two shuffles of the links a round and a number
    of rounds that grows with the logarithm of the longest path. No links give an empty result.
    """
    scratch = Scratch(links.sparkSession)
    held = scratch.save(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    mark, size = None, held.count()
    for n in range(most_rounds):
        after = scratch.save(few_files(_star(_star(held, True), False), size, 50_000), f"round{n}")
        scratch.drop(held)
        held = after
        seen = held.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if seen == mark or seen[0] == 0:
            return held.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(held.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
        mark = seen
    raise RuntimeError("components did not settle")
