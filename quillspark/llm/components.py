"""Connected components by alternating large and small stars, without a driver-side graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..workspace import Scratch


def connected_components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(a long, b long) links to (node, component): the smallest node reachable.

    Only nodes that have a link are returned. Null ends and loops are ignored; repeated links count
    once. An empty input gives an empty result. Each round is two aggregations of minima, combined
    before the shuffle, and two joins with the minima as a written table, so a hub's links can be
    split over tasks or meet a broadcast. Rounds grow with the logarithm of the longest path.
    """
    pairs = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    pairs = scratch.keep(pairs.where("a > b").distinct())

    def mark(frame: DataFrame) -> tuple:
        return tuple(frame.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    seen = mark(pairs)
    while True:
        if seen[0] == 0:
            return pairs.select(F.col("a").alias("node"), F.col("b").alias("component"))
        both = pairs.unionAll(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = scratch.keep(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")))
        # large star: every larger neighbour hangs on the smallest of the neighbourhood
        large = scratch.keep(
            both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        )
        small = scratch.keep(large.groupBy("a").agg(F.min("b").alias("m")))
        # small star: smaller neighbours hang on the smallest of them
        moved = large.join(small, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        after = scratch.keep(moved.unionAll(small.select("a", F.col("m").alias("b"))).distinct())
        scratch.drop(pairs, low, large, small)
        now = mark(after)
        pairs = after
        if now == seen:
            return pairs.select(F.col("a").alias("node"), F.col("b").alias("component"))
        seen = now
