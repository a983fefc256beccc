"""Connected components by alternating large-star and small-star rounds.

Every round is two aggregations and two joins on the edge table, which is
written to the shared folder; nothing is gathered on the driver but a count and
a checksum. A node of very high degree is pre-aggregated by its minimum and
joined back, so that a skewed join can be split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._store import Scratch


def _least(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))


def _both(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))


def connected_components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """node, root (the smallest node reachable) for every node of edges(a, b), a != b."""
    edges = scratch.keep(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "cc0")
    seen, turn = None, 0
    while True:
        both = _both(edges)
        large = both.join(_least(both), "u").where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        turn += 1
        large = scratch.keep(large, f"cc{turn}")
        down = large.select(F.col("a").alias("u"), F.col("b").alias("v"))
        least = _least(down)
        small = (
            down.join(least, "u").where("v <> m").select(F.col("v").alias("a"), F.col("m").alias("b"))
            .unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
            .distinct()
        )
        turn += 1
        new = scratch.keep(small, f"cc{turn}")
        scratch.drop(f"cc{turn - 2}")
        scratch.drop(f"cc{turn - 1}")
        edges = new
        now = tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").bitwiseAND(0xFFFFFFFF))).first())
        if now == seen:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        seen = now
