"""Connected components of links, in rounds of joins: the smallest reachable id names each component."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomline.sources.scratch import dropped, stored


def _state(pairs: DataFrame) -> tuple:
    """Number and order-free digest of the links, to see that a round changed nothing."""
    hashed = F.xxhash64("u", "v")
    row = pairs.agg(F.count("*"), F.bit_xor(hashed), F.sum(F.shiftright(hashed, 20))).first()
    return tuple(row)


def components(links: DataFrame) -> DataFrame:
    """node, component for every node of ``links`` (columns a and b, in any order, repeats allowed).

    Alternates a large star (each larger neighbour of a node links to the node's least neighbour)
    and a small star (each smaller neighbour and the node itself do). Every round is linear in the
    links, and rounds grow with the logarithm of the longest path. Minima are taken with partial
    aggregation and stored, so that the join back is a plain one whose hot keys Spark can split.
    Links with a null end or of a node with itself are left out; no links give no rows.
    """
    a, b = F.col("a"), F.col("b")
    pairs = stored(links.where(a != b).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "links")
    before = _state(pairs)
    while before[0]:
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = stored(both.groupBy("u").agg(F.least("u", F.min("v")).alias("m")), "least")
        large = stored(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large")
        lowest = stored(large.groupBy("u").agg(F.min("v").alias("m")), "lowest")
        moved = large.join(lowest, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = stored(moved.unionByName(lowest.select("u", F.col("m").alias("v"))).distinct(), "links")
        for old in (pairs, least, large, lowest):
            dropped(old)
        pairs, now = after, _state(after)
        if now == before:
            break
        before = now
    ends = pairs.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stored(ends.unionByName(pairs.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()), "components")
