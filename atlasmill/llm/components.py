"""Connected components of an edge table by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage, release


def _state(pairs: DataFrame) -> tuple:
    return tuple(pairs.agg(F.count("*"), F.sum(F.hash("hi", "lo").cast("bigint"))).first())


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node of an edge; the root is the smallest node of its component.

    Each round points a node's larger neighbours at its smallest one, then its smaller ones; the number of rounds
    grows with the logarithm of the longest chain. Every round is a table in the shared folder. Minima are written
    before they are joined back, so that both sides of the join are plain shuffles and a hub can be split.
    Loops and repeated edges don't matter; an empty edge table gives an empty result.
    """
    pairs = cut_lineage(edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).distinct())
    state = _state(pairs)
    while state[0]:
        both = pairs.select(F.col("hi").alias("n"), F.col("lo").alias("m")).unionByName(pairs.select(F.col("lo").alias("n"), F.col("hi").alias("m")))
        low = cut_lineage(both.groupBy("n").agg(F.min("m").alias("low")).select("n", F.least("n", "low").alias("low")))
        large = cut_lineage(both.join(low, "n").where(F.col("m") > F.col("n")).select(F.col("m").alias("hi"), F.col("low").alias("lo")).distinct())
        least = cut_lineage(large.groupBy("hi").agg(F.min("lo").alias("low")))
        small = large.join(least, "hi").where(F.col("lo") != F.col("low")).select(F.col("lo").alias("hi"), F.col("low").alias("lo"))
        after = cut_lineage(small.unionByName(least.select("hi", F.col("low").alias("lo"))).distinct())
        for old in (pairs, low, large, least):
            release(old)
        pairs, before, state = after, state, _state(after)
        if state == before:
            break
    return pairs.select(F.col("hi").alias("node"), F.col("lo").alias("root")).unionByName(
        pairs.select(F.col("lo").alias("node"), F.col("lo").alias("root")).distinct())
