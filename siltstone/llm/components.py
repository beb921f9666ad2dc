"""Connected components of an edge table, by alternating large-star and small-star steps (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.common import Scratch


def fingerprint(edges: DataFrame) -> tuple:
    """Two equal edge tables have the same; two others hardly ever, so that it saves the comparison of the tables in all rounds but the last."""
    h = F.xxhash64("a", "b")
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(h), F.sum(h.cast("decimal(20,0)"))).first())


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(a, b) long -> (node, root): root is the smallest node that can be reached. Nodes without an edge are not listed.

    Each step is a minimum per node, combined before the shuffle, and an equi-join; each round is written to the shared
    folder. The number of rounds grows with the logarithm of the longest path. Self-links and repeats do no harm.
    Rounds end when one changes no edge, which an anti-join settles.
    """
    now = scratch.keep(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "cc0")
    k, mark = 0, None
    while True:
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        large = both.join(least, "a").filter("b > a and b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a")
        small = small.select(F.col("b").alias("a"), F.col("m").alias("b")).union(small.select("a", F.col("m").alias("b"))).filter("a <> b").distinct()
        k += 1
        before, now = now, scratch.keep(small, f"cc{k}")
        seen = fingerprint(now)
        done = seen == mark and now.join(before, ["a", "b"], "left_anti").isEmpty()  # as many distinct edges, and none of them new
        scratch.drop(f"cc{k - 1}")
        if done:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        mark = seen
