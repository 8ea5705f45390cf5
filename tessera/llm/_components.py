"""Connected components of an edge table, by alternating star steps; nothing is collected but two numbers a round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import release, stored


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) for every node of an (a, b) long edge table; root is the smallest node reachable.

    Each round hangs larger neighbours on a node's smallest neighbour, then smaller ones likewise
    (large star, small star). A node's neighbours are never gathered: its minimum is a partial
    aggregate, which is joined back, so a hub is a skewed join key that adaptive execution splits.
    """
    ordered = edges.filter(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now, before = stored(ordered, "edges"), None
    for _ in range(rounds):
        state = now.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")).first()
        if not state["n"] or state == before:
            break
        before = state
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(least, "a").filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = large.join(least, "a")
        small = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b"))).filter(F.col("a") != F.col("b")).distinct()
        last, now = now, stored(small, "edges")
        release(last)
    else:
        raise RuntimeError(f"components: no end after {rounds} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
