"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.operators.relational import cut


def components(edges: DataFrame, rounds: int = 40) -> DataFrame:
    """(node, component): the least node that each node of `edges` (a, b) is connected with.

    Edges with a null end and loops say nothing of other nodes; a loop's node is its own component.
    Each round halves the distances to the least node; a graph that needs more than `rounds` raises.
    """
    e = edges.select("a", "b").where("a is not null and b is not null")
    loops = e.select(F.col("a").alias("node")).distinct()
    e = cut(e.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    last = None
    for _ in range(rounds):
        both = e.select("a", "b").union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        # large star: each greater neighbour of a node links to the least of its neighbourhood
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        # small star: each node and its lesser neighbours link to the least of them
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct(F.col("a").alias("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("x")).select("x.*").where("a <> b").distinct()
        e = cut(small)
        state = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if state == last:
            found = e.select(F.col("a").alias("node"), F.col("b").alias("component"))
            roots = e.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("component"))
            own = loops.join(found.select("node").union(roots.select("node")), "node", "left_anti").select("node", F.col("node").alias("component"))
            return found.union(roots).union(own)
        last = state
    raise RuntimeError(f"components did not settle within {rounds} rounds")
