"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumastack.llm.shared import materialise


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of edges (a, b: bigint): root is the same for all nodes that links connect, and one of them.

    Contraction: in each round nodes have an order of their own, by a hash of node and round. Each node points to its first
    neighbour in that order (or itself), pointers are followed once, edges are drawn between what they point to, and the rest
    goes on. A node stays only if it is first among its neighbours, which a random order makes it with a chance of half at
    most (1 / (1 + its neighbours)); so the nodes with an edge halve each round on average, whatever the ids and the shape.
    Every round is written to the shared folder. Self-links give a node its own root; no edges give no rows.
    """
    left = materialise(edges.select("a", "b"))
    whole, turn = None, 0
    while not left.isEmpty():
        place = lambda c, turn=turn: F.struct(F.xxhash64(F.col(c), F.lit(turn)), F.col(c))
        both = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        near = both.groupBy("a").agg(F.min_by("b", place("b")).alias("b"))
        up = materialise(near.select("a", F.when(place("b") < place("a"), F.col("b")).otherwise(F.col("a")).alias("p")))
        up = materialise(up.alias("x").join(up.alias("y"), F.col("x.p") == F.col("y.a")).select(F.col("x.a").alias("node"), F.col("y.p").alias("root")))
        a, b = up.select(F.col("node").alias("a"), F.col("root").alias("ra")), up.select(F.col("node").alias("b"), F.col("root").alias("rb"))
        moved = left.join(a, "a").join(b, "b").where("ra <> rb").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b"))
        left = materialise(moved.distinct())
        turn += 1
        if whole is None:
            whole = up
        else:
            then = up.select(F.col("node").alias("root"), F.col("root").alias("then"))
            whole = materialise(whole.join(then, "root", "left").select("node", F.coalesce("then", "root").alias("root")))
    if whole is None:
        whole = left.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return whole
