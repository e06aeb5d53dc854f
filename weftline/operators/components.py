"""Connected components of names, ids or whatever else can be ordered, in a logarithmic number of rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import written


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """node, root for every node of edges (a, b): root is the least node that can be reached, itself included.

    In a round every node points at the least of what its neighbours point at, and then at what that points at. Edges may repeat
    or join a node with itself; rounds are written, and only a count of what moved reaches the driver.
    """
    both = written(edges.select("a", "b").union(edges.select("b", "a")).filter("a <> b").distinct(), "edges")
    nodes = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct()
    now = written(nodes.withColumn("root", F.col("node")), "roots")
    for _ in range(rounds):
        near = both.join(now.select(F.col("node").alias("b"), "root"), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("_near"))
        # a root takes over the least that any node of its own sees, so whole groups move at once
        seen = now.join(near, "node", "left").withColumn("_near", F.least("root", F.coalesce("_near", "root")))
        taken = written(seen.groupBy("root").agg(F.min("_near").alias("_to")), "taken")
        hop = taken.join(taken.select(F.col("root").alias("_to"), F.col("_to").alias("_then")), "_to", "left").select("root", F.coalesce("_then", "_to").alias("_new"))
        moved = written(now.join(hop, "root").select("node", F.col("_new").alias("root"), (F.col("_new") < F.col("root")).alias("_moved")), "roots")
        now = moved.drop("_moved")
        if moved.filter("_moved").isEmpty():
            return now
    raise RuntimeError("components didn't settle")
