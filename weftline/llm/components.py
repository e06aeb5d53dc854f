"""Connected components by alternating large-star and small-star steps, as joins and aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import delete, new_path, save


def components(edges: DataFrame, most: int = 60) -> DataFrame:
    """node, root for every node of edges (columns a, b of one type): root is the smallest node that can be reached.

    Edges may repeat, go either way or join a node with itself; nodes without an edge to another are not returned; no
    edges give no rows. Each step's edges are written to the shared folder, which cuts the lineage; only their count and
    a checksum reach the driver. A hub's neighbours are reduced before they are
    shuffled, and the minima are written before the join, so that Spark can split a hub's part of it.
    """
    spark = edges.sparkSession

    def settle(df: DataFrame) -> tuple[DataFrame, str, tuple]:
        path = new_path(spark, "edges")
        save(df, path)
        back = spark.read.schema(df.schema).parquet(path)
        r = back.agg(F.count("*").alias("n"), F.sum(F.pmod(F.xxhash64("x", "y"), F.lit(1 << 40))).alias("s")).first()
        return back, path, (r.n, r.s)

    now, path, seen = settle(edges.select(F.greatest("a", "b").alias("x"), F.least("a", "b").alias("y")).filter("x <> y").distinct())
    for _ in range(most):
        if not seen[0]:
            break
        both = now.select(F.col("x").alias("u"), F.col("y").alias("v")).union(now.select("y", "x"))
        least, least_at, _ = settle(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("y"), F.least("u", "m").alias("x")))
        large = both.filter("v > u").join(least, F.col("u") == F.col("y")).select(F.col("v").alias("x"), F.col("x").alias("y")).distinct()
        lower = large.groupBy("x").agg(F.min("y").alias("m")).withColumnRenamed("x", "k")
        small = large.join(lower, F.col("x") == F.col("k")).filter("y <> m").select(F.col("y").alias("x"), F.col("m").alias("y"))
        new, new_at, sums = settle(small.union(lower.select("k", "m")).distinct())
        delete(spark, path)
        delete(spark, least_at)
        now, path, done, seen = new, new_at, sums == seen, sums
        if done:
            break
    else:
        raise RuntimeError("components didn't settle")
    roots = now.select(F.col("x").alias("node"), F.col("y").alias("root"))
    return roots.union(roots.select("root", "root").distinct())
