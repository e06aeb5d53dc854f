"""Exact vector search and the upkeep of vector tables: tombstones, compaction, shards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.values import safe_div, similarity
from .nearest import FOUND, best_of, scan, usable

#: More query vectors than this are searched in several blocks.
QUERY_BLOCK = 100_000


def top_k(vectors: DataFrame, queries: DataFrame, k: int, dead: DataFrame | None = None, id_col: str = "id", vector_col: str = "embedding") -> DataFrame:
    """query_id, id, distance (squared L2), rank: the k nearest live vectors of each query, ties by id.

    queries: query_id, query; ids are whole numbers. Every query is held against every vector of its number of components, a
    wave of QUERY_BLOCK queries at a time; every task keeps only its best k rows of a query before they are shuffled. Rows
    whose vector is null or holds a null or non-finite component are left out. k = 0 gives no rows.
    """
    live = usable(vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v")), "v")
    if dead is not None:
        live = live.join(dead.select(F.col("id")), "id", "left_anti")
    asked = usable(queries.select(F.col("query_id").cast("long").alias("query_id"), F.col("query").cast("array<double>").alias("query")), "query")
    if k <= 0:
        return vectors.sparkSession.createDataFrame([], f"{FOUND}, rank int")
    return best_of(scan(live, asked, k, QUERY_BLOCK), k)


def scored_hits(hits: DataFrame) -> DataFrame:
    return hits.withColumn("score", similarity(F.col("distance")))


def nearest_per_id(hits: DataFrame, k: int) -> DataFrame:
    """One row for each query and id, at its least distance; the k nearest of each query."""
    best = hits.groupBy("query_id", "id").agg(F.min("distance").alias("distance"))
    return best.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "id"))).filter(F.col("rank") <= k)


def compact(vectors: DataFrame, live_ids: DataFrame, id_col: str = "id") -> DataFrame:
    """The vectors whose ids are still live."""
    return vectors.join(live_ids.select(F.col("id").alias("_live")).distinct(), vectors[id_col] == F.col("_live"), "left_semi")


def deleted_stats(vectors: DataFrame, dead: DataFrame, shard: Column, id_col: str = "id") -> DataFrame:
    """shard, total, deleted, deleted_ratio; the ratio is null for an empty shard."""
    gone = dead.select(F.col("id").alias("_dead")).distinct()
    rows = vectors.select(shard.alias("shard"), F.col(id_col).alias("_id")).join(gone, F.col("_id") == F.col("_dead"), "left")
    return rows.groupBy("shard").agg(F.count("*").alias("total"), F.count("_dead").alias("deleted")).withColumn("deleted_ratio", safe_div(F.col("deleted").cast("double"), F.col("total")))


def append_latest(vectors: DataFrame, new: DataFrame, id_col: str = "id") -> DataFrame:
    """Vectors with new ones added: a new row replaces an old one with its id."""
    return vectors.join(new.select(id_col), id_col, "left_anti").unionByName(new)
