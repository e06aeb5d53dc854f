"""Vectors in shards of bounded size: sealing by running totals, a manifest, compaction of the shards that need it only.

A store is two tables: `vectors`, with a folder for each shard, and `manifest` (shard, n, first_id, last_id, sealed), a file for
each change of it, the last of which counts. Tombstones are a table of ids beside them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.values import safe_div
from ..storage import exists, remove, written
from .running import running_sums

MANIFEST = "shard int, n long, first_id long, last_id long, sealed boolean"


def running_shards(rows: DataFrame, size: int, order: str = "id", start: int = 0, room: int | None = None) -> DataFrame:
    """Adds shard: rows in order fill one shard after the other, `size` rows each, the first from `room` free places on.

    No row meets all others in one task.
    """
    at = F.col("_before") + (size - room if room is not None else 0)
    return running_sums(rows, [order], name="_before").withColumn("shard", (F.floor(at / size) + start).cast("int")).drop("_before")


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """The store's shards as the last change left them."""
    if not exists(spark, f"{path}/manifest"):
        return spark.createDataFrame([], MANIFEST)
    rows = spark.read.schema(f"{MANIFEST}, change int").parquet(f"{path}/manifest")
    last = rows.agg(F.max("change").alias("_last"))
    return rows.join(F.broadcast(last), F.col("change") == F.col("_last")).drop("change", "_last")


def _put_manifest(spark: SparkSession, path: str, size: int) -> None:
    seen = exists(spark, f"{path}/manifest")
    change = (spark.read.schema(f"{MANIFEST}, change int").parquet(f"{path}/manifest").agg(F.max("change")).first()[0] or 0) + 1 if seen else 0
    per = shards(spark, path).groupBy("shard").agg(F.count("*").alias("n"), F.min("id").alias("first_id"), F.max("id").alias("last_id"))
    per.withColumns({"sealed": F.col("n") >= size, "change": F.lit(change)}).coalesce(1).write.mode("append").parquet(f"{path}/manifest")


def shards(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/vectors") if exists(spark, f"{path}/vectors") else spark.createDataFrame([], "id long, embedding array<float>, shard int")


def add(vectors: DataFrame, path: str, size: int = 1_000_000, seal: bool = False) -> DataFrame:
    """Append vectors (id, embedding) and return the manifest. The open shard, the last if it isn't full, is filled up first.

    With seal it is left as it is and new vectors begin a shard, as after a checkpoint. Only new files are written.
    """
    spark = vectors.sparkSession
    top = manifest(spark, path).orderBy(F.desc("shard")).first()
    open_ = top is not None and top.n < size and not seal
    start = 0 if top is None else top.shard if open_ else top.shard + 1
    placed = running_shards(vectors, size, start=start, room=size - top.n if open_ else None)
    placed.repartition("shard").write.mode("append").partitionBy("shard").parquet(f"{path}/vectors")
    _put_manifest(spark, path, size)
    return manifest(spark, path)


def tombstones(spark: SparkSession, path: str, dead: DataFrame) -> DataFrame:
    """shard, n, deleted, ratio: how many of each shard's vectors are among the dead (id)."""
    rows = shards(spark, path).select("shard", "id").join(dead.select(F.col("id").alias("_dead")).distinct(), F.col("id") == F.col("_dead"), "left")
    return rows.groupBy("shard").agg(F.count("*").alias("n"), F.count("_dead").alias("deleted")).withColumn("ratio", safe_div(F.col("deleted").cast("double"), F.col("n")))


def compact(spark: SparkSession, path: str, dead: DataFrame, most: float = 0.2, size: int = 1_000_000) -> list[int]:
    """Write the shards whose share of dead vectors is over `most` without them, and return their numbers.

    Dynamic overwrite replaces those folders; the files of all others stay. Shards keep their numbers, and one that was full is
    sealed until it has room. Vectors of one id in several shards go together.
    """
    worn = [r.shard for r in tombstones(spark, path, dead).filter(F.col("ratio") > most).select("shard").collect()]  # a row for each shard
    if not worn:
        return []
    kept = shards(spark, path).filter(F.col("shard").isin(worn)).join(dead.select("id").distinct(), "id", "left_anti")
    live = written(kept, "live")  # the folders that are read are replaced
    emptied = sorted(set(worn) - {r.shard for r in live.select("shard").distinct().collect()})
    live.repartition("shard").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("shard").parquet(f"{path}/vectors")
    for shard in emptied:
        remove(spark, f"{path}/vectors/shard={shard}")
    _put_manifest(spark, path, size)
    return sorted(worn)
