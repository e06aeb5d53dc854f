"""Incremental processing: documents and stage calls as streams."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.store import insert_ignore


def ingest_documents(stream: DataFrame, path: str, checkpoint: str) -> Callable[[], StreamingQuery]:
    """Append a stream's new documents (name, content) to the table at path, each content once.

    Every micro-batch is anti-joined with what the table holds, by hash, so a batch that is run again adds nothing. The table
    is partitioned by the first two digits of the hash, and a batch reads only the partitions that its own hashes fall in.
    """

    def add(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        rows = batch.select("name", "content", F.md5(F.col("content").cast("binary")).alias("hash")).withColumn("part", F.substring("hash", 1, 2))
        parts = [r.part for r in rows.select("part").distinct().collect()]  # 256 at most
        try:
            existing = spark.read.schema("name string, content string, hash string, epoch long, part string").parquet(path).filter(F.col("part").isin(parts)).select("hash")
        except AnalysisException:  # the table isn't there yet
            existing = None
        insert_ignore(existing, rows, ["hash"], ["name"]).withColumn("epoch", F.lit(epoch).cast("long")).write.mode("append").partitionBy("part").parquet(path)

    return lambda: stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stage_counts(calls: DataFrame, time: str = "ts", late: str = "10 minutes", window: str = "1 hour") -> DataFrame:
    """window, stage, n, seconds of a stream of stage calls; a window is final when the watermark has passed it."""
    return calls.withWatermark(time, late).groupBy(F.window(time, window), "stage").agg(F.count("*").alias("n"), F.sum("seconds").alias("seconds"))
