"""The vectorise stage as a stream: rows become vectors, and are marked done once their vectors are written.

A table of vectors and a table of done ids stand under one path, each with a folder for every micro-batch. A batch writes its
vectors first and its done ids after; both writes replace the batch's own folders. A run that ends between the two leaves
rows undone, and the batch that is run again puts the same vectors in the same place: none is lost, none stands twice.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.models import TextModel, answers
from ..operators.stages import task_text
from ..storage import exists

VECTORS, DONE = "id long, embedding array<float>, batch string", "id long, batch string"


def done_ids(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(DONE).parquet(f"{path}/done") if exists(spark, f"{path}/done") else spark.createDataFrame([], DONE)


def vectors_of(spark: SparkSession, path: str) -> DataFrame:
    """id, embedding of the rows that are done; what a batch wrote without marking it done isn't among them."""
    if not exists(spark, f"{path}/vectors"):
        return spark.createDataFrame([], "id long, embedding array<float>")
    written = spark.read.schema(VECTORS).parquet(f"{path}/vectors")
    return written.join(done_ids(spark, path), ["id", "batch"], "left_semi").select("id", "embedding")


def undone(rows: DataFrame, path: str) -> DataFrame:
    """The rows without a vector: new ones, and those whose call failed."""
    return rows.join(done_ids(rows.sparkSession, path).select("id"), "id", "left_anti")


def with_status(rows: DataFrame, path: str) -> DataFrame:
    done = done_ids(rows.sparkSession, path).select(F.col("id").alias("_done")).distinct()
    joined = rows.drop("embedding_status").join(done, F.col("id") == F.col("_done"), "left")
    return joined.withColumn("embedding_status", F.when(F.col("_done").isNotNull(), "done").otherwise("undone")).drop("_done")


def _write(rows: DataFrame, table: str) -> None:
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(table)


def mark_done(rows: DataFrame, path: str) -> None:
    _write(rows.select("id", "batch"), f"{path}/done")


def sink(path: str, model: TextModel, name: str, **options) -> Callable[[DataFrame, int], None]:
    """What a micro-batch of rows (id, content, embedding_content) goes through. name: of the stream; epochs of two streams differ by it.

    Rows that are done already, or repeat an id within the batch, are not embedded again; a row without a text has no vector
    and stays undone, as does one whose call failed. options: of models.answers.
    """

    def put(batch: DataFrame, epoch: int) -> None:
        spark, key = batch.sparkSession, f"{name}-{epoch}"
        others = done_ids(spark, path).filter(F.col("batch") != key).select("id")  # what this batch did before it is done anew
        due = batch.select("id", task_text().alias("prompt")).filter(F.coalesce("prompt", F.lit("")) != "")
        due = due.groupBy("id").agg(F.min("prompt").alias("prompt")).join(others, "id", "left_anti")
        made = answers(due, model, result="array<float>", **options).filter("status = 1")
        _write(made.select("id", F.col("answer").alias("embedding"), F.lit(key).alias("batch")), f"{path}/vectors")
        if exists(spark, f"{path}/vectors/batch={key}"):
            mark_done(spark.read.schema(VECTORS).parquet(f"{path}/vectors").filter(F.col("batch") == key), path)

    return put


def vectorize(stream: DataFrame, path: str, checkpoint: str, model: TextModel, name: str, **options) -> Callable[[], StreamingQuery]:
    """Start it to take up what the stream has; a failed run is simply started again."""
    return lambda: stream.writeStream.foreachBatch(sink(path, model, name, **options)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def vectorize_rest(rows: DataFrame, path: str, model: TextModel, name: str, **options) -> None:
    """One batch over the rows of a table that have no vector yet, those that failed in a stream among them."""
    sink(path, model, name, **options)(undone(rows, path), 0)
