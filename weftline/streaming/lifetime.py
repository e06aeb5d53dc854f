"""Totals over all sessions as a stream's state: each session of a stage is folded in once."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

COUNTS = ["n_real", "n_cached", "n_skipped", "tokens"]
SESSION = "stage string, session string, n_real long, n_cached long, n_skipped long, tokens long, seconds double"
TOTALS = "stage string, sessions long, n_real long, n_cached long, n_skipped long, tokens long, seconds double"
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Fold(StatefulProcessor):
    """State of a stage: its totals, and the sessions that are in them."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.totals = handle.getValueState("totals", "sessions long, n_real long, n_cached long, n_skipped long, tokens long, seconds double")
        self.seen = handle.getMapState("seen", "session string", "folded boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        sums = list(self.totals.get()) if self.totals.exists() else [0] * 5 + [0.0]
        for frame in rows:
            for r in frame.itertuples():
                if not self.seen.containsKey((r.session,)):
                    self.seen.updateValue((r.session,), (True,))
                    sums = [sums[0] + 1, *(s + int(getattr(r, c)) for s, c in zip(sums[1:5], COUNTS)), sums[5] + float(r.seconds)]
        self.totals.update(tuple(sums))
        yield pd.DataFrame([[key[0], *sums]], columns=["stage", "sessions", *COUNTS, "seconds"])

    def close(self) -> None:
        pass


def lifetime_totals(sessions: DataFrame) -> DataFrame:
    """A stage's totals each time that sessions (SESSION) of it come in; of a session that comes again nothing is added.

    Null counts are 0, a null session is one like any other. State is kept in RocksDB, which transformWithState asks for.
    """
    rows = sessions.select("stage", F.coalesce("session", F.lit("")).alias("session"), *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in COUNTS], F.coalesce("seconds", F.lit(0.0)).alias("seconds"))
    return rows.groupBy("stage").transformWithStateInPandas(Fold(), TOTALS, "Update", "None")


def keep_lifetime(sessions: DataFrame, path: str, checkpoint: str) -> Callable[[], StreamingQuery]:
    """Write a stream's totals to path, in a folder for each micro-batch; read_lifetime() has the last of each stage."""
    spark = sessions.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)

    def put(batch: DataFrame, epoch: int) -> None:
        batch.withColumn("epoch", F.lit(epoch).cast("long")).write.mode("overwrite").parquet(f"{path}/epoch-{epoch:09d}")

    return lambda: lifetime_totals(sessions).writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_lifetime(spark: SparkSession, path: str) -> DataFrame:
    """stage, sessions and the sums of COUNTS and seconds, as they stand after the last micro-batch."""
    rows = spark.read.schema(f"{TOTALS}, epoch long").parquet(f"{path}/epoch-*")
    last = rows.groupBy("stage").agg(F.max_by(F.struct("sessions", *COUNTS, "seconds"), "epoch").alias("t"))
    return last.select("stage", "t.*")


def lifetime_of(sessions: DataFrame) -> DataFrame:
    """The same totals of a table; of rows with one session the first by all columns counts."""
    first = sessions.withColumn("_n", F.row_number().over(Window.partitionBy("stage", "session").orderBy(*COUNTS, "seconds"))).filter("_n = 1")
    return first.groupBy("stage").agg(F.count("*").alias("sessions"), *[F.sum(F.coalesce(c, F.lit(0))).cast("long").alias(c) for c in COUNTS], F.sum(F.coalesce("seconds", F.lit(0.0))).alias("seconds"))
