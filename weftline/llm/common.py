"""Helpers that the training-data operators share: the cluster's shared folder, tables written to it, text basics."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_own_dirs: dict[str, str] = {}

#: Words are runs of anything but the six ASCII white-space characters.
WORD_SPLIT = r"[\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir); one of our own only where that is unset and Spark runs locally."""
    given = spark.conf.get("spark.checkpoint.dir", None)
    if given:
        return given.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_dirs:
        _own_dirs[app] = "file://" + tempfile.mkdtemp(prefix="weftline-")
    return _own_dirs[app]


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def save(df: DataFrame, path: str) -> None:
    """Write df as Parquet. The shuffle files of that go with the write, not when the driver happens to collect its garbage."""
    conf, name = df.sparkSession.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    given = conf.get(name, None)
    conf.set(name, "true")
    try:
        df.write.parquet(path)
    finally:
        conf.unset(name) if given is None else conf.set(name, given)


def written(df: DataFrame, label: str, batch_rows: int | None = None) -> DataFrame:
    """Write df to the shared folder and read it again: this cuts the lineage, and lost executors don't recompute it.

    With batch_rows, Arrow functions in df get no more rows at once than that.
    """
    spark, path = df.sparkSession, new_path(df.sparkSession, label)
    with _batches_of(spark, batch_rows):
        save(df, path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def _batches_of(spark: SparkSession, rows: int | None):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    given = int(spark.conf.get(name))
    if rows and not 0 < given <= rows:
        spark.conf.set(name, rows)
    try:
        yield
    finally:
        spark.conf.set(name, given)


def give_back() -> None:
    """Return to the system what this process has freed: what a Python worker holds counts while Spark runs other stages."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc has it
        trim(0)


def frugal(f: Callable[[Iterable], Iterator]) -> Callable[[Iterable], Iterator]:
    """f, for mapInArrow, giving back memory at the end of a task; the worker outlives the task."""

    def run(batches: Iterable) -> Iterator:
        try:
            yield from f(batches)
        finally:
            give_back()

    return run


def delete(spark: SparkSession, path: str) -> None:
    """Remove a table of our own that a later one has replaced."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id: Column | str, folds: int = 5) -> Column:
    """True for the rows that no model may learn from; a null id is held out."""
    doc_id = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == 0, F.lit(True))
