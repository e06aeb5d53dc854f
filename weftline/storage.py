"""Tables in the folder that driver and executors share: intermediate results that are written and read again."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}
_made: dict[str, list[str]] = {}


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a folder of our own only where that is unset and Spark runs locally."""
    if given := spark.conf.get("spark.checkpoint.dir", None):
        return given.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = "file://" + tempfile.mkdtemp(prefix="weftline-")
    return _own[app]


def new_path(spark: SparkSession, label: str) -> str:
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    _made.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def clear(spark: SparkSession) -> int:
    """Remove this session's intermediate tables from the shared folder, once nothing reads them any more; how many there were."""
    made = _made.pop(spark.sparkContext.applicationId, [])
    for path in made:
        remove(spark, path)
    return len(made)


def written(df: DataFrame, label: str, folder: str | None = None) -> DataFrame:
    """Write df once and read it again: what uses it, however often, doesn't compute it anew, nor does a lost executor."""
    path = f"{folder.rstrip('/')}/{label}-{uuid.uuid4().hex}" if folder else new_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _at(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def exists(spark: SparkSession, path: str) -> bool:
    store, target = _at(spark, path)
    return store.exists(target)


def is_folder(spark: SparkSession, path: str) -> bool:
    store, target = _at(spark, path)
    return store.exists(target) and store.getFileStatus(target).isDirectory()


def files(spark: SparkSession, path: str) -> dict[str, int]:
    """Path and bytes of each file in a folder."""
    store, target = _at(spark, path)
    return {f.getPath().toString(): f.getLen() for f in store.listStatus(target) if f.isFile()} if store.exists(target) else {}


def remove(spark: SparkSession, path: str) -> None:
    store, target = _at(spark, path)
    store.delete(target, True)
