"""Model calls behind batch interfaces: anything that maps a list of texts to a list of results, run in Arrow batches, with a table as cache."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType, _parse_datatype_string

from ..storage import shared_dir, written

TextModel = Callable[[list[str]], list[Any]]

#: Errors of the code around a model rather than of a call; they end the job.
OF_THE_CODE = (TypeError, NameError, AttributeError, ImportError)


def cache_key(prompt, arguments):
    """The key of a call: MD5 of its prompt and arguments."""
    return F.md5(F.concat_ws("\x1f", prompt, arguments).cast("binary"))


def stub_model(texts: list[str]) -> list[str]:
    """Stands in for a model where there is none: the first line of each text."""
    return [t.strip().split("\n", 1)[0] for t in texts]


def stub_embedding(texts: list[str], size: int = 16) -> list[list[float]]:
    return [[b / 255 for b in hashlib.sha256(t.encode()).digest()[:size]] for t in texts]


def batches_of(texts: list[str], most: int, most_bytes: int) -> Iterator[tuple[int, int]]:
    """(start, stop) of runs of at most `most` texts and most_bytes bytes; a longer text is a run of its own."""
    start, held = 0, 0
    for i, text in enumerate(texts):
        size = len(text.encode())
        if i > start and (i - start == most or held + size > most_bytes):
            yield start, i
            start, held = i, 0
        held += size
    if texts:
        yield start, len(texts)


def asked(model: TextModel, texts: list[str]) -> list[tuple[Any, str | None]]:
    """(result, error) of each text. A batch that fails is asked in halves, so one bad text costs two calls for each halving."""
    try:
        found = list(model(texts))
        if len(found) != len(texts):
            raise ValueError(f"{len(found)} results for {len(texts)} texts")
        missing = [i for i, r in enumerate(found) if r is None]
        return [(r, "no result" if i in missing else None) for i, r in enumerate(found)]
    except OF_THE_CODE:
        raise
    except Exception as e:  # a failed call is a result: its error
        if len(texts) == 1:
            return [(None, f"{type(e).__name__}: {e}")]
        half = len(texts) // 2
        return asked(model, texts[:half]) + asked(model, texts[half:])


def answers(
    prompts: DataFrame, model: TextModel, cache: DataFrame | None = None, arguments: str = "", shared: str | None = None, result: str | DataType = "string", most: int = 256, most_bytes: int = 1_000_000
) -> DataFrame:
    """Adds key, answer, status (1, or 0 where the model failed) and cache_hit. Only prompts that the cache (key, answer) lacks are asked, equal ones once.

    result is the type of an answer, array<float> for an embedding model; where a call failed, a string answer is its error
    and any other is null. A call has at most `most` prompts and most_bytes bytes of them, and halves of it are asked where it
    fails; errors of the code around it (OF_THE_CODE) end the job. What was asked is written to `shared` (by default the
    session's checkpoint folder), so that using the result twice, or losing an executor, asks nothing again. Of several
    cached answers to a prompt the least counts. A null prompt is a prompt like any other, asked as an empty text.
    """
    spark, kind = prompts.sparkSession, _parse_datatype_string(result) if isinstance(result, str) else result
    text = kind.simpleString() == "string"
    keyed = prompts.withColumn("key", cache_key(F.col("prompt"), F.lit(arguments)))
    known = cache.groupBy("key").agg(F.min("answer").alias("answer")) if cache is not None else spark.createDataFrame([], f"key string, answer {kind.simpleString()}")
    missing = keyed.select("key", F.coalesce("prompt", F.lit("")).alias("prompt")).dropDuplicates(["key"]).join(known, "key", "left_anti")
    arrow = pa.schema([("key", pa.string()), ("answer", to_arrow_type(kind)), ("status", pa.int32())])

    def ask(batches):
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in batches_of(texts, most, most_bytes):
                found = asked(model, texts[a:b])
                said = [e if e is not None and text else r for r, e in found]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(said, arrow.field("answer").type), pa.array([int(e is None) for _, e in found], pa.int32())], schema=arrow)

    asked_rows = missing.mapInArrow(ask, f"key string, answer {kind.simpleString()}, status int")
    asked_rows = written(asked_rows, "answers", shared or shared_dir(spark)).withColumn("cache_hit", F.lit(False))
    return keyed.join(asked_rows.unionByName(known.select("key", "answer", F.lit(1).alias("status"), F.lit(True).alias("cache_hit"))), "key", "left")


def to_cache(answered: DataFrame) -> DataFrame:
    """What a cache takes over: answers that didn't fail and weren't in it."""
    return answered.filter((F.col("status") == 1) & ~F.col("cache_hit")).select("key", "answer").dropDuplicates(["key"])
