"""Token counts: batch encoding in Arrow functions that return lengths only."""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .segments import encoder, slices_by_bytes


def token_counts(
    docs: DataFrame,
    tokenizer_path: str,
    boundary: str = "drop",
    limit: int = 2048,
    id_col: str = "doc_id",
    text_col: str = "text",
    batch_bytes: int = 4_000_000,
) -> DataFrame:
    """One row per row of docs: id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit).

    The texts are encoded whole, in slices of about batch_bytes bytes however Spark has cut its Arrow batches, and no
    ids leave the Python worker. A null or empty text has no bytes and no tokens; a null id stays null; repeated rows
    are counted each; an empty table gives no rows; other columns are not read.
    """

    def count(batches):
        enc = encoder(tokenizer_path, boundary)
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for a, b in slices_by_bytes(texts, batch_bytes):
                part = pc.fill_null(texts.slice(a, b - a), "")
                n_tokens = enc.encode(part, lengths_only=True)[1]
                n_bytes = pc.binary_length(part).cast(pa.int64())
                yield pa.RecordBatch.from_arrays([ids.slice(a, b - a), n_bytes, pa.array(n_tokens, pa.int64()), pa.array(n_tokens > limit)], ["id", "n_bytes", "n_tokens", "over_limit"])

    id_type = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(count, f"id {id_type}, n_bytes long, n_tokens long, over_limit boolean").withColumnRenamed("id", id_col)
