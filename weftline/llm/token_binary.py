"""Token ids of whole documents in patched frame-of-reference files, in ascending id order, and back."""

from __future__ import annotations

import math
import uuid
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import frugal, new_path, written
from .files import dealt, read_file, write_file
from .pfor import decode_file, encode_section
from .segments import encoder, slices_by_bytes

MANIFEST = "bucket int, part int, file string, n_docs long, n_ids long"
MAX_RANGES = 100_000
_NULL = -(1 << 63)  # a null id's place


def id_ranges(docs: DataFrame, id_col: str, text_col: str, range_bytes: int) -> list[int]:
    """Upper bounds of ranges of about range_bytes bytes of text. An id whose rows fill several ranges is the bound of each."""
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length(text_col).cast("long"))).first()[0] or 0
    ranges = min(MAX_RANGES, max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(size / range_bytes)))
    at = docs.agg(F.percentile_approx(F.coalesce(id_col, F.lit(_NULL)), [i / ranges for i in range(1, ranges)], 10 * ranges).alias("p")).first() if ranges > 1 else None
    return sorted((at and at.p) or [])


def write_token_files(
    docs: DataFrame,
    tokenizer_path: str,
    path: str | None = None,
    boundary: str = "lead",
    end_id: int = 0,
    id_col: str = "doc_id",
    text_col: str = "text",
    range_bytes: int = 64_000_000,
    batch_bytes: int = 4_000_000,
    section_ids: int = 1_000_000,
    file_bytes: int = 16_000_000,
) -> DataFrame:
    """Write the ids of every text, each followed by end_id, and return the files' manifest: bucket, part, file, n_docs, n_ids.

    Documents are dealt by ranges of ascending id, so that files in the order of (bucket, part) hold all documents in
    id order. A task encodes a section of section_ids ids at a time and begins another file at file_bytes bytes, so it
    needs no more memory than that and its longest text. A null text is empty (the end id only), a null id comes first,
    rows with equal ids stand in the order of their texts (where they fill more than a range, in the order of a hash
    first), and an empty table gives no files. Files are named anew by every attempt of a task; the manifest has those
    of the attempts that count.
    """
    spark, root = docs.sparkSession, path or new_path(docs.sparkSession, "token-files")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    bounds = np.array(id_ranges(rows, "id", "text", range_bytes), np.int64)

    @F.pandas_udf("int")
    def bucket_of(ids: pd.Series, turn: pd.Series) -> pd.Series:
        at = ids.to_numpy(np.int64)
        low, high = np.searchsorted(bounds, at, "left"), np.searchsorted(bounds, at, "right")
        spread = low + 1 + turn.to_numpy(np.int64) % np.maximum(high - low, 1)
        return pd.Series(np.where(high - low > 1, spread, high).astype(np.int32))

    def write(batches):
        enc = encoder(tokenizer_path, boundary)
        bucket, part = None, 0
        doc_ids, lengths, ids, held = [], [], [], 0  # of the open section
        sections, n_docs, n_ids = [], 0, 0  # of the open file

        def close_section():
            nonlocal doc_ids, lengths, ids, held, n_docs, n_ids
            sections.append(encode_section(doc_ids, np.concatenate(lengths), np.concatenate(ids)))
            n_docs, n_ids = n_docs + len(doc_ids), n_ids + held
            doc_ids, lengths, ids, held = [], [], [], 0

        def close_file():
            nonlocal part, n_docs, n_ids
            file = f"{root}/ids-{bucket:06d}-{part:05d}-{uuid.uuid4().hex}.pfor"
            write_file(file, b"".join(sections))
            out = pa.RecordBatch.from_pylist([{"bucket": bucket, "part": part, "file": file, "n_docs": n_docs, "n_ids": n_ids}], pa.schema([("bucket", pa.int32()), ("part", pa.int32()), ("file", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64())]))
            sections.clear()
            part, n_docs, n_ids = part + 1, 0, 0
            return out

        for batch in batches:
            buckets, texts = batch.column(0).to_numpy(), batch.column(2)
            for a, b in slices_by_bytes(texts, batch_bytes):
                edges = [a, *(a + 1 + np.flatnonzero(np.diff(buckets[a:b]))), b]
                for x, y in zip(edges, edges[1:]):
                    other = buckets[x] != bucket
                    if doc_ids and (other or held >= section_ids):
                        close_section()
                    if sections and (other or sum(map(len, sections)) >= file_bytes):
                        yield close_file()
                    if other:
                        bucket, part = int(buckets[x]), 0
                    flat, n = enc.encode(texts.slice(x, y - x))
                    ended = np.insert(flat, np.cumsum(n), np.uint32(end_id))
                    doc_ids += batch.column(1).slice(x, y - x).to_pylist()
                    lengths.append(n + 1)
                    ids.append(ended)
                    held += len(ended)
        if doc_ids:
            close_section()
        if sections:
            yield close_file()

    turn = F.pmod(F.xxhash64("text", F.pmod(F.monotonically_increasing_id(), F.lit(4096))), F.lit(MAX_RANGES))
    placed = rows.select(bucket_of(F.coalesce("id", F.lit(_NULL)), turn).alias("bucket"), "id", "text")
    ordered = placed.repartitionById(len(bounds) + 1, "bucket").sortWithinPartitions("bucket", F.asc_nulls_first("id"), "text")
    return written(ordered.mapInArrow(frugal(write), MANIFEST), "token-manifest")


def read_token_files(manifest: DataFrame, with_ids: bool = False) -> DataFrame:
    """One row per document, from the files alone: doc_id, start (ids of all documents before it), n_tokens, ids_crc32, and the ids themselves with_ids.

    manifest: what write_token_files() returned; it has a row per file. A file that is missing or isn't whole raises.
    """
    spark = manifest.sparkSession
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids
    before, starts = 0, []
    for r in manifest.groupBy("bucket").agg(F.sum("n_ids").alias("n")).orderBy("bucket").collect():  # MAX_RANGES bounds them
        starts.append((r.bucket, before))
        before += r.n
    starts = spark.createDataFrame(starts, "in_bucket int, bucket_start long")
    inside = Window.partitionBy("bucket").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    files = manifest.withColumn("inside", F.coalesce(F.sum("n_ids").over(inside), F.lit(0)))
    files = files.join(F.broadcast(starts), F.col("bucket") == F.col("in_bucket")).select("file", (F.col("bucket_start") + F.col("inside")).alias("start"))

    def read(batches):
        for batch in batches:
            for file, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for doc_ids, lengths, ids in decode_file(read_file(file)):
                    ends = np.cumsum(lengths.astype(np.int64))
                    at = ends - lengths
                    raw = memoryview(ids.astype("<u4").tobytes())
                    crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(at.tolist(), ends.tolist())]
                    out = [pa.array(doc_ids, pa.int64()), pa.array(start + at), pa.array(lengths.astype(np.int64)), pa.array(crc, pa.int64())]
                    if with_ids:
                        out.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(ids.astype(np.int64))))
                    start += len(ids)
                    yield pa.RecordBatch.from_arrays(out, ["doc_id", "start", "n_tokens", "ids_crc32", "ids"][: 4 + with_ids])

    return dealt(files).mapInArrow(frugal(read), schema)
