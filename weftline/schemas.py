"""Schemas of the engine's tables: documents, summary hyperedges, chunks, entity nodes, edges and vectors."""

from __future__ import annotations

from pyspark.sql import types as T


def _s(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(n, t, True) for n, t in fields])


STR, LONG, DOUBLE, INT = T.StringType(), T.LongType(), T.DoubleType(), T.IntegerType()
DOC = _s(("id", LONG), ("name", STR), ("content", STR), ("hash", STR), ("extra", STR), ("status", STR))
HYPEREDGE = _s(("id", LONG), ("doc_id", LONG), ("chunk_id", LONG), ("name", STR), ("content", STR), ("embedding_content", STR), ("extra", STR), ("status", STR))
CHUNK = _s(("id", LONG), ("doc_id", LONG), ("name", STR), ("content", STR), ("extra", STR), ("status", STR))
NODE = _s(("id", LONG), ("doc_id", LONG), ("chunk_id", LONG), ("hyperedge_id", LONG), ("name", STR), ("content", STR), ("embedding_content", STR), ("extra", STR), ("status", STR))
EDGE = _s(("id", LONG), ("doc_id", LONG), ("hyperedge_id", LONG), ("node_id", LONG))
VECTOR = _s(("id", LONG), ("embedding", T.ArrayType(T.FloatType())))
HIT = _s(("chunk_id", LONG), ("doc_id", LONG), ("score", DOUBLE), ("match_type", STR))
PLAN_STEP = _s(("id", STR), ("question", STR), ("depends_on", T.ArrayType(STR)), ("kind", STR))
EXTRA = _s(("chunk_index", INT), ("is_head", T.BooleanType()), ("role", STR), ("source_name", STR), ("slice_index", INT))
