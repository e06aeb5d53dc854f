"""Building the hypergraph: chunk order, prior slices, entities of chunks, nodes, degrees."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import strip


def chunk_order(name: Column | str, index: Column | None = None) -> Column:
    """chunk_index, or what the name says (head 0, body_N N), or 10^9."""
    c = F.col(name) if isinstance(name, str) else name
    of_name = F.when(c == "head", 0).otherwise(F.regexp_extract(c, r"^body_([0-9]{1,9})$", 1).try_cast("int"))
    return F.coalesce(*([index] if index is not None else []), of_name, F.lit(1_000_000_000))


def ordered_chunks(chunks: DataFrame) -> DataFrame:
    """Adds position within the doc: by chunk_order, ties by id."""
    return chunks.withColumn("position", F.row_number().over(Window.partitionBy("doc_id").orderBy(chunk_order("name"), "id")))


def prior_slices(slices: DataFrame, family: str, index: str, text: str) -> DataFrame:
    """Adds `prior`: the texts of the earlier slices of the family in order, by newlines; missing ones are passed over."""
    w = Window.partitionBy(family).orderBy(index).rowsBetween(Window.unboundedPreceding, -1)
    return slices.withColumn("prior", F.array_join(F.collect_list(text).over(w), "\n"))


def longest_descriptions(rows: DataFrame, keys: list[str], description: str, order: str) -> DataFrame:
    """For each key the longest non-empty description (the first of equal length), and where the key first appears."""
    rank = F.struct(F.char_length(description).alias("n"), (-F.col(order)).alias("first"))
    return rows.filter(F.col(description) != "").groupBy(*keys).agg(F.max_by(description, rank).alias("description"), F.min(order).alias("first_at"))


def nodes(entities: DataFrame) -> DataFrame:
    """doc_id, chunk_id, name, content, embedding_content: one node per chunk and entity; hyperedge_id is filled on enrichment."""
    return entities.select("doc_id", "chunk_id", "name", F.col("description").alias("content"), strip(F.concat_ws("\n", "name", "description")).alias("embedding_content"))


def entity_degrees(nodes: DataFrame, entity: str, edge: str) -> DataFrame:
    """entity, degree: in how many different hyperedges it is, and its rank by that."""
    return nodes.groupBy(F.col(entity).alias("entity")).agg(F.countDistinct(edge).alias("degree"), F.count("*").alias("n_nodes"))
