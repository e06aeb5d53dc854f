"""The build's stages over the tables of `schemas`: what each has still to do, what it writes, and how it is undone.

A document goes from `new` to `summary` (it has a hyperedge) to `chunk`; a chunk from `new` to `extract` to `build`; a vector's row from
`undone` to `done`. A stage takes the rows in its status, asks a model where it needs one, and returns whole tables with the
statuses moved on, so a lost run is only run again: rows that were done are not asked for a second time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.judging import truthy
from ..functions.text import family_base, slice_index, strip
from ..functions.values import entities
from .chunking import chunks as packed
from .hypergraph import chunk_order, longest_descriptions, nodes
from .models import TextModel, answers

#: Which status a stage takes up.
TAKES = {"summary": "new", "chunk": "summary", "extract": "new", "build": "extract", "vectorize": "undone"}


def pending(rows: DataFrame, stage: str, everything: bool = False, status: str = "status") -> DataFrame:
    """The rows that a stage has still to do; all of them with `everything`."""
    return rows if everything else rows.filter(F.col(status) == TAKES[stage])


def pending_chunking(docs: DataFrame, hyperedges: DataFrame, everything: bool = False) -> DataFrame:
    """The docs to chunk; with `everything` all that have a hyperedge, whatever their status."""
    if not everything:
        return pending(docs, "chunk")
    return docs.join(hyperedges.select(F.col("doc_id").alias("_of")).distinct(), F.col("id") == F.col("_of"), "left_semi")


def summary_order() -> list[Column]:
    """Slices of a family one after the other: by base name, slice number, id."""
    return [family_base("name"), slice_index("name"), F.col("id")]


def task_text(embedding_content: Column | str = "embedding_content", content: Column | str = "content") -> Column:
    """What is embedded of a row; an empty embedding_content stays empty."""
    return F.coalesce(embedding_content, content)


def parsed_extra(extra: Column | str) -> Column:
    """A row's extra JSON as a map of texts; empty on anything else."""
    c = F.col(extra) if isinstance(extra, str) else extra
    return F.coalesce(F.from_json(c, "map<string,string>"), F.create_map().cast("map<string,string>"))


def is_head(name: Column, extra: Column, also: Column) -> Column:
    """Is a chunk its document's head? By its name, by is_head or role in its extra, or by `also`."""
    flag = truthy(F.get_json_object(extra, "$.is_head"))
    role = F.lower(strip(F.coalesce(F.get_json_object(extra, "$.role"), F.lit("")))) == "head"
    return (F.lower(strip(F.coalesce(name, F.lit("")))) == "head") | flag | role | F.coalesce(also, F.lit(False))


def with_head_flag(chunks: DataFrame, hyperedges: DataFrame | None = None) -> DataFrame:
    """Adds head: with hyperedges a chunk that one of them is bound to is a head too (retrieval, export), without them one of chunk_index 0 (building)."""
    if hyperedges is None:
        return chunks.withColumn("head", is_head(F.col("name"), F.col("extra"), F.get_json_object("extra", "$.chunk_index") == "0"))
    bound = hyperedges.filter("chunk_id IS NOT NULL").select(F.col("chunk_id").alias("_bound")).distinct()
    return chunks.join(bound, F.col("id") == F.col("_bound"), "left").withColumn("head", is_head(F.col("name"), F.col("extra"), F.col("_bound").isNotNull())).drop("_bound")


# running


def summarise(docs: DataFrame, hyperedges: DataFrame, model: TextModel, cache: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(docs, hyperedges, what was asked): each new document gets a hyperedge `head` that the model writes of its content, or a new text in the one it has.

    A document whose call failed stays as it is and is taken up by the next run.
    """
    asked = answers(pending(docs, "summary").select(F.col("id").alias("doc_id"), F.col("content").alias("prompt")), model, cache)
    done = asked.filter("status = 1").select("doc_id", "answer")
    kept = hyperedges.join(done.select("doc_id"), "doc_id", "left_anti")
    own = hyperedges.groupBy("doc_id").agg(F.min("id").alias("id"), F.min_by("chunk_id", "id").alias("chunk_id"))
    written = done.join(own, "doc_id", "left").select("id", "doc_id", "chunk_id", F.lit("head").alias("name"), F.col("answer").alias("content"))
    return moved(docs, done.select("doc_id"), "summary"), kept.select(*written.columns).unionByName(written), asked


def moved(rows: DataFrame, done: DataFrame, status: str) -> DataFrame:
    """rows with a new status where their id is in done (one column of ids)."""
    ids = done.select(F.col(done.columns[0]).alias("_done")).distinct()
    joined = rows.join(ids, F.col("id") == F.col("_done"), "left")
    return joined.withColumn("status", F.when(F.col("_done").isNotNull(), status).otherwise(F.col("status"))).drop("_done")


def chunk(docs: DataFrame, hyperedges: DataFrame, **options) -> tuple[DataFrame, DataFrame]:
    """(docs, new chunks): documents with a summary are packed into a head and body chunks."""
    due = pending_chunking(docs, hyperedges).select("id", "content")
    made = packed(due, hyperedges, **options)
    return moved(docs, made.select("doc_id").distinct(), "chunk"), made


def extract(chunks: DataFrame, model: TextModel, cache: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(chunks, what was asked): each new chunk's answer goes to its extra and its status on, if it holds entities; others stay for another attempt."""
    asked = answers(pending(chunks, "extract").select(F.col("id").alias("chunk_id"), F.col("content").alias("prompt")), model, cache)
    good = asked.filter((F.col("status") == 1) & entities("answer").isNotNull()).select("chunk_id", "answer")
    joined = chunks.join(good, F.col("id") == F.col("chunk_id"), "left")
    new = F.col("answer").isNotNull()
    out = joined.withColumns({"extra": F.when(new, F.to_json(F.struct(F.col("answer").alias("extract")))).otherwise(F.col("extra")), "status": F.when(new, "extract").otherwise(F.col("status"))})
    return out.drop("chunk_id", "answer"), asked


def build(chunks: DataFrame, hyperedges: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(chunks, nodes, edges): a node for each entity of each extracted chunk, tied to its document's first hyperedge.

    Of an entity that a chunk's answer names more than once the longest description counts (the first of equal length), and one
    without a description makes no node. The chunks of a document without a hyperedge stay as they are until it has one.
    enriched_hyperedges() gives the hyperedges what they take from the heads.
    """
    due, edge_of = _due_chunks(chunks, hyperedges)
    made = nodes(_chunk_entities(due)).join(edge_of.withColumnRenamed("_of", "doc_id"), "doc_id")
    edges = made.select("doc_id", "hyperedge_id", "chunk_id", "name")
    return moved(chunks, due.select("id"), "build"), made, edges


def _due_chunks(chunks: DataFrame, hyperedges: DataFrame) -> tuple[DataFrame, DataFrame]:
    edge_of = hyperedges.filter("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("_of")).agg(F.min("id").alias("hyperedge_id"))
    return pending(chunks, "build").join(edge_of, F.col("doc_id") == F.col("_of"), "left_semi"), edge_of


def _chunk_entities(due: DataFrame) -> DataFrame:
    """doc_id, chunk_id, name, description: each entity of each chunk once."""
    pairs = entities(F.get_json_object("extra", "$.extract"))
    found = due.select("doc_id", F.col("id").alias("chunk_id"), F.posexplode(pairs).alias("_at", "_e")).select("doc_id", "chunk_id", "_at", F.col("_e.name").alias("name"), F.col("_e.content").alias("content"))
    return longest_descriptions(found, ["doc_id", "chunk_id", "name"], "content", "_at")


def enriched_hyperedges(chunks: DataFrame, hyperedges: DataFrame) -> DataFrame:
    """The hyperedges, those of documents that build() takes up bound to the head chunk, with its entities in their extra.

    The head is the first chunk in order that is one by name, flag, role or index, else the first. What an extra held stays,
    but for is_head, role, entities and source_chunk_id; source stays or becomes summary.
    """
    due, edge_of = _due_chunks(chunks, hyperedges)
    order = chunk_order(F.lower(strip(F.coalesce("name", F.lit("")))), F.get_json_object("extra", "$.chunk_index").try_cast("int"))
    ranked = with_head_flag(due).select("doc_id", "id", F.struct((~F.col("head")).alias("_body"), order.alias("_order"), "id").alias("_rank"), "extra")
    head = ranked.groupBy("doc_id").agg(F.min_by("id", "_rank").alias("id"), F.min_by("extra", "_rank").alias("extra"))
    own = _chunk_entities(head).groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("first_at", "name", "description"))).alias("_e"))
    own = own.select("doc_id", F.map_from_entries(F.transform("_e", lambda e: F.struct(e["name"], e["description"]))).alias("_entities"))
    named = head.select("doc_id", F.col("id").alias("_head")).join(own, "doc_id", "left").join(edge_of, F.col("doc_id") == F.col("_of")).select(F.col("hyperedge_id").alias("_edge"), "_head", "_entities")
    old = hyperedges if "extra" in hyperedges.columns else hyperedges.withColumn("extra", F.lit(None).cast("string"))
    rows = old.join(named, F.col("id") == F.col("_edge"), "left")
    before = F.try_parse_json("extra")
    held = F.when(F.schema_of_variant(before).startswith("OBJECT"), F.try_variant_get(before, "$", "map<string,variant>"))
    source = F.coalesce(F.nullif(F.try_variant_get(before, "$.source", "string"), F.lit("")), F.lit("summary"))
    kept = F.map_filter(held, lambda k, v: ~k.isin("is_head", "role", "source", "entities", "source_chunk_id"))
    new = F.to_json(F.struct(F.lit(True).alias("is_head"), F.lit("head").alias("role"), source.alias("source"), F.coalesce("_entities", F.create_map().cast("map<string,string>")).alias("entities"), F.col("_head").alias("source_chunk_id")))
    joined = F.when(F.size(kept) > 0, F.concat(F.regexp_replace(F.to_json(kept), r"\}$", ","), F.substring(new, F.lit(2), F.char_length(new)))).otherwise(new)
    taken = F.col("_edge").isNotNull()
    return rows.withColumns({"chunk_id": F.when(taken, F.col("_head")).otherwise(F.col("chunk_id")), "extra": F.when(taken, joined).otherwise(F.col("extra"))}).drop("_edge", "_head", "_entities")


# undoing


def clear_chunks(docs: DataFrame, hyperedges: DataFrame) -> DataFrame:
    """The docs once their chunks are wiped: back to summary where they have a hyperedge, else to new."""
    has = hyperedges.select(F.col("doc_id").alias("_of")).distinct()
    joined = docs.join(has, F.col("id") == F.col("_of"), "left")
    return joined.withColumn("status", F.when(F.col("_of").isNotNull(), "summary").otherwise("new")).drop("_of")


def clear_summaries(docs: DataFrame) -> DataFrame:
    """The docs once their hyperedges are wiped: summary and chunk go back to new."""
    return docs.withColumn("status", F.when(F.col("status").isin("summary", "chunk"), "new").otherwise(F.col("status")))


def clear_extracts(chunks: DataFrame) -> DataFrame:
    """All chunks to new, without extra; a head is then told by its name alone."""
    return chunks.withColumns({"status": F.lit("new"), "extra": F.lit(None).cast("string")})


def clear_build(chunks: DataFrame) -> DataFrame:
    """All chunks to extract; their nodes and edges are wiped by writing those tables empty."""
    return chunks.withColumn("status", F.lit("extract"))


def clear_vectors(rows: DataFrame, column: str = "embedding_status") -> DataFrame:
    return rows.withColumn(column, F.lit("undone"))
