"""Retrieval: keyword matches, merging of hit paths, materials of documents, reranking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import contains_folded, folded, strip
from .hypergraph import chunk_order
from .keyword_index import KeywordIndex, keyword_order
from .keyword_index import keyword_hits as indexed_hits


def keyword_list(words: list[str]) -> list[str]:
    """Trimmed, of two characters at least, and distinct but for case, in order."""
    out: dict[str, str] = {}
    for w in words:
        w = w.strip()
        if len(w) >= 2:
            out.setdefault(w.casefold(), w)
    return list(out.values())


def keyword_match(chunks: DataFrame, minority: list[str], majority: list[str], k: int = 50) -> DataFrame:
    """chunk_id, doc_id, n_minority, n_majority, score: the k best of the chunks that hold any keyword. k is the feature."""
    rare = keyword_list(minority)
    common = [w for w in keyword_list(majority) if w.casefold() not in {r.casefold() for r in rare}]

    def hits(words: list[str]) -> Column:
        total = F.lit(0)
        for w in words:
            total = total + contains_folded("content", F.lit(w)).cast("int")
        return total

    rows = chunks.select(F.col("id").alias("chunk_id"), "doc_id", hits(rare).alias("n_minority"), hits(common).alias("n_majority")).filter("n_minority + n_majority > 0")
    rows = rows.withColumn("score", (10 * F.col("n_minority") + F.col("n_majority")).cast("double"))
    return rows.orderBy(*keyword_order()).limit(k)


def keyword_lists(words: DataFrame) -> DataFrame:
    """query_id, minority, majority: each question's keywords trimmed, of two characters at least, distinct but for case, the first spelling kept; a majority word that is a minority word too goes."""

    def tidy(c: str) -> Column:
        kept = F.filter(F.transform(F.coalesce(c, F.array().cast("array<string>")), strip), lambda w: F.char_length(w) >= 2)
        return F.filter(kept, lambda w, i: F.array_position(F.transform(kept, folded), folded(w)) == i + 1)

    rare = words.select("query_id", tidy("minority").alias("minority"), tidy("majority").alias("majority"))
    return rare.withColumn("majority", F.filter("majority", lambda w: ~F.array_contains(F.transform("minority", folded), folded(w))))


def keyword_hits(chunks: DataFrame, words: DataFrame, k: int = 50, index: KeywordIndex | None = None) -> DataFrame:
    """query_id, chunk_id, doc_id, n_minority, n_majority, score: keyword_match() for every question of words (query_id, minority, majority).

    With an index of the chunks (keyword_index.build_index) only chunks that can hold a keyword are read.
    """
    return indexed_hits(chunks, keyword_lists(words), k, index)


def keyword_path(pool: DataFrame, keys: list[str], k: int, relevance: DataFrame | None = None) -> DataFrame:
    """The pool's hits in the k documents of each question that a first reranking keeps.

    relevance: keys, doc_id, relevance of a question's documents, as a reranking model gives them; without it the documents'
    best hits rank them. k = 0 skips the path. Documents come from the pool, so each that is kept has a hit in it.
    """
    docs = pool.filter("doc_id IS NOT NULL").groupBy(*keys, "doc_id").agg(F.max("score").alias("material_score"))
    if relevance is not None:
        docs = docs.join(relevance.select(*keys, "doc_id", "relevance"), [*keys, "doc_id"], "left")
    kept = rerank(docs, F.coalesce("relevance", F.lit(0.0)) if relevance is not None else None, k, keys) if k > 0 else docs.limit(0)
    return pool.join(kept.select(*keys, "doc_id"), [*keys, "doc_id"], "left_semi")


def node_hits_to_chunks(hits: DataFrame, nodes: DataFrame) -> DataFrame:
    """query_id, chunk_id, score, node_id: each chunk's best node hit (of equal scores the least node id); nodes without a chunk are dropped."""
    joined = hits.join(nodes.select(F.col("id").alias("node_id"), "chunk_id"), hits["id"] == F.col("node_id")).filter("chunk_id IS NOT NULL")
    return joined.groupBy("query_id", "chunk_id").agg(F.max("score").alias("score"), F.min_by("node_id", F.struct(-F.col("score"), F.col("node_id"))).alias("node_id"))


def merge_hits(chunk_hits: DataFrame, node_hits: DataFrame, keys: list[str]) -> DataFrame:
    """keys, score, match_type of both paths: the greater score; chunk, node or chunk+node."""
    a = chunk_hits.select(*keys, F.col("score").alias("_a"))
    b = node_hits.select(*keys, F.col("score").alias("_b"))
    kind = F.when(F.col("_a").isNotNull() & F.col("_b").isNotNull(), "chunk+node").when(F.col("_a").isNotNull(), "chunk").otherwise("node")
    return a.join(b, keys, "full").select(*keys, F.greatest("_a", "_b").alias("score"), kind.alias("match_type"))


#: Fixed order of the parts of a match type.
PATHS = ["chunk", "node", "keyword"]


def union_hits(dual: DataFrame, keyword: DataFrame, keys: list[str]) -> DataFrame:
    """Both sides' hits by key: the greater score, and all parts of the match types in a fixed order. No hit is lost."""
    a = dual.select(*keys, F.col("score").alias("_a"), F.col("match_type").alias("_ta"))
    b = keyword.select(*keys, F.col("score").alias("_b"), F.lit("keyword").alias("_tb"))
    parts = F.array_union(F.split(F.coalesce("_ta", F.lit("")), r"\+"), F.split(F.coalesce("_tb", F.lit("")), r"\+"))
    kind = F.array_join(F.filter(F.array(*[F.lit(p) for p in PATHS]), lambda p: F.array_contains(parts, p)), "+")
    return a.join(b, keys, "full").select(*keys, F.greatest("_a", "_b").alias("score"), kind.alias("match_type"))


def materials(hits: DataFrame, chunks: DataFrame, full_body: bool = False, by: tuple[str, ...] = ()) -> DataFrame:
    """by, material_id, doc_id, position, chunk_id, name, match_type, score of each material's rows, for each question (`by`).

    Docs are ordered by their best hit, then id. By default a doc's head chunk goes first and its hit body chunks follow
    in chunk order; with full_body all body chunks do and there is no head row, except in a doc that has nothing but a head.
    hits: by, chunk_id, score, match_type; chunks: id, doc_id, name. Hits without a chunk, or chunks without a doc, are dropped.
    """
    placed = hits.join(chunks.select(F.col("id").alias("chunk_id"), "doc_id"), "chunk_id").filter("doc_id IS NOT NULL")
    docs = placed.groupBy(*by, "doc_id").agg(F.max("score").alias("material_score"))
    own = chunks.select(F.col("id").alias("chunk_id"), F.col("doc_id").alias("_doc"), "name").join(material_numbers(docs, by=by), F.col("_doc") == F.col("doc_id"))
    rows = own.join(hits.select(*by, "chunk_id", "score", "match_type"), [*by, "chunk_id"], "left")
    head, group = F.col("name") == "head", [*by, "doc_id"]
    if full_body:
        rows = rows.withColumn("_bodies", F.count(F.when(~head, 1)).over(Window.partitionBy(*group)))
        rows = rows.filter(~head | (F.col("_bodies") == 0)).withColumns({"match_type": F.coalesce("match_type", F.lit("full_body_expand")), "score": F.coalesce("score", "material_score")})
    else:
        rows = rows.filter(head | F.col("match_type").isNotNull()).withColumns({"match_type": F.coalesce("match_type", F.lit("head")), "score": F.coalesce("score", "material_score")})
    order = Window.partitionBy(*group).orderBy(F.when(head, 0).otherwise(1), chunk_order("name"), "chunk_id")
    return rows.withColumn("position", F.row_number().over(order)).select(*by, "material_id", "doc_id", "position", "chunk_id", "name", "match_type", "score")


def material_numbers(docs: DataFrame, k: int | None = None, by: tuple[str, ...] | list[str] = ()) -> DataFrame:
    """Adds material_id, 1 on, by score and then id, for each question. A question's docs are few: the paths' k bound them."""
    ranked = docs.withColumn("material_id", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("material_score"), "doc_id")))
    return ranked if k is None else ranked.filter(F.col("material_id") <= k)


def rerank(docs: DataFrame, relevance: Column | None, k: int, by: tuple[str, ...] | list[str] = ()) -> DataFrame:
    """The k most relevant materials of each question, numbered anew; without relevance (the reranker failed) by material score, fallback = true. k <= 0 leaves all as they are.

    With `by` a task keeps its best k rows of a question before they are shuffled; without it the best k are taken first.
    """
    if k <= 0:
        return material_numbers(docs, by=by).withColumn("fallback", F.lit(False))
    scored = docs if relevance is None else docs.withColumn("material_score", relevance)
    best = scored if by else scored.orderBy(F.desc("material_score"), "doc_id").limit(k)
    return material_numbers(best, k, by).withColumn("fallback", F.lit(relevance is None))


def rerank_results(raw: Column) -> Column:
    """array<struct<index, score>>, best first, of a reranking service's answer: `results` or `data` or a list itself, a score named relevance_score or score; entries without both go."""
    v = F.try_parse_json(raw)
    found = F.coalesce(F.try_variant_get(v, "$.results", "array<variant>"), F.try_variant_get(v, "$.data", "array<variant>"), F.try_variant_get(v, "$.output.results", "array<variant>"), F.try_variant_get(v, "$", "array<variant>"))
    pairs = F.transform(found, lambda x: F.struct(F.coalesce(F.try_variant_get(x, "$.relevance_score", "double"), F.try_variant_get(x, "$.score", "double")).alias("score"), F.coalesce(F.try_variant_get(x, "$.index", "int"), F.try_variant_get(x, "$.document.index", "int")).alias("index")))
    kept = F.filter(pairs, lambda p: p["score"].isNotNull() & p["index"].isNotNull())
    ordered = F.array_sort(kept, lambda a, b: F.when(a["score"] > b["score"], -1).when(a["score"] < b["score"], 1).otherwise(a["index"] - b["index"]))
    return F.transform(ordered, lambda p: F.struct(p["index"].alias("index"), p["score"].alias("score")))


def context_text(rows: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """by, material_id, text: a material's chunks as Markdown; scores aren't printed. rows: materials() with content and source."""
    title = F.when(F.col("name") == "head", F.lit("### Head")).otherwise(F.concat(F.lit("### Index block "), F.col("position").cast("string"), F.lit(" (match="), F.col("match_type"), F.lit(")")))
    parts = rows.groupBy(*by, "material_id").agg(F.first("source").alias("source"), F.sort_array(F.collect_list(F.struct("position", F.concat_ws("\n", title, "content").alias("text")))).alias("parts"))
    head = F.concat(F.lit("----- Material "), F.col("material_id").cast("string"), F.lit(" | source: "), F.coalesce("source", F.lit("未知来源")), F.lit(" -----"))
    return parts.select(*by, "material_id", F.concat_ws("\n", head, F.array_join(F.transform("parts", lambda p: p["text"]), "\n")).alias("text"))
