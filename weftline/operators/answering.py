"""Reranking and answering by a model, for many questions at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip, thought_and_answer
from ..storage import written
from .models import TextModel, answers
from .retrieval import context_text, rerank

#: Fixed value: what stands for the materials of a question that has none.
NO_MATERIALS = "(no relevant product materials retrieved)\n"


def relevance(pairs: DataFrame, model: TextModel, **options) -> DataFrame:
    """query_id, doc_id, relevance of pairs (query_id, doc_id, query, text): a model's numbers for {"query", "document"} as JSON.

    A question without a text keeps its documents at 0, unasked; a pair whose call failed has no relevance. Equal pairs are asked
    once, in batches of bounded texts and bytes (options: of models.answers).
    """
    blank = strip(F.coalesce("query", F.lit(""))) == ""
    asked = pairs.filter(~blank).withColumn("prompt", F.to_json(F.struct(strip("query").alias("query"), F.coalesce("text", F.lit("")).alias("document"))))
    scored = answers(asked, model, result="double", **options).select("query_id", "doc_id", F.when(F.col("status") == 1, F.col("answer")).alias("relevance"))
    return scored.unionByName(pairs.filter(blank).select("query_id", "doc_id", F.lit(0.0).alias("relevance")))


def reranked(docs: DataFrame, texts: DataFrame, queries: DataFrame, model: TextModel, k: int, **options) -> DataFrame:
    """docs (query_id, doc_id, material_score) by a model's relevance, the k best of each question, numbered anew, with `fallback`.

    texts: query_id, doc_id, text (what the question's hits in the document say); queries: query_id, query. A question of which
    any call failed keeps the order of its material scores, fallback = true, as a whole.
    """
    pairs = docs.select("query_id", "doc_id").join(texts, ["query_id", "doc_id"], "left").join(queries.select("query_id", "query"), "query_id", "left")
    said = written(relevance(pairs, model, **options), "relevance")
    lost = said.groupBy("query_id").agg(F.max(F.col("relevance").isNull()).alias("_lost"))
    rows = written(docs.join(said, ["query_id", "doc_id"], "left").join(lost, "query_id", "left"), "scored")
    good = rerank(rows.filter(~F.col("_lost")).drop("_lost"), F.col("relevance"), k, ["query_id"])
    kept = rerank(rows.filter(F.coalesce("_lost", F.lit(True))).drop("_lost"), None, k, ["query_id"])
    return good.unionByName(kept)


def answer_questions(rows: DataFrame, queries: DataFrame, model: TextModel, template: str = "{retrieval_result}\n.Question: {query}", **options) -> DataFrame:
    """query_id, thought, answer, status, sources, doc_ids for every question of queries (query_id, query).

    rows: the questions' materials with content and source, as context_text() takes them, and doc_id. All of a question's
    materials go into its prompt, in their order; sources and documents are named once each, in that order. A question without
    materials is asked too. Where the call failed, thought and answer are null.
    """
    texts = context_text(rows, ("query_id",))
    whole = texts.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("material_id", "text"))).alias("_t"))  # a question has few materials
    whole = whole.select("query_id", F.array_join(F.transform("_t", lambda t: t["text"]), "\n\n").alias("_context"))
    placed = rows.select("query_id", "doc_id", "source", "material_id", "position")
    first = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("_at", F.col(c).alias("v")))), lambda x: x["v"])

    def named(c: str, name: str) -> DataFrame:
        each = placed.filter(F.col(c).isNotNull()).groupBy("query_id", c).agg(F.min(F.struct("material_id", "position")).alias("_at"))
        return each.groupBy("query_id").agg(first(c).alias(name))

    prompt = F.replace(F.replace(F.lit(template), F.lit("{retrieval_result}"), F.coalesce("_context", F.lit(NO_MATERIALS))), F.lit("{query}"), F.coalesce("query", F.lit("")))
    asked = answers(queries.select("query_id", "query").join(whole, "query_id", "left").select("query_id", prompt.alias("prompt")), model, **options)
    said = thought_and_answer(F.when(F.col("status") == 1, F.col("answer")))
    out = asked.select("query_id", *[F.when(F.col("status") == 1, said[c]).alias(c) for c in ("thought", "answer")], "status")
    return out.join(named("source", "sources"), "query_id", "left").join(named("doc_id", "doc_ids"), "query_id", "left")
