"""Answers and reranking by a model, with calls that fail."""

import json

from weftline.operators import answering


def broken_for(word, then):
    def model(prompts):
        if any(word in p for p in prompts):
            raise RuntimeError("down")
        return [then(p) for p in prompts]

    return model


def test_reranking_falls_back_question_by_question(spark):
    docs = spark.createDataFrame([(1, 10, 0.9), (1, 11, 0.8), (2, 10, 0.1), (2, 12, 0.7), (3, 10, 0.5), (3, 11, 0.6)], "query_id long, doc_id long, material_score double")
    texts = spark.createDataFrame([(1, 10, "long text"), (1, 11, "x"), (2, 10, "bad"), (2, 12, "y"), (3, 10, "z")], "query_id long, doc_id long, text string")
    queries = spark.createDataFrame([(1, " one "), (2, "two"), (3, " ")], "query_id long, query string")
    model = broken_for('"document":"bad"', lambda p: 1.0 / (1 + len(json.loads(p)["document"])))
    got = {(r.query_id, r.material_id): (r.doc_id, r.fallback) for r in answering.reranked(docs, texts, queries, model, 1).collect()}
    assert got == {(1, 1): (11, False), (2, 1): (12, True), (3, 1): (10, False)}  # a blank question leaves its documents at 0, in the order of their ids
    pairs = docs.join(texts, ["query_id", "doc_id"]).join(queries, "query_id")
    said = {(r.query_id, r.doc_id): r.relevance for r in answering.relevance(pairs, model).collect()}
    assert said == {(1, 10): 0.1, (1, 11): 0.5, (2, 10): None, (2, 12): 0.5, (3, 10): 0.0}


def test_answers_name_sources_once_in_order(spark):
    columns = "query_id long, material_id int, doc_id long, position int, chunk_id long, name string, match_type string, content string, source string"
    rows = spark.createDataFrame(
        [(1, 2, 20, 1, 5, "head", "head", "h2", "b.pdf"), (1, 1, 10, 1, 3, "head", "head", "h1", "a.pdf"), (1, 1, 10, 2, 4, "body_1", "chunk", "b1", "a.pdf"), (1, 3, 30, 1, 9, "head", "head", "h3", "b.pdf"), (3, 1, 10, 1, 3, "head", "head", "boom", None)], columns
    )
    queries = spark.createDataFrame([(1, "why?"), (2, "what?"), (3, "x")], "query_id long, query string")
    model = broken_for("boom", lambda p: f"Thought: t\nAnswer: {p}")
    got = {r.query_id: r for r in answering.answer_questions(rows, queries, model).collect()}
    first = "----- Material 1 | source: a.pdf -----\n### Head\nh1\n### Index block 2 (match=chunk)\nb1\n\n----- Material 2 | source: b.pdf -----\n### Head\nh2\n\n----- Material 3 | source: b.pdf -----\n### Head\nh3\n.Question: why?"
    assert (got[1].thought, got[1].answer, got[1].status, got[1].sources, got[1].doc_ids) == ("t", first, 1, ["a.pdf", "b.pdf"], [10, 20, 30])
    assert got[2].answer == "(no relevant product materials retrieved)\n\n.Question: what?" and got[2].sources is None
    assert (got[3].thought, got[3].answer, got[3].status, got[3].doc_ids) == (None, None, 0, [10])
