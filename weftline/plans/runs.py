"""Registered queries that run something over the driver's tables: streams, model calls, rounds of plans, layouts."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import agent, layout, models, shards, slices, stages
from ..sources import sheets
from ..storage import is_folder, new_path, written
from ..streaming import lifetime, vectorize


def _t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _stream(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A table as a stream of its files; a table of one file is found in the folder that it lies in."""
    path = f"{sf}/{name}.parquet"
    stream = spark.readStream.schema(spark.read.parquet(path).schema)
    return stream.parquet(path) if is_folder(spark, path) else stream.option("pathGlobFilter", f"{name}.parquet").parquet(sf)


def vectorize_stage(spark, sf):
    """Documents go through the vectorise stream with a stub for a model; every seventh has nothing to embed."""
    path = new_path(spark, "vectorized")

    def rows(docs):
        return docs.select(F.col("doc_id").alias("id"), F.col("text").alias("content"), F.when(F.col("doc_id") % 7 == 0, "").when(F.col("doc_id") % 7 == 1, F.concat(F.lit("e"), F.col("doc_id").cast("string"))).alias("embedding_content"))

    vectorize.vectorize(rows(_stream(spark, sf, "documents")), path, f"{path}/checkpoint", models.stub_embedding, "documents")().awaitTermination()
    state = vectorize.with_status(rows(_t(spark, sf, "documents")), path)
    found = state.join(vectorize.vectors_of(spark, path), "id", "left")
    return found.select(F.col("id").alias("doc_id"), "embedding_status", F.size("embedding").cast("long").alias("n"), F.round(F.get("embedding", F.lit(0)).cast("double"), 4).alias("first"))


def _sessions(spark, sf):
    """A session for each user and kind of event: how many events of it were real, cached and skipped, and what they took."""
    kind = lambda x: F.count_if(F.col("event_id") % 3 == x)
    e = _t(spark, sf, "events").groupBy(F.col("event_type").alias("stage"), F.col("user_id").cast("string").alias("session"))
    return e.agg(kind(0).alias("n_real"), kind(1).alias("n_cached"), kind(2).alias("n_skipped"), F.sum("event_id").alias("tokens"), F.round(F.sum("value"), 2).alias("seconds"))


def lifetime_metrics(spark, sf):
    """Totals of all sessions as a stream's state; the stream brings every other session twice."""
    path, source = new_path(spark, "lifetime"), new_path(spark, "sessions")
    sessions = written(_sessions(spark, sf), "sessions")
    sessions.write.parquet(source)
    sessions.filter(F.pmod(F.xxhash64("session"), F.lit(2)) == 0).write.mode("append").parquet(source)
    lifetime.keep_lifetime(spark.readStream.schema(lifetime.SESSION).parquet(source), path, f"{path}-checkpoint")().awaitTermination()
    return lifetime.read_lifetime(spark, path).withColumn("seconds", F.round("seconds", 2))


def _digest(texts: list[str]) -> list[str]:
    """Stands in for a model whose answer depends on all of its prompt."""
    return [f" a {hashlib.sha256(t.encode()).hexdigest()[:12]}\nmore" for t in texts]


def conversation_plans(spark, sf):
    """A plan for each conversation: its turns are steps, each on the two before; every fifth plan has a cycle."""
    c = _t(spark, sf, "conversations")
    t = F.col("turn")
    back = F.when(t == 0, F.when(F.col("conv_id") % 5 == 0, F.array(F.lit("1"))).otherwise(F.array().cast("array<string>"))).when(t == 1, F.array(F.lit("0"))).otherwise(F.array((t - 1).cast("string"), (t - 2).cast("string")))
    steps = c.select(F.col("conv_id").alias("plan_id"), t.alias("ord"), t.cast("string").alias("id"), F.substring("text", 1, 60).alias("question"), back.alias("depends_on"))
    queries = c.groupBy(F.col("conv_id").alias("plan_id")).agg(F.min_by(F.substring("text", 1, 80), "turn").alias("query"))
    return agent.with_llm_step(agent.normalize_plan(steps, 8), "all"), queries


def agent_rounds(spark, sf):
    """Every conversation's plan run to its end, and what the last model is asked, as digests."""
    plans, queries = conversation_plans(spark, sf)
    plans = written(plans, "plans")
    done = agent.run_plans(plans, queries, _digest, _digest)
    said = agent.synthesis_prompts(plans, done, queries)
    sums = done.groupBy("plan_id").agg(F.count("*").alias("n_steps"), F.max("round").cast("long").alias("rounds"), F.count_if(F.col("status") == 1).alias("n_ok"))
    return sums.join(said, "plan_id").select("plan_id", "n_steps", "rounds", "n_ok", F.sha2("prompt", 256).alias("prompt_sha256"))


def thought_answer(spark, sf):
    """Turns as a model would word them: labelled in two languages, in the middle of a line, twice, or not at all."""
    said = F.regexp_replace("text", r"\s+", " ")
    shape = F.col("turn") % 5
    text = F.when(shape == 0, F.concat(F.lit("Thought: "), "role", F.lit("\nAnswer: "), said)).when(shape == 1, F.concat(F.lit("思考："), "role", F.lit("\n 回答： "), said, F.lit("\n结论: "), "role"))
    text = text.when(shape == 2, F.concat("role", F.lit(" Answer: "), said)).when(shape == 3, F.concat(F.lit("thought: "), said)).otherwise(F.concat(F.lit("answer: "), said))
    found = X.thought_and_answer(text)
    return _t(spark, sf, "conversations").select("conv_id", "turn", F.md5(found["thought"]).alias("thought_md5"), F.md5(found["answer"]).alias("answer_md5"))


def question_ids(spark, sf):
    n = F.col("doc_id").cast("string")
    raw = F.when(F.col("doc_id") % 6 == 0, n).when(F.col("doc_id") % 6 == 1, F.concat(F.lit("q00"), n)).when(F.col("doc_id") % 6 == 2, F.concat("lang", n)).when(F.col("doc_id") % 6 == 3, F.concat(F.lit(" Q"), n, F.lit(" "))).when(F.col("doc_id") % 6 == 4, " ")
    return _t(spark, sf, "documents").select("doc_id", X.question_id(raw, F.col("doc_id") + 1).alias("question_id"))


def error_fingerprints(spark, sf):
    """Errors of pages: what changes from attempt to attempt is replaced, so that like ones count together."""
    n = F.col("page_id")
    message = F.concat(F.lit(" Timeout for "), "url", F.when(n % 2 == 0, ".pdf").otherwise(".txt"), F.lit("  attempt "), (n % 5).cast("string"), F.lit(" / 5 pages="), (n % 97).cast("string"), F.lit(" code "), (n % 3).cast("string"))
    return _t(spark, sf, "pages").select(X.error_fingerprint(message, F.when(n % 4 == 0, "ValueError").otherwise("TimeoutError")).alias("fingerprint")).groupBy("fingerprint").agg(F.count("*").alias("n"))


def _extracted(spark, sf):
    """Each turn is a chunk whose answer names its first two long words, twice; two of three conversations have hyperedges."""
    words = F.array_distinct(F.filter(F.split(F.lower("text"), "[^a-z]+"), lambda w: F.length(w) >= 4))
    one, two = F.coalesce(F.get(words, F.lit(0)), F.lit("none1")), F.coalesce(F.get(words, F.lit(1)), F.lit("none2"))
    item = lambda a, b: F.struct(F.create_map(one, a, two, b).alias("entities"))
    said = F.to_json(F.array(item(F.lit(""), F.substring("text", 1, 20)), item(F.col("role"), F.substring("text", F.lit(1), F.lit(15) + 3 * F.col("turn").cast("int")))))
    c = _t(spark, sf, "conversations")
    status = F.when(F.col("turn") % 4 == 3, "new").otherwise("extract")
    chunks = c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.col("conv_id").alias("doc_id"), F.concat(F.lit("body_"), F.col("turn").cast("string")).alias("name"), F.to_json(F.struct(said.alias("extract"))).alias("extra"), status.alias("status"))
    ids = c.select("conv_id").distinct().filter("conv_id % 3 <> 2")
    edges = ids.select((F.col("conv_id") * 2).alias("id"), F.col("conv_id").alias("doc_id"), F.lit(None).cast("long").alias("chunk_id"), F.when(F.col("conv_id") % 2 == 0, F.lit('{"source": "given"}')).alias("extra"))
    return chunks, edges.unionByName(edges.withColumn("id", F.col("id") + 1))


def build_nodes(spark, sf):
    _, nodes, _ = stages.build(*_extracted(spark, sf))
    return nodes.select("doc_id", "chunk_id", "hyperedge_id", "name", F.md5("content").alias("content_md5"), F.md5("embedding_content").alias("embedding_md5"))


def build_hyperedges(spark, sf):
    edges = stages.enriched_hyperedges(*_extracted(spark, sf))
    v = F.try_parse_json("extra")
    said = lambda k, t: F.try_variant_get(v, f"$.{k}", t)
    return edges.select("id", "doc_id", "chunk_id", said("source", "string").alias("source"), said("source_chunk_id", "long").alias("head_id"), F.size(F.map_keys(said("entities", "map<string,string>"))).cast("long").alias("n_entities"))


def build_statuses(spark, sf):
    """Chunks after the build: those of documents without a hyperedge wait for one."""
    chunks, _, _ = stages.build(*_extracted(spark, sf))
    return chunks.groupBy("status").agg(F.count("*").alias("n"), F.sum("id").alias("ids"))


def slice_prior(spark, sf):
    """What stands before each slice of documents by fours, where some slices are missing and some empty."""
    n = F.col("doc_id")
    name = F.concat(F.lit("doc_"), F.floor(n / 4).cast("string"), F.lit(".pdf"), F.when(n % 4 > 0, F.concat(F.lit("_"), (n % 4).cast("string"))).otherwise(""))
    extra = F.when(n % 3 == 0, F.to_json(F.struct(((n % 4) * 12).alias("page_start"), ((n % 4) * 12 + 12).alias("page_end"))))
    docs = _t(spark, sf, "documents").filter("doc_id % 11 <> 5").select(n.alias("id"), name.alias("name"), F.when(n % 13 == 6, "  ").otherwise(F.col("text")).alias("content"), extra.alias("extra"))
    got = slices.summary_prompts(docs, "{content}", "{slice_pos}\n{prior_content}\n{content}")
    return got.select(F.col("id").alias("doc_id"), F.col("n_prior").cast("long").alias("n_prior"), F.md5("prior").alias("prior_md5"), F.md5("prompt").alias("prompt_md5"))


def _sheets(spark, sf):
    """A question sheet for each source: the documents' first words are questions, under headers of three kinds."""
    d = _t(spark, sf, "documents").select("source", "doc_id", "lang", F.regexp_replace(F.substring("text", 1, 60), r"\s+", " ").alias("q"))
    at = F.row_number().over(Window.partitionBy("source").orderBy("doc_id")) + 1
    cells = F.array(F.when(F.col("doc_id") % 5 == 0, "").otherwise(F.col("doc_id").cast("string")), F.when(F.col("doc_id") % 9 == 4, " ").otherwise(F.col("q")), "lang", F.when(F.col("doc_id") % 2 == 0, "d1；d2/ d3").otherwise(""), F.when(F.col("doc_id") % 7 == 0, "").otherwise(F.concat(F.lit("r"), F.col("doc_id").cast("string"))))
    rows = d.select(F.col("source").alias("file"), F.lit("questions").alias("sheet"), F.lit(0).alias("place"), at.alias("row"), cells.alias("cells"))
    heads = {0: ["序号", "问题文本", "难度等级", "评分维度", "备注"], 1: ["题号", "问题描述", "应用场景", "评估要点", "note"], 2: ["id", "query", "lang", "评分要点", "预期检索路径"]}
    kind = F.ascii(F.substring("source", -1, 1)) % 3
    head = F.when(kind == 0, F.array(*map(F.lit, heads[0]))).when(kind == 1, F.array(*map(F.lit, heads[1]))).otherwise(F.array(*map(F.lit, heads[2])))
    tops = d.select("source").distinct().select(F.col("source").alias("file"), F.lit("questions").alias("sheet"), F.lit(0).alias("place"), F.lit(1).alias("row"), head.alias("cells"))
    return rows.unionByName(tops)


def question_sheets(spark, sf):
    q = sheets.question_rows(_sheets(spark, sf))
    said = F.concat_ws("|", "question", "reasoning_path", "note", F.array_join("score_dimensions", "/"))
    return q.select("file", "row", "kind", F.col("id").alias("question_id"), F.md5(said).alias("said_md5"), F.array_join(F.transform(F.map_entries("categories"), lambda e: F.concat_ws("=", e["key"], e["value"])), ",").alias("categories"))


def shard_assign(spark, sf):
    """Documents in shards of a hundred and fifty by running totals, the first of them half full."""
    d = shards.running_shards(_t(spark, sf, "documents").select(F.col("doc_id").alias("id")), 150, start=3, room=75)
    return d.groupBy("shard").agg(F.count("*").alias("n"), F.min("id").alias("first_id"), F.max("id").alias("last_id"))


def hypergraph_layout(spark, sf):
    """Where a hypergraph's parts are drawn: conversations, their turns after the first, and the long words of those that have few."""
    c = _t(spark, sf, "conversations")
    hubs = c.select(F.col("conv_id").alias("hub")).distinct()
    turns = c.withColumn("chunk", F.col("conv_id") * 1000 + F.col("turn"))
    words = turns.select("conv_id", "turn", "chunk", F.explode(F.array_distinct(F.filter(F.split(F.lower("text"), "[^a-z]+"), lambda w: F.length(w) >= 9))).alias("name"))
    ties = words.select("name", F.when(F.col("turn") == 0, "he").otherwise("ch").alias("kind"), F.when(F.col("turn") == 0, F.col("conv_id")).otherwise(F.col("chunk")).alias("anchor"))
    placed = layout.hypergraph_positions(hubs, turns.filter("turn > 0").select("chunk", F.col("conv_id").alias("hub")).distinct(), ties, rounds=3)
    return placed.select("kind", "key", F.round("x", 4).alias("x"), F.round("y", 4).alias("y"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    names = """vectorize_stage lifetime_metrics agent_rounds thought_answer question_ids error_fingerprints build_nodes build_hyperedges build_statuses slice_prior question_sheets
    shard_assign hypergraph_layout"""
    return {n: globals()[n] for n in names.split()}
