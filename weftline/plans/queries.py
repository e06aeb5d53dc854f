"""The registered queries: each applies one operator to the driver's tables."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import judging as J
from ..functions import text as X
from ..functions import values as V
from ..operators import agent, answering, chunking, evaluation, hypergraph, keyword_index, models, report, retrieval, stages, store, vector_index, vectors
from ..sources import metrics, remote, tables
from ..storage import written
from . import runs

#: Keywords that occur in the fixture's English text.
MINORITY, MAJORITY = ["blehe", "thinhe", "eringed"], ["tion", "the", "edand", "oner"]


def _t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _docs(spark: SparkSession, sf: str) -> DataFrame:
    d = _t(spark, sf, "documents")
    return d.select(F.col("doc_id").alias("id"), F.concat(F.lit("doc_"), F.col("doc_id").cast("string"), F.lit(".pdf")).alias("name"), F.col("text").alias("content"), F.md5("text").alias("hash"), "lang", "source", "n_chars")


def _slices(spark: SparkSession, sf: str) -> DataFrame:
    base = F.concat(F.lit("doc_"), F.floor(F.col("doc_id") / 4).cast("string"), F.lit(".pdf"))
    return _t(spark, sf, "documents").select(F.col("doc_id").alias("id"), X.slice_name(base, F.col("doc_id") % 4).alias("name"), base.alias("source_name"), "n_chars")


def _verdict(c: str):
    return F.when(F.col(c) == 1, V.RIGHT).when(F.col(c) == 0, V.WRONG)


def _judged(spark: SparkSession, sf: str) -> DataFrame:
    d, labels = _t(spark, sf, "documents"), _t(spark, sf, "labels").withColumnRenamed("doc_id", "l_id")
    return d.join(labels, d.doc_id == F.col("l_id"), "left").select("doc_id", "lang", "source", (F.col("doc_id") % 3 + 1).alias("hop"), _verdict("quality").alias("verdict"), _verdict("toxic").alias("base_verdict"))


def _scored(spark: SparkSession, sf: str) -> DataFrame:
    return _t(spark, sf, "events").select("event_id", "event_type", "user_id", V.score_0_to_3(F.col("value") / 10).alias("score")).withColumn("verdict", V.verdict_of_score("score"))


def _queries(e: DataFrame) -> DataFrame:
    return e.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))


def _hits(spark: SparkSession, sf: str, k: int, dead: bool = False) -> DataFrame:
    e = _t(spark, sf, "embeddings")
    gone = e.filter("vec_id % 7 = 0").select(F.col("vec_id").alias("id")) if dead else None
    return vectors.top_k(e, _queries(e), k, gone, id_col="vec_id")


# store


def doc_insert_dedup(spark, sf):
    return store.insert_ignore(None, _docs(spark, sf), ["hash"], ["id"]).select(F.col("id").alias("doc_id"), "name", "hash")


def doc_name_antijoin(spark, sf):
    known = _t(spark, sf, "labels").select(F.concat(F.lit("doc_"), F.col("doc_id").cast("string"), F.lit(".pdf")).alias("name")).distinct()
    return _docs(spark, sf).join(known, "name", "left_anti").select(F.col("id").alias("doc_id"), "name")


def search_eq(spark, sf):
    return _t(spark, sf, "orders").filter(F.col("o_custkey") == 7).select("o_orderkey", "o_orderstatus", F.round("o_totalprice", 4).alias("o_totalprice"))


def count_by(spark, sf):
    return _t(spark, sf, "orders").filter(F.col("o_orderstatus") == "F").agg(F.count("*").alias("n"))


def keyset_page(spark, sf):
    page = store.keyset_page(_t(spark, sf, "lineitem"), F.col("l_returnflag") == "R", ["l_orderkey", "l_linenumber"], (100, 2), 50, ["l_partkey", "l_quantity"])
    return page.withColumn("l_quantity", F.round("l_quantity", 4))


def in_list_semi(spark, sf):
    wanted = _t(spark, sf, "customer").filter("c_mktsegment = 'BUILDING'").select("c_custkey")
    o = _t(spark, sf, "orders")
    return o.join(wanted, o.o_custkey == wanted.c_custkey, "left_semi").select("o_orderkey", "o_custkey")


def partial_update_last_wins(spark, sf):
    changes = _t(spark, sf, "orders").select("o_custkey", "o_orderkey", F.col("o_totalprice").alias("c_acctbal"))
    changes = changes.withColumnRenamed("o_custkey", "c_custkey")
    out = store.update_last_wins(_t(spark, sf, "customer"), changes, "c_custkey", "o_orderkey", ["c_acctbal"])
    return out.select("c_custkey", "c_name", F.round("c_acctbal", 4).alias("c_acctbal"))


def cascade_delete(spark, sf):
    gone = _t(spark, sf, "customer").filter("c_custkey % 10 = 0")
    tables = [("orders", "o_custkey", "o_orderkey"), ("lineitem", "l_orderkey", "l_orderkey")]
    out = gone.agg(F.lit("customer").alias("tbl"), F.count("*").alias("deleted"))
    done = store.cascade(gone, [(_t(spark, sf, n), f, k) for n, f, k in tables], "c_custkey")
    for (name, _, _), (_, deleted) in zip(tables, done):
        out = out.union(deleted.agg(F.lit(name).alias("tbl"), F.count("*").alias("deleted")))
    return out


def family_base(spark, sf):
    return _slices(spark, sf).select(F.col("id").alias("doc_id"), "name", X.family_base("name").alias("base"), X.slice_index("name").cast("long").alias("slice_index"))


def family_closure(spark, sf):
    s = _slices(spark, sf).withColumn("source_name", F.when(F.col("id") % 16 == 3, F.concat(F.lit("doc_"), F.floor((F.col("id") + 4) / 4).cast("string"), F.lit(".pdf"))))
    names = s.filter(F.col("id") % 100 == 0).select("name")
    return store.family_closure(s, names).select(F.col("id").alias("doc_id"), "name")


def slice_plan(spark, sf):
    files = _docs(spark, sf).select("name", F.floor(F.col("n_chars") / 200).alias("pages"))
    p = remote.plan_slices(files, 12)
    return p.select("base", "doc_name", "page_start", "page_end", F.col("slice_index").cast("long").alias("slice_index"), "total_pages", F.col("n_slices").cast("long").alias("n_slices"))


# sources


def object_key(spark, sf):
    p = _t(spark, sf, "pages")
    return p.select("page_id", X.object_key("url").alias("key"), X.file_name(X.object_key("url")).alias("file"))


def download_plan(spark, sf):
    p = _t(spark, sf, "pages").select(F.col("page_id").alias("id"), F.col("url").alias("oss_url"))
    return remote.downloads(remote.product_rows(p)).groupBy("state").agg(F.count("*").alias("n"))


def file_dedup_pref(spark, sf):
    name = F.when(F.col("id") % 3 == 0, F.concat("hash", F.lit(".pdf"))).when(F.col("id") % 3 == 1, F.concat(F.lit("f_"), F.col("id").cast("string"), F.lit(".pdf"))).otherwise(F.concat(F.lit("n"), F.col("id").cast("string"), F.lit("x.pdf")))
    return remote.duplicate_files(_docs(spark, sf).select(name.alias("name"), "hash")).select("name", "hash", "kept_name", "keep")


# text


def sentence_split(spark, sf):
    units = _t(spark, sf, "documents").select("doc_id", F.posexplode(X.sentences("text")).alias("pos", "unit"))
    return units.select("doc_id", F.col("pos").cast("long").alias("pos"), "unit")


def join_units(spark, sf):
    u = _t(spark, sf, "documents").select("doc_id", X.sentences("text").alias("units"))
    return u.select("doc_id", F.size("units").cast("long").alias("n_units"), F.md5(X.join_units("units")).alias("joined_md5"))


def chunk_pack(spark, sf):
    d = _docs(spark, sf)
    heads = d.select("id", F.col("id").alias("doc_id"), F.get(X.sentences("content"), F.lit(0)).alias("content"))
    return chunking.chunks(d.select("id", "content"), heads)


def head_body_order(spark, sf):
    c = _t(spark, sf, "conversations").select(F.col("conv_id").alias("doc_id"), (F.col("conv_id") * 100 + 99 - F.col("turn")).alias("id"), F.when(F.col("turn") == 0, "head").otherwise(F.concat(F.lit("body_"), F.col("turn").cast("string"))).alias("name"))
    return hypergraph.ordered_chunks(c).select("doc_id", "id", "name", F.col("position").cast("long").alias("position"))


def prior_slices(spark, sf):
    p = hypergraph.prior_slices(_t(spark, sf, "conversations"), "conv_id", "turn", "text")
    return p.select("conv_id", "turn", F.md5("prior").alias("prior_md5"))


# hypergraph


def _entities(spark, sf):
    words = F.array_distinct(F.split(F.lower("text"), "[^a-z]+"))
    return _t(spark, sf, "conversations").select("conv_id", "turn", "text", F.explode(words).alias("entity")).filter("length(entity) >= 4")


def entity_longest(spark, sf):
    out = hypergraph.longest_descriptions(_entities(spark, sf), ["conv_id", "entity"], "text", "turn")
    return out.select("conv_id", "entity", F.md5("description").alias("description_md5"), "first_at")


def entity_degree(spark, sf):
    return hypergraph.entity_degrees(_entities(spark, sf), "entity", "conv_id").select("entity", "degree", "n_nodes")


def llm_json_sum(spark, sf):
    e = _t(spark, sf, "events").select("event_type", F.get_json_object(V.json_object("props"), "$.k").try_cast("long").alias("k"))
    return e.groupBy("event_type").agg(F.sum("k").alias("k_sum"))


# vectors


def vector_topk_l2(spark, sf):
    return _hits(spark, sf, 10).select("query_id", F.col("id").alias("vec_id"), F.round("distance", 4).alias("distance"), F.col("rank").cast("long").alias("rank"))


def vector_similarity(spark, sf):
    return vectors.scored_hits(_hits(spark, sf, 10)).select("query_id", F.col("id").alias("vec_id"), F.round("score", 4).alias("score"))


def vector_topk_tombstoned(spark, sf):
    return _hits(spark, sf, 10, dead=True).select("query_id", F.col("id").alias("vec_id"), F.col("rank").cast("long").alias("rank"))


#: Cells that a query looks into of every hundred; the fixtures' vectors are spread evenly, so it takes many.
PROBED = 65


def _index(spark, sf, bits=16):
    return vector_index.build_index(_t(spark, sf, "embeddings"), id_col="vec_id", bits=bits)


def vector_topk_ivf(spark, sf):
    """The nearest vectors that an inverted file of cells finds; tests hold them against vector_topk_l2."""
    index = _index(spark, sf)
    hits = vector_index.search(index, _queries(_t(spark, sf, "embeddings")), 10, probes=-(-index.cells * PROBED // 100))
    return hits.select("query_id", F.col("id").alias("vec_id"), F.round("distance", 4).alias("distance"), F.col("rank").cast("long").alias("rank"))


def vector_topk_all_cells(spark, sf):
    """With all cells looked into, the inverted file is exact."""
    index = _index(spark, sf)
    hits = vector_index.search(index, _queries(_t(spark, sf, "embeddings")), 10, probes=index.cells)
    return hits.select("query_id", F.col("id").alias("vec_id"), F.round("distance", 4).alias("distance"), F.col("rank").cast("long").alias("rank"))


def _coded(spark, sf, bits, dead=None):
    e = _t(spark, sf, "embeddings")
    hits = vector_index.search_exact(_index(spark, sf, bits), _queries(e), 10, dead)
    return hits.select("query_id", F.col("id").alias("vec_id"), F.round("distance", 4).alias("distance"), F.col("rank").cast("long").alias("rank"))


def vector_topk_half(spark, sf):
    """Exact search over codes of half precision."""
    return _coded(spark, sf, 16)


def vector_topk_bytes(spark, sf):
    """Exact search over codes of a byte a component, but for tombstones."""
    return _coded(spark, sf, 8, _t(spark, sf, "embeddings").filter("vec_id % 7 = 0").select(F.col("vec_id").alias("id")))


def vector_dedupe_hits(spark, sf):
    h = _hits(spark, sf, 20)
    twice = h.select("query_id", (F.col("id") % 50).alias("id"), "distance")
    return vectors.nearest_per_id(twice, 5).select("query_id", "id", F.round("distance", 4).alias("distance"), F.col("rank").cast("long").alias("rank"))


def vector_compact(spark, sf):
    e = _t(spark, sf, "embeddings")
    live = e.filter("vec_id % 5 <> 0").select(F.col("vec_id").alias("id"))
    return vectors.compact(e, live, "vec_id").select("vec_id", "label")


def deleted_stats(spark, sf):
    e = _t(spark, sf, "embeddings")
    dead = e.filter("vec_id % 7 = 0").select(F.col("vec_id").alias("id"))
    s = vectors.deleted_stats(e, dead, F.floor(F.col("vec_id") / 100), "vec_id")
    return s.select("shard", "total", "deleted", F.round("deleted_ratio", 4).alias("deleted_ratio"))


def node_hits_to_chunk(spark, sf):
    nodes = _t(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").cast("long").alias("chunk_id"))
    return retrieval.node_hits_to_chunks(vectors.scored_hits(_hits(spark, sf, 20)), nodes).select("query_id", "chunk_id", F.round("score", 4).alias("score"), "node_id")


# retrieval


def _chunks(spark, sf):
    return _t(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.floor(F.col("doc_id") / 4).alias("doc_id"), F.when(F.col("doc_id") % 4 == 0, "head").otherwise(F.concat(F.lit("body_"), (F.col("doc_id") % 4).cast("string"))).alias("name"), F.col("text").alias("content"))


def keyword_match(spark, sf):
    k = retrieval.keyword_match(_chunks(spark, sf), MINORITY, MAJORITY)
    return k.select("chunk_id", F.col("n_minority").cast("long").alias("n_minority"), F.col("n_majority").cast("long").alias("n_majority"), "score")


def _words(spark, sf):
    """Each question's keywords, as a model would name them: with blanks, repeats, single letters, and none at all."""
    turn = F.floor(F.col("query_id") / 100) % 3
    words = lambda *w: F.array(*[F.lit(x) for x in w]) if w else F.array().cast("array<string>")
    minority = F.when(turn == 0, words(*MINORITY)).when(turn == 1, words(" BLEHE ", "blehe", "x")).otherwise(words())
    majority = F.when(turn == 0, words(*MAJORITY)).when(turn == 1, words("Blehe", "tion", "TION ", "oner")).otherwise(words("edand", "the"))
    return _queries(_t(spark, sf, "embeddings")).select("query_id", minority.alias("minority"), majority.alias("majority"))


def keyword_hits(spark, sf):
    k = retrieval.keyword_hits(_chunks(spark, sf), _words(spark, sf))
    return k.select("query_id", "chunk_id", F.col("n_minority").cast("long").alias("n_minority"), F.col("n_majority").cast("long").alias("n_majority"), "score")


def keyword_index_hits(spark, sf):
    """keyword_hits through an index of the chunks."""
    chunks = _chunks(spark, sf)
    k = retrieval.keyword_hits(chunks, _words(spark, sf), index=keyword_index.build_index(chunks))
    return k.select("query_id", "chunk_id", F.col("n_minority").cast("long").alias("n_minority"), F.col("n_majority").cast("long").alias("n_majority"), "score")


def keyword_containing(spark, sf):
    """In which documents each word of six letters and more of every item stands, as part of a word or by itself, through an index."""
    d = _t(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("content"))
    words = _t(spark, sf, "benchmark").select(F.explode(F.split(F.lower("text"), "[^a-zà-öø-ÿ]+")).alias("word")).filter("length(word) >= 6").distinct()
    found = keyword_index.containing(keyword_index.build_index(d), d, words)
    return found.groupBy("word").agg(F.count("*").alias("n"), F.sum("id").alias("ids"))


def _keyword_path(spark, sf):
    pool = written(retrieval.keyword_hits(_chunks(spark, sf), _words(spark, sf)), "pool")
    relevance = pool.select("query_id", "doc_id", ((F.col("doc_id") * 37 + F.col("query_id")) % 101 / 101.0).alias("relevance")).distinct()
    return retrieval.keyword_path(pool, ["query_id"], 10, relevance)


def keyword_path(spark, sf):
    return _keyword_path(spark, sf).select("query_id", "chunk_id", "doc_id", "score")


def _dual(spark, sf):
    hits = written(vectors.scored_hits(_hits(spark, sf, 30)), "hits")  # one pass over the vectors for both paths
    chunk = hits.select("query_id", F.col("id").alias("chunk_id"), "score")
    node = hits.filter("rank <= 20").select("query_id", (F.col("id") + F.col("id") % 2).alias("chunk_id"), "score").groupBy("query_id", "chunk_id").agg(F.max("score").alias("score"))
    return retrieval.merge_hits(chunk, node, ["query_id", "chunk_id"])


def merge_hits(spark, sf):
    return _dual(spark, sf).select("query_id", "chunk_id", F.round("score", 4).alias("score"), "match_type")


def _union(spark, sf):
    keyword = _keyword_path(spark, sf).select("query_id", "chunk_id", "score")
    return written(retrieval.union_hits(_dual(spark, sf), keyword, ["query_id", "chunk_id"]), "union")  # the materials read it twice


def union_hits(spark, sf):
    return _union(spark, sf).select("query_id", "chunk_id", F.round("score", 4).alias("score"), "match_type")


def _materials(spark, sf, full):
    m = retrieval.materials(_union(spark, sf), _chunks(spark, sf), full, by=("query_id",))
    return m.select("query_id", F.col("material_id").cast("long").alias("material_id"), "doc_id", F.col("position").cast("long").alias("position"), "chunk_id", "match_type", F.round("score", 4).alias("score"))


def build_materials(spark, sf):
    return _materials(spark, sf, False)


def build_materials_full_body(spark, sf):
    return _materials(spark, sf, True)


def rerank_by_question(spark, sf):
    docs = _union(spark, sf).join(_chunks(spark, sf).select(F.col("id").alias("chunk_id"), "doc_id"), "chunk_id").groupBy("query_id", "doc_id").agg(F.max("score").alias("material_score"))
    best = retrieval.rerank(docs, (F.col("doc_id") * 37 + F.col("query_id")) % 101 / 101.0, 4, ["query_id"])
    return best.select("query_id", F.col("material_id").cast("long").alias("material_id"), "doc_id", F.round("material_score", 4).alias("material_score"), "fallback")


def rerank_parse(spark, sf):
    """Answers of reranking services in several shapes."""
    e = F.col("event_id").cast("string")
    raw = F.when(F.col("event_id") % 4 == 0, F.concat(F.lit('{"results": [{"index": 0, "relevance_score": 0.5}, {"index": 1, "relevance_score": 0.75}, {"index": 2, "relevance_score": 0.5}, {"index": '), e, F.lit(', "x": 1}]}')))
    raw = raw.when(F.col("event_id") % 4 == 1, '{"data": [{"index": 3, "score": 1}, {"index": 1, "score": 2.5}]}').when(F.col("event_id") % 4 == 2, '[{"index": 7, "score": 0.25}, 5]').otherwise("no json")
    rows = _t(spark, sf, "events").select("event_id", F.posexplode(retrieval.rerank_results(raw)).alias("place", "r"))
    return rows.select("event_id", F.col("place").cast("long").alias("place"), F.col("r.index").cast("long").alias("at"), F.col("r.score").alias("score"))


def rerank_fallback(spark, sf):
    docs = _t(spark, sf, "documents").groupBy(F.floor(F.col("doc_id") / 4).alias("doc_id")).agg(F.max("n_chars").cast("double").alias("material_score"))
    return retrieval.rerank(docs, None, 4).select(F.col("material_id").cast("long").alias("material_id"), "doc_id", "material_score", "fallback")


# agent


def _plan(spark, sf):
    c = _t(spark, sf, "conversations")
    deps = F.when(F.col("turn") == 0, F.array().cast("array<string>")).otherwise(F.array((F.col("turn") - 1).cast("string"), F.col("turn").cast("string"), F.lit("zz")))
    return agent.normalize_plan(c.select(F.col("conv_id").alias("plan_id"), F.col("turn").alias("ord"), F.col("turn").cast("string").alias("id"), F.col("text").alias("question"), deps.alias("depends_on")), 6)


def plan_normalize(spark, sf):
    return _plan(spark, sf).select("plan_id", F.col("position").cast("long").alias("position"), "id", F.array_join("depends_on", ",").alias("deps"))


def ready_steps(spark, sf):
    p = _plan(spark, sf)
    done = p.filter("position <= plan_id % 3").select("plan_id", "id")
    return agent.ready_steps(p, done).select("plan_id", "id")


def sources_distinct(spark, sf):
    c = _t(spark, sf, "conversations").select("conv_id", "role", "turn")
    return agent.distinct_sources(c, ["conv_id"], "role", "turn").select("conv_id", "role", F.col("place").cast("long").alias("place"))


def usage_sum(spark, sf):
    e = _t(spark, sf, "events").select("user_id", F.when(F.col("event_type") != "error", F.get_json_object("props", "$.k").try_cast("long")).alias("tokens"))
    return agent.usage_sums(e, ["user_id"], ["tokens"])


# evaluation


def doc_recall(spark, sf):
    d = _docs(spark, sf)
    expected = d.select((F.col("id") % 50).alias("id"), "name")
    found = _t(spark, sf, "labels").select((F.col("doc_id") % 50).alias("id"), F.concat(F.lit("/data/DOC_"), F.col("doc_id").cast("string"), F.lit(".PDF ")).alias("name"))
    return evaluation.doc_recall(expected, found).select(F.col("id").alias("question_id"), "n_expected", "n_hit", "n_miss", F.round("recall", 4).alias("recall"))


def verdict_summary(spark, sf):
    return evaluation.verdict_summary(_judged(spark, sf), []).withColumn("accuracy", F.round("accuracy", 4))


def verdict_by_hop(spark, sf):
    return evaluation.verdict_summary(_judged(spark, sf), ["hop"]).withColumn("accuracy", F.round("accuracy", 4))


def recall_vs_accuracy(spark, sf):
    rows = _judged(spark, sf).withColumn("bucket", evaluation.recall_bucket(F.when(F.col("doc_id") % 5 != 4, (F.col("doc_id") % 5) / 3.0)))
    return evaluation.contingency(rows.withColumn("verdict", F.coalesce("verdict", F.lit(V.UNKNOWN))), "bucket", "verdict")


def system_comparison(spark, sf):
    return evaluation.system_comparison(_judged(spark, sf), "verdict", "base_verdict", "graph", "base").withColumn("graph_win_rate", F.round("graph_win_rate", 4))


def crosstab(spark, sf):
    return evaluation.crosstab(_judged(spark, sf), "verdict", "base_verdict")


def group_metrics(spark, sf):
    g = evaluation.group_metrics(_scored(spark, sf), ["event_type"])
    return g.select("event_type", "n", "n_right", "n_partly", "n_wrong", *[F.round(c, 4).alias(c) for c in ("score_mean", "accuracy", "lenient_accuracy", "score_share")])


def score_hist(spark, sf):
    return evaluation.score_histogram(_scored(spark, sf)).withColumn("score", F.col("score").cast("long"))


def category_coverage(spark, sf):
    groups = _judged(spark, sf).filter("verdict IS NOT NULL").groupBy(F.col("source").alias("label")).agg(F.count("*").alias("n"))
    declared = _t(spark, sf, "documents").filter("source <> 'src3'").groupBy(F.col("source").alias("label")).agg(F.count("*").alias("declared"))
    return evaluation.coverage(groups, declared).withColumn("coverage", F.round("coverage", 4))


def category_distribution(spark, sf):
    return evaluation.distribution(_t(spark, sf, "documents"), ["lang", "source"]).withColumn("ratio", F.round("ratio", 4))


def category_compare_outer(spark, sf):
    j = _judged(spark, sf)
    a = evaluation.verdict_summary(j.filter("source <> 'src1'"), ["source"]).select("source", "accuracy")
    b = evaluation.verdict_summary(j.filter("source <> 'src2'"), ["source"], "base_verdict").select("source", "accuracy")
    return evaluation.compare_categories(a, b, ["source"], "accuracy").select("source", *[F.round(c, 4).alias(c) for c in ("a", "b", "delta")])


def pairwise_order(spark, sf):
    return _t(spark, sf, "benchmark").select("item_id", V.judge_order("item_id").alias("swapped"))


def normalize_score(spark, sf):
    return _t(spark, sf, "events").select("event_id", V.score_0_to_3(F.round(F.col("value") / 5, 1)).cast("long").alias("score"))


def stage_metrics(spark, sf):
    kind = F.when(F.col("event_id") % 4 == 0, "cached").when(F.col("event_id") % 7 == 0, "skipped").otherwise("real")
    calls = _t(spark, sf, "events").select(F.col("event_type").alias("stage"), kind.alias("kind"), F.col("value").alias("seconds"), F.get_json_object("props", "$.k").try_cast("long").alias("tokens"))
    return evaluation.stage_metrics(calls).withColumn("seconds", F.round("seconds", 4))


def model_cache_join(spark, sf):
    prompts = _t(spark, sf, "documents").select("doc_id", F.col("text").alias("prompt"))
    cache = prompts.filter("doc_id % 3 = 0").select(models.cache_key(F.col("prompt"), F.lit("")).alias("key"), F.lit("cached").alias("answer")).distinct()
    a = models.answers(prompts, models.stub_model, cache)
    return a.select("doc_id", "key", F.col("status").cast("long").alias("status"), "cache_hit")


def retrieve(spark, sf):
    """The flagship: for every question the vector, node and keyword paths, merged into the materials of its four best documents."""
    rows = retrieval.materials(_union(spark, sf), _chunks(spark, sf), by=("query_id",))
    return rows.filter("material_id <= 4").select("query_id", F.col("material_id").cast("long").alias("material_id"), "doc_id", F.col("position").cast("long").alias("position"), "chunk_id", "match_type", F.round("score", 4).alias("score"))


# models' answers


def _case(column, values):
    """The value at the column's place in a list, over and over."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), (F.col(column) % len(values) + 1).cast("int"))


def llm_json_entities(spark, sf):
    """Extractions in every shape that is taken, and in some that aren't."""
    kind, user = F.col("event_type"), F.col("user_id").cast("string")
    pair = F.concat(F.lit('{"type": "'), kind, F.lit('", "user": "'), user, F.lit('"}'))
    n = F.col("event_id") % 9
    answer = F.when(n == 0, F.concat(F.lit("```json\n"), pair, F.lit("\n```"))).when(n == 1, F.concat(F.lit('{"entities": '), pair, F.lit(', "knowledge": [1]}')))
    answer = answer.when(n == 2, F.concat(F.lit('[{"entities": '), pair, F.lit('}, {"entities": {"more": "x"}}]'))).when(n == 3, F.concat(F.lit('{"type": "'), kind, F.lit('", "user": '), user, F.lit("}")))
    answer = answer.when(n == 4, F.concat(F.lit('[{"entities": '), pair, F.lit("}, 3]"))).when(n == 5, "{}").when(n == 6, "[]").when(n == 7, F.concat(F.lit("It says "), pair)).otherwise('{"entities": {"one": "a: 1, b"}}')
    return _t(spark, sf, "events").select("event_id", F.inline(V.entities(answer))).select("event_id", "name", "content")


def ratio_parse(spark, sf):
    raw = _case("event_id", ["29.4%", "about 29.4% of all", "0.294", "29.4", "1,234 of 5", "", "none", "-0.5", "100%", None])
    e = _t(spark, sf, "events")
    return e.select("event_id", V.ratio(raw, F.col("event_id") % 7, F.lit(8)).alias("ratio"))


#: What judges answer.
JUDGED_TEXTS = ["正确", " 错 ", "对", "不正确", "部分正确", "Verdict: wrong", "INCORRECT", "Yes", "yes, it is", "I know it is right", "不完全对", "?", "true", "False", "", None, "完全错误", "partial"]
WINNER_TEXTS = ["A", "回答 B", "answer_a", "It is a tie", "tie", "Both", "A is worse than B", "B wins", "两者相当", "甲更好", "乙", "neither", "超图", "baseline", "", None, "B is a better answer", "Answer-B", "LLM only", "回答A更好"]


def normalize_judgment(spark, sf):
    text = _case("event_id", JUDGED_TEXTS)
    score = F.when(F.col("event_id") % 5 < 4, F.col("event_id") % 5)
    return _t(spark, sf, "events").select("event_id", V.verdict(text, three=False).alias("of_two"), V.verdict(text).alias("of_three"), V.verdict(text, score=score).alias("with_score"))


def pairwise_winner(spark, sf):
    """The judge's winner by side or by name, else the one with the higher score."""
    e = _t(spark, sf, "events").select("event_id", _case("event_id", WINNER_TEXTS).alias("said"))
    e = e.select("event_id", report.stated_winner("said").alias("stated"), report.resolved_winner("said", V.judge_order("event_id")).alias("judge"))
    return e.select("event_id", "stated", "judge", report.pair_winner(F.col("judge"), F.col("event_id") % 5, F.col("event_id") % 3, "hypergraph", "llm_only").alias("winner"))


JUDGE_ANSWERS = [
    '{"answer_a": {"judgment": "正确", "score": 3, "reason": " good "}, "answer_b": {"judgment": "错误"}, "better": "A"}',
    '{"answers": [{"id": "A", "llm_acc": "错误"}, {"label": "回答B", "score": "2"}], "winner": "回答B"}',
    '{"judgment_a": "正确", "b_judgment": "错误", "scoreA": 1, "prefer": "tie"}',
    '```json\n{"A": {"score": 0}, "B": {"judgment": "部分正确"}, "comparison": {"better": "B"}}\n```',
    'Here: {"answers": {"A": {"score": 1}, "B": {"score": 9, "dimension_scores": [{"name": "d1", "score": "3"}, {"dimension": " ", "score": 1}, 5]}}} done',
    "no json at all",
    '{"A": {"judgment": "?"}, "comparison": "甲"}',
    '{"超图": {"judgment": "正确"}, "baseline": {"judgment": "错误", "score": 1}}',
]


def judge_answers(spark, sf):
    """Both sides' verdicts and the winner, from judges' answers of many shapes."""
    said = _t(spark, sf, "events").select("event_id", _case("event_id", JUDGE_ANSWERS).alias("answer"))
    e = J.judged_pairs(said, "answer", ["event_id"], dimensions=F.array(F.lit("x"), F.lit("y")))
    dims = lambda c: F.array_join(F.transform(c["dimension_scores"], lambda d: F.concat_ws("=", d["dimension"], d["score"].cast("string"))), ",")
    return e.select("event_id", *[F.col(f"{s}.llm_acc").alias(f"{s}_verdict") for s in "ab"], *[F.col(f"{s}.score").cast("long").alias(f"{s}_score") for s in "ab"], F.col("a.judge_reason").alias("a_reason"), dims(F.col("b")).alias("b_dimensions"), F.col("llm_only.llm_acc").alias("named_verdict"), report.stated_winner("better").alias("better"))


PLANS = [
    '{"steps": [{"id": "s1", "question": "one?"}, {"question": " two? ", "depends_on": ["s1", " "]}, {"id": 0, "query": "three?", "deps": ["s1", 2]}]}',
    'Plan:\n{"steps": [], "plan": [{"id": 7, "question": "seven"}, {"question": ""}, "no step"]}',
    '```\n{"plan": [{"query": "only"}]}\n```',
    '[{"question": "in a list"}]',
    "no plan",
    '{"steps": {"question": "not a list"}}',
]


def plan_parse(spark, sf):
    rows = _t(spark, sf, "events").select("event_id", F.posexplode(J.parse_plan(_case("event_id", PLANS))).alias("place", "s"))
    return rows.select("event_id", F.col("place").cast("long").alias("place"), F.col("s.id").alias("id"), F.col("s.question").alias("question"), F.array_join("s.depends_on", ",").alias("deps"))


# stages


def _stage_docs(spark, sf):
    return _docs(spark, sf).select("id", "name", "content", _case("id", ["new", "summary", "chunk", "new", "build"]).alias("status"))


def _hyperedges(spark, sf):
    """Two of three documents have a hyperedge, some of them two; every other one is bound to a chunk."""
    d = _docs(spark, sf).filter("id % 3 <> 2")
    one = d.select((F.col("id") * 2).alias("id"), F.col("id").alias("doc_id"), F.when(F.col("id") % 2 == 0, F.col("id")).alias("chunk_id"), F.lit("head").alias("name"), F.concat(F.lit("old "), "hash").alias("content"))
    return one.unionByName(one.filter("doc_id % 9 = 0").withColumns({"id": F.col("id") + 1, "chunk_id": F.lit(None).cast("long")}))


def _stage_chunks(spark, sf):
    extra = _case("doc_id", ['{"is_head": true}', '{"role": " HEAD "}', '{"chunk_index": 0}', '{"is_head": 0, "chunk_index": 1}', "broken", None, '{"is_head": "false", "role": "body"}'])
    d = _t(spark, sf, "documents")
    return d.select(F.col("doc_id").alias("id"), F.floor(F.col("doc_id") / 4).alias("doc_id"), _case("doc_id", [" Head", "body_1", "body_2", None, "body_3"]).alias("name"), F.col("text").alias("content"), extra.alias("extra"), _case("doc_id", ["new", "extract", "build"]).alias("status"))


def stage_pending(spark, sf):
    """How many rows each stage has still to do, and with everything asked for."""
    docs, chunks, edges = _stage_docs(spark, sf), _stage_chunks(spark, sf), _hyperedges(spark, sf)
    parts = {
        "summary": stages.pending(docs, "summary"), "chunk": stages.pending_chunking(docs, edges), "chunk all": stages.pending_chunking(docs, edges, everything=True), "extract": stages.pending(chunks, "extract"),
        "extract all": stages.pending(chunks, "extract", everything=True), "build": stages.pending(chunks, "build"),
    }
    out = None
    for name, rows in parts.items():
        part = rows.agg(F.lit(name).alias("stage"), F.count("*").alias("n"), F.sum("id").alias("ids"))
        out = part if out is None else out.unionByName(part)
    return out


def stage_clear(spark, sf):
    """Statuses after each stage is undone."""
    docs, chunks, edges = _stage_docs(spark, sf), _stage_chunks(spark, sf), _hyperedges(spark, sf)
    cleared = {"chunk": stages.clear_chunks(docs, edges), "summary": stages.clear_summaries(docs), "extract": stages.clear_extracts(chunks).filter("extra IS NULL"), "build": stages.clear_build(chunks)}
    out = None
    for name, rows in cleared.items():
        part = rows.groupBy("status").agg(F.count("*").alias("n"), F.sum("id").alias("ids")).withColumn("stage", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


def stage_summary(spark, sf):
    """New documents are summarised by a model (here: their first line) into a hyperedge, or into the one they have."""
    docs, edges, _ = stages.summarise(_stage_docs(spark, sf), _hyperedges(spark, sf), models.stub_model)
    per = edges.groupBy("doc_id").agg(F.count("*").alias("n"), F.min("id").alias("id"), F.min(F.md5("content")).alias("least_md5")).withColumnRenamed("doc_id", "of")
    return docs.withColumnRenamed("id", "doc_id").join(per, F.col("doc_id") == F.col("of"), "left").select("doc_id", "status", "n", "id", "least_md5")


def head_chunks(spark, sf):
    """Heads as retrieval and export tell them, and as building does."""
    chunks = _stage_chunks(spark, sf)
    bound = stages.with_head_flag(chunks, _hyperedges(spark, sf)).select("id", F.col("head").alias("bound"))
    return bound.join(stages.with_head_flag(chunks).select("id", F.col("head").alias("built")), "id")


def summary_order(spark, sf):
    """Slices in the order in which their summaries build on each other."""
    w = Window.partitionBy(X.family_base("name")).orderBy(*stages.summary_order()[1:])
    return _slices(spark, sf).select(F.col("id").alias("doc_id"), F.row_number().over(w).cast("long").alias("turn"))


# tables


def load_documents(spark, sf):
    d = _t(spark, sf, "documents").select(F.col("doc_id").alias("id"), _case("doc_id", ["a", " ", None]).alias("name"), F.when(F.col("doc_id") % 4 == 0, " \n ").when(F.col("doc_id") % 4 == 1, None).otherwise(F.col("text")).alias("content"))
    return tables.documents(d).select(F.col("id").alias("doc_id"), "name", F.md5("content").alias("md5"))


def resolve_ids(spark, sf):
    return tables.resolve_ids(_docs(spark, sf), [5, 3, 5], ["doc_9.pdf", "doc_3.pdf", "doc_0.pdf"]).select("doc_id", F.col("place").cast("long").alias("place"))


def sub_graph_export(spark, sf):
    docs = _docs(spark, sf).filter("id % 4 = 0").select(F.floor(F.col("id") / 4).alias("id"), "name", "content")
    nodes = _t(spark, sf, "conversations").select((F.col("conv_id") * 100 + F.col("turn")).alias("id"), F.col("conv_id").alias("doc_id"), F.col("role").alias("name"), F.col("text").alias("content"))
    g = tables.sub_graphs(docs, _hyperedges(spark, sf), _chunks(spark, sf), nodes)
    names = lambda c: F.array_join(F.transform(c, lambda x: x["name"]), ",")
    return g.select("doc_id", F.md5("doc.content").alias("doc_md5"), F.size("hyperedges").cast("long").alias("n_hyperedges"), names("chunks").alias("chunk_names"), names("nodes").alias("node_names"), F.md5(F.array_join(F.transform("chunks", lambda x: x["content"]), "\n")).alias("chunk_md5"))


def stats_sheet(spark, sf):
    """A statistics sheet for each language: its title, a table under a general header, its total, and a table that names itself."""
    per = _t(spark, sf, "documents").groupBy(F.col("lang").alias("sheet"), "source").agg(F.count("*").alias("n"))
    at = F.row_number().over(Window.partitionBy("sheet").orderBy("source"))
    items = per.select("sheet", (at + 3).alias("row"), F.concat(F.lit(" "), "source", F.lit(" ")).alias("a"), F.col("n").cast("double").cast("string").alias("b"), F.lit(None).cast("string").alias("c"))
    fixed = [(0, "A title of more than eight letters", None, None), (1, "按来源分布", None, None), (2, "类别", "数量", "占比"), (900, "总问题数", "1,177", None), (901, "", " ", None), (902, "难度", "count", "%"), (903, "hard", "3", "75%"), (904, "easy", "1.0", "0.25"), (905, "not an item", "many", None), (906, "after it", "5", None)]
    heads = spark.createDataFrame(fixed, "row int, a string, b string, c string")
    sheet = items.unionByName(per.select("sheet").distinct().crossJoin(F.broadcast(heads)))
    return tables.distributions(sheet)


def design_sheet(spark, sf):
    c = _t(spark, sf, "conversations").select(F.col("turn").alias("row"), F.concat(F.lit(" "), "role").alias("a"), F.col("conv_id").cast("double").alias("b"), "conv_id")
    per = tables.design_entries(c.select((F.col("row") * 100000 + F.col("conv_id")).alias("row"), "a", "b"))
    return per


def cache_deletes(spark, sf):
    c = _t(spark, sf, "pages").select(F.col("page_id").cast("string").alias("key"), F.concat(F.lit('{"name": "p'), (F.col("page_id") % 10).cast("string"), F.lit('.pdf", "n": 1}')).alias("input"))
    names = spark.createDataFrame([("p3.pdf",), ("p3.pdf",), ("q",)], "name string")
    return tables.drop_cached(c, names, c.filter("key % 7 = 0").select("key")).select(F.col("key").cast("long").alias("page_id"))


# counters


def throughput(spark, sf):
    e = _t(spark, sf, "events").select("event_type", F.unix_timestamp("ts").alias("at"), F.col("event_id").cast("double").alias("tokens"), F.col("user_id").cast("double").alias("running"))
    first = e.groupBy("event_type", "at").agg(F.max("tokens").alias("tokens"), F.max("running").alias("running"))
    out = tables.throughput(first, ["event_type"], "at", ["tokens"], ["running"])
    return out.select("event_type", "dt", "tokens_d", F.round("tokens_ps", 6).alias("tokens_ps"), "running_avg")


def counters_by_label(spark, sf):
    line = F.concat(F.lit("requests_total"), F.when(F.col("event_id") % 3 == 0, "").otherwise(F.concat(F.lit('{model="m",finished_reason="'), "event_type", F.lit('"}'))), F.lit(" "), F.col("event_id").cast("string"), F.lit(".0"))
    m = metrics.exposition(_t(spark, sf, "events").select(line.alias("value")))
    return tables.counter_by_label(m, "requests_total", "finished_reason")


def sum_and_count(spark, sf):
    e = _t(spark, sf, "events").groupBy("event_type").agg(F.round(F.sum("value"), 2).alias("s"), F.count("*").alias("c"))
    lines = e.select("event_type", F.inline(F.array(F.struct(F.lit("latency_sum").alias("name"), F.col("s").alias("value")), F.struct(F.lit("latency_count").alias("name"), F.when(F.col("event_type") != "error", F.col("c")).otherwise(0).cast("double").alias("value")))))
    return tables.sum_and_count(lines, ["event_type"], "latency").select("event_type", F.round("sum", 2).alias("sum"), "count", F.round("mean", 4).alias("mean"))


# evaluation files


def _results(spark, sf):
    """Evaluation results of two systems; older rows have the first one's fields at the top."""
    d, labels = _t(spark, sf, "documents"), _t(spark, sf, "labels").withColumnRenamed("doc_id", "l_id")
    j = d.join(labels, d.doc_id == F.col("l_id"), "left")
    n = F.col("doc_id")

    def block(shift: int, verdict: str):
        return [
            F.when((n + shift) % 6 != 0, F.concat(F.lit(" a"), n.cast("string"), F.lit(" "))).otherwise("").alias("answer"), F.when((n + shift) % 4 != 0, F.concat(F.lit("raw"), n.cast("string"))).alias("raw_answer"),
            ((n + shift) % 11 != 0).cast("long").alias("query_status"), F.when((n + shift) % 13 == 0, "timeout").alias("query_error"), _verdict(verdict).alias("llm_acc"), ((n + shift) % 4).alias("score"), F.lit("r").alias("judge_reason"),
            F.lit(1).cast("long").alias("judge_status"), F.when((n + shift) % 17 == 0, "bad").alias("judge_error"), F.when((n + shift) % 5 == 0, 0.5).alias("query_latency_s"),
        ]

    return j.select("doc_id", F.when(n % 19 != 0, F.col("text")).alias("question"), "lang", "source", F.when(n % 3 != 0, F.struct(*block(0, "quality"))).alias("hypergraph"), F.when(n % 7 != 0, F.struct(*block(1, "toxic"))).alias("llm_only"), *block(2, "toxic"))


def system_rows(spark, sf):
    r = report.system_rows(_results(spark, sf), ["hypergraph", "llm_only"], ["doc_id"], legacy="hypergraph")
    return r.select("doc_id", "system", "answer", "query_status", "query_error", "llm_acc", "score")


def detail_rows(spark, sf):
    return report.detail_rows(_results(spark, sf), "hypergraph", "llm_only", ["doc_id"])


def item_failures(spark, sf):
    hg, lo = F.col("hypergraph"), F.col("llm_only")
    return _results(spark, sf).select("doc_id", report.item_failed(F.col("question"), hg, lo).alias("failed"), report.item_failed(F.col("question"), hg).alias("first_failed"), report.attempted(hg).alias("attempted"), report.judging_mode(hg, lo).alias("mode"))


def report_summary(spark, sf):
    rows = report.system_rows(_results(spark, sf), ["hypergraph", "llm_only"], ["doc_id", "lang", "source"], legacy="hypergraph")
    return report.summary_report(rows, ["lang", "source"]).withColumns({"accuracy": F.round("accuracy", 4), "score_mean": F.round("score_mean", 4)})


def question_tasks(spark, sf):
    tasks = evaluation.question_tasks(spark, {1: 3, 2: 2, 3: 4})
    return evaluation.sample_for_tasks(tasks, _t(spark, sf, "documents").select("doc_id"), "doc_id", 44).select("task", F.col("place").cast("long").alias("place"), "doc_id")


def sample_padded(spark, sf):
    tasks = spark.createDataFrame([("all", 60), ("few", 3)], "task string, n int")
    return evaluation.sample_for_tasks(tasks, _t(spark, sf, "nation").filter("n_regionkey = 1").select("n_nationkey"), "n_nationkey", 44).select("task", F.col("place").cast("long").alias("place"), "n_nationkey")


# reports


def eval_failures(spark, sf):
    e = _t(spark, sf, "events").select("event_id", F.when(F.col("event_type") == "error", F.lit("timeout")).alias("error"), (F.col("event_id") % 11).alias("status"), (F.col("event_id") % 13).alias("judge"), F.col("props").alias("question"))
    return e.filter(report.failed("error", "status", "judge", "question")).select("event_id")


def eval_remaining(spark, sf):
    done = _t(spark, sf, "labels").filter("toxic = 0")
    return report.remaining(_t(spark, sf, "documents").select("doc_id", "lang"), done, "doc_id")


def latency_long(spark, sf):
    rows = _t(spark, sf, "events").select("event_type", "value", F.get_json_object("props", "$.k").try_cast("double").alias("tokens"))
    return report.long_metrics(rows, ["event_type"], ["value", "tokens"]).select("event_type", "metric", "n", F.round("mean", 4).alias("mean"), F.round("total", 4).alias("total"))


def metric_table(spark, sf):
    rows = _scored(spark, sf)
    out = report.metric_table(rows, "event_type", "click", "view", {"questions": F.count("*"), "score": F.avg("score"), "best": F.max("score")})
    return out.select("metric", *[F.round(c, 4).alias(c) for c in ("a", "b", "delta")])


def dimension_counts(spark, sf):
    rows = _t(spark, sf, "documents").select(F.concat_ws("；", "lang", "source", F.lit(" "), F.concat(F.lit(" hop"), (F.col("doc_id") % 3).cast("string"))).alias("dimensions"))
    return report.dimension_counts(rows, "dimensions")


def sample_docs(spark, sf):
    return evaluation.sample_rows(_t(spark, sf, "documents").select("doc_id", "lang"), "doc_id", 20, 44)


def metric_lines(spark, sf):
    line = F.when(F.col("event_id") % 10 == 0, F.concat(F.lit("# HELP "), "event_type")).when(F.col("event_id") % 10 == 1, F.concat("event_type", F.lit(" n/a"))).otherwise(F.concat("event_type", F.lit('{user="'), F.col("user_id").cast("string"), F.lit('"} '), (F.col("event_id") % 100).cast("string")))
    m = metrics.exposition(_t(spark, sf, "events").select(line.alias("value")))
    return m.groupBy("name").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def error_kinds(spark, sf):
    return _t(spark, sf, "pages").select(X.error_kind(F.concat(F.lit("failed  after 12 s at 0xAB12: "), "url")).alias("kind")).groupBy("kind").agg(F.count("*").alias("n"))


def context_text(spark, sf):
    c = _chunks(spark, sf).select(F.col("id").alias("chunk_id"), "content", F.concat(F.lit("doc_"), F.col("doc_id").cast("string"), F.lit(".pdf")).alias("source"))
    rows = retrieval.materials(_union(spark, sf), _chunks(spark, sf), by=("query_id",)).filter("material_id <= 4").join(c, "chunk_id")
    return retrieval.context_text(rows, ("query_id",)).select("query_id", F.col("material_id").cast("long").alias("material_id"), F.md5("text").alias("text_md5"))


def _told(texts):
    """Stands in for a model: a thought, and a digest of all that it was asked."""
    return [f"Thought: {len(t)} characters\nAnswer: {hashlib.md5(t.encode()).hexdigest()}" for t in texts]


def answered_questions(spark, sf):
    """Every question with what is retrieved for it put to a model, and its answer read."""
    c = _chunks(spark, sf).select(F.col("id").alias("chunk_id"), "content", F.concat(F.lit("doc_"), F.col("doc_id").cast("string"), F.lit(".pdf")).alias("source"))
    rows = written(retrieval.materials(_union(spark, sf), _chunks(spark, sf), by=("query_id",)).filter("material_id <= 4"), "materials").join(c, "chunk_id")
    asked = _t(spark, sf, "embeddings").filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.concat(F.lit("question "), F.col("vec_id").cast("string")).alias("query"))
    a = answering.answer_questions(rows, asked, _told)
    return a.select("query_id", "thought", "answer", F.col("status").cast("long").alias("status"), F.array_join("sources", ",").alias("sources"), F.array_join("doc_ids", ",").alias("doc_ids"))


def _lengths(prompts):
    """Stands in for a reranker: shorter documents are better; some can't be read."""
    if any('"query":"question 2' in p for p in prompts):
        raise RuntimeError("unreadable")
    return [1 / (1 + len(json.loads(p)["document"])) for p in prompts]


def reranked_by_model(spark, sf):
    """The best documents of each question by a model's relevance; questions whose calls fail keep their order."""
    hits = _union(spark, sf).join(_chunks(spark, sf).select(F.col("id").alias("chunk_id"), "doc_id", "content"), "chunk_id")
    hits = written(hits, "hit-texts")
    docs = hits.groupBy("query_id", "doc_id").agg(F.max("score").alias("material_score"))
    texts = hits.groupBy("query_id", "doc_id").agg(F.sort_array(F.collect_list(F.struct("chunk_id", "content"))).alias("c")).select("query_id", "doc_id", F.array_join(F.transform("c", lambda x: F.substring(x["content"], 1, 200)), "\n").alias("text"))
    asked = docs.select("query_id").distinct().withColumn("query", F.concat(F.lit("question "), F.col("query_id").cast("string")))
    best = answering.reranked(docs, texts, asked, _lengths, 4)
    return best.select("query_id", F.col("material_id").cast("long").alias("material_id"), "doc_id", "fallback")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    names = """doc_insert_dedup doc_name_antijoin search_eq count_by keyset_page in_list_semi partial_update_last_wins cascade_delete family_base family_closure slice_plan
    object_key download_plan file_dedup_pref sentence_split join_units chunk_pack head_body_order prior_slices entity_longest entity_degree llm_json_entities llm_json_sum
    vector_topk_l2 vector_topk_ivf vector_topk_all_cells vector_topk_half vector_topk_bytes keyword_index_hits keyword_containing vector_similarity vector_topk_tombstoned vector_dedupe_hits vector_compact deleted_stats node_hits_to_chunk keyword_match merge_hits union_hits build_materials
    build_materials_full_body rerank_fallback plan_normalize ready_steps sources_distinct usage_sum doc_recall verdict_summary verdict_by_hop recall_vs_accuracy system_comparison crosstab
    group_metrics score_hist category_coverage category_distribution category_compare_outer pairwise_order normalize_score normalize_judgment stage_metrics model_cache_join retrieve
    keyword_hits keyword_path rerank_by_question rerank_parse ratio_parse judge_answers plan_parse stage_pending stage_clear stage_summary head_chunks summary_order
    load_documents resolve_ids sub_graph_export stats_sheet design_sheet cache_deletes throughput counters_by_label sum_and_count system_rows detail_rows item_failures report_summary
    question_tasks sample_padded eval_failures eval_remaining latency_long metric_table dimension_counts pairwise_winner sample_docs metric_lines error_kinds context_text answered_questions
    reranked_by_model"""
    return {n: globals()[n] for n in names.split()} | runs.queries()
