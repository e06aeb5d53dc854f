import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from weftline.operators import agent, chunking, models, retrieval, stages, store, vectors
from weftline.sources import remote, tables
from weftline.streaming import ingest


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("ab .é", min_size=1, max_size=40), max_size=12), st.integers(4, 30), st.sampled_from([0, 0.1, 0.3, 20]))
def test_chunks_hold_every_unit_within_the_limit(units, most, ratio):
    out = chunking.pack(units, most, ratio)
    assert all(chunking.count_tokens(c) <= most + 1 for c in out)  # joining may put two tokens beside each other, never split one
    letters = set("".join(units)) - {" "}
    assert letters <= set("".join(out)) | {" "}


def test_chunk_overlap_is_whole_units():
    units = [f"s{i} is here." for i in range(12)]
    first, second = chunking.pack(units, 20, 0.25)[:2]
    assert second.startswith(units[4]) and units[4] in first


def test_insert_ignore_and_null_keys(spark):
    old = spark.createDataFrame([("a", 1)], "h string, id int")
    new = spark.createDataFrame([("a", 2), ("b", 4), ("b", 3), (None, 5), (None, 6)], "h string, id int")
    assert sorted(r.id for r in store.insert_ignore(old, new, ["h"], ["id"]).collect()) == [3, 5, 6]


def test_update_keeps_rows_without_changes(spark):
    t = spark.createDataFrame([(1, "x"), (2, "y")], "id int, v string")
    c = spark.createDataFrame([(1, 1, "p"), (1, 2, None), (None, 3, "q")], "id int, o int, v string")
    assert {r.id: r.v for r in store.update_last_wins(t, c, "id", "o", ["v"]).collect()} == {1: None, 2: "y"}


def test_top_k_equals_brute_force_and_blocks_agree(spark, monkeypatch):
    rows = [(i, [float((i * 7) % 11), float((i * 5) % 13)]) for i in range(60)]
    v = spark.createDataFrame(rows, "id long, embedding array<float>")
    q = spark.createDataFrame([(k, rows[k][1]) for k in range(7)], "query_id long, query array<float>")
    want = {k: [i for _, i in sorted((sum((a - b) ** 2 for a, b in zip(e, rows[k][1])), i) for i, e in rows)][:5] for k in range(7)}

    def got():
        out = {}
        for r in sorted(vectors.top_k(v, q, 5).collect(), key=lambda r: (r.query_id, r["rank"])):
            out.setdefault(r.query_id, []).append(r.id)
        return out

    assert got() == want
    monkeypatch.setattr(vectors, "QUERY_BLOCK", 2)
    assert got() == want
    assert vectors.top_k(v, q, 0).count() == 0


def test_compact_leaves_the_live_ids(spark):
    v = spark.createDataFrame([(i, [0.0]) for i in range(10)], "id long, embedding array<float>")
    live = spark.createDataFrame([(i,) for i in (1, 3, 3, 50)], "id long")
    assert sorted(r.id for r in vectors.compact(v, live).collect()) == [1, 3]


def test_union_loses_no_hit_and_orders_parts(spark):
    dual = spark.createDataFrame([(1, 0.5, "chunk+node"), (2, 0.9, "node")], "chunk_id long, score double, match_type string")
    key = spark.createDataFrame([(1, 11.0), (3, 1.0)], "chunk_id long, score double")
    got = {r.chunk_id: (r.score, r.match_type) for r in retrieval.union_hits(dual, key, ["chunk_id"]).collect()}
    assert got == {1: (11.0, "chunk+node+keyword"), 2: (0.9, "node"), 3: (1.0, "keyword")}


def test_plan_rules(spark):
    steps = [("p", 0, "a", "q0", ["b", "a", "x"]), ("p", 1, "b", "q1", None), ("p", 2, "b", "again", None), ("p", 3, None, "q3", ["b"]), ("p", 4, "d", "  ", None)]
    plan = agent.normalize_plan(spark.createDataFrame(steps, "plan_id string, ord int, id string, question string, depends_on array<string>"))
    assert {r.id: r.depends_on for r in plan.collect()} == {"a": ["b"], "b": [], "3": ["b"]}
    assert {r.id: r.level for r in agent.levels(plan).collect()} == {"b": 1, "a": 2, "3": 2}
    cycle = agent.normalize_plan(spark.createDataFrame([("p", 0, "a", "q", ["b"]), ("p", 1, "b", "q", ["a"])], "plan_id string, ord int, id string, question string, depends_on array<string>"))
    assert {r.level for r in agent.levels(cycle).collect()} == {1}


def test_answers_ask_once_and_only_what_is_missing(spark):
    p = spark.createDataFrame([("x",), ("x",), ("y",)], "prompt string")
    first = models.answers(p, models.stub_model)
    assert sorted((r.answer, r.cache_hit) for r in first.collect()) == [("x", False), ("x", False), ("y", False)]
    again = models.answers(p, models.stub_model, models.to_cache(first))
    assert all(r.cache_hit for r in again.collect())

    def broken(texts):
        raise ValueError("down")

    assert {r.status for r in models.answers(p, broken).collect()} == {0}


def test_remote_rows_use_the_columns_there_are(spark):
    t = spark.createDataFrame([(1, "h/a.pdf", 0, 1), (2, "h/b.pdf", 1, 1), (3, "h/c.pdf", 0, 2)], "id int, oss_url string, is_delete int, type int")
    assert [r.id for r in remote.product_rows(t, "tds").collect()] == [1]
    assert [r.oss_url for r in remote.product_rows(t.select("oss_url"), limit=2).collect()] == ["h/a.pdf", "h/b.pdf"]
    with pytest.raises(ValueError):
        remote.file_type("pdf")


def test_files_are_sniffed(spark, tmp_path):
    for name, data in (("a.pdf", b"%PDF-1.7"), ("b.pdf", b"PK\x03\x04"), ("c.pdf", b"<html>")):
        (tmp_path / name).write_bytes(data)
    got = {r.name: r.problem for r in remote.binary_files(spark, str(tmp_path)).collect()}
    assert got == {"a.pdf": "", "b.pdf": "ZIP", "c.pdf": "HTML"}


def test_stream_adds_each_content_once(spark, tmp_path):
    rows = spark.createDataFrame([("a", "x"), ("b", "x"), ("c", "y")], "name string, content string")
    rows.write.parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    for n in (1, 2):  # the second run has lost its checkpoint and sees every file again
        ingest.ingest_documents(stream(), str(tmp_path / "out"), str(tmp_path / f"check{n}"))().awaitTermination()
    assert sorted(r.name for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["a", "c"]


def test_stage_counts_by_window(spark, tmp_path):
    spark.sql("SELECT timestamp'2024-01-01 00:10:00' AS ts, 'a' AS stage, 1.5 AS seconds").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("ts timestamp, stage string, seconds decimal(2,1)").parquet(str(tmp_path / "in"))
    q = ingest.stage_counts(stream).writeStream.outputMode("complete").format("memory").queryName("counts").start()
    q.processAllAvailable()
    q.stop()
    assert [(r.stage, r.n) for r in spark.table("counts").collect()] == [("a", 1)]


def test_rerank_without_limit_leaves_all(spark):
    docs = spark.createDataFrame([(1, 0.5), (2, 0.7)], "doc_id long, material_score double")
    assert [(r.material_id, r.doc_id) for r in retrieval.rerank(docs, F.lit(1.0), 0).orderBy("material_id").collect()] == [(1, 2), (2, 1)]


def test_family_closure_follows_a_chain_of_any_length(spark):
    docs = spark.createDataFrame([(i, f"d{i}.pdf", f"d{i + 1}.pdf") for i in range(55)] + [(99, "other.pdf", None)], "id long, name string, source_name string")
    found = store.family_closure(docs, docs.filter("id = 0").select("name"))
    assert sorted(r.id for r in found.collect()) == list(range(55))


def test_stages_run_and_resume(spark):
    """Documents through summary, chunks, entities and nodes with stub models; what fails stays for the next run."""
    docs = spark.createDataFrame([(1, "a.pdf", "First line.\nMore of it.", "new"), (2, "b.pdf", "bad document", "new"), (3, "c.pdf", "Done before.", "chunk")], "id long, name string, content string, status string")
    edges = spark.createDataFrame([(7, 1, None, "head", "old"), (9, 3, None, "head", "kept")], "id long, doc_id long, chunk_id long, name string, content string")

    def model(texts):
        if any("bad" in t for t in texts):
            raise ValueError("bad")
        return [t.split("\n")[0] for t in texts]

    docs, edges, asked = stages.summarise(docs, edges, model)
    assert {(r.doc_id, r.status) for r in asked.collect()} == {(1, 1), (2, 0)}
    assert {(r.id, r.status) for r in docs.collect()} == {(1, "summary"), (2, "new"), (3, "chunk")}
    assert {(r.id, r.doc_id, r.content) for r in edges.collect()} == {(7, 1, "First line."), (9, 3, "kept")}
    docs, made = stages.chunk(docs, edges)
    assert {(r.doc_id, r.name) for r in made.collect()} == {(1, "head"), (1, "body_1")} and docs.filter("id = 1").first().status == "chunk"
    chunks = made.select(F.monotonically_increasing_id().alias("id"), "doc_id", "name", "content", F.lit(None).cast("string").alias("extra"), F.lit("new").alias("status"))
    chunks, _ = stages.extract(chunks, lambda texts: ['{"entities": {"x": "one", "y": "two"}}' if "More" in t else "no json" for t in texts])
    assert {(r.name, r.status) for r in chunks.collect()} == {("head", "new"), ("body_1", "extract")}
    chunks, found, links = stages.build(chunks, edges)
    assert {(r.name, r.content, r.hyperedge_id) for r in found.collect()} == {("x", "one", 7), ("y", "two", 7)} and links.count() == 2
    assert {(r.name, r.status) for r in chunks.collect()} == {("head", "new"), ("body_1", "build")}


def test_full_body_of_a_doc_with_a_head_only(spark):
    chunks = spark.createDataFrame([(1, 5, "head"), (2, 6, "head"), (3, 6, "body_1"), (4, 6, "body_2")], "id long, doc_id long, name string")
    hits = spark.createDataFrame([("q", 1, 0.5, "chunk"), ("q", 2, 0.9, "node"), ("r", 3, 0.1, "chunk")], "query_id string, chunk_id long, score double, match_type string")
    got = {(r.query_id, r.material_id, r.doc_id, r.chunk_id, r.match_type) for r in retrieval.materials(hits, chunks, True, ("query_id",)).collect()}
    assert got == {("q", 1, 6, 3, "full_body_expand"), ("q", 1, 6, 4, "full_body_expand"), ("q", 2, 5, 1, "chunk"), ("r", 1, 6, 3, "chunk"), ("r", 1, 6, 4, "full_body_expand")}


def test_resolving_unknown_names_raises(spark):
    docs = spark.createDataFrame([(1, "a"), (2, "b")], "id long, name string")
    assert [(r.doc_id, r.place) for r in tables.resolve_ids(docs, [2], ["a", "b"]).orderBy("place").collect()] == [(2, 1), (1, 2)]
    with pytest.raises(ValueError):
        tables.resolve_ids(docs, [], ["z"])
