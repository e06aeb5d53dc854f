"""Streams, model calls, rounds and slices: replays and crashes, and plain loops beside them."""

import math
import random

import pytest
from pyspark.sql import functions as F

from weftline.functions import text as X
from weftline.operators import agent, evaluation, layout, models, slices, stages
from weftline.plans import runs
from weftline.streaming import lifetime, vectorize

SF = "/root/testdata/sf0.001"


# model calls


def test_batches_keep_to_both_bounds():
    texts = ["a" * n for n in (3, 3, 3, 50, 1, 1, 1, 1, 1)]
    got = list(models.batches_of(texts, 3, 10))
    assert [texts[a:b] for a, b in got] == [texts[:3], texts[3:4], texts[4:7], texts[7:]]
    assert list(models.batches_of([], 3, 10)) == []


def test_one_bad_text_costs_two_calls_a_halving():
    calls = []

    def model(texts):
        calls.append(len(texts))
        if "bad" in texts:
            raise RuntimeError("no")
        return [t.upper() for t in texts]

    texts = ["x"] * 37 + ["bad"] + ["y"] * 26
    out = models.asked(model, texts)
    assert [r for r, _ in out] == [None if t == "bad" else t.upper() for t in texts]
    assert out[37][1] == "RuntimeError: no" and len(calls) <= 1 + 2 * math.ceil(math.log2(64))


def test_errors_of_the_code_end_the_job_and_short_answers_fail():
    with pytest.raises(TypeError):
        models.asked(lambda texts: [t + 1 for t in texts], ["a"])
    assert [r for r, _ in models.asked(lambda texts: texts[:1], ["a", "b"])] == ["a", "b"]  # two at once give one result, so each is asked alone


def test_embeddings_with_a_cache_for_each_text(spark):
    def model(texts):
        if any("bad" in t for t in texts):
            raise RuntimeError("down")
        return [[float(len(t)), 0.5] for t in texts]

    rows = spark.createDataFrame([(1, "aa"), (2, "bad"), (3, "aa"), (4, "cccc"), (5, None)], "id int, prompt string")
    first = models.answers(rows, model, result="array<float>", most=2)
    assert dict(first.dtypes)["answer"] == "array<float>"
    assert {r.id: (r.answer, r.status) for r in first.collect()} == {1: ([2.0, 0.5], 1), 2: (None, 0), 3: ([2.0, 0.5], 1), 4: ([4.0, 0.5], 1), 5: ([0.0, 0.5], 1)}
    again = models.answers(rows, model, models.to_cache(first), result="array<float>")
    assert {r.id: r.cache_hit for r in again.collect()} == {1: True, 2: False, 3: True, 4: True, 5: True}


# vectorise stage


def rows_of(spark, ids):
    return spark.createDataFrame([(i, f"text {i}", "" if i % 10 == 0 else None) for i in ids], "id long, content string, embedding_content string")


def test_a_run_that_stops_between_the_two_writes_loses_and_doubles_nothing(spark, tmp_path, monkeypatch):
    path, source, check = (f"file://{tmp_path}/{n}" for n in ("out", "in", "check"))
    rows_of(spark, range(1, 40)).repartition(3).write.parquet(source)
    stream = lambda: spark.readStream.schema("id long, content string, embedding_content string").option("maxFilesPerTrigger", 1).parquet(source)
    start = lambda: vectorize.vectorize(stream(), path, check, models.stub_embedding, "s")()
    plain, stopped = vectorize.mark_done, []

    def stop(rows, at):
        if len(stopped) == 0 and at == path:
            stopped.append(1)
            raise RuntimeError("stopped")
        plain(rows, at)

    monkeypatch.setattr(vectorize, "mark_done", stop)
    with pytest.raises(Exception, match="stopped"):
        start().awaitTermination()
    assert spark.read.parquet(f"{path}/vectors").count() > 0 and vectorize.vectors_of(spark, path).count() == 0
    start().awaitTermination()
    start().awaitTermination()  # nothing new
    want = {i: models.stub_embedding([f"text {i}"])[0] for i in range(1, 40) if i % 10}
    got = vectorize.vectors_of(spark, path).collect()
    assert len(got) == len(want) and all(r.embedding == pytest.approx(want[r.id]) for r in got)
    assert {r.id for r in vectorize.undone(rows_of(spark, range(1, 40)), path).collect()} == {10, 20, 30}
    rows_of(spark, [5, 5, 77, 78]).write.mode("append").parquet(source)  # one that is done, twice, and new ones
    start().awaitTermination()
    assert sorted(r.id for r in vectorize.vectors_of(spark, path).collect()) == sorted([*want, 77, 78])


def test_failed_calls_stay_undone_until_a_later_batch(spark, tmp_path):
    path = f"file://{tmp_path}/out"

    def moody(texts):
        if any("7" in t for t in texts):
            raise RuntimeError("down")
        return models.stub_embedding(texts)

    rows = rows_of(spark, range(1, 20))
    vectorize.vectorize_rest(rows, path, moody, "first")
    assert {r.id for r in vectorize.undone(rows, path).collect()} == {7, 10, 17}
    vectorize.vectorize_rest(rows, path, models.stub_embedding, "second")
    assert {r.id: r.embedding_status for r in vectorize.with_status(rows, path).collect()} == {i: "undone" if i == 10 else "done" for i in range(1, 20)}


# lifetime totals


def test_replayed_sessions_change_nothing(spark, tmp_path):
    path, source, check = (f"file://{tmp_path}/{n}" for n in ("out", "in", "check"))
    sessions = spark.createDataFrame([("a", "1", 1, 2, 0, 10, 0.5), ("a", "2", 1, 0, 0, None, 0.25), ("b", "1", 3, 0, 1, 7, None), ("b", None, 1, 1, 1, 1, 1.0)], lifetime.SESSION)
    sessions.limit(2).write.parquet(source)
    start = lambda: lifetime.keep_lifetime(spark.readStream.schema(lifetime.SESSION).parquet(source), path, check)().awaitTermination()
    start()
    assert {r.stage: (r.sessions, r.tokens) for r in lifetime.read_lifetime(spark, path).collect()} == {"a": (2, 10)}
    sessions.write.mode("append").parquet(source)
    start()
    sessions.filter("stage = 'b'").write.mode("append").parquet(source)
    start()
    want = sorted(map(tuple, lifetime.lifetime_of(sessions).collect()))
    assert sorted(map(tuple, lifetime.read_lifetime(spark, path).collect())) == want == [("a", 2, 2, 2, 0, 10, 0.75), ("b", 2, 4, 1, 2, 8, 1.0)]


# rounds of plans


def plain_run(plan, query, model):
    """plan: (id, kind, question, depends_on) in order."""
    results, rounds = {}, 0
    while len(results) < len(plan):
        rounds += 1
        waiting = [s for s in plan if s[0] not in results]
        ready = [s for s in waiting if all(d in results for d in s[3])] or waiting
        fresh = {}
        for i, kind, question, needs in ready:
            if kind == "llm":
                asked = query
            elif needs:
                prior = "\n\n".join(f"[步骤 {d}] 问：{results[d][0].strip()}\n答：{results[d][1].strip()}" for d in needs if d in results) or "（无）"
                said = model([f"{query}\n{prior}\n{question.strip()}"])[0].strip().split("\n")[0].strip()
                asked = said or f"{question.strip()}\n（已知：{prior[:500]}）"
            else:
                asked = question.strip()
            fresh[i] = (asked, model([asked])[0], rounds)
        results |= fresh
    return results


def test_rounds_equal_a_plain_loop(spark):
    plans, queries = runs.conversation_plans(spark, SF)
    steps, asked = {}, {r.plan_id: r["query"] for r in queries.collect()}
    for r in sorted(plans.collect(), key=lambda r: (r.plan_id, r.position)):
        steps.setdefault(r.plan_id, []).append((r.id, r.kind, r.question, r.depends_on))
    got = {(r.plan_id, r.id): (r.question, r.answer, r["round"]) for r in agent.run_plans(plans, queries, runs._digest, runs._digest).collect()}
    want = {(p, i): x for p, plan in steps.items() for i, x in plain_run(plan, asked[p], runs._digest).items()}
    assert got == want and max(x[2] for x in want.values()) >= 4


def test_failed_steps_and_what_the_last_model_is_asked(spark):
    plan = spark.createDataFrame([(1, 1, "a", "first?", [], "retrieve"), (1, 2, "b", "second?", ["a"], "retrieve"), (1, 3, "llm", "q", [], "llm")], "plan_id long, position int, id string, question string, depends_on array<string>, kind string")
    queries = spark.createDataFrame([(1, "whole?"), (2, None)], "plan_id long, query string")

    def broken(texts):
        raise RuntimeError("down")

    done = agent.run_plans(plan, queries, models.stub_model, broken)
    rows = {r.id: r for r in done.collect()}
    assert rows["b"].question == "second?\n（已知：[步骤 a] 问：first?\n答：first?）" and rows["b"].answer == "second?" and rows["llm"].question == "whole?"
    said = {r.plan_id: r.prompt for r in agent.synthesis_prompts(plan, done, queries).collect()}
    assert said[1] == "whole?\n### 步骤 a\n问：first?\n答：first?\n来源：（无）\n\n### 步骤 b\n问：second?\n（已知：[步骤 a] 问：first?\n答：first?）\n答：second?\n来源：（无）\nwhole?"
    assert said[2] == "\n（无检索子步骤结论）\n（无纯 LLM 回答）"
    assert agent.run_plans(plan.limit(0), queries, models.stub_model, broken).count() == 0


# slices


def test_prior_text_of_slices(spark):
    rows = [
        (1, "x.pdf", " one ", '{"slice_index": 0, "n_slices": 3, "source_name": "x.pdf", "page_start": 0, "page_end": 12}'), (2, "x.pdf_1", None, None), (3, "x.pdf_2", "three", '{"slice_index": 2, "n_slices": 3, "source_name": "x.pdf"}'),
        (4, "x.pdf_3", "four", None), (5, "y", "alone", "broken"), (6, "x.pdf", "a later copy", None), (7, "z.PDF_4", "orphan", "{}"), (8, None, None, None),
    ]
    docs = spark.createDataFrame(rows, "id long, name string, content string, extra string")
    got = {r.id: r for r in slices.summary_prompts(docs, "sum: {content}", "{slice_pos} of {n_slices}\n{prior_content}\nnow: {content}").collect()}
    assert {i: (r.source_name, r.slice_index, r.n_slices) for i, r in got.items()} == {1: ("x.pdf", 0, 3), 2: ("x.pdf", 1, 2), 3: ("x.pdf", 2, 3), 4: ("x.pdf", 3, 4), 5: ("y", 0, 1), 6: ("x.pdf", 0, 1), 7: ("z.PDF", 4, 5), 8: ("", 0, 1)}
    one = "【前文第 1 段 / x.pdf，源页约 1-12】\none"
    assert got[2].prior == one and got[3].prior == one and got[4].prior == f"{one}\n\n【前文第 3 段 / x.pdf_2】\nthree"
    assert got[3].prompt == f"3/3 of 3\n{one}\nnow: three" and got[7].prompt == "sum: orphan" and not got[7].continued and got[1].prompt == "sum:  one "


def test_wavefront_sees_the_answers_before(spark):
    rows = spark.createDataFrame([("a", 1, "x"), ("a", 2, "fail"), ("a", 3, "z"), ("b", 5, "p"), ("b", 9, "q")], "fam string, i int, content string")

    def model(texts):
        if any(t.endswith("fail") for t in texts):
            raise RuntimeError("down")
        return [f"<{t.replace(chr(10), '/')}>" for t in texts]

    got = {(r.fam, r.i): (r.turn, r.prior, r.answer) for r in slices.wavefront(rows, "fam", "i", model).collect()}
    assert got[("a", 1)] == (1, "", "</x>") and got[("a", 2)] == (2, "</x>", None) and got[("a", 3)] == (3, "</x>", "<</x>/z>") and got[("b", 9)] == (2, "</p>", "<</p>/q>")
    cut = {(r.fam, r.i): r.prior for r in slices.wavefront(rows, "fam", "i", model, keep=3).collect()}
    assert cut[("a", 3)] == "/x>"
    assert slices.wavefront(rows.limit(0), "fam", "i", model).count() == 0


# building


def test_build_merges_enriches_and_waits_for_hyperedges(spark):
    extract = lambda *items: '{"chunk_index": %d, "extract": "%s"}' % (items[0], items[1].replace('"', '\\"'))
    chunks = spark.createDataFrame(
        [
            (10, 1, "body_1", extract(1, '[{"entities": {"x": "one", "y": ""}}, {"entities": {"x": "longer", "z": "zed"}}, {"entities": {"x": "equals"}}]'), "extract"),
            (11, 1, "head", extract(0, '{"entities": {"h": "head one", "x": "in head"}}'), "extract"),
            (12, 2, "body_1", extract(1, '{"entities": {"x": "no hyperedge"}}'), "extract"),
            (13, 3, "body_2", extract(2, '{"entities": {"p": "two"}}'), "extract"), (14, 3, "body_1", extract(1, '{"entities": {"q": "one"}}'), "extract"), (15, 1, "body_2", None, "new"),
        ],
        "id long, doc_id long, name string, extra string, status string",
    )
    edges = spark.createDataFrame([(7, 1, None, "head", '{"source": "mine", "kept": {"deep": 1}, "role": "old"}'), (6, 1, 99, "head", None), (8, 3, None, "head", "broken"), (9, 4, 5, "head", None)], "id long, doc_id long, chunk_id long, name string, extra string")
    after, nodes, links = stages.build(chunks, edges)
    assert {(r.chunk_id, r.name, r.content, r.hyperedge_id) for r in nodes.collect()} == {(10, "x", "longer", 6), (10, "z", "zed", 6), (11, "h", "head one", 6), (11, "x", "in head", 6), (13, "p", "two", 8), (14, "q", "one", 8)}
    assert {r.embedding_content for r in nodes.filter("name = 'z'").collect()} == {"z\nzed"} and links.count() == 6
    assert {r.id: r.status for r in after.collect()} == {10: "build", 11: "build", 12: "extract", 13: "build", 14: "build", 15: "new"}
    got = {r.id: r for r in stages.enriched_hyperedges(chunks, edges).collect()}
    assert (got[6].chunk_id, got[7].chunk_id, got[8].chunk_id, got[9].chunk_id) == (11, None, 14, 5)
    said = spark.createDataFrame([(got[6].extra,), (got[8].extra,)], "e string").select(*[F.get_json_object("e", f"$.{k}") for k in ("is_head", "role", "source", "entities.h", "source_chunk_id")]).collect()
    assert tuple(said[0]) == ("true", "head", "summary", "head one", "11") and tuple(said[1]) == ("true", "head", "summary", None, "14")
    first = edges.filter("id = 7")
    kept = stages.enriched_hyperedges(chunks, first).first().extra
    assert '"kept":{"deep":1}' in kept and '"source":"mine"' in kept and '"role":"head"' in kept and "old" not in kept


# texts


def one(spark, f, *args):
    names = [f"c{i}" for i in range(len(args))]
    return spark.createDataFrame([args], ", ".join(f"{n} string" for n in names)).select(f(*[F.col(n) for n in names]).alias("r")).first().r


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("Thought: a\nAnswer: b\nAnswer: c ", ("a\nAnswer: b", "c")), ("Answer: 1 Answer: 2", ("", "1 Answer: 2")), ("思考：想\n回答：答", ("想", "答")), ("thought : x\n  结论: y\nmore", ("x", "y\nmore")), ("Thought: only", ("only", "")), ("plain", ("", "plain")),
        ("", ("", "")), (None, ("", "")), ("Answer:\nAnswer: x", ("", "Answer: x")), ("my Answer: x", ("", "my Answer: x")), ("lead\nANSWER：z", ("lead", "z")), ("Answer:", ("", "")),
    ],
)
def test_thought_and_answer(spark, text, want):
    assert tuple(one(spark, X.thought_and_answer, text)) == want


def test_question_ids(spark):
    got = [one(spark, lambda c: X.question_id(c, F.lit(3)), q) for q in ("7", "Q12", "q0005", "abc12", "v2-q10", " ", None, "12345", "Q", "1.5", "0")]
    assert got == ["Q0007", "Q0012", "Q0005", "abc12", "v2-q10", "Q0003", "Q0003", "Q12345", "Q", "1.5", "Q0000"]


def test_error_fingerprints(spark):
    f = lambda m: one(spark, lambda c: X.error_fingerprint(c, F.lit("E")), m)
    assert f("Timeout FOR a/b c.pdf") == "E|Timeout FOR a/b c.pdf" and f("Timeout For a/b.PDF  attempt 3 / 5 pages=12 id 77") == "E|Timeout for <file>.pdf attempt ?/? pages=? id 77"
    assert f(" " + "x" * 200) == "E|" + "x" * 160 and f(None) == "E|"


def test_case_is_folded(spark):
    assert one(spark, X.folded, "Straße ΣΊΣΥΦΟΣ Éa") == "Straße ΣΊΣΥΦΟΣ Éa".casefold()


# samples


def test_samples_for_many_tasks_are_limited_below_the_shuffle(spark):
    rows, tasks = spark.range(1000).withColumnRenamed("id", "k"), spark.createDataFrame([("a", 3), ("b", 5), ("c", 2000)], "task string, n int")
    got = evaluation.sample_for_tasks(tasks, rows, "k", 1)
    assert {r.task: r["count"] for r in got.groupBy("task").count().collect()} == {"a": 3, "b": 5, "c": 2000}
    assert got.filter("task = 'c'").select("k").distinct().count() == 1000


# layout


def plain_separated(positions, fixed, least, rounds, step):
    pos = dict(positions)
    for _ in range(rounds):
        delta = {k: [0.0, 0.0] for k in pos}
        for a in pos:
            for b, at, need, share in [(b, pos[b], least, 0.5) for b in pos if b != a] + [(None, f, least * 1.05, 1.0) for f in fixed]:
                dx, dy = pos[a][0] - at[0], pos[a][1] - at[1]
                d = math.hypot(dx, dy)
                assert d >= 1e-9  # rows in one place are tested by themselves
                if d < need:
                    delta[a][0] += dx * share * (need - d) / d
                    delta[a][1] += dy * share * (need - d) / d
        most = 0.0
        for k, (dx, dy) in delta.items():
            m = math.hypot(dx, dy)
            f = step / m if m > step else 1.0
            pos[k] = (pos[k][0] + dx * f, pos[k][1] + dy * f)
            most = max(most, min(m, step))
        if most < 1e-3:
            break
    return pos


def test_separation_equals_all_pairs(spark):
    rnd = random.Random(3)
    start = {i: (rnd.uniform(-1, 1), rnd.uniform(-1, 1)) for i in range(40)}
    fixed = [(0.1, 0.1), (-0.5, 0.4)]
    df = spark.createDataFrame([(k, *v) for k, v in start.items()], "key int, x double, y double")
    still = spark.createDataFrame([(i, *v) for i, v in enumerate(fixed)], "key int, x double, y double")
    got = {r.key: (r.x, r.y) for r in layout.separated(df, still, least=0.25, rounds=6).collect()}
    want = plain_separated(start, fixed, 0.25, 6, 0.12)
    assert all(got[k] == pytest.approx(want[k], abs=1e-9) for k in start)


def test_rows_in_one_place_come_apart(spark):
    df = spark.createDataFrame([(k, 0.0, 0.0) for k in range(6)], "key int, x double, y double")
    got = [(r.x, r.y) for r in layout.separated(df, least=0.2, rounds=40).collect()]
    assert min(math.dist(a, b) for i, a in enumerate(got) for b in got[:i]) > 0.05


def test_rings_hold_what_they_have_room_for(spark):
    members = spark.createDataFrame([("h", k) for k in range(30)] + [("g", k) for k in range(2)], "hub string, key int")
    centres = spark.createDataFrame([("h", 1.0, 2.0), ("g", 0.0, 0.0)], "hub string, x double, y double")
    got = {(r.hub, r.key): (r.x, r.y) for r in layout.on_rings(members, centres, 0.6, 0.3).collect()}
    want, number = {}, 0
    for ring, radius, first, room in layout.ring_plan(30, 0.6, 0.3):
        here = min(room, 30 - first)
        for j in range(here):
            a = (math.pi / here if ring % 2 else 0.0) + 2 * math.pi * j / here
            want["h", number] = (1 + radius * math.cos(a), 2 + radius * math.sin(a))
            number += 1
    want |= {("g", 0): (0.6, 0.0), ("g", 1): (-0.6, 0.0)}
    assert set(got) == set(want) and all(got[k] == pytest.approx(want[k], abs=1e-9) for k in want)


def rings_around(keys, centre, inner, spacing, turn):
    out, number = {}, 0
    for ring, radius, first, room in layout.ring_plan(len(keys), inner, spacing):
        here = min(room, len(keys) - first)
        for j in range(here):
            a = turn + (math.pi / here if ring % 2 else 0.0) + 2 * math.pi * j / here
            out[keys[number]] = (centre[0] + radius * math.cos(a), centre[1] + radius * math.sin(a))
            number += 1
    return out


def test_positions_of_a_small_hypergraph_equal_a_plain_version(spark):
    """Three hyperedges, chunks of two of them, entities with one anchor, and two that stand between."""
    hubs, chunks = [1, 2, 5], [(11, 1), (12, 1), (21, 2), (22, 2), (23, 2), (24, 2), (25, 2), (26, 2)]
    ties = [(f"a{i:02}", "he", 1) for i in range(9)] + [(f"b{i}", "ch", 21) for i in range(3)] + [("x", "he", 1), ("x", "ch", 21), ("y", "ch", 12), ("y", "he", 5)]
    df = lambda rows, schema: spark.createDataFrame(rows, schema).repartition(3)
    got = layout.hypergraph_positions(df([(h,) for h in hubs], "hub long"), df(chunks, "chunk long, hub long"), df(ties + ties[:4], "name string, kind string, anchor long"), rounds=4)
    got = {(r.kind, r.key): (r.x, r.y) for r in got.collect()}
    he, ch, gap = layout.HYPEREDGE, layout.CHUNK, layout.SPACING
    single = {"a": [f"a{i:02}" for i in range(9)], "b": [f"b{i}" for i in range(3)]}
    reach = lambda n: layout.ring_plan(n, ch + gap, gap)[-1][1]
    bubble = {1: he + 1.0 + reach(9) + 0.35, 2: he + 1.0 + 0.15 * 2 + reach(3) + 0.35, 5: he + 0.55 + 0.35}
    radius, total, seen, want = (2 * max(bubble.values()) + gap * 1.5) / (2 * math.sin(math.pi / 3)), sum(bubble.values()), 0.0, {}
    for h in hubs:
        a = (seen + bubble[h] / 2) / total * 2 * math.pi - bubble[1] / 2 / total * 2 * math.pi - math.pi / 2
        want["he", str(h)] = (radius * math.cos(a), radius * math.sin(a))
        seen += bubble[h]
    for i, h in enumerate(hubs):
        x, y = want["he", str(h)]
        for k, at in rings_around([c for c, of in chunks if of == h], (x, y), he + ch + 0.75, max(gap * 1.5, ch * 2.8), math.atan2(y, x) + i * 0.05).items():
            want["ch", str(k)] = at
    x, y = want["he", "1"]
    want |= {("ent", k): at for k, at in rings_around(single["a"], (x, y), he + gap * 0.7, gap, math.atan2(y, x)).items()}
    (cx, cy), (hx, hy) = want["ch", "21"], want["he", "2"]
    want |= {("ent", k): at for k, at in rings_around(single["b"], (cx, cy), ch + gap * 0.85, gap, math.atan2(cy - hy, cx - hx)).items()}
    fixed, start = list(want.values()), {}
    for g, (name, anchors) in enumerate([("y", [("ch", "12"), ("he", "5")]), ("x", [("ch", "21"), ("he", "1")])]):  # groups in the order of their anchors' names
        mx, my = (sum(want[a][d] for a in anchors) / 2 for d in (0, 1))
        r = gap * (0.55 + 0.45 * math.sqrt(0.5))
        start[name] = (mx + r * math.cos(g * 0.37), my + r * math.sin(g * 0.37))
    want |= {("ent", k): at for k, at in plain_separated(start, fixed, gap * 0.95, 4, gap * 0.35).items()}
    assert set(got) == set(want)
    assert all(got[k] == pytest.approx(want[k], abs=1e-9) for k in want), [(k, got[k], want[k]) for k in want if got[k] != pytest.approx(want[k], abs=1e-9)]


def test_positions_of_little_or_nothing(spark):
    none = spark.createDataFrame([], "name string, kind string, anchor long")
    one = spark.createDataFrame([(7,)], "hub long")
    chunks = spark.createDataFrame([], "chunk long, hub long")
    assert [tuple(r) for r in layout.hypergraph_positions(one, chunks, none).collect()] == [("he", "7", 0.0, 0.0)]
    assert layout.hypergraph_positions(one.limit(0), chunks, none).count() == 0


def test_intermediate_tables_can_be_removed(spark):
    from weftline import storage

    rows = storage.written(spark.range(5), "kept")
    folder = rows.inputFiles()[0].rsplit("/", 1)[0]
    assert rows.count() == 5 and storage.exists(spark, folder)
    assert storage.clear(spark) >= 1 and not storage.exists(spark, folder) and storage.clear(spark) == 0
