"""Vector index, codes, shards and keyword index, against plain versions."""

import math
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from weftline.operators import keyword_index, nearest, shards, vector_index, vectors
from weftline.operators.retrieval import keyword_hits
from weftline.plans import queries
from weftline.storage import files

SF = "/root/testdata/sf0.01"


def plain_nearest(rows, asked, k):
    out = {}
    for q, x in asked:
        found = sorted((float(sum((a - b) ** 2 for a, b in zip(v, x))), i) for i, v in rows)
        out[q] = [i for _, i in found[:k]]
    return out


def ids_of(hits):
    out = {}
    for r in sorted(hits.collect(), key=lambda r: (r.query_id, r["rank"])):
        out.setdefault(r.query_id, []).append(r.id)
    return out


@pytest.fixture(scope="module")
def clustered(spark):
    """600 vectors around 12 points, of which a third are one and the same, some null, odd or of another size."""
    rng = np.random.default_rng(4)
    points = rng.normal(size=(12, 8)) * 5
    rows = [(i, (points[i % 12] + rng.normal(size=8) * 0.3).astype(np.float32).tolist()) for i in range(400)]
    rows += [(400 + i, rows[7][1]) for i in range(200)]
    odd = [(1000, None), (1001, [1.0, None] + [0.0] * 6), (1002, [math.nan] * 8), (1003, [1.0] * 3), (1004, [math.inf] * 8), (1005, [])]
    df = spark.createDataFrame(rows + odd, "id long, embedding array<float>").withColumns({"cell": F.lit("x"), "v": F.lit(1), "code": F.lit(2), "error": F.lit(3)}).repartition(3)
    asked = spark.createDataFrame([(i, rows[i][1]) for i in range(0, 600, 37)] + [(-1, None), (-2, [0.0])], "query_id long, query array<float>")
    return rows, df, asked


def test_all_cells_give_the_exact_result_and_few_most_of_it(spark, clustered, tmp_path):
    rows, df, asked = clustered
    index = vector_index.build_index(df, f"file://{tmp_path}/index", cells=12)
    want = plain_nearest(rows, [(i, rows[i][1]) for i in range(0, 600, 37)], 10)
    assert ids_of(vector_index.search(index, asked, 10, probes=12)) == want
    few = vector_index.search(index, asked, 10, probes=2)
    assert vector_index.recall(few, vector_index.search(index, asked, 10, probes=12)) >= 0.95
    assert vector_index.probes_for(index, 0.95, sample=60) <= 4
    again = vector_index.load_index(spark, f"file://{tmp_path}/index")
    assert again.vectors.count() == 600 and again.cells == 12
    plan = again.vectors.filter(F.col("cell").isin([3])).select("id")._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(cell" in plan or "PartitionFilters: [(cell" in plan


@pytest.mark.parametrize("bits", [8, 16])
def test_codes_give_the_exact_result_with_tombstones(spark, clustered, bits, monkeypatch):
    rows, df, asked = clustered
    monkeypatch.setattr(vector_index.Candidates, "LIMIT", 50)
    index = vector_index.build_index(df, cells=7, bits=bits)
    dead = spark.createDataFrame([(i,) for i in range(0, 600, 9)], "id long")
    want = plain_nearest([(i, v) for i, v in rows if i % 9], [(i, rows[i][1]) for i in range(0, 600, 37)], 10)
    assert ids_of(vector_index.search_exact(index, asked, 10, dead)) == want
    assert vector_index.search_exact(index, asked, 0).count() == 0


def test_codes_are_as_near_as_they_say():
    v = np.random.default_rng(1).normal(size=(200, 16)) * np.geomspace(1e-9, 1e9, 200)[:, None]
    v[5] = 0
    for bits in (8, 16):
        codes, scale, error = vector_index.encode(v, bits)
        off = np.sqrt(((v - vector_index.decode(codes, scale)) ** 2).sum(1))
        assert (off <= error).all() and (error <= np.sqrt((v**2).sum(1)) * (0.02 if bits == 8 else 0.001) + 1e-12).all()


def test_candidates_of_copies_stay_few():
    """Of ten thousand copies of one vector only the k smallest ids are candidates."""
    maybe = vector_index.Candidates(np.zeros((1, 4)), 3)
    maybe.LIMIT = 1_000
    for a in range(0, 10_000, 500):
        n = np.arange(a, a + 500)
        maybe.add(np.ones((500, 4)), np.full(500, 0.1), (np.full(500, 77), np.zeros(500, np.int64), n))
    (batch,) = maybe.found(np.array([9]))
    assert batch["id"].to_pylist() == [0, 1, 2]


def test_waves_agree_with_one_pass(spark, clustered, monkeypatch):
    rows, df, asked = clustered
    want = ids_of(vectors.top_k(df, asked, 5))
    assert want == plain_nearest(rows, [(i, rows[i][1]) for i in range(0, 600, 37)], 5)
    index = vector_index.build_index(df, cells=6)
    monkeypatch.setattr(nearest, "WAVE_BYTES", 600)
    assert ids_of(vectors.top_k(df, asked, 5)) == want
    assert ids_of(vector_index.search(index, asked, 5, probes=6)) == want
    assert ids_of(vector_index.search_exact(index, asked, 5)) == want


def test_recall_of_the_registered_query(spark):
    found = queries.vector_topk_ivf(spark, SF).withColumnRenamed("vec_id", "id")
    exact = queries.vector_topk_l2(spark, SF).withColumnRenamed("vec_id", "id")
    assert vector_index.recall(found, exact) >= 0.95


def test_no_nested_loop_in_search_and_retrieval(spark):
    for name in ("vector_topk_l2", "keyword_hits", "keyword_index_hits", "retrieve"):
        plan = queries.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan, name


# shards


def test_shards_fill_up_and_only_worn_ones_are_written_anew(spark, tmp_path):
    path = f"file://{tmp_path}/store"
    make = lambda a, b: spark.createDataFrame([(i, [float(i)]) for i in range(a, b)], "id long, embedding array<float>").repartition(5)
    first = {r.shard: (r.n, r.sealed) for r in shards.add(make(0, 250), path, 100).collect()}
    assert first == {0: (100, True), 1: (100, True), 2: (50, False)}
    second = {r.shard: (r.n, r.first_id, r.last_id) for r in shards.add(make(250, 420), path, 100).collect()}
    assert second == {0: (100, 0, 99), 1: (100, 100, 199), 2: (100, 200, 299), 3: (100, 300, 399), 4: (20, 400, 419)}
    third = {r.shard: r.n for r in shards.add(make(420, 440), path, 100, seal=True).collect()}
    assert third[4] == 20 and third[5] == 20
    names = lambda: {s: set(files(spark, f"{path}/vectors/shard={s}")) for s in range(6)}
    before = names()
    dead = spark.createDataFrame([(i,) for i in [*range(100, 150), 5, 7, *range(420, 440)]], "id long")
    stats = {r.shard: r.deleted for r in shards.tombstones(spark, path, dead).collect()}
    assert stats == {0: 2, 1: 50, 2: 0, 3: 0, 4: 0, 5: 20}
    assert shards.compact(spark, path, dead, 0.2, 100) == [1, 5]
    after = names()
    assert all(after[s] == before[s] for s in (0, 2, 3, 4)) and after[1].isdisjoint(before[1]) and not after[5]
    assert sorted(r.id for r in shards.shards(spark, path).collect()) == [i for i in range(440) if not (100 <= i < 150 or i >= 420)]
    assert {r.shard: (r.n, r.sealed) for r in shards.manifest(spark, path).collect()}[1] == (50, False)
    assert shards.compact(spark, path, dead, 0.2, 100) == []


def test_shards_of_equal_ids_and_of_nothing(spark, tmp_path):
    rows = spark.createDataFrame([(1, [0.0])] * 25, "id long, embedding array<float>")
    got = shards.running_shards(rows, 10).groupBy("shard").count().collect()
    assert {r.shard: r["count"] for r in got} == {0: 10, 1: 10, 2: 5}
    assert shards.running_shards(rows.limit(0), 10).count() == 0


# keyword index

TEXTS = ["Straße und Strasse", "ΣΊΣΥΦΟΣ σίσυφος", "ab", "a", "", None, "日本語の文字", "🙂🙂ab🙂", "The cat. THE CAT", "x" * 500, "catalogue", "é é", "aaa"]
WORDS = ["strasse", "STRASSE", "straße", "σισυφος", "σίσυφος", "ab", "cat", "日本", "本語の", "🙂a", "🙂🙂", "xxxx", "é", "zz", "zzz", "a", "", "aa", "the cat", "ca"]


def folded(text):
    return text.casefold()


def test_index_finds_what_a_scan_and_plain_python_find(spark):
    chunks = spark.createDataFrame([(i, i // 2, t) for i, t in enumerate(TEXTS)], "id long, doc_id long, content string").repartition(3)
    words = spark.createDataFrame([(w,) for w in WORDS], "word string")
    index = keyword_index.build_index(chunks)
    want = {(w, i) for w in WORDS for i, t in enumerate(TEXTS) if t and len(w) >= 2 and folded(w) in folded(t)}
    for rarest in (1, 3, 9):
        assert {tuple(r) for r in keyword_index.containing(index, chunks, words, rarest).collect()} == want
    assert {tuple(r) for r in keyword_index.scanned(chunks, words).collect()} == want
    assert {tuple(r) for r in keyword_index.scanned(chunks, words, wave_bytes=20).collect()} == want
    assert keyword_index.containing(index, chunks, words.limit(0)).count() == 0


def test_candidates_are_places_in_chunks(spark, monkeypatch):
    rng = np.random.default_rng(3)
    known = ["".join(chr(97 + c) for c in rng.integers(0, 6, n)) for n in rng.integers(2, 9, 300)]
    rows = [(None if i % 50 == 0 else i // 2, " ".join(known[j] for j in (rng.random(12) ** 3 * 300).astype(int))) for i in range(3000)]
    rows += [rows[7], rows[7], (5, None), (None, "")]
    chunks = spark.createDataFrame(rows, "id long, content string").repartition(2)
    asked = ["".join(w) for w in zip(*[iter(known[1] + known[2])] * 3)] + known[::4] + ["abcdefabc"]
    words = spark.createDataFrame([(w,) for w in asked], "word string")
    index, tables, written = keyword_index.build_index(chunks), [], keyword_index.written
    monkeypatch.setattr(keyword_index, "written", lambda df, label: tables.append(written(df, label)) or tables[-1])
    want = Counter((w, i) for w in set(asked) for i, t in rows if t and w in t)
    for few in (False, True):
        some = words.filter(words.word == known[-4]) if few else words  # few texts are candidates, or all
        mine = Counter({k: n for k, n in want.items() if not few or k[0] == known[-4]})
        for most in (0, 100_000):  # ids are shuffled, or broadcast
            monkeypatch.setattr(keyword_index, "MOST_SENT", most)
            assert Counter(tuple(r) for r in keyword_index.containing(index, chunks, some).collect()) == mine and mine
        if few:
            assert 0 < tables[-1].filter("folded IS NULL").first().n < 1000
    assert tables[0].count() <= (len(set(asked)) + 1) * index.chunks.count() < len(want)
    assert index.postings.filter("substr(hex(places), 1, 2) = '6E'").count() and index.postings.filter("substr(hex(places), 1, 2) = '62'").count()


def test_found_words_are_given_out_piece_by_piece(monkeypatch):
    monkeypatch.setattr(keyword_index, "MOST_HELD", 2)
    arrow = pa.schema([("folded", pa.string()), ("id", pa.int64())])
    pieces = list(keyword_index._spotted(keyword_index._automaton(["one", "two"]), ["one two", "one", "", "two"], pa.array([5, 6, 7, None]), arrow))
    assert sorted(map(str, (tuple(r.values()) for b in pieces for r in b.to_pylist()))) == sorted(map(str, [("one", 5), ("two", 5), ("one", 6), ("two", None)])) and len(pieces) > 2


def test_index_grows_by_new_texts(spark, tmp_path):
    make = lambda a, b: spark.createDataFrame([(i, TEXTS[i]) for i in range(a, b)], "id long, content string")
    index = keyword_index.add_texts(keyword_index.build_index(make(0, 6)), f"file://{tmp_path}/index", make(6, 13))
    whole = keyword_index.build_index(make(0, 13))
    assert {tuple(r) for r in index.frequencies.collect()} == {tuple(r) for r in whole.frequencies.collect()}
    assert index.postings.agg(F.sum("n")).first()[0] == whole.postings.agg(F.sum("n")).first()[0]
    words = spark.createDataFrame([(w,) for w in WORDS], "word string")
    assert {tuple(r) for r in keyword_index.containing(index, make(0, 13), words).collect()} == {(w, i) for w in WORDS for i, t in enumerate(TEXTS) if t and len(w) >= 2 and folded(w) in folded(t)}


def test_postings_of_either_form_and_of_every_character(monkeypatch):
    for n in (1, 9, 100, 8192):
        for some in (1, n // 20, n // 2, n):
            places = np.sort(np.random.default_rng(n).permutation(n)[: max(1, some)])
            assert keyword_index.unpack(keyword_index.pack(places, n)).tolist() == places.tolist()
    text = "a\x00b🙂\U0010fffeé日本" * 3
    want = {text[i : i + k] for k in (2, 3) for i in range(len(text) - k + 1)}
    assert {keyword_index.gram_text(int(c)) for c in keyword_index.gram_codes(text)} == want
    monkeypatch.setattr(keyword_index, "STRETCH", 4)
    assert {keyword_index.gram_text(int(c)) for c in keyword_index.gram_codes(text)} == want
    assert len(keyword_index.gram_codes("")) == 0 and len(keyword_index.gram_codes("a")) == 0


def test_keyword_hits_with_and_without_index_agree(spark):
    chunks = queries._chunks(spark, "/root/testdata/sf0.001")
    words = queries._words(spark, "/root/testdata/sf0.001")
    index = keyword_index.build_index(chunks)
    for k in (0, 3, 50):
        a = sorted(map(str, keyword_hits(chunks, words, k).collect()))
        assert a == sorted(map(str, keyword_hits(chunks, words, k, index).collect()))
