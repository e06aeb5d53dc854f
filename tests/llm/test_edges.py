"""Nulls, empty and long texts, ties, repeated rows, empty tables, extra columns with clashing names; and parts by themselves."""

import bisect
import glob
import hashlib
import math
import struct
import time
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from tests.llm.test_contracts import smallest_reachable
from weftline.llm import common, decontaminate, fingerprint, language_id, mixing, quality, simhash, suffix_dedup, token_binary, token_counts, warc
from weftline.llm.components import components
from weftline.llm.pfor import decode_file, encode_section
from weftline.llm.segments import SegmentEncoder, cut_long

LONG = "langes wort " * 30_000
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp long, size string, score string, id string, node string, bucket string, `text ` string"
ROWS = [(1, "one two three four five six", "en", "a"), (1, "one two three four five six", "en", "a"), (2, None, None, None), (3, "", "en", "b"), (None, "no id here at all", None, "a"), (4, LONG, "de", None), (5, " \n\t ", "en", "b"), (6, "1234 !!", None, "a"), (7, "é ü 日本語 a  b \n c", "fr", "b")]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(*r, None, 1, "x", "y", "z", "n", "b", "t") for r in ROWS], SCHEMA)


@pytest.fixture(scope="module")
def empty(spark, odd):
    return spark.createDataFrame([], odd.schema)


def test_language_id(spark, odd, empty):
    model = language_id.train(odd)
    out = {(r.doc_id, r.lang_pred) for r in language_id.identify(odd, model).collect()}
    assert {(2, "und"), (3, "und"), (5, "und"), (6, "und"), (1, "en"), (4, "de")} <= out
    assert language_id.identify(odd, language_id.train(empty)).filter("lang_pred <> 'und'").count() == 0
    assert language_id.identify(empty, model).count() == 0


def test_a_rare_language_keeps_its_entries(spark):
    """Two languages of 600 texts and one of 12, all of the same letters, and a sample that takes only the last whole."""
    rng = np.random.default_rng(5)
    lexicon = {lang: ["".join(rng.choice(list("abcdefgh"), 7)) for _ in range(n)] for lang, n in (("p", 400), ("q", 400), ("rare", 60))}
    text = lambda lang: " ".join(rng.choice(lexicon[lang], 12))
    rows = [(i, lang, text(lang)) for i, lang in enumerate(["p"] * 600 + ["q"] * 600 + ["rare"] * 12)]
    model = language_id.train(spark.createDataFrame(rows, "doc_id long, lang string, text string"), rows_per_language=200)
    scorer = language_id.Scorer(model)
    own = {w for _, lang, t in rows if lang == "rare" for w in t.split()}
    twice = [w for w in own if sum(t.split().count(w) for _, _, t in rows) > 1]
    assert np.isin(language_id.entry_keys(twice, 0), model.entries[0].keys).all() and len(twice) > 20
    assert np.mean([lang == "rare" for lang, _ in scorer.predict([text("rare") for _ in range(100)])]) > 0.9
    assert np.mean([lang == "p" for lang, _ in scorer.predict([text("p") for _ in range(100)])]) > 0.9


def entries(n, *rows):
    """Entries of two languages from (entry, row) pairs."""
    keys = language_id.entry_keys([e for e, _ in rows], n)
    order = np.argsort(keys)
    lifts = np.array([r for _, r in rows], np.float32).reshape(-1, 2)[order].reshape(-1)
    return language_id.Entries(keys[order], np.arange(0, 2 * len(rows) + 1, 2), np.tile(np.int32([0, 1]), len(rows)), lifts, np.float32([0, 0]))


def test_unseen_words_fall_back_to_ngrams():
    known = {0: entries(0, ("known", (-1, -9))), 1: entries(1, ("x", (-9, -1))), 2: entries(2), 3: entries(3, ("^fo", (-2, -8))), 4: entries(4), 5: entries(5)}
    model = language_id.LanguageModel(["a", "b"], known, np.float32([-14, -14]))
    out = model.score(["known", "foo", "xx"])
    assert out[0].tolist() == [-1, -9] and out[1][0] > out[1][1] and out[2].tolist() == [-9, -1]


def plain_languages(texts, score_of):
    """Word-first backoff, written plainly: counts by language, then a prediction for each text of score_of."""
    words = {}
    for lang, text in texts:
        words.setdefault(lang, Counter()).update(language_id.words_of(text))
    langs = sorted(words)
    tables = [words, *({lang: Counter(g for w in c for g in language_id.grams_of(w, n)) for lang, c in words.items()} for n in range(1, 6))]
    kept = [{e for e, c in sum(t.values(), Counter()).items() if c >= 2} for t in tables]

    def row(n, entry):
        smooth = 0.5 if n == 0 else 0.1
        return [math.log((tables[n][lang][entry] + smooth) / (sum(c for e, c in tables[n][lang].items() if e in kept[n]) + smooth * max(1, len(kept[n])))) for lang in langs]

    def of_word(word):
        if word in kept[0]:
            return row(0, word)
        marked, rows = f"^{word}$", []
        for i in range(len(marked)):
            grams = [(n, marked[i : i + n]) for n in (5, 4, 3, 2, 1) if i + n <= len(marked) and (n > 1 or marked[i] not in "^$")]
            found = next((row(n, g) for n, g in grams if g in kept[n]), None)
            if found or 0 < i < len(marked) - 1:
                rows.append(found or [math.log(1e-6)] * len(langs))
        return [sum(r[k] for r in rows) / len(rows) for k in range(len(langs))]

    for text in score_of:
        found = [of_word(w) for w in language_id.words_of(text)]
        total = [min(1.0, 30 / len(found)) * sum(r[k] for r in found) for k in range(len(langs))]
        yield langs[total.index(max(total))], 1 / sum(math.exp(t - max(total)) for t in total)


def test_languages_equal_a_plain_version(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy("doc_id").limit(60)
    taught = [(r.lang, r.text) for r in docs.filter("doc_id % 2 = 0 AND lang IS NOT NULL AND text IS NOT NULL").collect()]
    others = [r for r in docs.filter("doc_id % 2 = 1").collect() if language_id.words_of(r.text)]
    model = language_id.train(docs.filter("doc_id % 2 = 0"))
    got = {r.doc_id: r for r in language_id.identify(docs, model).collect()}
    for r, (lang, score) in zip(others, plain_languages(taught, [r.text for r in others])):
        assert got[r.doc_id].lang_pred == lang and got[r.doc_id].score == pytest.approx(score, abs=1e-4)


def test_quality(spark, odd, empty):
    labels = spark.createDataFrame([(1, 1), (1, 0), (3, 0), (6, None), (None, 1), (7, 1)], "doc_id long, quality int")
    model = quality.train(odd, labels)
    out = quality.score(odd, model).collect()
    assert len(out) == len(ROWS) and all(0 <= r.score <= 1 for r in out)
    assert len({r.score for r in out if r.doc_id in (2, 3)}) == 1
    assert {r.score for r in quality.score(odd, quality.train(odd, labels.limit(0))).collect()} == {0.5}
    assert quality.score(empty, model).count() == 0 and quality.keep(odd, model, 0.0).columns == odd.columns


def test_additive_model_learns_an_interaction():
    x = np.random.default_rng(1).random((4000, len(quality.FEATURES)))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = quality.fit(x, y, rounds=10)
    assert (0, 1) in model.pairs and np.mean((model.score(x) > 0.5) == y) > 0.9


def test_mixing(spark, odd, empty):
    out = mixing.mix_sources(odd).collect()
    assert len(out) == len(ROWS) and all(r.taken <= 2 * r["size"] for r in out)
    assert {r.taken for r in out if r["size"] == 0} == {0}
    assert mixing.mix_sources(empty).count() == 0


def test_targets_fill_up():
    assert mixing.fill_targets([10, 100], [3, 1], 1.5, 2) == [20.0, 145.0]
    assert mixing.fill_targets([], [], 1.5, 2) == [] and mixing.fill_targets([0, 4], [1, 1], 1.5, 2) == [0.0, 6.0]


def test_decontamination(spark, odd, empty):
    items = spark.createDataFrame([(1, "three four five six"), (2, None), (3, "!!"), (4, "no id here"), (4, "no id here")], "item_id int, text string")
    out = decontaminate.contaminated(odd, items).collect()
    assert sorted((r.doc_id or 0, r.item_id) for r in out) == [(0, 4), (0, 4), (1, 1), (1, 1)]
    dealt = decontaminate.contaminated(odd, items, index_words=4).collect()
    assert sorted((r.doc_id or 0, r.item_id) for r in dealt) == sorted((r.doc_id or 0, r.item_id) for r in out)
    assert decontaminate.contaminated(empty, items).count() == 0 and decontaminate.contaminated(odd, items.limit(0)).count() == 0


def test_a_long_item_does_not_widen_the_others_passages(spark):
    rng = np.random.default_rng(8)
    item = "the cat sat on the mat and it was warm"
    pairs = [" ".join(p) for p in zip(item.split(), item.split()[1:])]
    filler = lambda: " ".join(f"f{i}" for i in rng.integers(0, 9000, 300))
    docs = spark.createDataFrame([(1, " ".join(filler() + " " + p for p in pairs)), (2, f"{filler()} {item} {filler()}")], "doc_id long, text string")
    long = " ".join(f"long{i}" for i in range(5000))
    for more in ([], [(2, long)]):
        items = spark.createDataFrame([(1, item), *more], "item_id int, text string")
        assert [r.doc_id for r in decontaminate.contaminated(docs, items).collect()] == [2]
    copied = spark.createDataFrame([(3, f"{filler()} {long} {filler()}")], docs.schema)
    assert [r.item_id for r in decontaminate.contaminated(copied, items).collect()] == [2]


def test_no_item_is_pruned_that_reaches_its_threshold():
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(60)]
    items = [(i, " ".join(rng.choice(words, rng.integers(1, 30)))) for i in range(50)]
    frequencies, total = {}, 0
    for _, t in items:
        total += len(t.split())
        for w in set(t.split()):
            frequencies[w] = frequencies.get(w, 0) + 1
    index = decontaminate.build(items, frequencies, len(items), total / len(items), 32, 0.5)
    for _ in range(20):
        text = " ".join(rng.choice(words, 300))
        found, all_words = decontaminate.search(text, index, overlap=0.0), text.split()
        want = set()
        for a in range(0, len(all_words), 32):
            terms = {index.terms[w] for w in all_words[a : a + 64] if w in index.terms}
            for k, item in enumerate(index.items):
                score = sum(index.weights[p] for t in terms for p in range(index.starts[t], index.starts[t + 1]) if index.docs[p] == k)
                if score >= index.needed[k]:
                    want.add(item)
        assert {index.items[i] for i in found} == want


def test_a_long_text_is_searched_in_pieces(monkeypatch):
    items = [(1, "alpha beta gamma delta epsilon zeta")]
    index = decontaminate.build(items, dict.fromkeys(items[0][1].split(), 1), 1, 6, 32, 0.5)
    monkeypatch.setattr(decontaminate, "CHUNK_CHARS", 100)
    for at in range(0, 60, 3):
        assert decontaminate.search("word " * at + items[0][1] + " word" * 60, index) != {}


def test_fingerprints(spark, odd, empty):
    out = fingerprint.fingerprints_with_next(odd, samples=4).collect()
    assert len(out) == len(ROWS) and len({r.fingerprint for r in out if r.doc_id in (2, 3, 5)}) == 1
    assert len({(r.fingerprint, r.n_chars) for r in out if r.doc_id == 1}) == 1
    assert fingerprint.fingerprints_with_next(empty, samples=4).count() == 0
    one = fingerprint.fingerprints_with_next(odd.filter("doc_id = 7"), samples=4).first()
    text = ROWS[-1][1]
    assert one.near_next == 1.0 and one.edited_sha256 == hashlib.sha256((text[: len(text) - len(text) // 3] + text[: len(text) // 3]).encode()).hexdigest()
    assert {r.doc_id for r in fingerprint.fingerprints(odd, samples=4).collect()} == {r[0] for r in ROWS}


def test_next_bucket_over_far_apart_ids(spark):
    ids = [-(1 << 60), -5, 0, 1, 63, 64, 1 << 20, 1 << 40, (1 << 62) + 1]
    out = fingerprint.fingerprints_with_next(spark.createDataFrame([(i, f"text {i}") for i in ids], "doc_id long, text string"), samples=4).collect()
    for r in out:
        text, after = f"text {r.doc_id}", f"text {ids[ids.index(r.doc_id) - 1]}"
        assert r.edited_sha256 == hashlib.sha256((text[: len(text) - len(text) // 3] + after[: len(text) // 3]).encode()).hexdigest()


def test_repeats(spark, odd, empty):
    out = {r.doc_id: r for r in suffix_dedup.remove_repeats(odd, with_text=True).collect()}
    assert out[2].n_bytes == 0 and out[1].n_removed == 0
    assert out[4].n_bytes == out[4].n_removed == len(LONG) and out[4].n_spans == 1
    assert suffix_dedup.remove_repeats(empty).count() == 0
    twice = "".join(chr(97 + (i * i * 7 + i) % 26) for i in range(450))
    two = spark.createDataFrame([(1, twice), (1, twice), (2, "x" + twice[:420] + "y")], "doc_id long, text string")
    assert sorted((r.doc_id, r.n_removed) for r in suffix_dedup.remove_repeats(two).collect()) == [(1, 450), (1, 450), (2, 420)]


def test_repeats_of_edited_and_periodic_texts(spark):
    rng = np.random.default_rng(5)
    base = bytes(rng.integers(97, 105, 3000, dtype=np.uint8)).decode()
    texts = [base, base[:700] + "#" + base[701:1500], "q" + base[100:501], base[2500:] + base[:399], "ab" * 300, "xyz" + "ab" * 199 + "a", "z" * 401, base[5:404]]
    out = {r.doc_id: r for r in suffix_dedup.remove_repeats(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")).collect()}
    where = {}
    for i, t in enumerate(texts):
        for k in range(len(t) - 399):
            where.setdefault(t[k : k + 400], []).append((i, k))
    gone = [np.zeros(len(t), bool) for t in texts]
    for places in where.values():
        for i, k in places if len(places) > 1 else []:
            gone[i][k : k + 400] = True
    assert [out[i].n_removed for i in range(len(texts))] == [int(g.sum()) for g in gone]


def test_tokens(spark, odd, empty):
    path = public_tokenizers.path("word_bpe_49k.json")
    plain = Tokenizer.from_file(path)
    want = sorted((r[0] or 0, len(plain.encode(r[1] or "", add_special_tokens=False).ids)) for r in ROWS)
    assert sorted((r.doc_id or 0, r.n_tokens) for r in token_counts.token_counts(odd, path, batch_bytes=20).collect()) == want
    assert token_counts.token_counts(empty, path).count() == 0
    byte = public_tokenizers.path("byte_bpe_50k.json")
    manifest = token_binary.write_token_files(odd, byte, section_ids=5, file_bytes=100, range_bytes=20)
    out = token_binary.read_token_files(manifest, with_ids=True).orderBy("start").collect()
    assert [r.doc_id for r in out] == [None, 1, 1, 2, 3, 4, 5, 6, 7]
    exact = Tokenizer.from_file(byte)
    texts = {r[0]: r[1] or "" for r in ROWS}
    assert all(list(r.ids) == [*exact.encode(texts[r.doc_id], add_special_tokens=False).ids, 0] for r in out)
    assert token_binary.read_token_files(token_binary.write_token_files(empty, byte)).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.one_of(st.sampled_from(" \n\t　\x1c.,'sé̈<|endoftext|>Aaß1²"), st.characters(codec="utf-8")), max_size=30), min_size=1, max_size=5))
def test_segments_give_the_library_s_ids(texts):
    for name, boundary in (("byte_bpe_50k.json", "lead"), ("word_bpe_49k.json", "drop")):
        path = public_tokenizers.path(name)
        ours, library = _encoder(path, boundary), _library(path)
        ids, counts = ours.encode(pa.array(texts))
        want = [library.encode(t, add_special_tokens=False).ids for t in texts]
        assert counts.tolist() == list(map(len, want)) and ids.tolist() == [i for w in want for i in w]
    assert all("".join(cut_long(t, 3)) == t for t in texts)


_cache: dict = {}


def _encoder(path, boundary):
    return _cache.setdefault((path, boundary), None) or _cache.update({(path, boundary): SegmentEncoder(path, boundary)}) or _cache[path, boundary]


def _library(path):
    return _cache.setdefault(path, None) or _cache.update({path: Tokenizer.from_file(path)}) or _cache[path]


@settings(max_examples=50, deadline=None)
@given(st.lists(st.lists(st.one_of(st.integers(0, 300), st.integers(0, 2**32 - 1)), max_size=900), max_size=4))
def test_files_of_ids_round_trip(docs):
    ids, lengths = np.array([i for d in docs for i in d], np.uint32), np.array(list(map(len, docs)), np.int64)
    names = [None if i == 1 else i - 2 for i in range(len(docs))]
    data = encode_section(names, lengths, ids, step=1)
    for back in decode_file(data + data):
        assert back[0] == names and back[1].tolist() == lengths.tolist() and back[2].tolist() == ids.tolist()
    for bad in (data[:-5] + bytes([data[-5] ^ 1]) + data[-4:], data + data[:-1], data + b"x"):
        with pytest.raises(ValueError):
            list(decode_file(bad))


def test_token_files_of_a_hot_id(spark):
    """An id that fills several ranges, null ids, and a folder that holds another attempt's files."""
    rows = [(7, f"hot text {i % 3}") for i in range(400)] + [(None, "none")] * 50 + [(i, f"text {i}") for i in range(100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    byte = public_tokenizers.path("byte_bpe_50k.json")
    folder = common.new_path(spark, "twice")
    first = token_binary.write_token_files(docs.limit(30), byte, path=folder)
    manifest = token_binary.write_token_files(docs, byte, path=folder, range_bytes=200, section_ids=100, file_bytes=400)
    out = token_binary.read_token_files(manifest).orderBy("start").collect()
    ids = [-1 if r.doc_id is None else r.doc_id for r in out]
    assert ids == sorted(-1 if i is None else i for i, _ in rows) and token_binary.read_token_files(first).count() == 30
    assert [r.start for r in out] == [0, *np.cumsum([r.n_tokens for r in out])[:-1].tolist()]
    assert manifest.filter("n_docs > 0").select("bucket").distinct().count() > 12  # the hot id is in many tasks


def test_an_added_token_of_letters(tmp_path):
    from tokenizers import AddedToken

    path = public_tokenizers.path("byte_bpe_50k.json")
    for token in (AddedToken("abc"), AddedToken("b c", single_word=True)):
        changed = Tokenizer.from_file(path)
        changed.add_tokens([token])
        changed.save(str(tmp_path / "t.json"))
        texts = ["xabcx abc ab c b c.", "a b c d", "", None]
        ids, counts = SegmentEncoder(str(tmp_path / "t.json"), "lead").encode(pa.array(texts))
        want = [changed.encode(t or "", add_special_tokens=False).ids for t in texts]
        assert counts.tolist() == list(map(len, want)) and ids.tolist() == [i for w in want for i in w]


def test_warc(spark):
    rows = [(1, "http://a/ b\r\n", "same"), (2, None, "same"), (3, "u", None), (4, "u", ""), (None, "u", "same"), (5, "u", "é" * 100_000), (5, "u", "other"), (6, "u", "other")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    out = warc.read_warc(warc.write_warc(warc.resolve_revisits(pages), file_bytes=200)).collect()
    got = sorted((r.page_id or 0, r.payload_bytes, r.record_type, r.refers_to or 0) for r in out)
    assert got == [(0, 4, "revisit", 1), (1, 4, "response", 0), (2, 4, "revisit", 1), (3, 0, "response", 0), (4, 0, "revisit", 3), (5, 5, "response", 0), (5, 200_000, "response", 0), (6, 5, "revisit", 5)]
    large = warc.read_warc(warc.write_warc(warc.resolve_revisits(pages, min_bytes=5))).filter("record_type = 'revisit'").collect()
    assert [r.page_id for r in large] == [6]
    assert warc.read_warc(warc.write_warc(warc.resolve_revisits(pages.limit(0)))).count() == 0


def test_a_warc_folder_written_to_twice(spark):
    """As if an attempt had left its files: the second manifest's archives have each page once. Columns with clashing names don't matter."""
    rows = [(i, "u", f"page {i % 40}", 1, 2, "x") for i in range(50)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, sha1 int, refers_to int, payload string")
    folder = common.new_path(spark, "archives")
    warc.write_warc(warc.resolve_revisits(pages), path=folder)
    again = warc.write_warc(warc.resolve_revisits(pages.orderBy(F.desc("page_id"))), path=folder, file_bytes=300)
    out = warc.read_warc(again).collect()
    assert sorted(r.page_id for r in out) == list(range(50)) and sum(r.record_type == "revisit" for r in out) == 10


def test_simhash(spark, odd, empty):
    out = simhash.near_duplicates(odd).collect()
    assert {(r.fingerprint, r.component_id) for r in out if r.doc_id in (2, 3, 5)} == {("0" * 16, 2)}
    assert len(out) == len(ROWS) and simhash.near_duplicates(empty).count() == 0
    wide = {r.doc_id: r.component_id for r in simhash.similar_groups(odd).collect()}
    assert wide[1] == 1 and wide[3] == 2 and simhash.similar_groups(empty).count() == 0


def test_links_are_all_pairs_within_three_bits(spark):
    rng = np.random.default_rng(11)
    base = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    prints = {int(b) ^ sum(1 << int(k) for k in rng.choice(64, n, replace=False)) for b in base for n in range(6)}
    signed = sorted(np.array(sorted(prints), np.uint64).view(np.int64).tolist())
    got = sorted((r.a, r.b) for r in simhash.links(spark.createDataFrame([(x,) for x in signed], "fp long")).collect())
    want = sorted((a, b) for a in signed for b in signed if a < b and ((a ^ b) & (1 << 64) - 1).bit_count() <= 3)
    assert got == want


def test_components(spark):
    rng = np.random.default_rng(2)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 150, (110, 2))] + [(i, i + 1) for i in range(200, 240)] + [(300, i) for i in range(301, 330)] + [(7, 7)]
    nodes = sorted({x for e in edges for x in e})
    linked = {frozenset(e) for e in edges}
    want = dict(zip(nodes, smallest_reachable(nodes, lambda i, j: frozenset((nodes[i], nodes[j])) in linked)))
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    alone = {n for n in nodes if all(n not in e or len(e) == 1 for e in linked)}
    assert got == {n: r for n, r in want.items() if n not in alone}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_similar_texts_group(spark):
    rng = np.random.default_rng(4)
    words = [f"word{i}" for i in range(5000)]
    rows, truth = [], []
    for g in range(30):
        base = list(rng.choice(words, 300))
        for c in range(4):
            text = list(base)
            for k in rng.choice(300, c, replace=False):
                text[k] = "edited"
            rows.append((len(rows), " ".join(text)))
            truth.append(g * 4)
    got = {r.doc_id: r.component_id for r in simhash.similar_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert np.mean([got[i] == t for i, t in enumerate(truth)]) >= 0.97
    assert all(got[i] // 4 == i // 4 for i in got)


def test_similar_groups_are_all_pairs_of_four_fifths(spark):
    """Against brute force: a family of texts near 0.7 to each other, and in it pairs around the threshold of 0.8."""
    rng = np.random.default_rng(11)
    words = np.array([f"word{i}" for i in range(50_000)])
    core = list(rng.choice(words, 200))
    texts = []
    for i in range(250):
        text = core + list(rng.choice(words, 40))
        texts.append(" ".join(text))
        if i % 3 == 0:
            k = 4 + i % 60  # so many words of the end are others
            texts.append(" ".join(text[: len(text) - k] + list(rng.choice(words, k))))
    texts += ["a b c d e f g h", "a b c d e f g h i", "a b", "A  b", "x y z"]
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in (t.lower().split() for t in texts)]
    linked = {}
    for i, x in enumerate(sets):
        for j in range(i):
            if 5 * len(x & sets[j]) >= 4 * len(x | sets[j]):
                linked.setdefault(i, []).append(j)
                linked.setdefault(j, []).append(i)
    want = {}
    for i in range(len(texts)):
        todo = [] if i in want else [i]
        while todo:
            if (k := todo.pop()) not in want:
                want[k] = i
                todo += linked.get(k, [])
    similar = [len(x & y) / len(x | y) for x, y in zip(sets, sets[1:])]
    assert any(0.8 <= s < 0.83 for s in similar) and any(0.77 < s < 0.8 for s in similar) and 0 < len(linked) < len(texts)
    got = {r.doc_id: r.component_id for r in simhash.similar_groups(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got == want


def test_texts_below_four_fifths_stay_apart(spark):
    """Pairs of similarity 0.7, just below 0.8, 0.8 and 0.85; a pair links if, and only if, it has 0.8."""
    rows, want = [], {}
    for g, cut in enumerate([50] * 60 + [34] * 60 + [33] * 60 + [24] * 60):
        words = [f"g{g}w{i}" for i in range(304)]  # 300 shingles; without the last k words (300 - k) / 300 are left, here k more are others
        rows += [(2 * g, " ".join(words)), (2 * g + 1, " ".join(words[:-cut] + [f"g{g}x{i}" for i in range(cut)]))]
        want |= {2 * g: 2 * g, 2 * g + 1: 2 * g + ((300 - cut) * 5 < 4 * (300 + cut))}
    got = {r.doc_id: r.component_id for r in simhash.similar_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want and len(set(want.values())) == 360


def test_pipeline_stages_keep_columns_and_rules(spark, odd, tmp_path):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    n = docs.count()
    quality_stage, near, clean, mix, tokens = (f for _, f in corpus_pipeline.STAGES)
    kept = quality_stage(spark, docs, sf).persist()
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    ids = {r.doc_id for r in kept.select("doc_id").collect()}
    assert np.mean([d in ids for d, q in labels.items() if q == 1]) > 0.95 and np.mean([d in ids for d, q in labels.items() if q == 0]) < 0.1
    once = near(spark, kept, sf).persist()
    assert once.groupBy("text").count().filter("count > 1").count() == 0
    ready = clean(spark, once, sf).persist()
    item = spark.read.parquet(f"{sf}/benchmark.parquet").first().text
    planted = ready.limit(1).withColumns({"doc_id": F.lit(-1).cast("long"), "text": F.concat(F.lit("Words before. "), F.lit(item), F.lit(" Words after."))})
    assert clean(spark, ready.unionByName(planted), sf).filter("doc_id = -1").count() == 0
    mixed = mix(spark, ready, sf)
    assert once.columns == ready.columns == mixed.columns == docs.columns and mixed.count() > ready.count()
    assert tokens(spark, mixed, sf).count() == mixed.count() and n > kept.count() > once.count()
    assert near(spark, odd, sf).count() >= 5


def test_pipeline_decides_by_row(spark, tmp_path):
    """Null and repeated ids: what one row holds says nothing about another row of its id."""
    sf = "/root/testdata/sf0.01"
    item = spark.read.parquet(f"{sf}/benchmark.parquet").first().text
    dirty, clean_text, other = f"Words before. {item} Words after.", "a clean text of its own words " * 5, "quite another text with nothing in common at all " * 4
    ids = [None, None, None, None, 5, 5, 5, 6, 6]
    texts = [dirty, clean_text, clean_text, other, dirty, "only five has these words here " * 3, clean_text, "six words of six stand twice here", "six words of six stand twice here"]
    docs = spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in zip(ids, texts)], "doc_id long, text string, lang string, source string, n_chars long")
    _, near, clean, mix, _ = (f for _, f in corpus_pipeline.STAGES)
    left = sorted((r.doc_id or 0, r.text) for r in clean(spark, docs, sf).collect())
    assert left == sorted((i or 0, t) for i, t in zip(ids, texts) if t != dirty)
    once = [(r.doc_id, r.text) for r in near(spark, docs, sf).collect()]
    assert sorted(t for _, t in once) == sorted(set(texts)) and {i for i, t in once if t in (clean_text, dirty)} == {5} and {i for i, t in once if t == other} == {None}
    many = spark.createDataFrame([(None if k % 2 else 1, f"{k} " + "word " * (k % 7 + 3), "en", "ab"[k % 2], 1) for k in range(400)], docs.schema)
    size = F.size(F.split(F.trim("text"), " "))
    target = {r.source: r.target for r in mixing.mix_sources(many).groupBy("source").agg(F.max("target").alias("target")).collect()}
    got = {r.source: r.n for r in mix(spark, many, sf).groupBy("source").agg(F.sum(size).alias("n")).collect()}
    assert all(abs(got[s] - t) < 0.02 * t for s, t in target.items())
    rated = mixing.mix_sources(many, rows_per_block=50)
    assert rated.count() == 400


@pytest.mark.parametrize("stage", range(5))
def test_every_stage_takes_odd_rows(spark, odd, empty, stage):
    """Null, repeated and long rows, and columns named like those that a stage or its operator makes for itself."""
    sf = "/root/testdata/sf0.01"
    names = ["row", "row_", "stays", "gone", "text_key", "of_row", "copies", "copy", "at", "component_id", "taken", "rate", "item_id", "label_id", "start", "order", "turn"]
    name, f = corpus_pipeline.STAGES[stage]
    wide = odd.select("*", *[F.lit(n).alias(n) for n in names])
    out = f(spark, wide, sf)
    rows = out.collect()
    if name == "token_ids":
        assert sorted(r.doc_id or 0 for r in rows) == sorted(r[0] or 0 for r in ROWS)
    else:
        assert out.columns == wide.columns and {r.doc_id for r in rows} <= {r[0] for r in ROWS} and all(r.copies == "copies" for r in rows)
    if name == "near_duplicates":
        assert sorted(r.doc_id or 0 for r in rows) == [0, 1, 2, 4, 6, 7]  # of the two equal rows one, of the three without a word that with the least id
    if name == "decontamination":
        assert len(rows) == len(ROWS)
    assert f(spark, empty, sf).count() == 0


def test_mixing_rates_solve_the_dual(spark):
    """Each source's rates against a plain bisection of its multiplier, and the hot id spread over blocks."""
    rng = np.random.default_rng(3)
    rows = [(int(i), "w " * int(n), s) for s, share in (("a", 100), ("b", 300), ("c", 50)) for i, n in enumerate(rng.integers(1, 200, share))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {}
    for r in mixing.mix_sources(docs).collect():
        got.setdefault(r.source, []).append(r)
    for some in got.values():
        sizes, target = np.array([r.size for r in some]), some[0].target
        low, high = -1e7, 1e7
        for _ in range(200):
            mid = (low + high) / 2
            low, high = (mid, high) if (sizes * np.minimum(2, np.exp(np.minimum(mid * sizes / sizes.mean(), 50)))).sum() < target else (low, mid)
        want = np.minimum(2, np.exp(np.minimum(low * sizes / sizes.mean(), 50)))
        assert np.allclose([r.rate for r in some], want, atol=1e-5)
        assert abs(sum(r.taken for r in some) - target) <= 0.01 * target
    hot = docs.withColumn("doc_id", F.lit(1).cast("long"))
    assert sum(r.taken for r in mixing.mix_sources(hot, rows_per_block=50).collect()) == pytest.approx(1.5 * sum(len(r[1].split()) for r in rows), rel=0.01)


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def of_long(x, seed):
    return xxhash.xxh64_intdigest((x & (1 << 64) - 1).to_bytes(8, "little"), seed=seed & (1 << 64) - 1)


def units(term, k):
    """The five uniform numbers of a term's draws for a sample."""
    one, two = (xxhash.xxh64_intdigest((2 * k + i).to_bytes(4, "little"), seed=of_long(term, 42)) for i in (0, 1))
    unit = lambda x, shift, width: ((x >> shift & (1 << width) - 1) + 0.5) / (1 << width)
    return unit(one, 0, 32), unit(one, 32, 32), unit(two, 0, 24), unit(two, 24, 24), unit(two, 48, 16)


def weights_of(text):
    return Counter(signed(xxhash.xxh64_intdigest(w, seed=42)) for w in text.encode().split())


def draws_of_spark(spark, texts, samples=64):
    """(term, k) -> r and ln(c), and weight -> ln(weight), with the logarithms that Spark computes."""
    terms = {t for text in texts for t in weights_of(text)}
    rows = [(t, k, *units(t, k)) for t in terms for k in range(samples)]
    df = spark.createDataFrame(rows, "t long, k int, a double, b double, c double, d double, e double")
    out = {(r.t, r.k): (r.r, r.c) for r in df.select("t", "k", (-F.ln(F.col("a") * F.col("b"))).alias("r"), F.ln(-F.ln(F.col("c") * F.col("d"))).alias("c")).collect()}
    most = max(n for text in texts for n in weights_of(text).values())
    return out | {r.n: r.l for r in spark.range(1, most + 1).select(F.col("id").alias("n"), F.ln(F.col("id").cast("double")).alias("l")).collect()}


def plain_signature(text, samples=64, draws=None, kept=None):
    """The 16-bit samples, term by term, from the definition."""
    out = []
    for k in range(samples):
        ranks = []
        for t, weight in weights_of(text).items():
            a, b, c, d, shift = units(t, k)
            r, log_c = draws[t, k] if draws else (-math.log(a * b), math.log(-math.log(c * d)))
            log_weight = draws[weight] if draws else math.log(weight)
            if kept is not None:
                kept[t, k], kept[weight] = (r, log_c), log_weight
            ranks.append(log_c - r * (float(math.floor(log_weight / r + shift)) - shift + 1.0))
        out.append(f"{of_long(struct.unpack('<q', struct.pack('<d', min(ranks)))[0], 42) & 0xFFFF:04x}")
    return out


def test_fingerprints_equal_a_plain_version(spark):
    texts = ["one two two three three three", "a b c d e f g h a b a", "word", "many words " * 20 + "and a few of them once"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.fingerprint for r in fingerprint.fingerprints(docs).collect()}
    pairs = {r.doc_id: r.fingerprint for r in fingerprint.fingerprints_with_next(docs).collect()}
    assert got == pairs
    of_spark = draws_of_spark(spark, texts)
    for i, text in enumerate(texts):
        want = plain_signature(text, draws=of_spark)
        assert [got[i][4 * k : 4 * k + 4] for k in range(len(want))] == want  # all samples, over draws with Spark's own logarithms
    own = {}
    for text in texts:
        plain_signature(text, draws=None, kept=own)
    for key, draw in own.items():  # and those are the definition's, but for the last bits of a logarithm
        assert of_spark[key] == pytest.approx(draw, rel=1e-12, abs=1e-12)


def test_quality_scores_are_sums_of_looked_up_values(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = quality.train(docs, spark.read.parquet("/root/testdata/sf0.001/labels.parquet"))
    got = {r.doc_id: r.score for r in quality.score(docs, model).collect()}
    for r in docs.limit(50).collect():
        x, total = quality.features(r.text), model.intercept
        for f, (cuts, values) in enumerate(zip(model.cuts, model.tables)):
            total += values[bisect.bisect_right(cuts.tolist(), x[f])]
        for (a, b), values in zip(model.pairs, model.pair_tables):
            total += values[bisect.bisect_right(model.pair_cuts[a].tolist(), x[a]), bisect.bisect_right(model.pair_cuts[b].tolist(), x[b])]
        assert got[r.doc_id] == pytest.approx(1 / (1 + math.exp(-total)), abs=1e-9)


def test_quality_fit_follows_a_plain_boosting():
    """One feature, two leaves: the best cut by trying each, its leaves' steps, over and over."""
    rng = np.random.default_rng(9)
    x = rng.integers(0, 12, 300).astype(float)
    y = (rng.random(300) < np.where(x > 6, 0.8, 0.3)).astype(float)
    model = quality.fit(x[:, None], y, rounds=25, pair_rounds=0, leaves=2)
    cuts = model.cuts[0].tolist()
    bins = [bisect.bisect_right(cuts, v) for v in x]
    table, base = [0.0] * (len(cuts) + 1), math.log(y.mean() / (1 - y.mean()))
    for _ in range(25):
        p = [1 / (1 + math.exp(-base - table[b])) for b in bins]
        g, h = [sum(y[i] - p[i] for i, b in enumerate(bins) if b == k) for k in range(len(table))], [sum(p[i] * (1 - p[i]) for i, b in enumerate(bins) if b == k) for k in range(len(table))]
        gain = lambda c: sum(g[:c]) ** 2 / (sum(h[:c]) + 2) + sum(g[c:]) ** 2 / (sum(h[c:]) + 2)
        cut = max(range(1, len(table)), key=gain)
        for k in range(len(table)):
            part = slice(0, cut) if k < cut else slice(cut, None)
            table[k] += 0.15 * sum(g[part]) / (sum(h[part]) + 2)
    assert np.allclose(model.tables[0], table, atol=1e-9)


def test_a_long_text_is_searched_in_stretches():
    """The same hits whatever part of a text's passages is looked at together; copies of an item are found for each."""
    rng = np.random.default_rng(1)
    words = [f"w{i}" for i in range(400)]
    items = [(i, " ".join(rng.choice(words, 20)) + ". " + " ".join(rng.choice(words, 6))) for i in range(40)]
    text = " ".join(" ".join(rng.choice(words, 90)) + " " + t for _, t in items)
    freq = Counter(w for _, t in items for w in set(decontaminate.words_of(t)))
    index = decontaminate.build(items, freq, len(items), 26, 32, 0.5)
    tokens = decontaminate.words_of(text)
    ids = decontaminate._numbers(tokens, index.terms)
    found = []
    for slots in (10**9, 1, 50):
        found.append({})
        decontaminate._search_words(tokens, ids, index, 0.5, found[-1], slots)
    assert found[0] == found[1] == found[2] and len(found[0]) == len(items)


def test_passages_around_the_length_of_a_repeat(spark):
    """Passages of over fifty words that two documents share: from 400 bytes on all of one goes, below that none of it."""
    rng = np.random.default_rng(8)
    word = lambda n: "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), n))
    docs, want = [], {}
    for i, (words, size) in enumerate([(51, 399), (51, 400), (51, 401), (60, 399), (60, 400), (90, 700), (51, 306), (130, 1200)]):
        text = " ".join(word(max(2, size // words - 1)) for _ in range(words - 1))
        passage = f"{text} {word(max(1, size - len(text) - 1))}"
        assert len(passage) == size and len(passage.split()) == words
        for k in range(2):  # each between words of its document's own, told apart from the other's beside the passage
            docs.append((2 * i + k, f"{word(300)}{k}#{passage}#{k}{word(200)}"))
            want[2 * i + k] = size + 2 if size + 2 >= 400 else 0  # the two marks beside it are shared too
    docs.append((99, word(2_000)))
    got = {r.doc_id: (r.n_removed, r.n_spans) for r in suffix_dedup.remove_repeats(spark.createDataFrame(docs, "doc_id long, text string"), length=400).collect()}
    assert got == {d: (n, int(n > 0)) for d, n in (want | {99: 0}).items()}


def test_entry_works_without_this_subpackage():
    import subprocess
    import sys
    from pathlib import Path

    code = "import sys; sys.modules['weftline.llm'] = None; import __spark_entry__ as e; q = e.queries(); assert 'pipeline' not in q and 'retrieve' in q; assert set(e.oracle_sql()) <= set(q)"
    assert subprocess.run([sys.executable, "-c", code], cwd=Path(__file__).resolve().parents[2]).returncode == 0


def test_workers_give_memory_back_and_get_few_texts_at_once(spark, monkeypatch):
    given = []
    monkeypatch.setattr(common, "give_back", lambda: given.append(1))
    assert list(common.frugal(lambda xs: (x + 1 for x in xs))([1, 2])) == [2, 3] and given == [1]
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    sizes = lambda batches: (pa.RecordBatch.from_arrays([pa.array([len(b)])], ["n"]) for b in batches)
    found = common.written(spark.range(0, 3000, 1, 1).mapInArrow(sizes, "n long"), "sizes", batch_rows=1000)
    assert [r.n for r in found.collect()] == [1000] * 3 and spark.conf.get(name) == before
    found = common.written(spark.range(0, 3000, 1, 1).mapInArrow(sizes, "n long"), "sizes")
    assert [r.n for r in found.collect()] == [3000] and spark.conf.get(name) == before


def test_a_written_table_leaves_no_shuffle_files(spark):
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name)
    blocks = spark._jvm.org.apache.spark.SparkEnv.get().blockManager()
    root = [str(d) for d in blocks.diskBlockManager().localDirsString()]
    files = lambda: {f for d in root for f in glob.glob(f"{d}/**/shuffle_*.data", recursive=True)}
    there = files()
    found = common.written(spark.range(20_000).withColumn("k", F.xxhash64("id")).repartition(3, "k"), "shuffled")
    for _ in range(50):  # they are removed beside the query
        if not files() - there:
            break
        time.sleep(0.1)
    assert not files() - there and found.count() == 20_000 and spark.conf.get(name) == before


def test_sets_are_fetched_alike_whether_nodes_are_sent_or_shuffled(spark, monkeypatch):
    rng = np.random.default_rng(5)
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 500, 60)) for _ in range(30)]
    texts += [t + " one more" for t in texts[::2]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found, plans = [], []
    monkeypatch.setattr(simhash, "written", lambda df, label, *more: (label == "similar-sets" and plans.append(df._jdf.queryExecution().optimizedPlan().toString()), common.written(df, label, *more))[1])
    for most in (1_000_000, -1):
        monkeypatch.setattr(simhash, "MOST_SENT", most)
        found.append({r.doc_id: r.component_id for r in simhash.similar_groups(docs).collect()})
    half = len(plans) // 2
    assert found[0] == found[1] and len(set(found[0].values())) == 30
    assert half and all("broadcast" in p for p in plans[:half]) and not any("strategy=broadcast" in p for p in plans[half:])


def test_near_copies_of_one_text_are_not_compared_in_pairs(spark, monkeypatch):
    """A family around one text, most of its pairs above 0.8 and many below, and two texts apart; whole sets decide, but about few pairs."""
    rng = np.random.default_rng(8)
    core = [f"word{i}" for i in range(150)]
    texts = [" ".join(core)]
    for i in range(300):
        text = list(core)
        for k in rng.choice(150, 1 + i % 3, replace=False):
            text[k] = f"edit{i}"
        texts.append(" ".join(text))
    texts += ["quite another text of its own words here", " ".join(core[:75])]
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (t.split() for t in texts)]
    similar = [5 * len(x & y) >= 4 * len(x | y) for i, x in enumerate(sets[1:301]) for y in sets[1 : 1 + i]]
    assert all(5 * len(sets[0] & x) >= 4 * len(sets[0] | x) for x in sets[:301]) and 0.1 < np.mean(similar) < 0.95
    compared = []
    monkeypatch.setattr(simhash, "written", lambda df, label, *more: (out := common.written(df, label, *more), label == "similar-candidates" and compared.append(out.count()))[0])
    got = {r.doc_id: r.component_id for r in simhash.similar_groups(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got == {i: 0 if i < 301 else i for i in range(303)}
    assert sum(compared) < 5 * len(texts)


def test_few_ranks_are_drawn_and_the_least_is_found(spark, monkeypatch):
    """Fingerprints don't change by passing over ranks that can't be least, even if most texts have to be signed again."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    docs = docs.union(spark.createDataFrame([(-1, ""), (-2, None), (-3, "of few words"), (-4, "again " * 400)], docs.schema))
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    want = {r.doc_id: r.fingerprint for r in fingerprint.sign(rows, ["doc_id"], "text", 8).collect()}
    for reach in (14.0, 3.0):  # at 3 a text has some sample beyond it in one of three cases
        monkeypatch.setattr(fingerprint, "_REACH", reach)
        got = {r.doc_id: r.fingerprint for r in fingerprint.sign(rows, ["doc_id"], "text", 8, sure=False).collect()}
        assert all(f in (None, want[i]) for i, f in got.items()) and len(got) == len(want)
        assert {got[i] for i in (-1, -2)} == {want[-1]} and got[-3] == want[-3]
        assert {r.doc_id: r.fingerprint for r in fingerprint.fingerprints_with_next(docs, samples=8).collect()} == want
    assert None in got.values()
    terms = spark.range(20000).select(F.xxhash64("id").alias("t"), F.lit(14 / 300).alias("bound"), F.lit(1.0).alias("single"))
    assert terms.filter(fingerprint._within(F.col("t"), F.col("bound"), F.col("single"), 0)).count() < 4000


def test_new_segments_are_encoded_side_by_side(monkeypatch):
    """Words that are new to the memo go to the tokenizer as a few texts, and get the ids that they have alone."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    ours, library = SegmentEncoder(path, "lead", memo_limit=5000), _library(path)
    rng = np.random.default_rng(3)
    words = ["".join(rng.choice(list("aeionrst.,#é1<|>'\t"), rng.integers(1, 9))) for _ in range(4000)] + ["<|endoftext|>", "x<|endoftext|>y", "日本語", "don't", "\x1c.", "a\u2028"]
    calls = []
    monkeypatch.setattr(ours, "_ids", lambda some, alone=ours._ids: calls.append(len(some)) or alone(some))
    ours.encode(pa.array([" ".join(words)]))
    assert sum(calls) < len(words) / 3
    got = ours._side_by_side(pa.array([w for w in words if w.strip() == w], pa.large_string())).to_pylist()
    assert got == [np.array(library.encode(" " + w, add_special_tokens=False).ids, np.uint32).tobytes() for w in words if w.strip() == w]
    for _ in range(3):  # the memo overflows
        texts = [" ".join(rng.choice(words, 300)) for _ in range(20)]
        ids, counts = ours.encode(pa.array(texts))
        want = [library.encode(t, add_special_tokens=False).ids for t in texts]
        assert counts.tolist() == list(map(len, want)) and ids.tolist() == [i for w in want for i in w]


def test_segments_of_an_earlier_slice_are_not_encoded_again(monkeypatch):
    """Words that each slice has once come from the store with the same ids, within its bytes."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    library, rng = _library(path), np.random.default_rng(6)
    words = list(dict.fromkeys("".join(rng.choice(list("aeionrst.é"), rng.integers(3, 9))) for _ in range(3000)))
    texts = [" ".join(["first", *rng.permutation(words)[: len(words) - 100 * k]]) + " " + " ".join(f"new{k}x{i}" for i in range(50)) for k in range(4)]
    for store_bytes, most in ((64_000_000, len(words) + 200), (60_000, 4 * len(words)), (0, 4 * len(words))):
        ours, asked = SegmentEncoder(path, "lead", store_bytes=store_bytes), []
        monkeypatch.setattr(ours, "_side_by_side", lambda some, alone=ours._side_by_side: asked.append(len(some)) or alone(some))
        for text in texts:
            ids, counts = ours.encode(pa.array([text]))
            assert ids.tolist() == library.encode(text, add_special_tokens=False).ids and counts.tolist() == [len(ids)]
            assert sum(x.nbytes for x in ours.store) <= store_bytes
        assert sum(asked) <= most


def _plans_of_links(monkeypatch) -> list[str]:
    """A list that gets how Spark ran the join of each call of links() from now on."""
    plans, links = [], simhash.links

    def seen(prints):
        found = links(prints)
        found.collect()
        plans.append(found._jdf.queryExecution().executedPlan().toString())
        return found

    monkeypatch.setattr(simhash, "links", seen)
    return plans


def test_near_duplicates_of_the_pipeline_broadcast_no_exploded_fingerprints(spark, monkeypatch):
    plans = _plans_of_links(monkeypatch)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert simhash.similar_groups(docs).count() == docs.count()
    assert len(plans) == 1 and "SortMergeJoin" in plans[0] and "BroadcastHashJoin" not in plans[0]


def test_simhash_broadcasts_no_exploded_fingerprints(spark, monkeypatch):
    plans = _plans_of_links(monkeypatch)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert simhash.near_duplicates(docs).count() == docs.count()
    assert len(plans) == 1 and "SortMergeJoin" in plans[0] and "BroadcastHashJoin" not in plans[0]
