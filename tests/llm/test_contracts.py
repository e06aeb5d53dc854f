"""The registered queries against brute-force versions, or SQL, on the small fixture."""

import base64
import hashlib
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import xxhash
from tokenizers import Tokenizer

import __spark_entry__ as entry
from tests.oracle import connect, same
from weftline.llm import oracle

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return sorted(spark.read.parquet(f"{SF}/documents.parquet").collect(), key=lambda r: r.doc_id)


def rows(spark, name):
    return sorted(entry.queries()[name](spark, SF).collect(), key=lambda r: r[0])


@pytest.mark.parametrize("name", sorted(oracle.oracle_sql()))
def test_query_equals_sql(spark, name):
    equal, got = same(spark, connect(SF), entry.queries()[name], oracle.oracle_sql()[name], SF)
    assert equal, got[1][:3]


def test_op1_language_on_held_out_rows(spark, docs):
    lang = {d.doc_id: d.lang for d in docs}
    out = rows(spark, "op1_language_id")
    assert [r.doc_id for r in out] == [d.doc_id for d in docs]
    held = [r for r in out if r.held_out]
    assert {r.doc_id for r in held} == {d.doc_id for d in docs if zlib.crc32(str(d.doc_id).encode()) % 5 == 0}
    assert np.mean([r.lang_pred == lang[r.doc_id] for r in held]) >= 0.95
    assert all(0 <= r.score <= 1 for r in out)


def test_op2_quality_on_held_out_rows(spark):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    out = rows(spark, "op2_quality")
    held = [r for r in out if r.held_out and r.doc_id in labels]
    assert np.mean([r.predicted == labels[r.doc_id] for r in held]) >= 0.85
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in out)


def test_op3_reaches_targets_and_reruns_agree(spark, docs):
    out = rows(spark, "op3_mix_sources")
    assert [(r.doc_id, r.taken) for r in out] == [(r.doc_id, r.taken) for r in rows(spark, "op3_mix_sources")]
    source = {d.doc_id: d.source for d in docs}
    words = {d.doc_id: len(d.text.encode().split()) for d in docs}
    total, taken, target = Counter(), Counter(), {}
    for r in out:
        s = source[r.doc_id]
        assert r.size == words[r.doc_id] and r.taken <= 2 * r.size
        total[s] += r.size
        taken[s] += r.taken
        target[s] = r.target
    assert sum(target.values()) == pytest.approx(1.5 * sum(total.values()))
    weights = {s: (3, 1, 2)[i % 3] for i, s in enumerate(sorted(total))}
    free = [s for s in total if target[s] < 2 * total[s] - 1e-6]
    assert len({round(target[s] / weights[s], 6) for s in free}) == 1
    assert all(target[s] / weights[s] <= target[free[0]] / weights[free[0]] + 1e-6 for s in total)
    assert all(abs(taken[s] - target[s]) <= 0.01 * target[s] + 2 for s in total)


def test_op4_finds_the_items_that_texts_hold(spark, docs):
    items = {r.item_id: r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    squeeze = lambda t: " ".join("".join(c if c.isalnum() else " " for c in t.lower()).split())
    want = {(d.doc_id, i) for d in docs for i, t in items.items() if squeeze(t) in squeeze(d.text)}
    assert {(r.doc_id, r.item_id) for r in rows(spark, "op4_decontaminate")} == want


def test_op5_fingerprints(spark, docs):
    out = rows(spark, "op5_fingerprint")[::-1]
    texts = [d.text for d in docs][::-1]
    after = texts[1:] + texts[:1]
    edited = [t[: len(t) - len(t) // 3] + n[: len(t) // 3] for t, n in zip(texts, after)]
    assert [r.n_chars for r in out] == list(map(len, texts))
    assert [r.edited_sha256 for r in out] == [hashlib.sha256(e.encode()).hexdigest() for e in edited]

    def jaccard(a, b):
        a, b = Counter(a.split()), Counter(b.split())
        return sum((a & b).values()) / max(1, sum((a | b).values()))

    assert abs(np.mean([r.near_edited - jaccard(t, e) for r, t, e in zip(out, texts, edited)])) < 0.02
    assert abs(np.mean([r.near_next - jaccard(t, n) for r, t, n in zip(out, texts, after)])) < 0.02
    by_text = {}
    for r, t in zip(out, texts):
        assert by_text.setdefault(t, r.fingerprint) == r.fingerprint


def test_op6_removes_every_repeated_string(spark, docs):
    data, size = [d.text.encode() for d in docs], 400
    seen = Counter(b[i : i + size] for b in data for i in range(len(b) - size + 1))
    for r, b in zip(rows(spark, "op6_suffix_dedup"), data):
        gone = np.zeros(len(b) + 1, int)
        for i in range(len(b) - size + 1):
            if seen[b[i : i + size]] > 1:
                gone[i : i + size] = 1
        kept = bytes(x for x, g in zip(b, gone) if not g)
        assert (r.n_bytes, r.n_removed, r.n_spans) == (len(b), gone.sum(), (np.diff(np.r_[0, gone]) == 1).sum())
        assert r.kept_sha256 == hashlib.sha256(kept).hexdigest()


def test_op7_and_op8_equal_the_library(spark, docs):
    plain = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    counts = [len(plain.encode(d.text, add_special_tokens=False).ids) for d in docs]
    assert [(r.n_tokens, r.n_bytes, r.over_limit) for r in rows(spark, "op7_token_counts")] == [(n, len(d.text.encode()), n > 2048) for n, d in zip(counts, docs)]
    byte = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    start = 0
    for r, d in zip(rows(spark, "op8_token_binary"), docs):
        ids = [*byte.encode(d.text, add_special_tokens=False).ids, 0]
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (d.doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_op9_digests(spark):
    pages = {r.page_id: (r.html or "").encode() for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    out = rows(spark, "op9_warc")
    assert len(out) == len(pages)
    assert all(r.payload_digest == base64.b32encode(hashlib.sha1(pages[r.page_id]).digest()).decode() and r.payload_bytes == len(pages[r.page_id]) for r in out)


def simhash(text, k):
    words = text.encode().lower().split()
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i : i + k]), seed=42) for i in range(max(1, len(words) - k + 1))] if words else []
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def smallest_reachable(ids, linked):
    at = list(range(len(ids)))

    def find(x):
        while at[x] != x:
            at[x] = at[at[x]]
            x = at[x]
        return x

    for i in range(len(ids)):
        for j in range(i):
            if linked(i, j):
                at[find(i)] = find(j)
    least = {}
    for i, x in enumerate(ids):
        least[find(i)] = min(x, least.get(find(i), x))
    return [least[find(i)] for i in range(len(ids))]


def test_op10_components(spark, docs):
    out = rows(spark, "op10_simhash")
    prints = [simhash(d.text, 3) for d in docs]
    assert [r.fingerprint for r in out] == [f"{p:016x}" for p in prints]
    assert [r.component_id for r in out] == smallest_reachable([d.doc_id for d in docs], lambda i, j: (prints[i] ^ prints[j]).bit_count() <= 3)
