"""Cross-tokenizer alignment, exact inner products and ranked search, against plain versions."""

import hashlib
import math
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from weftline.llm import alignment, inner_product, lexical, queries

SF = "/root/testdata/sf0.001"
A_PATH, B_PATH = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


# cross-tokenizer alignment


def plain_alignment(texts):
    """Whole texts, token by token; rows of (n_a, n_b, n_groups, n_links, n_best, count_sum, digest)."""
    a_tok, b_tok = Tokenizer.from_file(A_PATH), sentencepiece.SentencePieceProcessor(model_file=B_PATH)
    a_tok.encode_special_tokens = True
    odd = [b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255)]
    letter = {chr(b): b for b in range(256) if b not in odd} | {chr(256 + i): b for i, b in enumerate(odd)}

    def b_bytes(i):
        return bytes([int(b_tok.id_to_piece(i)[3:5], 16)]) if b_tok.is_byte(i) else b_tok.id_to_piece(i).replace("▁", " ").encode()

    per_doc = []
    for text in texts:
        groups = []
        if text:
            a, b = a_tok.encode(" " + text, add_special_tokens=False).ids, b_tok.encode(text)
            a_parts, b_parts = [bytes(letter[c] for c in a_tok.id_to_token(i)) for i in a], [b_bytes(i) for i in b]
            if b"".join(a_parts) == b"".join(b_parts) == (" " + text).encode():
                a_ends, b_ends = (np.cumsum([len(p) for p in x]).tolist() for x in (a_parts, b_parts))
                cuts = sorted(set(a_ends) & set(b_ends))
                low = 0
                for cut in cuts:
                    groups.append(([i for i, e in zip(a, a_ends) if low < e <= cut], [i for i, e in zip(b, b_ends) if low < e <= cut]))
                    low = cut
        per_doc.append(groups)
    counts = Counter()
    for groups in per_doc:
        counts.update({(x, y) for a, b in groups for x in a for y in b})
    most = Counter()
    for (a, _), n in counts.items():
        most[a] = max(most[a], n)
    out = []
    for groups in per_doc:
        links = [(x, y) for a, b in groups for x in a for y in b]
        text = ";".join(f"{','.join(map(str, a))}|{','.join(map(str, b))}" for a, b in groups)
        out.append((sum(len(a) for a, _ in groups), sum(len(b) for _, b in groups), len(groups), len(links), sum(counts[p] == most[p[0]] for p in links), sum(counts[p] for p in links), hashlib.sha256(text.encode()).hexdigest() if groups else ""))
    return out


def columns(r):
    return r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256


def test_op12_equals_plain_version_on_the_fixture(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()
    got = sorted(queries.op12_cross_tokenizer(spark, SF).collect())
    assert [r.doc_id for r in got] == [d.doc_id for d in docs]
    assert [columns(r) for r in got] == plain_alignment([d.text for d in docs])


ODD_TEXTS = [
    None, "", " ", "  ", "a", " a", "a ", "a  b", "\n\na\r\nb\t", "naïve  café über", "<|endoftext|> and </s> <unk> <0x41>", "a▁b", "日本語の 文字 です", "🙂🙂 👩‍👩‍👧 x", "a b   c", "　x y", "don't we'll I'm", "x" * 3000, "word " * 700,
    "      many      spaces      ", "é́ ̈b", "a\x00b", "123 4567 89.0, (x)", "The cat. The cat.", "The cat. The cat.", "\x85 a\x1cb", "tab\tand more", "ünïcödé wörds ünïcödé", "a​b c﻿d",
]


def test_alignment_of_odd_texts_repeats_and_extra_columns(spark, monkeypatch):
    rows = [(None if i % 7 == 3 else i // 2, t, i) for i, t in enumerate(ODD_TEXTS * 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, key int").withColumns({"chunk": F.lit("x"), "n_a": F.lit(1), "a": F.lit(2), "times": F.lit(3)}).repartition(3)
    monkeypatch.setattr(alignment, "MEMO_BYTES", 2_000)  # only this process; the workers' bound is tested below
    got = alignment.align(df.withColumnRenamed("key", "at"), A_PATH, B_PATH, chunk_bytes=200)
    want = plain_alignment([t for _, t, _ in rows])
    assert sorted(map(str, ((r.doc_id, *columns(r)) for r in got.documents.collect()))) == sorted(map(str, ((i, *w) for (i, _, _), w in zip(rows, want))))
    assert got.pairs.filter("best").count() > 0 and got.groups.count() == got.groups.select("key").distinct().count()
    named = alignment.align(df.select(F.col("key").cast("string").alias("name"), "text"), A_PATH, B_PATH, id_col="name").documents
    assert {r.name: columns(r) for r in named.collect()} == {str(k): w for (_, _, k), w in zip(rows, want)}
    assert alignment.align(df.limit(0), A_PATH, B_PATH).documents.count() == 0


def test_alignment_forgets_and_goes_on_and_takes_invalid_utf8():
    import pyarrow as pa

    enc = alignment.Aligner(A_PATH, B_PATH)
    one = alignment.encoded(enc, pa.array([b"some words here", b"\xff\xfe bad", b"some words"]))
    assert one.stats[1].tolist() == [0, 0, 0, 0] and one.digests[1] == "" and enc.held > 0
    enc.forget()
    again = alignment.encoded(enc, pa.array([b"some words here", b"\xff\xfe bad", b"some words"]))
    assert again.digests == one.digests and again.stats.tolist() == one.stats.tolist()


# exact top-k by inner product


def plain_top(rows, is_query, k, scale=256):
    usable = [(i, [math.floor(scale * v) for v in x]) for i, x in rows if x is not None and all(v is not None and math.isfinite(v) and abs(v) < 1e15 for v in x)]
    out = []
    for at, (query, q) in enumerate(usable):
        if is_query(query):
            best = sorted((-sum(a * b for a, b in zip(q, v)), i is None, i or 0) for other, (i, v) in enumerate(usable) if other != at and len(v) == len(q))[:k]
            out += [(query, rank, None if nameless else i, -s) for rank, (s, nameless, i) in enumerate(best, 1)]
    return sorted(out, key=str)


@pytest.mark.parametrize("bounds", [(16_000_000, 4_000_000, 16_000_000, 1_000_000), (2_000, 400, 600, 50)])
def test_inner_products_of_odd_vectors_equal_plain_version(spark, monkeypatch, bounds):
    for name, value in zip(("SAMPLE_BYTES", "HEAD_BYTES", "WAVE_BYTES", "TILE"), bounds):
        monkeypatch.setattr(inner_product, name, value)
    rng = np.random.default_rng(5)
    rows = []
    for i in range(260):
        x = [float(v) for v in np.round(rng.normal(size=int(rng.choice([0, 1, 3, 9]))) * rng.choice([0.01, 1, 1, 40]), 1)]
        if x and rng.random() < 0.1:
            x[0] = [None, math.nan, math.inf, -math.inf, 1e30][i % 5]
        rows.append((None if i % 23 == 0 else i // 2, None if i % 29 == 0 else x))
    rows += rows[:40] + [rows[6]] * 25  # copies, and many equal rows
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({"row": F.lit(1), "v": F.lit(2), "score": F.lit(3), "d": F.lit(4)}).repartition(3)
    got = inner_product.top_inner_products(df, F.col("vec_id") % 5 == 0, k=4)
    assert sorted((tuple(r) for r in got.collect()), key=str) == plain_top(rows, lambda i: i is not None and i % 5 == 0, 4)
    assert inner_product.top_inner_products(df.limit(0), F.col("vec_id") % 5 == 0).count() == 0


def test_inner_products_prune_by_length():
    """A query skips vectors that are too short, and finds the same."""
    rng = np.random.default_rng(2)
    v = np.floor(rng.normal(size=(3000, 16)) * 100 * np.geomspace(10, 0.01, 3000)[:, None]).astype(np.int64)
    v = v[np.argsort(-(v**2).sum(1), kind="stable")]
    turn = inner_product.rotation(v[:500].astype(float))
    search = inner_product.Search(inner_product.Side(v[:20], turn), np.arange(20), np.full(20, -(1 << 60)), 5)
    opened = []
    plain = search._open
    search._open = lambda mine, vectors, slack: opened.append(len(mine)) or plain(mine, vectors, slack)
    for a in range(0, 3000, 100):
        rows = np.arange(a, min(a + 100, 3000))
        search.add(inner_product.Side(v[rows], turn), rows, rows, np.zeros(len(rows), bool))
    assert len(opened) < 30  # the last blocks meet no query
    scores = v[:20] @ v.T
    scores[np.arange(20), np.arange(20)] = -(1 << 62)
    for q in range(20):
        assert search.id[q].tolist() == sorted(range(3000), key=lambda i: (-scores[q, i], i))[:5]


# ranked search


def plain_ranked(docs, items, k):
    term = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
    fold = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})
    counted = [(i, Counter(term.findall((t or "").translate(fold)))) for i, t in docs]
    counted = [(i, c) for i, c in counted if c]
    n_docs, n_terms = len(counted), sum(sum(c.values()) for _, c in counted)
    df = Counter(t for _, c in counted for t in c)
    out = []
    for item, text in items:
        wanted = Counter(term.findall((text or "").translate(fold)))
        found = []
        for i, c in counted:
            m = 100 - 25 + (25 * sum(c.values()) * n_docs) // n_terms
            s = sum(times * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 12 * m)) for t, times in wanted.items() if t in c)
            if s > 0:
                found.append((-s, i is None, i or 0))
        out += [(item, rank, None if nameless else i, -s) for rank, (s, nameless, i) in enumerate(sorted(found)[:k], 1)]
    return sorted(out, key=str)


@pytest.mark.parametrize("item_bytes", [lexical.ITEM_BYTES, 60])
def test_ranked_search_of_odd_rows_equals_plain_version(spark, monkeypatch, item_bytes):
    rng = np.random.default_rng(3)
    words = ["The", "the", "THE", "cat", "Ünï", "ünï", "x1", "日本", "rare", "a_b", "no\x00pe", "É", "é"]
    docs = [(None if i % 11 == 0 else i // 2, " ".join(rng.choice(words, int(rng.integers(0, 30))))) for i in range(150)] + [(5, None), (6, ""), (7, " .,;\n"), *[(900 + i, "the cat") for i in range(70)], (None, "the cat")]
    items = [(1, "the cat"), (2, "the THE rare rare"), (2, "the THE rare rare"), (3, ""), (4, None), (5, "unknown words"), (None, "日本, x1!"), (6, "ünï É a b"), (7, "...")]
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"score": F.lit(1), "rank": F.lit(2), "item_id": F.lit(3), "n": F.lit(4)}).repartition(4)
    i = spark.createDataFrame(items, "item_id long, text string").withColumns({"doc_id": F.lit(1), "item": F.lit(2)})
    got = lexical.ranked_documents(d, i, k=6, item_bytes=item_bytes)
    assert sorted((tuple(r) for r in got.collect()), key=str) == plain_ranked(docs, items, 6)
    assert lexical.ranked_documents(d.limit(0), i).count() == 0 and lexical.ranked_documents(d, i.limit(0)).count() == 0


def test_ranked_search_by_text_ids(spark):
    docs = [("b", "one two"), ("a", "one two"), ("c", "two"), (None, "one two")]
    got = lexical.ranked_documents(spark.createDataFrame(docs, "name string, body string"), spark.createDataFrame([("q", "one")], "item string, text string"), 2, "name", "body", "item", "text")
    assert [(r.item, r["rank"], r.name) for r in sorted(got.collect(), key=lambda r: r["rank"])] == [("q", 1, "a"), ("q", 2, "b")]


def test_terms_of_long_texts_are_whole(monkeypatch):
    monkeypatch.setattr(lexical, "STRETCH", 10)
    text = "Abc déf-ghi " * 50 + "z" * 100
    assert [t for part in lexical.terms_of(text.encode()) for t in part] == re.findall(rb"[a-z\x80-\xff]+", text.encode().lower())


def test_impacts_of_huge_counts_are_exact():
    n, n_docs, n_terms = np.array([10**7, 3]), 10**12, 7 * 10**14
    got = lexical.impacts(np.array([5000, 1]), np.array([4, 1]), n, n_docs, n_terms)
    assert got.tolist() == [w * (10**9 * tf // (1000 * tf + 12 * (75 + 25 * int(x) * n_docs // n_terms))) for w, tf, x in zip([5000, 1], [4, 1], n)]
