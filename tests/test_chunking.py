"""Packing of units into chunks, against a plain version that goes unit by unit."""

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from weftline.operators import chunking, store
from weftline.operators.components import components


def longest_tail(text, budget, count):
    """By halving, as counts are taken to grow with length."""
    low, high, best = 1, len(text), ""
    if budget <= 0 or not text or count(text) <= budget:
        return text if text and budget > 0 else ""
    while low <= high:
        mid = (low + high) // 2
        if count(text[-mid:]) <= budget:
            low, best = mid + 1, text[-mid:]
        else:
            high = mid - 1
    return best


class Plain:
    """One unit after the other goes into an open chunk; a full one is closed, and its end opens the next."""

    def __init__(self, most, overlap, count):
        self.most, self.overlap, self.count = most, overlap, count
        self.done, self.open, self.size = [], [], 0

    def close(self):
        text = chunking.join_units(self.open)
        self.done += [text] if text else []
        units, self.open, self.size = self.open, [], 0
        if self.overlap <= 0:
            return
        last = self.count(units[-1])
        room = max(self.overlap, last) if last <= max(self.overlap, 2 * self.most // 3) else self.overlap
        for unit in reversed(units):
            n = self.count(unit)
            if not self.open and n > room:
                part = longest_tail(unit, room, self.count)
                self.open, self.size = ([part], self.count(part)) if part else ([], 0)
                return
            if self.open and self.size + n > room:
                return
            self.open, self.size = [unit, *self.open], self.size + n

    def add(self, unit):
        n = self.count(unit)
        if self.open and self.size + n > self.most:
            self.close()
            if self.open and self.size + n > self.most:
                part = longest_tail(chunking.join_units(self.open), self.most - n, self.count) if n < self.most else ""
                self.open, self.size = ([part], self.count(part)) if part else ([], 0)
        self.open, self.size = [*self.open, unit], self.size + n
        if self.size >= self.most:
            self.close()

    def chunks(self, units):
        for unit in units:
            self.add(unit)
        rest = chunking.join_units(self.open)
        return self.done + ([rest] if rest and (not self.done or self.done[-1] != rest) else [])


WORD = st.text("ab é中", min_size=1, max_size=9).map(str.strip).filter(bool)
UNIT = st.lists(WORD, min_size=1, max_size=12).map(" ".join)


@settings(max_examples=300, deadline=None)
@given(st.lists(UNIT, max_size=25), st.integers(3, 30), st.sampled_from([0, 0.1, 0.3, 0.5, 0.9]))
def test_chunks_equal_a_plain_version(units, most, ratio):
    units = [u for u in units if chunking.count_tokens(u) <= most]  # longer ones are cut to windows first
    assert chunking.pack(units, most, ratio) == Plain(most, int(most * ratio), chunking.count_tokens).chunks(units)


def test_chunks_by_a_public_vocabulary(spark):
    count = chunking.bpe_counter(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    assert count("") == 0 and count("hello world") == 2
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").selectExpr("cast(doc_id as string) AS id", "text AS content").limit(40)
    heads = docs.selectExpr("id", "id AS doc_id", "'head' AS content")
    got = chunking.chunks(docs, heads, 64, 0.1, count).collect()
    assert {type(r.doc_id) for r in got} == {str} and max(count(r.content) for r in got) <= 64 + 8
    text = {r.id: r.content for r in docs.collect()}
    from weftline.functions.text import sentences

    units = {r.id: r.u for r in docs.select("id", sentences("content").alias("u")).collect()}
    for i in text:
        if all(count(u) <= 64 for u in units[i]):
            assert [r.content for r in sorted((r for r in got if r.doc_id == i and r.chunk_index), key=lambda r: r.chunk_index)] == Plain(64, 6, count).chunks(units[i])


@settings(max_examples=15, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 20), st.integers(0, 20)), min_size=1, max_size=30))
def test_components_equal_union_find(spark, edges):
    root = {n: n for e in edges for n in e}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a int, b int")).collect()}
    assert got == {n: find(n) for n in root}


def test_closure_takes_few_rounds_for_a_long_chain(spark, monkeypatch):
    calls = []
    plain = store.components
    monkeypatch.setattr(store, "components", lambda edges: calls.append(1) or plain(edges, rounds=14))
    docs = spark.createDataFrame([(i, f"d{(i * 37) % 300}.pdf", f"d{((i + 1) * 37) % 300}.pdf") for i in range(300)] + [(999, "other.pdf_1", "other.pdf")], "id long, name string, source_name string")
    assert store.family_closure(docs, docs.filter("id = 7").select("name")).count() == 300 and calls
    assert [r.id for r in store.family_closure(docs, spark.createDataFrame([("other.pdf_5",)], "name string")).collect()] == [999]
    assert store.family_closure(docs, spark.createDataFrame([], "name string")).count() == 0
