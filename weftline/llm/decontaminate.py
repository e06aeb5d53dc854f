"""Benchmark decontamination: a BM25 index of the test items, searched with every training passage by block-max WAND.

Items are dealt to indexes by length: an index's stride is a power of two, 32 at least, that its items' words reach but don't
exceed. A passage is 2 * stride words, every stride words, so an item copied into a text lies whole within some passage, and
is looked for in passages of about its own length whatever the other items are. A passage's score for an item is BM25 with the passage's distinct words as the query. It is
retrieved if it reaches `share` of the score that the item's own words give; no number of hits is cut off.

As in WAND, an item's least telling words, which cannot reach half its threshold together, are left out of the first look:
only its other words have postings there. Items stand in blocks of like thresholds, and a posting of the first look holds
the greatest weight of its word in a block. A passage whose block maxima add up to less than a block's least threshold
skips the block; the items of the others are scored in full. A retrieved passage counts as a copy when it also has the
item's question and its answer: `overlap` of the word pairs of either.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_WORD = re.compile(r"\w+")
K1, B, BLOCK = 1.2, 0.75, 8
#: Words of one index, which is broadcast; a larger benchmark is searched in as many indexes as it takes.
INDEX_WORDS = 2_000_000
CHUNK_CHARS = 4_000_000


def words_of(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def question_and_answer(text: str) -> tuple[list[str], list[str]]:
    """An item's question and answer: its last line is the answer, or else its last sentence, or else its last third."""
    for pattern in (r"\n+", r"(?<=[.?!])\s+"):
        parts = [p for p in re.split(pattern, text) if _WORD.search(p)]
        if len(parts) > 1:
            return words_of(" ".join(parts[:-1])), words_of(parts[-1])
    words = words_of(text)
    cut = len(words) - len(words) // 3
    return words[:cut], words[cut:]


def _pairs(words: list[str]) -> set[tuple[str, ...]]:
    return set(zip(words, words[1:])) if len(words) > 1 else {tuple(words)} if words else set()


@dataclass
class Index:
    items: list  # ids, in the order of their thresholds
    texts: list[tuple[set, set]]  # word pairs of question and answer
    terms: dict[str, int]
    starts: np.ndarray  # full postings by term: item number, weight
    docs: np.ndarray
    weights: np.ndarray
    needed: np.ndarray  # score to reach, by item
    own: np.ndarray  # score of the item's own words
    first_starts: np.ndarray  # postings of the first look by term: block, greatest weight
    first_blocks: np.ndarray
    first_weights: np.ndarray
    block_needs: np.ndarray
    stride: int


def build(items: list[tuple], frequencies: dict[str, int], n_items: int, mean_words: float, stride: int, share: float, terms: dict[str, int] | None = None) -> Index:
    """Index of (id, text) items; frequencies: in how many of all n_items items each word is; terms: numbers of all words, which several indexes can share."""
    entries = []
    for item_id, text in items:
        counts = Counter(words_of(text))
        n = sum(counts.values())
        w = {t: float(np.log(1 + (n_items - frequencies[t] + 0.5) / (frequencies[t] + 0.5)) * c * (K1 + 1) / (c + K1 * (1 - B + B * n / max(mean_words, 1e-9)))) for t, c in counts.items()}
        own = sum(w.values())
        light, seen = set(), 0.0
        for t in sorted(w, key=lambda t: (w[t], t)):
            if seen + w[t] > share * own / 2:
                break
            seen += w[t]
            light.add(t)
        entries.append((share * own - seen, item_id, text, w, own, light))
    entries.sort(key=lambda e: (e[0], str(e[1])))
    terms = {} if terms is None else terms
    full: list[tuple[int, int, float]] = []
    first: dict[tuple[int, int], float] = {}
    for i, (_, _, _, w, _, light) in enumerate(entries):
        for t, x in w.items():
            k = terms.setdefault(t, len(terms))
            full.append((k, i, x))
            if t not in light:
                first[k, i // BLOCK] = max(first.get((k, i // BLOCK), 0.0), x)
    full.sort()
    looks = sorted((k, b, x) for (k, b), x in first.items())
    starts = lambda rows: np.searchsorted([r[0] for r in rows], np.arange(len(terms) + 1))
    needs = np.array([e[0] for e in entries])
    return Index(
        [e[1] for e in entries], [tuple(map(_pairs, question_and_answer(e[2]))) for e in entries], terms, starts(full), np.array([r[1] for r in full], np.int64), np.array([r[2] for r in full]),
        np.array([share * e[4] for e in entries]), np.array([e[4] for e in entries]), starts(looks), np.array([r[1] for r in looks], np.int64), np.array([r[2] for r in looks]), np.minimum.reduceat(needs, np.arange(0, len(needs), BLOCK)) if len(needs) else needs, stride,
    )


def _expand(starts: np.ndarray, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each posting of each of the terms: which of the terms it is of, and its place."""
    n = starts[terms + 1] - starts[terms]
    of = np.repeat(np.arange(len(terms)), n)
    return of, np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(starts[terms], n)


def _share(part: set[tuple[str, ...]], pairs: set, words: list[str]) -> float:
    """Share of a question's or answer's word pairs that a passage has; of a single word, whether it has it; 1 for nothing."""
    if not part:
        return 1.0
    if len(part) == 1 and len(alone := next(iter(part))) == 1:
        return float(alone[0] in words)
    return len(part & pairs) / len(part)


def _numbers(words: list[str], terms: dict[str, int]) -> np.ndarray:
    return np.fromiter(map(terms.get, words, repeat(-1)), np.int64, len(words))


def _search_words(words: list[str], ids: np.ndarray, index: Index, overlap: float, found: dict, slots: int = 1_000_000) -> None:
    """Put (score, question overlap, answer overlap) of the best passage of each item that is copied into `found`.

    The first look goes over as many passages at a time as make about `slots` pairs of passage and block.
    """
    stride, n_blocks = index.stride, len(index.block_needs)
    step = stride * max(1, slots // n_blocks)
    for a in range(0, max(1, len(words)), step):
        _search_stretch(words[a : a + step + 2 * stride], ids[a : a + step + 2 * stride], index, overlap, found, step // stride)


def _search_stretch(words: list[str], ids: np.ndarray, index: Index, overlap: float, found: dict, most: int) -> None:
    """_search_words() for passages 0 to most."""
    known = np.flatnonzero(ids >= 0)
    if not len(known):
        return
    n_blocks, stride = len(index.block_needs), index.stride
    of, place = _expand(index.first_starts, ids[known])
    slot = (known // stride)[of] * n_blocks + index.first_blocks[place]
    n_slots = (len(words) // stride + 1) * n_blocks
    own = np.bincount(slot, index.first_weights[place], n_slots)
    bound = own.copy()
    bound[:-n_blocks] += own[n_blocks:]  # passage j has the words of strides j and j + 1
    hits = np.flatnonzero(bound.reshape(-1, n_blocks)[: most + 1] >= index.block_needs - 1e-9)
    for passage, blocks in _grouped(hits, n_blocks):
        a, b = passage * stride, min(len(words), (passage + 2) * stride)
        terms = np.unique(ids[a:b])
        terms = terms[terms >= 0]
        _, place = _expand(index.starts, terms)
        scores = np.bincount(index.docs[place], index.weights[place], len(index.items))
        near = np.flatnonzero(scores >= index.needed - 1e-9)
        near = near[np.isin(near // BLOCK, blocks)]
        if len(near):
            pairs = _pairs(words[a:b])
            for i in near.tolist():
                question, answer = index.texts[i]
                q, r = (_share(part, pairs, words[a:b]) for part in (question, answer))
                if q >= overlap and r >= overlap and (best := (float(scores[i]), q, r)) > found.get(i, (0.0,)):
                    found[i] = best


def _grouped(hits: np.ndarray, n_blocks: int):
    passages = hits // n_blocks
    cuts = np.flatnonzero(np.diff(passages)) + 1
    for part in np.split(hits, cuts) if len(hits) else []:
        yield int(part[0]) // n_blocks, part % n_blocks


def search(text: str | None, index: Index, overlap: float = 0.5) -> dict[int, tuple[float, float, float]]:
    """Items copied into a whole text; a very long one is gone through piece by piece, the pieces sharing a passage."""
    return search_all(text, [index], overlap)[0]


def search_all(text: str | None, indexes: list[Index], overlap: float = 0.5) -> list[dict[int, tuple[float, float, float]]]:
    """As search(), for each of several indexes that share their terms."""
    found: list[dict[int, tuple[float, float, float]]] = [{} for _ in indexes]
    carried: list[list[str]] = [[] for _ in indexes]
    text, at = text or "", 0
    while at < len(text):
        stop = min(len(text), at + CHUNK_CHARS)
        while stop < len(text) and not text[stop].isspace():
            stop += 1
        fresh, at = words_of(text[at:stop]), stop
        ids = _numbers(fresh, indexes[0].terms)
        for k, index in enumerate(indexes):
            words = carried[k] + fresh
            _search_words(words, np.concatenate([_numbers(carried[k], index.terms), ids]), index, overlap, found[k])
            carried[k] = words[len(words) // index.stride * index.stride - 2 * index.stride if len(words) > 2 * index.stride else 0 :]
    return found


def contaminated(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", share: float = 0.5, overlap: float = 0.5, index_words: int = INDEX_WORDS
) -> DataFrame:
    """id, item_id, score, share (of the item's own score), question_overlap, answer_overlap: one row for each text and item copied into it.

    Every passage of every whole text is searched. Items with a null text or no word match nothing, nor do null or empty
    texts; null ids and repeated rows (of texts or items) are reported each; an empty table of either gives no rows. An
    index has at most about index_words words, whatever the size of the benchmark: a larger one is dealt to several
    sets of indexes by a hash of the item, with word frequencies over all items, so the result doesn't depend on that.
    """
    spark = docs.sparkSession
    id_type, item_type = docs.schema[id_col].dataType.simpleString(), items.schema[item_id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))

    def count(batches):
        for batch in batches:
            for text in batch.column(0).to_pylist():
                words = words_of(text)
                if words:
                    yield pa.RecordBatch.from_pydict({"term": [None, *sorted(set(words))], "n": [len(words)] + [1] * len(set(words))}, pa.schema([("term", pa.string()), ("n", pa.int64())]))

    texts = items.select(F.col(item_id_col).alias("item_id"), F.col(item_text_col).cast("string").alias("text")).filter("text IS NOT NULL")
    counted = texts.select("text").mapInArrow(count, "term string, n long")
    terms = counted.filter("term IS NOT NULL").groupBy("term").agg(F.sum("n").alias("n"))
    whole = counted.filter("term IS NULL").agg(F.count("*").alias("items"), F.sum("n").alias("words")).first()
    schema = f"id {id_type}, item_id {item_type}, score double, share double, question_overlap double, answer_overlap double"
    if not whole.items:
        return spark.createDataFrame([], schema).withColumnRenamed("id", id_col)
    shards = -(-whole.words // index_words)
    out = None
    for shard in range(shards):
        mine = texts.select("text").distinct().filter(F.pmod(F.xxhash64("text"), F.lit(shards)) == shard)  # copies of an item are searched for once
        own_terms = mine.select("text").mapInArrow(count, "term string, n long").filter("term IS NOT NULL").select("term").distinct()
        frequencies = {r.term: r.n for r in own_terms.join(terms, "term").collect()}
        classes: dict[int, list[tuple]] = {}
        for r in mine.collect():
            if n := len(words_of(r.text)):
                classes.setdefault(max(32, 1 << (n - 1).bit_length()), []).append((hashlib.sha256(r.text.encode()).hexdigest(), r.text))
        numbers = {t: k for k, t in enumerate(sorted(frequencies))}
        index = [build(some, frequencies, whole.items, whole.words / whole.items, stride, share, numbers) for stride, some in sorted(classes.items())]
        if not index:
            continue
        part = rows.mapInArrow(_searcher(spark.sparkContext.broadcast(index), overlap, rows_type(rows)), schema.replace(f"item_id {item_type}", "text_key string"))
        out = part if out is None else out.union(part)
    named = texts.select("item_id", F.sha2("text", 256).alias("key"))
    out = out.join(named, F.col("text_key") == F.col("key"))
    return out.select(F.col("id").alias(id_col), "item_id", "score", "share", "question_overlap", "answer_overlap")


def rows_type(df: DataFrame) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(df.schema[0].dataType)


def _searcher(shared, overlap: float, id_type: pa.DataType):
    def run(batches):
        indexes: list[Index] = shared.value
        schema = pa.schema([("id", id_type), ("text_key", pa.string()), *(pa.field(n, pa.float64()) for n in ("score", "share", "question_overlap", "answer_overlap"))])
        for batch in batches:
            out = []
            for doc_id, text in zip(batch.column(0), batch.column(1)):
                for index, found in zip(indexes, search_all(text.as_py(), indexes, overlap)):
                    for i, (s, q, r) in found.items():
                        out.append({"id": doc_id.as_py(), "text_key": index.items[i], "score": s, "share": s / index.own[i], "question_overlap": q, "answer_overlap": r})
            yield pa.RecordBatch.from_pylist(out, schema)

    return run
