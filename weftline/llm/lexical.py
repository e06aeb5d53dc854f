"""Ranked lexical search: every document for every item, as a sparse matrix product in blocks.

The rows of one matrix are the items, its columns the terms, its values how often an item has a term. The other has a row
for each term, a column for each document, and the term's integer impact in the document. Gustavson's product goes over an
item's terms and adds the rows of the second matrix, times the multiplicity, into one row of sums; a block of documents at
a time, so the sums are one dense int64 array. A task carries the k best documents of each item from block to block.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import written

#: ASCII letters and digits and all bytes of other characters are parts of terms, all else parts them.
_PART = bytes(c if chr(c).isalnum() else 32 for c in range(128)) + bytes(range(128, 256))
_FOLD = _PART.lower()
STRETCH = 1 << 20
#: Bytes of the items of one pass over the documents; a larger set of items takes several.
ITEM_BYTES = 8_000_000


def terms_of(text: bytes | None) -> Iterator[list[bytes]]:
    """The terms of a whole text, about STRETCH bytes of it at a time."""
    data, at = (text or b"").translate(_FOLD), 0
    while at < len(data):
        stop = data.find(b" ", min(at + STRETCH, len(data)))
        stop = len(data) if stop < 0 else stop
        yield data[at:stop].split()
        at = stop


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def impacts(weights: np.ndarray, tf: np.ndarray, n: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """int64 impact of each (term, document): of its weight, its occurrences, and the document's length n against the mean."""
    top = 25 * int(n.max(initial=0)) * n_docs
    share = 25 * n * n_docs // n_terms if top < 1 << 63 else np.array([25 * int(x) * n_docs // n_terms for x in n], np.int64)
    return weights * (1_000_000_000 * tf // (1000 * tf + 12 * (75 + share)))


class Best:
    """The k best (score, id) of each item among the documents seen so far."""

    def __init__(self, n_items: int, k: int, id_type: pa.DataType):
        self.k, self.kth = k, np.zeros(n_items, np.int64)
        self.rows = pa.table({"item": pa.array([], pa.int32()), "score": pa.array([], pa.int64()), "id": pa.array([], id_type)})

    def add(self, items: list[int], scores: list[np.ndarray], ids: list[np.ndarray], all_ids: pa.Array) -> None:
        """ids: places in all_ids. Of equal scores the smaller id goes first, a null id last."""
        if not items:
            return
        fresh = pa.table({"item": pa.array(np.repeat(items, [len(s) for s in scores]), pa.int32()), "score": np.concatenate(scores), "id": all_ids.take(pa.array(np.concatenate(ids)))})
        rows = pa.concat_tables([self.rows, fresh])
        rows = rows.take(pc.sort_indices(rows, sort_keys=[("item", "ascending"), ("score", "descending"), ("id", "ascending")], null_placement="at_end")).combine_chunks()
        item = rows["item"].to_numpy()
        first = np.flatnonzero(np.diff(item, prepend=-1))
        place = np.arange(len(item)) - np.repeat(first, np.diff(first, append=len(item)))
        self.rows = rows.filter(pa.array(place < self.k))
        last = rows.filter(pa.array(place == self.k - 1))
        self.kth[last["item"].to_numpy()] = last["score"].to_numpy()


def product_top(items: list[tuple[np.ndarray, np.ndarray]], term: np.ndarray, doc: np.ndarray, impact: np.ndarray, n_docs: int, ids: pa.Array, best: Best) -> None:
    """Multiply the items' rows (terms, multiplicities) with a block of the other matrix, given as its entries, and put the sums into best."""
    order = np.argsort(term, kind="stable")
    term, doc, impact = term[order], doc[order], impact[order]
    held, starts = np.unique(term, return_index=True)
    stops, row_of = np.append(starts[1:], len(term)), {int(t): r for r, t in enumerate(held)}
    found: tuple[list, list, list] = ([], [], [])
    for i, (terms, times) in enumerate(items):
        sums, touched = np.zeros(n_docs, np.int64), False
        for t, m in zip(terms.tolist(), times.tolist()):
            if (r := row_of.get(t)) is not None:
                sums[doc[starts[r] : stops[r]]] += m * impact[starts[r] : stops[r]]
                touched = True
        if not touched:
            continue
        at = np.flatnonzero(sums >= max(1, best.kth[i]))
        if len(at) > best.k:  # what is below the block's own k-th goes, what equals it stays for its ids to decide
            at = at[sums[at] >= np.partition(sums[at], -best.k)[-best.k]]
        if len(at):
            for to, what in zip(found, (i, sums[at], at)):
                to.append(what)
    best.add(*found, ids)


def ranked_documents(
    docs: DataFrame, items: DataFrame, k: int = 20, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", item_bytes: int = ITEM_BYTES
) -> DataFrame:
    """item_id, rank, doc_id, score: the k best documents of each item with a score above 0.

    Whole texts are read, as bytes, so what isn't valid UTF-8 is no error. A null or empty text, or one without a term, is
    no document of the statistics and is never found; an item without a term finds nothing. Each row of items is ranked by
    itself and each row of docs by itself, whatever their ids and however often a row repeats; among equal scores a null id
    comes last. An empty table of either gives no rows; other columns aren't read. Items of more than item_bytes bytes of text
    are dealt to several passes by a hash of their text; term and document counts are always over all documents.
    """
    spark = docs.sparkSession
    id_type, item_type = docs.schema[id_col].dataType, items.schema[item_id_col].dataType
    schema = f"item_id {item_type.simpleString()}, rank int, doc_id {id_type.simpleString()}, score long"
    texts = items.select(F.col(item_id_col).alias("item_id"), F.col(item_text_col).cast("string").cast("binary").alias("text")).filter("length(text) > 0")
    size = texts.agg(F.sum(F.length("text").cast("long"))).first()[0] or 0
    named = {"doc_id": id_col, "item_id": item_id_col}
    out = None
    for p in range(passes := -(-size // item_bytes)):
        mine = [(r.text, Counter(t for part in terms_of(bytes(r.text)) for t in part)) for r in _pass(texts, passes, p).select("text").distinct().toLocalIterator()]
        number = {t: i for i, t in enumerate(sorted({t for _, c in mine for t in c}))}
        if not number:
            continue
        found = _pass_ranked(docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").cast("binary").alias("text")), [c for _, c in mine], number, k, id_type)
        keys = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(mine)], "item int, text binary")
        found = _pass(texts, passes, p).join(keys, "text").join(found, "item").select("item_id", "rank", F.col("id").alias("doc_id"), "score")
        out = found if out is None else out.unionByName(found)
    out = spark.createDataFrame([], schema) if out is None else out
    return out.withColumnsRenamed({a: b for a, b in named.items() if a != b})


def _pass(texts: DataFrame, passes: int, p: int) -> DataFrame:
    return texts if passes == 1 else texts.filter(F.pmod(F.xxhash64("text"), F.lit(passes)) == p)


def _pass_ranked(rows: DataFrame, counts: list[Counter], number: dict[bytes, int], k: int, id_type) -> DataFrame:
    """item (its place in counts), rank, id, score."""
    spark, arrow_id = rows.sparkSession, to_arrow_type(id_type)
    known = spark.sparkContext.broadcast(number)

    def profile(batches):
        get = known.value.get
        for batch in batches:
            n, terms, tf = [], [], []
            for text in batch.column(1):
                total, own = 0, Counter()
                for part in terms_of(text.as_py()):
                    total += len(part)
                    own.update(map(get, part))
                own.pop(None, None)
                n.append(total)
                terms.append(list(own))
                tf.append(list(own.values()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(terms, pa.list_(pa.int32())), pa.array(tf, pa.list_(pa.int64()))], ["id", "n", "terms", "tf"])

    # as wide as the documents, a few bytes for each item's term in a text
    profiles = written(rows.mapInArrow(profile, f"id {id_type.simpleString()}, n long, terms array<int>, tf array<long>").filter("n > 0"), "lexical")
    whole = profiles.agg(F.count("*").alias("docs"), F.sum("n").alias("terms")).first()
    df = np.zeros(len(number), np.int64)

    def held(batches):
        seen = np.zeros(len(known.value), np.int64)
        for batch in batches:
            seen += np.bincount(batch.column(0).flatten().to_numpy(), minlength=len(seen))
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(seen[at])], ["term", "df"])

    got = profiles.select("terms").mapInArrow(held, "term int, df long").groupBy("term").agg(F.sum("df").alias("df")).toArrow()
    df[got["term"].to_numpy()] = got["df"].to_numpy()
    weights = np.array([weight(whole.docs, int(x)) for x in df], np.int64)
    matrix = [(np.array([number[t] for t in sorted(c)], np.int64), np.array([c[t] for t in sorted(c)], np.int64)) for c in counts]
    shared = spark.sparkContext.broadcast((matrix, weights, whole.docs, whole.terms))

    def search(batches):
        item_rows, weights, n_docs, n_terms = shared.value
        best = Best(len(item_rows), k, arrow_id)
        for batch in batches:
            terms, tf = batch.column(2), batch.column(3)
            sizes = np.diff(terms.offsets.to_numpy())
            doc = np.repeat(np.arange(len(sizes)), sizes)
            term, tf = terms.flatten().to_numpy().astype(np.int64), tf.flatten().to_numpy()
            impact = impacts(weights[term], tf, batch.column(1).to_numpy()[doc], n_docs, n_terms)
            product_top(item_rows, term, doc, impact, len(sizes), batch.column(0), best)
        yield from best.rows.to_batches()

    partial = profiles.mapInArrow(search, f"item int, score long, id {id_type.simpleString()}")
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("id"))
    return partial.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("item", "rank", "id", "score")
