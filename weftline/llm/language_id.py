"""Language identification: known words first, then ever shorter character n-grams."""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written
from .segments import slices_by_bytes

UNDETERMINED = "und"
_WORD = re.compile(r"[^\W\d_]+")
ORDERS = (5, 4, 3, 2, 1)
#: Languages are few; more labels than this are an error in the data, not a model.
MAX_LANGUAGES = 10_000


def words_of(text: str | None) -> list[str]:
    """Runs of letters, lower-cased; empty where the text has no letter."""
    if not text:
        return []
    if not unicodedata.is_normalized("NFC", text):
        text = unicodedata.normalize("NFC", text)
    found = _WORD.findall(text.lower())
    return found if text.isascii() else [w for w in found if w.isalpha() or any(map(str.isalpha, w))]


def grams_of(word: str, n: int) -> list[str]:
    """The word's n-grams, its ends marked; a single character has no mark."""
    marked = word if n == 1 else f"^{word}$"
    return [marked[i : i + n] for i in range(len(marked) - n + 1)]


def entry_keys(entries: list[str], n: int) -> np.ndarray:
    """64-bit keys of words (n = 0) or n-grams, which stand for them in a model."""
    import xxhash

    return np.fromiter((xxhash.xxh3_64_intdigest(e, n) for e in entries), np.uint64, len(entries)).view(np.int64)


@dataclass
class Entries:
    """Words or n-grams of one order, in ascending order of their keys: which languages have them, and by how much that lifts
    their log frequency above that of an entry which the language lacks."""

    keys: np.ndarray
    starts: np.ndarray  # of an entry's languages
    langs: np.ndarray
    lifts: np.ndarray
    base: np.ndarray  # log frequency, by language, of an entry that it lacks

    def rows(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the keys are known, and those entries' log frequencies by language."""
        at = np.minimum(np.searchsorted(self.keys, keys), max(0, len(self.keys) - 1))
        known = np.flatnonzero(self.keys[at] == keys) if len(self.keys) else np.empty(0, np.int64)
        at = at[known]
        n = self.starts[at + 1] - self.starts[at]
        place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(self.starts[at], n)
        out = np.tile(self.base, (len(at), 1))
        out[np.repeat(np.arange(len(at)), n), self.langs[place]] += self.lifts[place]
        return known, out


@dataclass
class LanguageModel:
    """Log frequencies by language of `words` and of n-grams of each order."""

    languages: list[str]
    entries: dict[int, Entries]  # 0: words; n: n-grams
    floor: np.ndarray

    def backoff(self, words: list[str]) -> np.ndarray:
        """For each unseen word the mean, over its positions, of the row of the longest known n-gram there."""
        marked = [f"^{w}$" for w in words]
        of = np.repeat(np.arange(len(words)), [len(m) for m in marked])
        place = np.concatenate([np.arange(len(m)) for m in marked])
        total, found = np.zeros((len(words), len(self.languages)), np.float32), np.zeros(len(words), np.int64)
        open_ = np.ones(len(of), bool)
        words_at, places = of.tolist(), place.tolist()
        for n in ORDERS:
            grams = [(i, marked[words_at[i]][places[i] : places[i] + n]) for i in np.flatnonzero(open_).tolist()]
            grams = [(i, g) for i, g in grams if len(g) == n and (n > 1 or g not in "^$")]
            if not grams:
                continue
            at = [i for i, _ in grams]
            known, rows = self.entries[n].rows(entry_keys([g for _, g in grams], n))
            at = np.array(at)[known]
            np.add.at(total, of[at], rows)
            np.add.at(found, of[at], 1)
            open_[at] = False
        inner = np.flatnonzero(open_ & (place > 0) & (place < np.array([len(m) for m in marked])[of] - 1))
        np.add.at(total, of[inner], self.floor)
        np.add.at(found, of[inner], 1)
        return np.where(found[:, None] > 0, total / np.maximum(found, 1)[:, None], self.floor).astype(np.float32)

    def score(self, words: list[str]) -> np.ndarray:
        """A known word's row; else that of its n-grams."""
        out = np.empty((len(words), len(self.languages)), np.float32)
        known, rows = self.entries[0].rows(entry_keys(words, 0))
        out[known] = rows
        unseen = np.setdiff1d(np.arange(len(words)), known)
        if len(unseen):
            out[unseen] = self.backoff([words[i] for i in unseen.tolist()])
        return out


class Scorer:
    """Scores texts with a model; keeps the rows of words it has met in a memo of about memo_bytes."""

    def __init__(self, model: LanguageModel, memo_bytes: int = 48_000_000, evidence: int = 30):
        self.model, self.evidence = model, evidence
        self.limit, self.step = memo_bytes // (100 + 4 * max(1, len(model.languages))), max(1000, 4_000_000 // max(1, len(model.languages)))
        self._clear()

    def _clear(self) -> None:
        self.memo, self.rows = {}, np.empty((4096, len(self.model.languages)), np.float32)

    def _learn(self, new: list[str]) -> None:
        n = len(self.memo)
        if n + len(new) > len(self.rows):
            grown = np.empty((max(2 * len(self.rows), n + len(new)), self.rows.shape[1]), np.float32)
            grown[:n] = self.rows[:n]
            self.rows = grown
        for a in range(0, len(new), self.step):
            part = new[a : a + self.step]
            self.rows[n + a : n + a + len(part)] = self.model.score(part)
        self.memo.update(zip(new, range(n, n + len(new))))

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """Each text's likeliest language and its share of the likelihood, of at most `evidence` words' weight."""
        words = [words_of(t) for t in texts]
        n = np.array(list(map(len, words)), np.int64)
        totals = np.zeros((len(texts), len(self.model.languages)))
        if self.model.languages:
            flat, of = list(chain.from_iterable(words)), np.repeat(np.arange(len(texts)), n)
            for a in range(0, len(flat), self.step):
                if len(self.memo) > self.limit:
                    self._clear()
                part, texts_of = flat[a : a + self.step], of[a : a + self.step]
                at = list(map(self.memo.get, part))
                if None in at:
                    self._learn(list(dict.fromkeys(w for w, i in zip(part, at) if i is None)))
                    at = list(map(self.memo.get, part))
                starts = np.flatnonzero(np.diff(texts_of, prepend=-1))
                totals[texts_of[starts]] += np.add.reduceat(self.rows[np.array(at)], starts, axis=0, dtype=np.float64)
        out = []
        for total, k in zip(totals * np.minimum(1.0, self.evidence / np.maximum(n, 1))[:, None], n):
            if not k or not len(total):
                out.append((UNDETERMINED, 0.0))
                continue
            share = np.exp(total - total.max())
            best = int(total.argmax())
            out.append((self.model.languages[best], float(share[best] / share.sum())))
        return out


_last: list[Scorer] = []


def _scorer(model: LanguageModel) -> Scorer:
    """The worker's scorer of this model; its memo outlives a task, as the worker does."""
    if not _last or _last[0].model is not model:
        _last[:] = [Scorer(model)]
    return _last[0]


def train(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", id_col: str = "doc_id", rows_per_language: int = 4000, least_count: int = 2) -> LanguageModel:
    """Count words and n-grams by language over a sample of docs, all rows of which may be learned from.

    The sample has about rows_per_language rows of each language (a hash of the id picks them; a rarer language is taken
    whole), which is all that bounds the model: whatever the sample has least_count times in all languages together stays,
    as a 64-bit key. An n-gram counts once for each distinct word of a language. Rows with a null text or language teach
    nothing. At most MAX_LANGUAGES languages; more raise.
    """
    rows = docs.select(F.col(id_col).cast("string").alias("id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text")).filter("lang IS NOT NULL AND text IS NOT NULL")
    rates = written(rows.groupBy("lang").agg(F.count("*").alias("n")), "languages")
    languages = sorted(r.lang for r in rates.limit(MAX_LANGUAGES + 1).collect())
    if len(languages) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    rates = rates.select(F.col("lang").alias("of"), (F.lit(float(rows_per_language)) / F.col("n")).alias("rate"))
    picked = F.pmod(F.xxhash64("id", F.lit("language")), F.lit(1 << 20)) < F.col("rate") * (1 << 20)
    sample = rows.join(F.broadcast(rates), F.col("lang") == F.col("of")).filter(picked).select("lang", "text")  # MAX_LANGUAGES bounds it

    def counts_of(lang: str, n: int, counts: Counter, with_entry: bool) -> pa.RecordBatch:
        columns = {"lang": [lang] * len(counts), "n": np.full(len(counts), n, np.int32), "key": entry_keys(list(counts), n), "c": list(counts.values())}
        types = [("lang", pa.string()), ("n", pa.int32()), ("key", pa.int64()), ("c", pa.int64())]
        if with_entry:
            columns["entry"] = list(counts)
            types.append(("entry", pa.string()))
        return pa.RecordBatch.from_pydict(columns, pa.schema(types))

    def count(batches):
        for batch in batches:
            found: dict[str, Counter] = {}
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                found.setdefault(lang, Counter()).update(words_of(text.as_py()))
            for lang, counts in found.items():
                yield counts_of(lang, 0, counts, True)

    def count_grams(batches):
        for batch in batches:
            found: dict[tuple[str, int], Counter] = {}
            for lang, word in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for n in ORDERS:  # each distinct word once: unseen words are rare ones
                    found.setdefault((lang, n), Counter()).update(grams_of(word, n))
            for (lang, n), counts in found.items():
                yield counts_of(lang, n, counts, False)

    kind = "lang string, n int, key long, c long"
    known = written(sample.mapInArrow(count, kind + ", entry string").groupBy("n", "key", "lang", "entry").agg(F.sum("c").alias("c")), "language-words")
    grams = known.select("lang", "entry").mapInArrow(count_grams, kind).groupBy("n", "key", "lang").agg(F.sum("c").alias("c"))
    counted = known.select("n", "key", "lang", "c").union(grams)
    entries = counted.groupBy("n", "key").agg(F.sum("c").alias("all"), F.collect_list(F.struct("lang", "c")).alias("by")).filter(F.col("all") >= least_count)
    named = F.broadcast(docs.sparkSession.createDataFrame([(x, i) for i, x in enumerate(languages)], "of string, lang_no int"))
    table = entries.select("n", "key", F.inline("by")).join(named, F.col("lang") == F.col("of")).select("n", "key", "lang_no", "c").toArrow()
    n, key, lang, c = (table.column(i).to_numpy() for i in range(4))
    parts = {}
    for order in (0, *ORDERS):
        mine = np.flatnonzero(n == order)
        mine = mine[np.lexsort((lang[mine], key[mine]))]
        keys, starts = np.unique(key[mine], return_index=True)
        counts, langs = c[mine].astype(np.float64), lang[mine].astype(np.int32)
        smooth = 0.5 if order == 0 else 0.1
        all_ = np.bincount(langs, counts, len(languages)) + smooth * max(1, len(keys))
        parts[order] = Entries(keys, np.append(starts, len(mine)), langs, np.log((counts + smooth) / smooth).astype(np.float32), np.log(smooth / all_).astype(np.float32))
    return LanguageModel(languages, parts, np.full(len(languages), math.log(1e-6), np.float32))


def identify(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, lang_pred, score for each row of docs, from the whole text alone.

    A null text, or one without a letter, is `und` with score 0, as is everything where the model has no language; null
    ids and repeated rows are kept as they are; of equally likely languages the first by name counts; an empty table gives
    no rows. The model is bounded by the sample that it is trained on, so it is broadcast.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def predict(batches):
        scorer = _scorer(shared.value)
        for batch in batches:
            for start, stop in slices_by_bytes(batch.column(1), 1_000_000):
                part = batch.slice(start, stop - start)
                found = scorer.predict(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], ["id", "lang_pred", "score"])

    id_type = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(predict, f"id {id_type}, lang_pred string, score double").withColumnRenamed("id", id_col)
