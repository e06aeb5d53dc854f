"""A quality classifier: a generalised additive model with pairwise interactions.

Features of whole texts are binned; boosting goes round the features in cycles and adds a shallow tree on one feature at a
time to that feature's lookup table, then does the same on the pairs of features that explain most of what is left.
A text's score is the logistic of the sum of its bins' table entries.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass, field
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import frugal

FEATURES = [
    "log_bytes", "log_words", "word_length", "word_length_sd", "longest_word", "upper_share", "digit_share", "symbol_share", "stop_share", "exclaim_share", "comma_share",
    "space_share", "wide_share", "pipe_share", "caps_words", "letter_words", "short_words", "distinct_words", "top_word", "repeat_next", "distinct_pairs", "log_lines", "line_words", "repeat_lines",
    "end_marks", "symbol_end_words", "byte_entropy", "control_share", "link_share", "brace_share",
]

_CLASS = {
    "upper": range(65, 91), "lower": range(97, 123), "digit": range(48, 58), "symbol": [ord(c) for c in "#$%&*+=@^~<>\\_/"], "stop": [ord(c) for c in ".?"], "exclaim": [33],
    "comma": [ord(c) for c in ",;:"], "space": [9, 10, 11, 12, 13, 32], "wide": range(128, 256), "pipe": [124], "control": [*range(9), *range(14, 32), 127], "brace": [ord(c) for c in "{}[]()"],
}
_MATRIX = np.zeros((256, len(_CLASS)))
for _i, _codes in enumerate(_CLASS.values()):
    _MATRIX[list(_codes), _i] = 1


def features(text: str | None) -> list[float]:
    """The FEATURES of a whole text; a null text is empty, and an empty text has zeros throughout."""
    raw = (text or "").encode("utf-8", "replace")
    if not raw:
        return [0.0] * len(FEATURES)
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    n = len(raw)
    c = dict(zip(_CLASS, (counts @ _MATRIX).tolist()))
    share = counts[counts > 0] / n
    entropy = float(-(share * np.log2(share)).sum())
    letters = c["upper"] + c["lower"] + c["wide"] / 2
    words = text.split()
    w = len(words)
    lines = [x for x in text.split("\n") if x.strip()]
    if w:
        sizes = np.fromiter(map(len, words), np.float64, w)
        seen = Counter(words)
        of_words = [sizes.mean(), sizes.std(), np.log1p(sizes.max())]
        caps, alpha = sum(map(str.isupper, words)) / w, sum(map(str.isalpha, words)) / w
        of_more = [caps, alpha, float((sizes <= 3).mean()), len(seen) / w, max(seen.values()) / w, sum(map(eq, words, words[1:])) / w, len(set(zip(words, words[1:]))) / max(1, w - 1)]
        ends = sum(x[-1] in "#$%&*|=~^_" for x in words) / w
        links = sum(x.startswith(("http", "www.")) for x in words) / w
    else:
        of_words, of_more, ends, links = [0.0] * 3, [0.0] * 7, 0.0, 0.0
    repeated = 1 - len(set(lines)) / len(lines) if lines else 0.0
    marks = (c["stop"] + c["exclaim"]) / max(1, w)
    return [
        np.log1p(n), np.log1p(w), *of_words, c["upper"] / max(1, letters), c["digit"] / n, c["symbol"] / n, c["stop"] / n, c["exclaim"] / n, c["comma"] / n, c["space"] / n, c["wide"] / n, c["pipe"] / n,
        *of_more, np.log1p(len(lines)), np.log1p(w / max(1, len(lines))), repeated, marks, ends, entropy, c["control"] / n, links, c["brace"] / n,
    ]


@dataclass
class AdditiveModel:
    intercept: float = 0.0
    cuts: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int]] = field(default_factory=list)
    pair_cuts: list[np.ndarray] = field(default_factory=list)
    pair_tables: list[np.ndarray] = field(default_factory=list)

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probabilities for rows of features: table look-ups, added."""
        total = np.full(len(x), self.intercept)
        for f, (cut, values) in enumerate(zip(self.cuts, self.tables)):
            total += values[np.searchsorted(cut, x[:, f], "right")]
        for (a, b), values in zip(self.pairs, self.pair_tables):
            total += values[np.searchsorted(self.pair_cuts[a], x[:, a], "right"), np.searchsorted(self.pair_cuts[b], x[:, b], "right")]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def _cuts(x: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(x, np.linspace(0, 1, bins + 1)[1:-1]))


def _gain(g, h, ridge: float):
    return g * g / (h + ridge)


def _tree(g: np.ndarray, h: np.ndarray, leaves: int, ridge: float) -> np.ndarray:
    """A tree of a few leaves over ordered bins: always split the leaf whose best cut gains most; returns a step per bin."""
    parts = [(0, len(g))]
    while len(parts) < leaves:
        best = (1e-9, None, None)
        for k, (a, b) in enumerate(parts):
            if b - a < 2:
                continue
            gl, hl = np.cumsum(g[a:b])[:-1], np.cumsum(h[a:b])[:-1]
            gs, hs = g[a:b].sum(), h[a:b].sum()
            gain = _gain(gl, hl, ridge) + _gain(gs - gl, hs - hl, ridge) - _gain(gs, hs, ridge)
            i = int(gain.argmax())
            if gain[i] > best[0]:
                best = (gain[i], k, a + i + 1)
        if best[1] is None:
            break
        a, b = parts.pop(best[1])
        parts += [(a, best[2]), (best[2], b)]
    out = np.zeros(len(g))
    for a, b in parts:
        out[a:b] = g[a:b].sum() / (h[a:b].sum() + ridge)
    return out


def _pair_tree(g: np.ndarray, h: np.ndarray, ridge: float) -> tuple[np.ndarray, float]:
    """The best tree that cuts both axes once (four leaves), as a step per cell, and its gain."""
    gc, hc = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)
    gl, hl, gr, hr = gc[:-1, :-1], hc[:-1, :-1], gc[:-1, -1:], hc[:-1, -1:]
    gt, ht, gs, hs = gc[-1:, :-1], hc[-1:, :-1], gc[-1, -1], hc[-1, -1]
    quads = [(gl, hl), (gr - gl, hr - hl), (gt - gl, ht - hl), (gs - gr - gt + gl, hs - hr - ht + hl)]
    if not gl.size:
        return np.zeros_like(g), 0.0
    gain = sum(_gain(a, b, ridge) for a, b in quads) - _gain(gs, hs, ridge)
    i, j = np.unravel_index(int(gain.argmax()), gain.shape)
    out = np.empty_like(g)
    for (a, b), cells in zip(quads, [(slice(None, i + 1), slice(None, j + 1)), (slice(None, i + 1), slice(j + 1, None)), (slice(i + 1, None), slice(None, j + 1)), (slice(i + 1, None), slice(j + 1, None))]):
        out[cells] = a[i, j] / (b[i, j] + ridge)
    return out, float(gain[i, j])


def fit(x: np.ndarray, y: np.ndarray, bins: int = 48, pair_bins: int = 8, rounds: int = 120, pair_rounds: int = 60, n_pairs: int = 8, leaves: int = 3, rate: float = 0.15, ridge: float = 2.0) -> AdditiveModel:
    """Fit by cyclic boosting on the logistic loss. Without rows of both kinds the model is a constant (1/2 without any)."""
    if not len(y):
        return AdditiveModel()
    base = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    model = AdditiveModel(intercept=float(np.log(base / (1 - base))))
    if y.min() == y.max():
        return model
    k = x.shape[1]
    model.cuts, model.pair_cuts = [_cuts(x[:, f], bins) for f in range(k)], [_cuts(x[:, f], pair_bins) for f in range(k)]
    at = [np.searchsorted(c, x[:, f], "right") for f, c in enumerate(model.cuts)]
    model.tables = [np.zeros(len(c) + 1) for c in model.cuts]
    total = np.full(len(y), model.intercept)

    def slopes():
        p = 1 / (1 + np.exp(-total))
        return y - p, p * (1 - p)

    for _ in range(rounds):
        for f in range(k):
            g, h = slopes()
            size = len(model.tables[f])
            step = rate * _tree(np.bincount(at[f], g, size), np.bincount(at[f], h, size), leaves, ridge)
            model.tables[f] += step
            total += step[at[f]]
    coarse = [np.searchsorted(c, x[:, f], "right") for f, c in enumerate(model.pair_cuts)]
    size = [len(c) + 1 for c in model.pair_cuts]

    def cells(a: int, b: int, g: np.ndarray, h: np.ndarray):
        where = coarse[a] * size[b] + coarse[b]
        return where, np.bincount(where, g, size[a] * size[b]).reshape(size[a], size[b]), np.bincount(where, h, size[a] * size[b]).reshape(size[a], size[b])

    g, h = slopes()
    ranked = sorted(((_pair_tree(*cells(a, b, g, h)[1:], ridge)[1], a, b) for a in range(k) for b in range(a + 1, k)), reverse=True)
    model.pairs = [(a, b) for gain, a, b in ranked[:n_pairs] if gain > 0]
    model.pair_tables = [np.zeros((size[a], size[b])) for a, b in model.pairs]
    for _ in range(pair_rounds):
        for i, (a, b) in enumerate(model.pairs):
            where, gg, hh = cells(a, b, *slopes())
            step = rate * _pair_tree(gg, hh, ridge)[0]
            model.pair_tables[i] += step
            total += step.reshape(-1)[where]
    return model


def train(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", most_rows: int = 20_000) -> AdditiveModel:
    """Learn from labelled documents, all rows of which may be learned from.

    A hash of the id picks about most_rows labelled rows (the bound of what reaches the driver, as one row of features
    each). Null labels teach nothing; of several labels of a document the mean decides, a half counting as 1.
    """
    known = labels.select(F.col(id_col).alias("label_id"), F.col(label_col).cast("double").alias("y")).filter("label_id IS NOT NULL AND y IS NOT NULL")
    n = known.count()
    picked = known.filter(F.pmod(F.xxhash64(F.col("label_id").cast("string"), F.lit("quality")), F.lit(1 << 20)) < int((1 << 20) * min(1.0, most_rows / max(1, n))) + (n <= most_rows))
    picked = picked.groupBy("label_id").agg((F.avg("y") >= 0.5).cast("int").alias("y"))

    def measure(batches):
        for batch in batches:
            rows = [features(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(pa.float64()))], ["y", "x"])

    sample = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(picked), F.col("id") == F.col("label_id")).select("y", "text")
    got = sample.mapInArrow(frugal(measure), "y int, x array<double>").toPandas()
    order = got.assign(key=[tuple(x) for x in got["x"]]).sort_values(["key", "y"]) if len(got) else got  # reruns agree
    return fit(np.array(order["x"].tolist(), np.float64).reshape(-1, len(FEATURES)), order["y"].to_numpy(np.float64))


def score(docs: DataFrame, model: AdditiveModel, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text", batch_rows: int = 512) -> DataFrame:
    """id, score, predicted (1 if score >= threshold) for each row of docs, from the whole text alone.

    A null text is scored as an empty one; null ids and repeated rows are kept as they are; an empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def scores(batches):
        for batch in batches:
            for a in range(0, len(batch), batch_rows):
                part = batch.slice(a, batch_rows)
                p = shared.value.score(np.array([features(t.as_py()) for t in part.column(1)], np.float64))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(p), pa.array((p >= threshold).astype(np.int32))], ["id", "score", "predicted"])

    id_type = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(frugal(scores), f"id {id_type}, score double, predicted int").withColumnRenamed("id", id_col)


def keep(docs: DataFrame, model: AdditiveModel, threshold: float = 0.3, text_col: str = "text", batch_rows: int = 512) -> DataFrame:
    """The rows of docs, all columns as they are, that score at least threshold; each row is judged by its own text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def choose(batches):
        for batch in batches:
            for a in range(0, len(batch), batch_rows):
                part = batch.slice(a, batch_rows)
                p = shared.value.score(np.array([features(t.as_py()) for t in part.column(at).cast(pa.string())], np.float64))
                yield part.filter(pa.array(p >= threshold))

    return docs.mapInArrow(frugal(choose), docs.schema)
