"""Alignment of two tokenizers' tokens over a corpus, by a dictionary of groups.

Both tokenizers read the same bytes: a space and the text. Where a token of each ends at the same byte, the text is cut; what
lies between two cuts is a group of A ids and B ids, and every A token of a group is linked with every B token of it.
Few groups make up most of a corpus, so each is interned: its links are expanded once, and what is counted of
the corpus is joined back to the documents by the group.

A text is cut at single spaces, which no token of either vocabulary crosses, so groups never do either. Of each chunk of
documents every distinct piece is encoded once, many of them as one text.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import written
from .segments import _WIDE, _byte_letters, cut_long, slices_by_bytes

#: Spaces where a text must not be cut: beside other white space, or at either end.
_UNSAFE = f"^{_WIDE}|{_WIDE} | {_WIDE}| $"
CHUNK_BYTES, MEMO_BYTES, RUN_BYTES = 8_000_000, 64_000_000, 50_000
#: Groups of so many ids at most are told apart by numpy, longer ones one by one.
_SHORT = 8
_BYTE = re.compile(r"<0x([0-9A-F]{2})>")

_loaded: dict[tuple[str, str], "Aligner"] = {}


def aligner(a_path: str, b_path: str) -> "Aligner":
    """The worker's aligner for these files; it outlives a task, as the worker does."""
    if (a_path, b_path) not in _loaded:
        _loaded[a_path, b_path] = Aligner(a_path, b_path)
    return _loaded[a_path, b_path]


@dataclass
class Pieces:
    """For each piece of text whether its tokens give it back, its counts, and its groups: sizes[i] of them from starts[i] on."""

    good: np.ndarray
    n_a: np.ndarray
    n_b: np.ndarray
    n_links: np.ndarray
    starts: np.ndarray
    sizes: np.ndarray
    groups: np.ndarray


class Aligner:
    """Encodes pieces of text by both tokenizers and cuts them into groups. Groups and pairs of ids have numbers, which hold until forget()."""

    def __init__(self, a_path: str, b_path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.no_truncation()
        self.a.no_padding()
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        letters = {m: ord(c) for c, m in _byte_letters().items()}
        self.a_bytes = [b""] * self.a.get_vocab_size(with_added_tokens=True)
        for token, i in self.a.get_vocab(with_added_tokens=False).items():
            self.a_bytes[i] = bytes(letters[c] for c in token) if all(c in letters for c in token) else token.encode()
        for token in json.loads(self.a.to_str())["added_tokens"] or []:
            self.a_bytes[token["id"]] = token["content"].encode()
        names = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(m[1], 16)]) if (m := _BYTE.fullmatch(t)) and self.b.is_byte(i) else t.replace("▁", " ").encode() for i, t in enumerate(names)]
        self.a_size, self.b_size = (np.array(list(map(len, x))) for x in (self.a_bytes, self.b_bytes))
        #: A piece that goes on after a later space could cross a cut.
        self.cuts = not any(re.search("[^▁]▁", t) for t in names)
        self.forget()

    def forget(self) -> None:
        self.held = 0
        self.groups: dict[str, int] = {}
        self.keys: list[str] = []
        self.of_group: list[np.ndarray] = []  # a group's pairs, by number
        self.pairs: dict[tuple[int, int], int] = {}

    def _tokens(self, texts: list[bytes]) -> list[tuple[np.ndarray, np.ndarray] | None]:
        """Ids of texts that begin with a space, by A and B; None where they don't give the text back."""
        said = [t.decode("utf-8", "replace") for t in texts]
        out: list[tuple[np.ndarray, np.ndarray] | None] = []
        for text, a, b in zip(texts, self.a.encode_batch(said, add_special_tokens=False), self.b.encode([t[1:] for t in said], num_threads=1)):
            same = b"".join(map(self.a_bytes.__getitem__, a.ids)) == text == b"".join(map(self.b_bytes.__getitem__, b))
            out.append((np.array(a.ids, np.int64), np.array(b, np.int64)) if same else None)
        return out

    def _run(self, pieces: list[bytes], of: list[int]) -> list[tuple[list[int], tuple[np.ndarray, np.ndarray] | None]]:
        """Tokens of a run of pieces, encoded as one text; if that isn't given back, of its halves, down to single pieces."""
        got = self._tokens([b" " + b" ".join([pieces[i] for i in of])])[0]
        if got is not None or len(of) == 1:
            return [(of, got)]
        half = len(of) // 2
        return self._run(pieces, of[:half]) + self._run(pieces, of[half:])

    def cut(self, pieces: list[bytes], whole: list[bytes]) -> Pieces:
        """Of pieces without their leading spaces, between which a text may be cut, and then of whole texts."""
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces)) + 1
        run = np.cumsum(sizes) // RUN_BYTES
        units: list[tuple[list[int], tuple[np.ndarray, np.ndarray] | None]] = []
        for of in np.split(np.arange(len(pieces)), np.flatnonzero(np.diff(run)) + 1) if pieces else []:
            units += self._run(pieces, of.tolist())
        for i, text in enumerate(whole, len(pieces)):
            parts = cut_long(" " + text.decode("utf-8", "replace"), 200_000) if self.cuts else [" " + text.decode("utf-8", "replace")]
            got = self._tokens([p.encode() for p in parts]) if b"".join(p.encode() for p in parts) == b" " + text else [None]
            units.append(([i], None if any(g is None for g in got) else (np.concatenate([g[0] for g in got]), np.concatenate([g[1] for g in got]))))

        n = len(pieces) + len(whole)
        lengths = np.concatenate([sizes, np.fromiter(map(len, whole), np.int64, len(whole)) + 1])
        fine = [(of, got) for of, got in units if got is not None]
        order = np.array([i for of, _ in fine for i in of], np.int64)
        a, b = (np.concatenate([np.empty(0, np.int64), *(got[k] for _, got in fine)]) for k in range(2))
        a_ends, b_ends, ends = np.cumsum(self.a_size[a]), np.cumsum(self.b_size[b]), np.cumsum(lengths[order])
        cuts = np.intersect1d(a_ends, b_ends, assume_unique=True)  # every token has a byte at least
        na, nb = (np.bincount(np.searchsorted(cuts, x), minlength=len(cuts)) for x in (a_ends, b_ends))
        of = order[np.searchsorted(ends, cuts)]  # the piece of each group; units stand in the order of their pieces
        count = lambda weights: np.bincount(of, weights, n).astype(np.int64)
        good = np.zeros(n, bool)
        good[order] = True
        per = count(None)
        return Pieces(good, count(na), count(nb), count(na * nb), np.cumsum(per) - per, per, self._interned(a, b, na, nb))

    def _interned(self, a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
        """The numbers of groups, which stand one after the other in a and b."""
        out = np.empty(len(na), np.int64)
        a_from, b_from = np.cumsum(na) - na, np.cumsum(nb) - nb
        short = np.flatnonzero(na + nb <= _SHORT)
        rows = np.zeros((len(short), _SHORT + 2), np.int64)
        rows[:, 0], rows[:, 1] = na[short], nb[short]
        for k in range(_SHORT):
            has = np.flatnonzero(rows[:, 0] > k)
            rows[has, 2 + k] = a[a_from[short[has]] + k]
            has = np.flatnonzero(rows[:, 1] > k)
            rows[has, 2 + rows[has, 0] + k] = b[b_from[short[has]] + k]
        mixed = np.zeros(len(rows), np.uint64)
        for k in range(rows.shape[1]):
            mixed = (mixed ^ rows[:, k].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            mixed ^= mixed >> np.uint64(29)
        _, first, back = np.unique(mixed, return_index=True, return_inverse=True)
        if (rows[first][back] != rows).any():  # two groups mixed to one number
            _, first, back = np.unique(rows, axis=0, return_index=True, return_inverse=True)
        numbers = [self._number(r[2 : 2 + r[0]], r[2 + r[0] : 2 + r[0] + r[1]]) for r in rows[first].tolist()]
        out[short] = np.array(numbers, np.int64)[back] if numbers else 0
        for g in np.flatnonzero(na + nb > _SHORT).tolist():
            out[g] = self._number(a[a_from[g] : a_from[g] + na[g]].tolist(), b[b_from[g] : b_from[g] + nb[g]].tolist())
        return out

    def _number(self, a: list[int], b: list[int]) -> int:
        key = f"{','.join(map(str, a))}|{','.join(map(str, b))}"
        if key not in self.groups:
            self.groups[key] = len(self.keys)
            self.keys.append(key)
            links = [(i, j) for i in dict.fromkeys(a) for j in dict.fromkeys(b)]
            self.of_group.append(np.array([self.pairs.setdefault(p, len(self.pairs)) for p in links], np.int64))
            self.held += 400 + 2 * len(key) + 200 * len(links)
        return self.groups[key]


def _spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places starts[i], starts[i] + 1, ... of each i, sizes[i] of them, one after the other."""
    return np.arange(sizes.sum()) + np.repeat(starts - np.cumsum(sizes) + sizes, sizes)


def _joined(parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    sizes = np.fromiter(map(len, parts), np.int64, len(parts))
    return np.concatenate([*parts, np.empty(0, np.int64)]), np.cumsum(sizes) - sizes, sizes


@dataclass
class Chunk:
    """Some documents: their counts, and their distinct groups with how often each holds them."""

    stats: np.ndarray  # n_a, n_b, n_groups, n_links of each document
    digests: list[str]
    offsets: np.ndarray
    groups: np.ndarray  # by the aligner's numbers
    times: np.ndarray
    pairs: np.ndarray  # held by some document, by number
    docs: np.ndarray  # by how many


def encoded(enc: Aligner, texts: pa.Array) -> Chunk:
    """texts: binary; a null one is empty."""
    texts = pc.fill_null(texts, b"").cast(pa.large_binary())
    n = len(texts)
    split = pc.split_pattern(texts, b" ")
    starts = split.offsets.to_numpy().astype(np.int64)
    starts -= starts[0]
    coded = split.flatten().dictionary_encode()
    index = coded.indices.to_numpy().astype(np.int64)
    empty = pc.binary_length(texts).to_numpy() == 0
    whole = np.flatnonzero((pc.match_substring_regex(texts.view(pa.large_string()), _UNSAFE).to_numpy(zero_copy_only=False) if enc.cuts else np.ones(n, bool)) & ~empty)
    doc = np.repeat(np.arange(n), np.diff(starts))
    skipped = empty.copy()
    skipped[whole] = True
    kept = ~skipped[doc]
    used, index = np.unique(index[kept], return_inverse=True)
    found = enc.cut(coded.dictionary.take(pa.array(used)).to_pylist(), texts.take(pa.array(whole)).to_pylist())
    doc, piece = np.concatenate([doc[kept], whole]), np.concatenate([index, len(used) + np.arange(len(whole))])
    order = np.argsort(doc, kind="stable")
    doc, piece = doc[order], piece[order]
    bad = np.zeros(n, bool)
    bad[doc[~found.good[piece]]] = True
    doc, piece = doc[~bad[doc]], piece[~bad[doc]]
    sizes = found.sizes[piece]
    group = found.groups[_spread(found.starts[piece], sizes)]
    stats = np.stack([np.bincount(doc, x[piece], n).astype(np.int64) for x in (found.n_a, found.n_b, found.sizes, found.n_links)], axis=1)
    doc = np.repeat(doc, sizes)
    ends = np.searchsorted(doc, np.arange(n + 1)).tolist()
    names = np.array([*enc.keys, ""], object)[group]
    digests = [hashlib.sha256(";".join(names[a:b]).encode()).hexdigest() if b > a else "" for a, b in zip(ends[:-1], ends[1:])]
    width = max(1, len(enc.keys))
    key, times = np.unique(doc * width + group, return_counts=True)
    doc, group = key // width, key % width
    flat, at, sizes = _joined(enc.of_group)
    width = max(1, len(enc.pairs))
    held = np.sort(np.repeat(doc, sizes[group]) * width + flat[_spread(at[group], sizes[group])])
    docs = np.bincount(held[np.diff(held, prepend=-1) != 0] % width)
    pairs = np.flatnonzero(docs)
    return Chunk(stats, digests, np.searchsorted(doc, np.arange(n + 1)), group, times, pairs, docs[pairs])


@dataclass
class Alignment:
    documents: DataFrame
    pairs: DataFrame
    groups: DataFrame


def align(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text", chunk_bytes: int = CHUNK_BYTES) -> Alignment:
    """Aligns tokenizers A (byte-level, of the tokenizers library) and B (sentencepiece) over all whole texts.

    documents: a row for each row of docs: id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256. pairs: a, b,
    docs (in how many documents a token a is linked with a token b), best (is that the most that a has with any).
    groups: key (`a1,a2|b1`), links, best, count_sum of each distinct group.

    A document with a null or empty text, or with one whose tokens don't give its bytes back (invalid UTF-8, or U+2581,
    which B reads as a space), has no tokens: zeros, and an empty groups_sha256. Null ids stay null and rows with equal ids
    are documents of their own; an empty table gives no rows; other columns aren't read. Documents are taken in chunks of
    chunk_bytes bytes of text, a longer text by itself; a chunk's groups are shuffled, not its documents' occurrences.
    """
    id_type = docs.schema[id_col].dataType
    schema = f"kind string, chunk string, id {id_type.simpleString()}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, at array<int>, times array<long>, key string, place int, a int, b int, docs long"
    arrow = pa.schema([("kind", pa.string()), ("chunk", pa.string()), ("id", to_arrow_type(id_type)), *((c, pa.int64()) for c in ("n_a", "n_b", "n_groups", "n_links")), ("groups_sha256", pa.string()), ("at", pa.list_(pa.int32())), ("times", pa.list_(pa.int64())), ("key", pa.string()), ("place", pa.int32()), ("a", pa.int32()), ("b", pa.int32()), ("docs", pa.int64())])

    def batch_of(kind: str, n: int, **columns) -> pa.RecordBatch:
        given = {"kind": pa.array([kind] * n, pa.string()), **columns}
        return pa.RecordBatch.from_arrays([given.get(f.name, pa.nulls(n, f.type)) for f in arrow], schema=arrow)

    def pair_batch(enc: Aligner, counts: np.ndarray) -> pa.RecordBatch:
        at = np.flatnonzero(counts)
        ids = np.array(list(enc.pairs), np.int32).reshape(-1, 2)[at]
        return batch_of("pair", len(at), a=pa.array(ids[:, 0]), b=pa.array(ids[:, 1]), docs=pa.array(counts[at]))

    def run(batches):
        enc = aligner(a_path, b_path)
        counts = np.zeros(0, np.int64)
        for batch in batches:
            for lo, hi in slices_by_bytes(batch.column(1), chunk_bytes):
                if enc.held > MEMO_BYTES:
                    yield pair_batch(enc, np.pad(counts, (0, len(enc.pairs) - len(counts))))
                    enc.forget()
                    counts = np.zeros(0, np.int64)
                c, name = encoded(enc, batch.column(1).slice(lo, hi - lo)), uuid.uuid4().hex
                counts = np.pad(counts, (0, len(enc.pairs) - len(counts)))
                counts[c.pairs] += c.docs
                held, place = np.unique(c.groups, return_inverse=True)
                n, offsets = hi - lo, pa.array(c.offsets, pa.int32())
                yield batch_of(
                    "doc", n, chunk=pa.array([name] * n), id=batch.column(0).slice(lo, n), groups_sha256=pa.array(c.digests, pa.string()), at=pa.ListArray.from_arrays(offsets, pa.array(place, pa.int32())), times=pa.ListArray.from_arrays(offsets, pa.array(c.times)),
                    **{x: pa.array(c.stats[:, k]) for k, x in enumerate(("n_a", "n_b", "n_groups", "n_links"))},
                )
                yield batch_of("group", len(held), chunk=pa.array([name] * len(held), pa.string()), place=pa.array(np.arange(len(held)), pa.int32()), key=pa.array([enc.keys[g] for g in held.tolist()], pa.string()))
        yield pair_batch(enc, np.pad(counts, (0, len(enc.pairs) - len(counts))))

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").cast("binary").alias("text"))
    parts = written(rows.mapInArrow(run, schema), "alignment")
    counted = parts.filter("kind = 'pair'").groupBy("a", "b").agg(F.sum("docs").alias("docs"))
    # an A id has at most as many rows here as B has ids
    pairs = written(counted.withColumn("best", F.col("docs") == F.max("docs").over(Window.partitionBy("a"))), "alignment-pairs")
    local = parts.filter("kind = 'group'").select("chunk", "place", "key")
    links = local.select("key").distinct().mapInArrow(_expand, "key string, a int, b int, times long")
    got = links.join(pairs, ["a", "b"]).groupBy("key").agg(F.sum("times").alias("links"), F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("best"), F.sum(F.col("times") * F.col("docs")).alias("count_sum"))
    groups = written(got, "alignment-groups")
    held = local.join(groups.select("key", "best", "count_sum"), "key").select(F.col("chunk").alias("of"), "place", "best", "count_sum")
    own = ["n_a", "n_b", "n_groups", "n_links"]
    back = parts.filter("kind = 'doc'").select("chunk", "id", *own, "groups_sha256", "at", "times")
    out_schema = f"id {id_type.simpleString()}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
    documents = back.groupBy("chunk").cogroup(held.groupBy("of")).applyInArrow(_sums, out_schema)
    return Alignment(documents.withColumnRenamed("id", id_col), pairs, groups)


def _expand(batches):
    """A row for each pair of ids linked in a group, with how often it is."""
    for batch in batches:
        out = {"key": [], "a": [], "b": [], "times": []}
        for key in batch.column(0).to_pylist():
            (a, na), (b, nb) = (np.unique(np.array(side.split(","), np.int32), return_counts=True) for side in key.split("|"))
            out["key"].append(np.full(len(a) * len(b), key, object))
            out["a"].append(np.repeat(a, len(b)))
            out["b"].append(np.tile(b, len(a)))
            out["times"].append(np.outer(na, nb).ravel())
        if out["key"]:
            yield pa.RecordBatch.from_pydict({k: np.concatenate(v) for k, v in out.items()}, pa.schema([("key", pa.string()), ("a", pa.int32()), ("b", pa.int32()), ("times", pa.int64())]))


def _sums(docs: pa.Table, groups: pa.Table) -> pa.Table:
    """Of one chunk: each document's n_best and count_sum, from its groups'."""
    docs = docs.combine_chunks()
    if not docs.num_rows:
        return pa.table({c: pa.array([], docs.schema.field(c).type if c in docs.column_names else pa.int64()) for c in ("id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")})
    known = np.zeros((2, groups.num_rows), np.int64)
    known[:, groups["place"].to_numpy()] = groups["best"].to_numpy(), groups["count_sum"].to_numpy()
    at, times = docs["at"].combine_chunks(), docs["times"].combine_chunks()
    doc = np.repeat(np.arange(docs.num_rows), np.diff(at.offsets.to_numpy()))
    sums = np.zeros((2, docs.num_rows), np.int64)
    for k in range(2):
        np.add.at(sums[k], doc, known[k][at.flatten().to_numpy()] * times.flatten().to_numpy())
    out = {c: docs[c] for c in ("id", "n_a", "n_b", "n_groups", "n_links")}
    return pa.table(out | {"n_best": sums[0], "count_sum": sums[1], "groups_sha256": docs["groups_sha256"]})
