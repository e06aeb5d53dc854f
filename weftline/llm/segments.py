"""Encoding of texts with a public tokenizer, one call for each distinct segment.

A text is cut at single spaces wherever no token can cross the cut. Segments that repeat are encoded once by each
Python worker and kept in a bounded memo or store, so the tokenizer mostly sees segments that are new to the worker.
"""

from __future__ import annotations

import json
import os
import re
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: A space beside other white space, where byte-level tokenizers take runs of white space together (Unicode's, and \x1c-\x1f to be safe).
_WIDE = r"[\s\v\x1c-\x1f\x{85}\p{Z}]"
_UNSAFE = f"{_WIDE} | {_WIDE}"
_EDGE = rf"\A(?:\z|{_WIDE})|{_WIDE}\z"

_PLAIN_CHARS = re.compile(r"[ A-Za-zÀ-ÖØ-öø-ÿ.,;:!?]*")

_loaded: dict[tuple[str, str], "SegmentEncoder"] = {}


def encoder(path: str, boundary: str) -> "SegmentEncoder":
    """The worker's encoder for this file; it outlives a task, as the worker does."""
    if (path, boundary) not in _loaded:
        _loaded[path, boundary] = SegmentEncoder(path, boundary)
    return _loaded[path, boundary]


def _byte_letters() -> dict[str, str]:
    """The character that stands for each byte in byte-level vocabularies: itself if printable, else the next one from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): chr(b) for b in plain} | {chr(b): chr(256 + i) for i, b in enumerate(other)}


def slices_by_bytes(texts: pa.Array, limit: int):
    """(start, stop) of runs of rows with about `limit` bytes each; a longer text is a run of its own."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(sizes)
    start = 0
    while start < len(sizes):
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + limit, "right")))
        yield start, stop
        start = stop


def cut_long(text: str, limit: int) -> list[str]:
    """Pieces of at least `limit` characters, cut before single spaces between other characters; joined they are the text."""
    parts, start = [], 0
    while len(text) - start > 2 * limit:
        at = text.find(" ", start + limit)
        while at >= 0 and (at + 1 >= len(text) or text[at - 1].isspace() or text[at + 1].isspace()):
            at = text.find(" ", at + 1)
        if at < 0:
            break
        parts.append(text[start:at])
        start = at
    return [*parts, text[start:]]


class SegmentEncoder:
    """boundary: "drop" where the tokenizer drops white space (any space is a safe cut), "lead" where a space goes with
    the word after it (byte-level BPE; texts with a space beside other white space are encoded whole)."""

    def __init__(self, path: str, boundary: str, memo_limit: int = 200_000, store_bytes: int = 64_000_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        if boundary not in ("drop", "lead"):
            raise ValueError(f"unknown boundary {boundary!r}")
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.lead, self.memo_limit = boundary == "lead", memo_limit
        self.memo: dict[str, bytes] = {}
        self.store, self.store_bytes = (pa.array([], pa.large_string()), pa.array([], pa.large_binary())), store_bytes
        parts = json.loads(self.tokenizer.to_str())
        byte_level = parts["pre_tokenizer"] or {}
        self.direct = self.lead and parts["normalizer"] is None and byte_level.get("type") == "ByteLevel" and byte_level["use_regex"] and not byte_level["add_prefix_space"] and parts["post_processor"] is None
        added = [t for t in parts["added_tokens"] or []]
        #: An added token of plain characters is found inside words, one with a space across a cut: such tokenizers get whole texts or segments.
        self.direct = self.direct and not any(_PLAIN_CHARS.fullmatch(t["content"]) for t in added)
        self.whole = any(" " in t["content"] or t["lstrip"] or t["rstrip"] or t["single_word"] for t in added)
        if self.direct:
            special = {t["id"]: len(t["content"].encode()) for t in added}
            vocabulary = self.tokenizer.get_vocab()
            self.token_bytes = np.zeros(max(vocabulary.values()) + 1, np.int64)
            for token, i in vocabulary.items():
                self.token_bytes[i] = special.get(i, len(token))  # a byte is a letter in byte-level vocabularies

    def _ids(self, segments: list[str]) -> list[bytes]:
        """The ids of each segment as bytes of unsigned 32-bit integers."""
        memo = self.memo
        found = list(map(memo.get, segments))
        new = list(dict.fromkeys(s for s, x in zip(segments, found) if x is None))
        if new:
            if len(memo) + len(new) > self.memo_limit:
                memo.clear()
                memo.update((s, x) for s, x in zip(segments, found) if x is not None)  # most likely the frequent ones
            fresh = {}
            for i in range(0, len(new), 4096):
                part = new[i : i + 4096]
                for s, e in zip(part, self.tokenizer.encode_batch_fast(part, add_special_tokens=False)):
                    fresh[s] = array("I", e.ids).tobytes()
            memo.update(fresh)
            found = [fresh[s] if x is None else x for s, x in zip(segments, found)]
        return found

    def _side_by_side(self, segments: pa.Array, run: int = 512) -> pa.Array | None:
        """The ids of each segment, a space before it, as bytes; runs of segments are encoded as one text each.

        The segments must have no white space at either end. The tokens' bytes tell where a segment's ids end; None if
        some segment doesn't end with a token.
        """
        words = segments.to_pylist()
        runs = [" " + " ".join(words[i : i + run]) for i in range(0, len(words), run)]
        ids = [np.array(e.ids, np.uint32) for i in range(0, len(runs), 64) for e in self.tokenizer.encode_batch_fast(runs[i : i + 64], add_special_tokens=False)]
        ids = np.concatenate([*ids, np.empty(0, np.uint32)])
        reached, ends = np.cumsum(self.token_bytes[ids]), np.cumsum(pc.binary_length(segments).to_numpy().astype(np.int64) + 1)
        last = np.searchsorted(reached, ends)
        if len(ends) and (last[-1] != len(ids) - 1 or (reached[last] != ends).any()):
            return None
        offsets = np.concatenate([[0], 4 * (last + 1)])
        return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(segments), [None, pa.py_buffer(offsets), pa.py_buffer(ids)])

    def _recalled(self, segments: pa.Array) -> pa.Array | None:
        """_side_by_side, of which those segments are spared that a slice had before; the store has them and their ids as Arrow arrays."""
        words, ids = self.store
        at = pc.index_in(segments, value_set=words)
        missing = at.is_null()
        new = segments.filter(missing)
        fresh = self._side_by_side(new)
        if fresh is None:
            return None
        where = at.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        where[missing.to_numpy(zero_copy_only=False)] = len(words) + np.arange(len(new))
        all_words, all_ids = pa.concat_arrays([words, new]), pa.concat_arrays([ids, fresh])
        for held in ((all_words, all_ids), (new, fresh), (words[:0], ids[:0])):
            if sum(x.nbytes for x in held) <= self.store_bytes:
                self.store = held
                break
        return all_ids.take(pa.array(where))

    def _after_spaces(self, segments: pa.Array, times: np.ndarray) -> tuple[pa.Array, np.ndarray]:
        """Ids as bytes, and where among them those of each used segment are, a space before it; the last are empty.

        Segments used once are most likely new to the memo: they bypass it where they can.
        """
        used = times > 0
        alone = times != 1 if self.direct else np.ones(len(segments), bool)
        if self.direct:
            alone |= pc.match_substring_regex(segments, _EDGE).to_numpy(zero_copy_only=False)
        joined = self._recalled(segments.filter(pa.array(~alone))) if self.direct else None
        if joined is None:
            joined, alone = pa.array([], pa.large_binary()), np.ones(len(segments), bool)
        single = alone & used
        ids = self._ids([" " + s for s in segments.filter(pa.array(single)).to_pylist()])
        where = np.full(len(segments), len(joined) + len(ids))
        where[~alone] = np.arange(len(joined))
        where[single] = len(joined) + np.arange(len(ids))
        return pa.concat_arrays([joined, pa.array([*ids, b""], pa.large_binary())]), where

    def encode(self, texts: pa.Array, lengths_only: bool = False) -> tuple[np.ndarray | None, np.ndarray]:
        """All ids of the texts one after the other (None if lengths_only), and the number of ids of each text. Null is empty."""
        texts = pc.fill_null(texts, "").cast(pa.large_string())
        n = len(texts)
        if not n:
            return np.empty(0, np.uint32), np.zeros(0, np.int64)
        if self.whole:
            found = [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch(texts.to_pylist(), add_special_tokens=False)]
            return None if lengths_only else np.concatenate(found), np.array([len(f) for f in found], np.int64)
        pieces = pc.split_pattern(texts, " ")
        starts = pieces.offsets.to_numpy().astype(np.int64)
        starts -= starts[0]
        coded = pieces.flatten().dictionary_encode()
        segments, index = coded.dictionary, coded.indices.to_numpy().astype(np.int64)
        if self.lead:
            first = segments.take(pa.array(index[starts[:-1]])).to_pylist()
            unsafe = np.flatnonzero(pc.match_substring_regex(texts, _UNSAFE).to_numpy(zero_copy_only=False))
            for i in unsafe:  # such a text is one segment: what stands in for its other pieces is empty
                first[i] = texts[int(i)].as_py()
                index[starts[i] : starts[i + 1]] = len(segments)
            index[starts[:-1]] = len(segments) + 1 + np.arange(n)
            times = np.bincount(index, minlength=len(segments))[: len(segments)]
            kept = {i for i in unsafe}
            ids, where = self._after_spaces(segments, times)
            of_first = self._ids([s if i not in kept else "" for i, s in enumerate(first)])
            for i in unsafe:
                of_first[i] = self._whole(first[i])
            index = np.concatenate([where, len(ids) - 1 + np.arange(n + 1)])[index]
            ids = pa.concat_arrays([ids, pa.array(of_first, pa.large_binary())])
        else:
            ids = pa.array(self._ids(segments.to_pylist()), pa.large_binary())
        sizes = pc.binary_length(ids).to_numpy() // 4
        counts = np.add.reduceat(sizes[index], starts[:-1])
        if lengths_only:
            return None, counts
        data = ids.take(pa.array(index)).buffers()[2]
        return np.frombuffer(data, np.uint32, counts.sum()) if counts.any() else np.empty(0, np.uint32), counts

    def _whole(self, text: str) -> bytes:
        parts = cut_long(text, 200_000)
        return b"".join(array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch(parts, add_special_tokens=False))
