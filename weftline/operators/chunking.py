"""Packing sentence units into chunks of at most so many tokens, with overlaps. The one operator with state from row to row."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Callable
from itertools import accumulate

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import sentences

_TOKEN = re.compile(r"[A-Za-z0-9]+|[^\sA-Za-z0-9]")


def count_tokens(text: str) -> int:
    """The default counter: runs of ASCII letters and digits, and other characters one by one."""
    return len(_TOKEN.findall(text))


def bpe_counter(path: str, pattern: str) -> Callable[[str], int]:
    """Counts the tokens of a public byte-pair vocabulary (a .tiktoken file and its pattern); a worker loads it once."""

    def count(text: str) -> int:
        if path not in _loaded:
            import base64

            import tiktoken

            with open(path, "rb") as f:
                ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
            _loaded[path] = tiktoken.Encoding("counter", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        return len(_loaded[path].encode_ordinary(text))

    return count


_loaded: dict = {}


def overlap_ratio(value: float) -> float:
    """Over 1 means percent; held within 0 and 0.9."""
    return min(0.9, max(0.0, value / 100 if value > 1 else value))


def join_units(units: list[str]) -> str:
    out = ""
    for u in units:
        near = out[-1:].isascii() and out[-1:].isalnum() and u[:1].isascii() and u[:1].isalnum()
        out += (" " if near else "") + u
    return out


def _fit(text: str, budget: int, count: Callable[[str], int], tail: bool) -> str:
    """The longest prefix (or suffix, with tail) within budget tokens; counts grow with length, so it is found by halving."""
    low, high = 0, len(text)
    while low < high:
        mid = (low + high + 1) // 2
        part = text[len(text) - mid :] if tail else text[:mid]
        low, high = (mid, high) if count(part) <= budget else (low, mid - 1)
    return text[len(text) - low :] if tail else text[:low]


def _windows(unit: str, most: int, overlap: int, count: Callable[[str], int]) -> list[str]:
    out, rest = [], unit
    while count(rest) > most:
        piece = _fit(rest, most, count, tail=False) or rest[:1]
        out.append(piece)
        again = _fit(piece, overlap, count, tail=True) if overlap else ""
        rest = (again if len(again) < len(piece) else "") + rest[len(piece) :]
    return [*out, rest] if rest else out


def _overlap(texts: list[str], sizes: list[int], overlap: int, most: int, count: Callable[[str], int]) -> tuple[list[str], list[int]]:
    """What the next chunk takes over, with its sizes: as many of the last texts as the overlap has room for (one more than it, if that is at most two thirds of a chunk), or the end of the last one."""
    if not overlap or not texts:
        return [], []
    room = max(overlap, sizes[-1]) if 3 * sizes[-1] <= 2 * most or sizes[-1] <= overlap else overlap
    n = bisect_right(list(accumulate(reversed(sizes))), room)
    if n:
        return texts[-n:], sizes[-n:]
    part = _fit(texts[-1], room, count, tail=True)
    return ([part], [count(part)]) if part else ([], [])


def pack(units: list[str], most: int = 512, ratio: float = 0.1, count: Callable[[str], int] = count_tokens) -> list[str]:
    """Chunks of consecutive units; a chunk starts with the end of the one before it, its lead.

    Units are counted once. Each chunk's last piece is found in the running total of the sizes; a lead that would keep the
    next piece out is cut to what that leaves room for.
    """
    overlap = int(most * overlap_ratio(ratio))
    pieces = [p for u in units for p in (_windows(u, most, overlap, count) if count(u) > most else [u])]
    sizes = list(map(count, pieces))
    total = [0, *accumulate(sizes)]
    out: list[str] = []
    lead, lead_sizes, at = [], [], 0
    while at < len(pieces):
        room = most - sum(lead_sizes)
        stop = max(at if lead else at + 1, bisect_right(total, total[at] + room) - 1)
        texts, held = lead + pieces[at:stop], lead_sizes + sizes[at:stop]
        full = stop > at and sum(held) >= most
        last = stop == len(pieces) and not full
        if not last or not out or out[-1] != join_units(texts):
            out.append(join_units(texts))
        if last:
            return out
        lead, lead_sizes = _overlap(texts, held, overlap, most, count)
        if not full and sum(lead_sizes) + sizes[stop] > most:
            part = _fit(join_units(lead), most - sizes[stop], count, tail=True) if sizes[stop] < most else ""
            lead, lead_sizes = ([part], [count(part)]) if part else ([], [])
        at = stop
    rest = join_units(lead)
    return [*out, rest] if rest and (not out or out[-1] != rest) else out


def chunks(docs: DataFrame, heads: DataFrame, most: int = 512, ratio: float = 0.1, count: Callable[[str], int] = count_tokens, batch_col: str = "content") -> DataFrame:
    """doc_id, chunk_index, name, content: `head` (the hyperedge's content) and body_1, body_2 ... of each doc that has a hyperedge.

    docs: id, content; heads: doc_id, content (the first of each doc by id counts). A doc whose text and head are both
    empty is left out. Sentences are cut by Spark; only packing runs in Python, row by row within Arrow batches.
    """
    first = heads.groupBy("doc_id").agg(F.min_by("content", "id").alias("head"))
    rows = docs.join(first, docs.id == first.doc_id).select(docs.id.alias("doc_id"), F.coalesce("head", F.lit("")).alias("head"), sentences(F.coalesce(F.col(batch_col), F.lit(""))).alias("units"))
    rows = rows.filter((F.col("head") != "") | (F.size("units") > 0))

    def run(frames):
        for f in frames:
            out = []
            for doc_id, head, units in zip(f["doc_id"], f["head"], f["units"]):
                out.append((doc_id, 0, "head", head))
                out += [(doc_id, i, f"body_{i}", c) for i, c in enumerate(pack(list(units), most, ratio, count), 1)]
            yield pd.DataFrame(out, columns=["doc_id", "chunk_index", "name", "content"])

    return rows.mapInPandas(run, f"doc_id {docs.schema['id'].dataType.simpleString()}, chunk_index int, name string, content string")
