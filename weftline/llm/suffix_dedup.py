"""Removal of long repeated byte strings, by bucket-pointer refinement of sampled suffixes.

Of all suffixes only those enter that start with an anchor: the q-gram of least hash among those that start in the first
LENGTH - Q + 1 bytes of some LENGTH-byte string. Equal strings have their anchor at equal places, so every string can be
found from its anchor's bucket, and an anchor stands for the contiguous range of strings that it is the anchor of.

Buckets of equal q-grams are then refined by identifiers of what stands at other offsets, and each level's split is what
the next one starts from:

1. bucket: the q-gram; identifier: the whole stretch that the anchor's range of strings covers.
2. bucket: the q-gram and the bytes common to GRID neighbouring strings; identifier: the stretch that those strings cover.
3. bucket: one string at its offset from the anchor.

Members of a bucket with equal identifiers repeat each other wholly. Only buckets with several identifiers go on to the
next level, with one member for each identifier, so copies are never refined twice and no pairs are formed.
Stretches are compared by 64-bit polynomial fingerprints beside those of their anchors.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import delete, new_path, written

Q, GRID, CHUNK = 200, 16, 800_000
_BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64
_TABLE = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_POS = np.uint64((1 << 20) - 1)


class _Powers:
    """Powers of the base and of its inverse, as many as any chunk has needed."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = 1 << (n - 1).bit_length()
            with np.errstate(over="ignore"):
                self.up = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size, _BASE, np.uint64)]))
                self.down = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size, pow(_BASE, -1, 1 << 64), np.uint64)]))
        return self.up, self.down


_powers = _Powers()


class Prints:
    """Fingerprints of any stretches of some bytes."""

    def __init__(self, data: bytes):
        raw = np.frombuffer(data, np.uint8)
        up, self.down = _powers.get(len(raw) + 1)
        self.sums = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(_TABLE[raw] * up[: len(raw)], out=self.sums[1:])

    def of(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return (self.sums[stop] - self.sums[start]) * self.down[start]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    n = len(x) - width + 1
    blocks = np.concatenate([x, np.full(-len(x) % width, np.iinfo(np.uint64).max, np.uint64)]).reshape(-1, width)
    before = np.minimum.accumulate(blocks, axis=1).reshape(-1)
    after = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(after[:n], before[width - 1 : width - 1 + n])


def anchors_of(data: bytes, length: int) -> list[np.ndarray]:
    """at, lo, hi, gram, whole: an anchor at byte `at` for the strings that start at at - hi ... at - lo."""
    out = []
    for c in range(0, max(0, len(data) - length + 1), CHUNK):
        part = data[c : c + CHUNK + length - 1]
        prints = Prints(part)
        starts = np.arange(len(part) - Q + 1)
        grams = prints.of(starts, starts + Q)
        ranked = (_mix(grams) & ~_POS) | starts.astype(np.uint64)
        best = (_sliding_min(ranked, length - Q + 1) & _POS).astype(np.int64)
        first = np.concatenate([[0], 1 + np.flatnonzero(np.diff(best))])
        last = np.concatenate([first[1:], [len(best)]]) - 1
        at = best[first]
        lo, hi = at - last, at - first
        whole = _mix(prints.of(first, last + length)) * np.uint64(_BASE) + (lo * 1024 + hi).astype(np.uint64)
        out.append((at + c, lo, hi, grams[at], whole))
    return [np.concatenate(x) for x in zip(*out)] if out else [np.empty(0, np.int64)] * 3 + [np.empty(0, np.uint64)] * 2


def _merge(ranges: list[tuple[int, int]], length: int) -> list[tuple[int, int]]:
    """Maximal runs of bytes covered by strings whose starts are in the (first, last) ranges."""
    runs: list[list[int]] = []
    for a, b in sorted(ranges):
        if runs and a <= runs[-1][1]:
            runs[-1][1] = max(runs[-1][1], b + length)
        else:
            runs.append([a, b + length])
    return [(a, b) for a, b in runs]


def remove_repeats(docs: DataFrame, length: int = 400, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """One row per row of docs: id, n_bytes, n_removed, n_spans, kept_sha256, and the kept bytes as `kept` with_text.

    Every byte goes that is covered by a string of `length` bytes which starts anywhere else too, in the same text or
    another; strings are judged on the input, overlaps count, and none crosses texts. A null text is empty; a text shorter
    than `length` is kept whole; repeated rows are copies of each other; null ids are kept; an empty table gives no rows.
    """
    if not 2 * Q <= length <= 900:
        raise ValueError("length must be 400 to 900 bytes")
    id_type = docs.schema[id_col].dataType.simpleString()
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), text.alias("text")).withColumn("rk", F.xxhash64("id", "text"))
    place = f"id {id_type}, rk long"

    def same(a: DataFrame, b: DataFrame, *more: str) -> Column:
        on = a["id"].eqNullSafe(b["id"]) & (a["rk"] == b["rk"])
        for c in more:
            on = on & (a[c] == b[c])
        return on

    def find(batches):
        for batch in batches:
            n, parts = [], []
            for t in batch.column(2):
                parts.append(anchors_of(t.as_py().encode("utf-8", "surrogatepass"), length))
                n.append(len(parts[-1][0]))
            at, lo, hi, gram, whole = (np.concatenate(x) for x in zip(*parts))
            of = pa.array(np.repeat(np.arange(len(n)), n))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(of), batch.column(1).take(of), *(pa.array(x.astype(np.int32)) for x in (at, lo, hi)), pa.array(gram.view(np.int64)), pa.array(whole.view(np.int64))], ["id", "rk", "at", "lo", "hi", "gram", "whole"])

    every_at = new_path(docs.sparkSession, "anchors")
    anchors = rows.select("id", "rk", "text").mapInArrow(find, f"{place}, at int, lo int, hi int, gram long, whole long")
    anchors.write.parquet(every_at)
    anchors = docs.sparkSession.read.schema(anchors.schema).parquet(every_at)
    # what is joined with a hot bucket is written first: a join of two plain shuffles can be split, one above an aggregation can't
    again = written(anchors.groupBy("gram").agg(F.count("*").alias("n")).filter("n > 1").select("gram"), "grams-again")
    found = written(anchors.join(again, "gram", "left_semi"), "anchors-again")
    delete(docs.sparkSession, every_at)

    # level 1
    classes = written(found.groupBy("gram", "whole").agg(F.count("*").alias("n"), F.min(F.struct("id", "rk", "at", "lo", "hi")).alias("one")), "classes")
    ranges = [found.join(classes.filter("n > 1").select("gram", "whole"), ["gram", "whole"], "left_semi").select("id", "rk", (F.col("at") - F.col("hi")).alias("first"), (F.col("at") - F.col("lo")).alias("last"))]
    several = written(classes.groupBy("gram").agg(F.count("*").alias("c"), F.max((F.col("n") == 1).cast("int")).alias("open")).filter("c > 1 AND open = 1").select("gram"), "grams-open")
    ones = classes.join(several, "gram", "left_semi").select("one.*", "gram", (F.col("n") == 1).alias("open"))

    def cut(batches):
        names = ["id", "rk", "at", "lo", "hi", "gram", "open", "context"]
        for batch in batches:
            of, cols = [], [[] for _ in range(6)]
            for i, (t, them) in enumerate(zip(batch.column(2), batch.column(3))):
                data = t.as_py().encode("utf-8", "surrogatepass")
                for x in them.as_py():
                    of.append(i)
                    for c, v in zip(cols, (x["at"], x["lo"], x["hi"], x["gram"], x["open"], data[x["at"] - x["hi"] : x["at"] - x["lo"] + length])):
                        c.append(v)
            of = pa.array(of, pa.int64())
            types = [pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.bool_(), pa.binary()]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(of), batch.column(1).take(of), *(pa.array(c, t) for c, t in zip(cols, types))], names)

    by_row = ones.groupBy("id", "rk").agg(F.collect_list(F.struct("at", "lo", "hi", "gram", "open")).alias("them"))
    cut_from = rows.join(by_row, same(rows, by_row)).select(rows["id"], rows["rk"], "text", "them")
    contexts = written(cut_from.mapInArrow(cut, f"{place}, at int, lo int, hi int, gram long, open boolean, context binary"), "contexts")

    # level 2
    def grid(batches):
        names = ["id", "rk", "at", "lo", "gram", "open", "k", "core", "whole", "first", "last"]
        for batch in batches:
            at, lo, hi = (batch.column(i).to_numpy() for i in (2, 3, 4))
            parts = []
            for i, data in enumerate(batch.column(7)):
                prints = Prints(data.as_py())
                k = np.arange(lo[i] // GRID, hi[i] // GRID + 1)
                a, b = np.maximum(lo[i], k * GRID), np.minimum(hi[i], k * GRID + GRID - 1)
                zero = hi[i]  # an offset d before the anchor is at byte hi - d of the context
                core = prints.of(zero - k * GRID, zero - k * GRID - GRID + 1 + length)
                whole = _mix(prints.of(zero - b, zero - a + length)) * np.uint64(_BASE) + (a * 1024 + b).astype(np.uint64)
                parts.append((np.full(len(k), i), k, core, whole, at[i] - b, at[i] - a))
            if not parts:
                continue
            of, k, core, whole, first, last = (np.concatenate(x) for x in zip(*parts))
            of = pa.array(of)
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(of) for c in (0, 1, 2, 3, 5, 6)), pa.array(k.astype(np.int32)), pa.array(core.view(np.int64)), pa.array(whole.view(np.int64)), pa.array(first.astype(np.int32)), pa.array(last.astype(np.int32))], names)

    cells = written(contexts.mapInArrow(grid, f"{place}, at int, lo int, gram long, open boolean, k int, core long, whole long, first int, last int"), "cells")
    bucket = ["gram", "k", "core"]
    split = written(cells.groupBy(*bucket, "whole").agg(F.count("*").alias("n"), F.max("open").alias("open"), F.min(F.struct("id", "rk", "at", "lo")).alias("one")), "cell-classes")
    ranges.append(cells.filter("open").join(split.filter("n > 1").select(*bucket, "whole"), [*bucket, "whole"], "left_semi").select("id", "rk", "first", "last"))
    several = written(split.groupBy(*bucket).agg(F.count("*").alias("c"), F.max(F.col("open") & (F.col("n") == 1)).alias("some")).filter("c > 1 AND some").select(*bucket), "cells-open")
    ones = split.join(several, bucket, "left_semi").select("one.*", "k", (F.col("open") & (F.col("n") == 1)).alias("open"))

    # level 3
    def single(batches):
        names = ["id", "rk", "gram", "open", "d", "string", "first"]
        for batch in batches:
            at, lo, hi = (batch.column(i).to_numpy() for i in (2, 3, 4))
            parts = []
            for i, (data, them) in enumerate(zip(batch.column(6), batch.column(7))):
                prints = Prints(data.as_py())
                for x in them.as_py():
                    d = np.arange(max(lo[i], x["k"] * GRID), min(hi[i], x["k"] * GRID + GRID - 1) + 1)
                    parts.append((np.full(len(d), i), np.full(len(d), x["open"]), d, prints.of(hi[i] - d, hi[i] - d + length), at[i] - d))
            if not parts:
                continue
            of, open_, d, string, first = (np.concatenate(x) for x in zip(*parts))
            of = pa.array(of)
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(of) for c in (0, 1, 5)), pa.array(open_), pa.array(d.astype(np.int32)), pa.array(string.view(np.int64)), pa.array(first.astype(np.int32))], names)

    chosen = ones.groupBy("id", "rk", "at", "lo").agg(F.collect_list(F.struct("k", "open")).alias("them"))
    chosen = contexts.join(chosen, same(contexts, chosen, "at", "lo")).select(contexts["id"], contexts["rk"], contexts["at"], contexts["lo"], "hi", "gram", "context", "them")
    strings = written(chosen.mapInArrow(single, f"{place}, gram long, open boolean, d int, string long, first int"), "strings")
    bucket = ["gram", "d", "string"]
    twice = written(strings.groupBy(*bucket).agg(F.count("*").alias("n")).filter("n > 1").select(*bucket), "strings-twice")
    ranges.append(strings.filter("open").join(twice, bucket, "left_semi").select("id", "rk", "first", F.col("first").alias("last")))

    covered = ranges[0].union(ranges[1]).union(ranges[2]).groupBy("id", "rk").agg(F.collect_set(F.struct("first", "last")).alias("ranges"))

    def keep(batches):
        for batch in batches:
            out = [[] for _ in range(5)]
            for t, found in zip(batch.column(1), batch.column(2)):
                data = t.as_py().encode("utf-8", "surrogatepass")
                runs = _merge([(x["first"], x["last"]) for x in found.as_py() or []], length)
                kept, at = [], 0
                for a, b in runs:
                    kept.append(data[at:a])
                    at = b
                kept = b"".join([*kept, data[at:]])
                for c, v in zip(out, (len(data), len(data) - len(kept), len(runs), hashlib.sha256(kept).hexdigest(), kept)):
                    c.append(v)
            types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
            arrays = [pa.array(c, t) for c, t in zip(out, types)][: 4 + with_text]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"][: 5 + with_text])

    joined = rows.join(covered, same(rows, covered), "left").select(rows["id"], "text", "ranges")
    return joined.mapInArrow(keep, f"id {id_type}, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_text).withColumnRenamed("id", id_col)
