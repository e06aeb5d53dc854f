"""SimHash near-duplicates: 64-bit fingerprints of word shingles, links within a Hamming distance by pigeonring filtering.

Cut the fingerprint's 64 bits into a ring of M segments. If two fingerprints differ in at most D bits, some segment starts
a chain around the ring whose cumulative differences stay within its share of D at every length: at most l*D/M after l
segments (the pigeonring principle). With D = 3 and M = 4 the budgets are 0, 1, 2, 3. The first two segments of a chain
give the join key: one side has its own 32 bits, the other those 32 bits with none or any one of the second segment's 16
bits changed. Whoever meets is held against the longer chains, and only then against the full distance.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import delete, frugal, written
from .components import components
from .segments import slices_by_bytes

MAX_BITS, SEGMENTS, WIDTH = 3, 4, 16


def fingerprint(text: str | None, shingle: int = 3, step: int = 1 << 16) -> int:
    """The SimHash of a text's word shingles, repeats included; 0 where it has no word."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined, ends = b" ".join(words), np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = max(1, len(words) - shingle + 1)
    last = ends[min(shingle, len(words)) - 1 :]
    digest, counts = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for i in range(0, n, step):
        spans = zip(starts[i : min(n, i + step)].tolist(), last[i : i + step].tolist())
        hashes = np.fromiter((digest(joined[a:b], 42) for a, b in spans), np.uint64, min(step, n - i))
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp (the fingerprint's bits as a signed long) for each row of docs."""

    def hashes(batches):
        for batch in batches:
            out = np.fromiter((fingerprint(t.as_py(), shingle) for t in batch.column(1)), np.uint64, len(batch))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out.view(np.int64))], ["doc_id", "fp"])

    id_type = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(hashes, f"doc_id {id_type}, fp long")


def _segment(fp: Column, i: int) -> Column:
    return F.shiftrightunsigned(fp, WIDTH * (i % SEGMENTS)).bitwiseAND(F.lit(0xFFFF))


def _chain(a: Column, b: Column, start: int) -> Column:
    """Do the differences from this segment on stay within their budgets at every length?"""
    total, ok = F.lit(0), F.lit(True)
    for length in range(1, SEGMENTS + 1):
        total = total + F.bit_count(_segment(a.bitwiseXOR(b), start + length - 1))
        ok = ok & (total <= length * MAX_BITS // SEGMENTS)
    return ok


def links(prints: DataFrame) -> DataFrame:
    """a, b (a < b): every pair of different fingerprints of prints (column fp, distinct) within MAX_BITS bits, once each."""
    fp = F.col("fp")

    def key(i: int, flip: int = 0) -> Column:
        second = _segment(fp, i + 1).bitwiseXOR(F.lit(flip))
        return F.lit(i << 32).bitwiseOR(F.shiftleft(_segment(fp, i), 16)).bitwiseOR(second).cast("long")

    exact = prints.select(fp.alias("a"), F.explode(F.array(*[key(i) for i in range(SEGMENTS)])).alias("k"))
    near = prints.select(fp.alias("b"), F.explode(F.array(*[key(i, flip) for i in range(SEGMENTS) for flip in (0, *(1 << n for n in range(WIDTH)))])).alias("j"))
    a, b, start = F.col("a"), F.col("b"), F.shiftright("k", 32)
    chains = [_chain(a, b, i) for i in range(SEGMENTS)]
    here, first = F.lit(False), F.lit(False)
    for i, chain in enumerate(chains):
        here = here | ((start == i) & chain & ~first)  # a pair that several chains find counts at the first
        first = first | chain
    # Spark sizes what explode makes as if each row gave one, so by itself it broadcasts 68 rows a fingerprint through the driver
    return exact.join(near.hint("merge"), (F.col("k") == F.col("j")) & (a < b) & here & (F.bit_count(a.bitwiseXOR(b)) <= MAX_BITS)).select("a", "b")


def near_duplicates(docs: DataFrame, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, fingerprint (16 hex digits), component_id (the smallest id reachable over links).

    Texts with equal fingerprints are one node, so copies are never paired. A null or empty text has the fingerprint 0,
    which links like any other; fewer words than a shingle are one shingle; null ids are kept but never name a component
    (one of null ids only has a null component_id); repeated rows are in one component; an empty table gives no rows.
    """
    each = written(fingerprints(docs, shingle, id_col, text_col), "fingerprints")
    distinct = written(each.groupBy("fp").agg(F.min("doc_id").alias("least")), "fingerprint-nodes")
    found = components(links(distinct.select("fp")))
    rooted = distinct.join(found, distinct.fp == found.node)
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    linked = rooted.select("fp", "root").join(named, "root").select(F.col("fp").alias("linked_fp"), "component_id")
    nodes = written(distinct.join(linked, distinct.fp == F.col("linked_fp"), "left").select("fp", F.coalesce("component_id", "least").alias("component_id")), "fingerprint-components")
    out = each.join(nodes, "fp")
    return out.select(F.col("doc_id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


SIMILAR = (4, 5)  # a Jaccard similarity of 4/5, in whole numbers so that no rounding decides
SAMPLED, COMMON, MOST_COMMON = 32, 2, 1_000_000
LOOKS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xFF51AFD7ED558CCD)  # odd numbers; each gives a least hash of a set
PARITIES = 16  # words of 64 parities
CROWD = 8  # nodes that share a shingle of their prefixes; of fewer all pairs are few
MOST_SENT = 1_000_000  # nodes of 12 bytes that may be broadcast
BATCH_ROWS = 1000  # whole texts that a worker of similar_groups gets at once


def shingle_set(text: str | None, shingle: int = 5, step: int = 1 << 16) -> np.ndarray:
    """The distinct 64-bit hashes of a text's word shingles, in ascending order; fewer words than a shingle are one."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.int64)
    joined, ends = b" ".join(words), np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = max(1, len(words) - shingle + 1)
    last = ends[min(shingle, len(words)) - 1 :]
    digest, parts = xxhash.xxh3_64_intdigest, []
    for i in range(0, n, step):
        spans = zip(starts[i : min(n, i + step)].tolist(), last[i : i + step].tolist())
        parts.append(np.unique(np.fromiter((digest(joined[a:b], 42) for a, b in spans), np.uint64, min(step, n - i)).view(np.int64)))
    return np.unique(np.concatenate(parts)) if len(parts) > 1 else parts[0]


def prefix_length(n: int) -> int:
    """So many of a set's n elements, the first in an order common to all sets, meet those of any similar set."""
    return n - -(-SIMILAR[0] * n // SIMILAR[1]) + 1


def set_fingerprint(found: np.ndarray, step: int = 1 << 16) -> int:
    """The SimHash of a set of hashes, as a signed long; 0 for an empty set."""
    counts = np.zeros(64, np.int64)
    for i in range(0, len(found), step):
        counts += np.unpackbits(found[i : i + step].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(found), bitorder="little").view("<i8")[0])


def least_hashes(found: np.ndarray) -> list[int]:
    """For each of LOOKS the least of the set's hashes times it; similar sets have most often the same. 0 for an empty set."""
    return [int((found.view(np.uint64) * np.uint64(k)).min().view(np.int64)) if len(found) else 0 for k in LOOKS]


def parities(found: np.ndarray) -> np.ndarray:
    """Whether each of 64 * PARITIES classes of hashes has an odd number of the set's; two sets differ in as many hashes as parities, at least."""
    counts = np.bincount(found & (64 * PARITIES - 1), minlength=64 * PARITIES)
    return np.packbits(counts & 1, bitorder="little").view(np.int64)


def _drop(*tables: DataFrame) -> None:
    """Remove written tables that nothing reads any more."""
    for df in tables:
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            delete(df.sparkSession, folder)


def _plausible(pairs: DataFrame, sketches: DataFrame) -> DataFrame:
    """Those rows of pairs (a, b and more) whose sketches don't rule out that they are similar.

    Sets of n and m elements that are similar differ in at most (n + m) / 9 of them; the parities rule out most others
    before the sets are fetched, and rule out no similar ones.
    """
    a, b = (sketches.select(*[F.col(c).alias(f"{side}_{c}") for c in ("node", "n", *(f"w{i}" for i in range(PARITIES)))]).withColumnRenamed(f"{side}_node", side) for side in "ab")
    differ = sum((F.bit_count(F.col(f"a_w{i}").bitwiseXOR(F.col(f"b_w{i}"))) for i in range(1, PARITIES)), F.bit_count(F.col("a_w0").bitwiseXOR(F.col("b_w0"))))
    lengths = (F.col("a_n") * SIMILAR[1] >= F.col("b_n") * SIMILAR[0]) & (F.col("b_n") * SIMILAR[1] >= F.col("a_n") * SIMILAR[0])
    few = differ * (SIMILAR[1] + SIMILAR[0]) <= (F.col("a_n") + F.col("b_n")) * (SIMILAR[1] - SIMILAR[0])
    return pairs.join(a, "a").join(b, "b").filter(lengths & few).select(*pairs.columns)


def _similar_pairs(pairs: DataFrame, sets_of) -> DataFrame:
    """Those plausible pairs (a, b) of nodes whose whole shingle sets are similar, written. sets_of gives the sets of a table of nodes."""
    pairs = written(pairs.select("a", "b").distinct(), "similar-candidates")
    sets = sets_of(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct())
    left, right = sets.select(F.col("node").alias("a"), F.col("shingles").alias("x")), sets.select(F.col("node").alias("b"), F.col("shingles").alias("y"))
    # a pair takes one set along; the other is joined where it is counted
    both = F.size(F.array_intersect("x", "y"))
    union = F.size("x") + F.size("y") - both
    out = written(pairs.join(left, "a").join(right, "b").filter(both * SIMILAR[1] >= union * SIMILAR[0]).select("a", "b"), "similar-links")
    _drop(pairs, sets)
    return out


def similar_groups(docs: DataFrame, shingle: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, component_id (smallest id reachable) for each row of docs, where texts of a Jaccard similarity of 0.8 or more link.

    SimHash comes first: fingerprints of the sets link by pigeonring chains as in near_duplicates, and each text is held
    against one of those that it is linked with, against one of those that share a least hash with it (LOOKS of
    them), and, for each shingle that many prefixes share, against the middle of that crowd: the text whose prefix has
    most in common with all others, so the one that near copies were made of if it is there. What that links is one group. Fingerprints alone can't give such groups: at 0.8 a tenth to a fifth of their
    bits differ, at 0.7 little more. So prefix filtering finds the rest: in any order of all shingles, two similar sets
    share one among the first fifth of each. The order puts common shingles last (a sample tells them; it bears on the
    time, not on the result). Then
    all pairs from different groups that share enough of their prefixes are compared, none left out, so that only a large
    group of near copies is spared its pairs. Whole sets of 64-bit hashes decide about every pair.

    Texts of equal sets are one node. A null or empty text groups with other such texts; null ids are kept but never name
    a component (one of null ids only has a null component_id); repeated rows are in one component; an empty table gives
    no rows.
    """
    import xxhash

    spark, words = docs.sparkSession, [f"w{i}" for i in range(PARITIES)]
    looks = [f"m{i}" for i in range(len(LOOKS))]
    id_type = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def some_shingles(batches):
        for batch in batches:
            for text in batch.column(0):
                yield pa.RecordBatch.from_arrays([pa.array(shingle_set(text.as_py(), shingle))], ["shingle"])

    sampled = rows.filter(F.pmod(F.xxhash64("text"), F.lit(SAMPLED)) == 0).select("text").distinct().mapInArrow(frugal(some_shingles), "shingle long").groupBy("shingle").agg(F.count("*").alias("n"))
    common = sampled.filter(F.col("n") >= COMMON).orderBy(F.desc("n"), "shingle").limit(MOST_COMMON).toPandas()["shingle"].to_numpy(np.int64)
    by_hash = np.argsort(common)
    shared = spark.sparkContext.broadcast((common[by_hash], len(common) - by_hash))  # the commonest has the highest rank

    def prefix(found: np.ndarray) -> np.ndarray:
        common, ranks = shared.value
        rank = np.zeros(len(found), np.int64)
        if len(common):
            at = np.minimum(np.searchsorted(common, found), len(common) - 1)
            rank = np.where(common[at] == found, ranks[at], 0)
        return found[np.argsort(rank, kind="stable")[: prefix_length(len(found))]]

    def hashes(batches):
        seen: set[int] = set()  # of one task; a node's set is written once there
        part = TaskContext.get().partitionId()
        for batch in batches:
            for start, stop in slices_by_bytes(batch.column(1), 500_000):
                nodes, sizes, prints, leasts, firsts, sets, odd = [], [], [], [], [], [], []
                for text in batch.column(1).slice(start, stop - start):
                    found = shingle_set(text.as_py(), shingle)
                    node = xxhash.xxh3_64_intdigest(found.tobytes()) - (1 << 63)
                    new = node not in seen and len(found) > 0
                    seen.add(node)
                    nodes.append(node)
                    sizes.append(len(found))
                    odd.append(parities(found))
                    prints.append(set_fingerprint(found))
                    leasts.append(least_hashes(found))
                    firsts.append(prefix(found) if new else None)
                    sets.append(found if new else None)
                leasts = np.array(leasts, np.int64).reshape(-1, len(LOOKS))
                odd = np.array(odd, np.int64).reshape(-1, PARITIES)
                arrays = [batch.column(0).slice(start, stop - start), pa.array(nodes, pa.int64()), pa.array(np.full(len(nodes), part, np.int32)), pa.array(sizes, pa.int32()), pa.array(prints, pa.int64()), pa.array(firsts, pa.list_(pa.int64())), pa.array(sets, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays([*arrays, *(pa.array(odd[:, i]) for i in range(PARITIES)), *(pa.array(leasts[:, i]) for i in range(len(LOOKS)))], ["doc_id", "node", "part", "n", "fp", "prefix", "shingles", *words, *looks])

    each = written(rows.mapInArrow(frugal(hashes), f"doc_id {id_type}, node long, part int, n int, fp long, prefix array<long>, shingles array<long>, " + ", ".join(f"{w} long" for w in [*words, *looks])), "shingle-sets", BATCH_ROWS)
    known = each.filter("shingles IS NOT NULL")

    def sets_of(nodes: DataFrame) -> DataFrame:
        # of a set that several tasks wrote, one; so few nodes go to the sets, and only else all sets are shuffled to them
        wanted = written(nodes.join(sketches.select("node", "part"), "node"), "similar-wanted")
        near = F.broadcast(wanted) if wanted.count() <= MOST_SENT else wanted
        out = written(known.select("node", "part", "shingles").join(near, ["node", "part"], "left_semi").select("node", "shingles"), "similar-sets")
        _drop(wanted)
        return out

    sketches = written(known.groupBy("node").agg(F.first("n").alias("n"), F.min("part").alias("part"), F.first("fp").alias("fp"), *[F.first(w).alias(w) for w in [*words, *looks]]), "similar-sketches")
    prints = written(sketches.groupBy("fp").agg(F.min("node").alias("least")), "similar-prints")
    sketched = components(links(prints.select("fp"))).withColumnRenamed("node", "of")
    rooted = written(prints.join(sketched, F.col("fp") == F.col("of"), "left").select("fp", F.coalesce("root", "fp").alias("ring"), "least"), "similar-rings")
    center = written(rooted.groupBy("ring").agg(F.min("least").alias("center")), "similar-centers")
    seen = sketches.select("node", "fp").join(rooted.select("fp", "ring"), "fp").join(center, "ring").select("center", "node")
    for m in looks:
        least = written(sketches.groupBy(m).agg(F.min("node").alias("center"), F.count("*").alias("times")).filter("times > 1").select(m, "center"), "similar-least")
        seen = seen.union(sketches.select("node", m).join(least, m).select("center", "node"))
    members = known.select("node", "n", F.explode("prefix").alias("shingle")).repartition("shingle")  # one shuffle for what follows
    met = members.groupBy("shingle").agg(F.min("node").alias("low"), F.max("node").alias("high")).filter("low <> high").select("shingle")
    members = written(members.join(met, "shingle", "left_semi").distinct(), "similar-members")
    crowded = members.groupBy("shingle").agg(F.count("*").alias("times")).filter(F.col("times") >= CROWD)
    crowds = written(members.join(crowded, "shingle").select("shingle", "node", "times"), "similar-crowds")
    weights = written(crowds.groupBy("node").agg(F.sum("times").alias("weight")), "similar-weights")
    middle = crowds.join(weights, "node").groupBy("shingle").agg(F.max(F.struct("weight", "node")).alias("most"))
    middle = written(middle.select("shingle", F.col("most.node").alias("center")), "similar-middles")
    seen = seen.union(crowds.join(middle, "shingle").select("center", "node"))
    looked = seen.filter("node <> center").select(F.col("center").alias("a"), F.col("node").alias("b")).distinct()
    linked = _similar_pairs(_plausible(looked, sketches), sets_of)
    _drop(prints, rooted, center, crowds, weights, middle)
    found = components(linked).select(F.col("node").alias("in_group"), "root")
    grouped = members.join(found, F.col("node") == F.col("in_group"), "left").select("shingle", "node", "n", F.coalesce("root", "node").alias("root"))
    grouped = written(grouped, "similar-groups")
    apart = grouped.groupBy("shingle").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low <> high").select("shingle")
    open_ = written(grouped.join(apart, "shingle", "left_semi"), "similar-open")
    _drop(grouped, members)
    a, b = (open_.select("shingle", *[F.col(c).alias(f"{c}_{side}") for c in ("node", "n", "root")]) for side in "ab")
    near = (F.col("n_a") * SIMILAR[1] >= F.col("n_b") * SIMILAR[0]) & (F.col("n_b") * SIMILAR[1] >= F.col("n_a") * SIMILAR[0])
    crossing = a.join(b, "shingle").filter((F.col("node_a") < F.col("node_b")) & (F.col("root_a") != F.col("root_b")) & near)
    # what two sets share beyond the shorter prefix is at most the rest of one of them, so their prefixes must share the difference
    meetings = crossing.groupBy(F.col("node_a").alias("a"), F.col("node_b").alias("b"), "n_a", "n_b").agg(F.count("*").alias("times"))
    rest = F.greatest(*[F.floor((SIMILAR[0] * n + SIMILAR[1] - 1) / SIMILAR[1]) - 1 for n in (F.col("n_a"), F.col("n_b"))])
    enough = (F.col("times") + rest) * (SIMILAR[0] + SIMILAR[1]) >= (F.col("n_a") + F.col("n_b")) * SIMILAR[0]
    more = _similar_pairs(_plausible(meetings.filter(enough).select("a", "b"), sketches), sets_of)
    found = components(linked.union(more))
    nodes = written(each.groupBy("node").agg(F.min("doc_id").alias("least")), "similar-nodes")
    rooted = nodes.join(found, "node").select("node", "root", "least")
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = written(nodes.join(rooted.select("node", "root").join(named, "root").select("node", "component_id"), "node", "left").select("node", F.coalesce("component_id", "least").alias("component_id")), "similar-named")
    slim = written(each.select("doc_id", "node"), "similar-rows")
    _drop(each, sketches, open_, linked, more, nodes)
    return slim.join(named, "node").select(F.col("doc_id").alias(id_col), "component_id")
