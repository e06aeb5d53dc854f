"""Mixing sources to target weights by entropy balancing.

Each document gets a rate r (its expected number of copies). Of all rates in [0, cap] that give every source its target
number of words, entropy balancing takes those closest to one copy of everything (least sum of r log r - r). By the convex
dual there is one multiplier per source, and r = min(cap, exp(multiplier * words)): exponentially tilted rates. Newton steps
on the multipliers, kept inside brackets, need only sums over the documents, which Spark computes; the rates are then
rounded into whole copies so that the words taken follow the words wanted.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

#: A mixture is stated per source, so the sources are few; more than this is an error, not a cut.
MAX_SOURCES = 100_000


def cyclic_weights(cycle: tuple[float, ...] = (3, 1, 2)) -> Callable[[list], list[float]]:
    return lambda sources: [cycle[i % len(cycle)] for i in range(len(sources))]


def fill_targets(sizes: list[float], weights: list[float], share: float, cap: float) -> list[float]:
    """Shares of `share` times all sizes by weight; none above cap times its size, the excess shared anew by weight."""
    left, targets = share * sum(sizes), [0.0] * len(sizes)
    open_ = [i for i, w in enumerate(weights) if w > 0]
    while open_:
        total = sum(weights[i] for i in open_)
        full = [i for i in open_ if left * weights[i] / total > cap * sizes[i]]
        if not full:
            for i in open_:
                targets[i] = left * weights[i] / total
            break
        for i in full:
            targets[i] = float(cap * sizes[i])
        left -= sum(targets[i] for i in full)
        open_ = [i for i in open_ if i not in set(full)]
    return targets


def solve_dual(histogram: DataFrame, sources: list[dict], cap: float, tolerance: float = 1e-7, most: int = 60) -> dict[int, float]:
    """The multiplier of each source, by Newton steps; a step's gradient and curvature are one Spark aggregation.

    histogram: source_no, size, n. sources: dicts with no, words, rows, target. Multipliers are per mean document size of
    the source; inf stands for rates at the cap, -inf for rates of 0.
    """
    spark, done, open_ = histogram.sparkSession, {}, {}
    for s in sources:
        if s["target"] <= 0 or s["words"] <= 0:
            done[s["no"]] = -math.inf
        elif s["target"] >= cap * s["words"] * (1 - 1e-12):
            done[s["no"]] = math.inf
        else:
            mean = s["words"] / s["rows"]
            open_[s["no"]] = {"at": 0.0, "low": -math.inf, "high": math.log(cap) * mean + 1, "mean": mean, "target": s["target"]}
    for _ in range(most):
        if not open_:
            break
        now = spark.createDataFrame([(k, v["at"], v["mean"]) for k, v in open_.items()], "source_no int, at double, mean double")
        x = F.col("size") / F.col("mean")
        rate = F.least(F.lit(float(cap)), F.exp(F.least(F.col("at") * x, F.lit(50.0))))
        words = F.col("n") * F.col("size") * rate
        sums = histogram.join(F.broadcast(now), "source_no").groupBy("source_no").agg(F.sum(words).alias("words"), F.sum(F.when(rate < cap, words * x).otherwise(0.0)).alias("slope"))
        for r in sums.collect():
            s = open_[r.source_no]
            off = r.words - s["target"]
            s["low" if off < 0 else "high"] = s["at"]
            if abs(off) <= tolerance * s["target"] or s["high"] - s["low"] < 1e-12:
                done[r.source_no] = open_.pop(r.source_no)["at"]
                continue
            step = s["at"] - off / r.slope if r.slope > 0 else math.nan
            if not s["low"] < step < s["high"]:
                step = (s["low"] + s["high"]) / 2 if s["low"] > -math.inf else 2 * s["at"] - 1
            s["at"] = step
    if open_:
        raise RuntimeError(f"{len(open_)} sources' multipliers didn't settle in {most} steps")
    return done


def _close_gap(copies: np.ndarray, size: np.ndarray, rate: np.ndarray, wanted: float, most: int, rounds: int = 8, pairs_up_to: int = 512, near: float = 0.002) -> np.ndarray:
    """Change the copies of one document, or of two where the block is small, as long as that brings the words taken nearer.

    First among the documents whose rate is fractional (round the other way); where that leaves more than `near` of the
    words wanted, as it may in a source of a few documents, among all of them.
    """
    low, gap = np.floor(rate), wanted - float((copies * size).sum())
    for free in (False, True):
        for _ in range(rounds):
            if free and abs(gap) <= near * wanted:
                break
            up = (copies < most) & (free | ((low < rate) & (copies == low)))
            down = (copies > 0) & (free | ((low < rate) & (copies > low)))
            doc = np.concatenate([np.flatnonzero(up), np.flatnonzero(down)])
            sign = np.repeat([1, -1], [up.sum(), down.sum()])
            if not len(doc):
                break
            change = sign * size[doc]
            one = int(np.argmin(np.abs(gap - change)))
            flips, left = [one], abs(gap - change[one])
            if len(doc) <= pairs_up_to:
                both = np.abs(gap - change[:, None] - change[None, :])
                both[doc[:, None] == doc[None, :]] = np.inf
                i, j = np.unravel_index(int(np.argmin(both)), both.shape)
                if both[i, j] < left:
                    flips, left = [i, j], both[i, j]
            if left >= abs(gap):
                break
            for i in flips:
                copies[doc[i]] += sign[i]
                gap -= change[i]
    return copies


def _round_block(rows: pd.DataFrame, most: int) -> pd.DataFrame:
    """Whole copies, the floor or the ceiling of each rate, so that at every point the words taken are as near as can be to those wanted; longest first, so the last and smallest documents close the gap."""
    rows = rows.sort_values(["size", "order", "doc_id"], ascending=[False, True, True], kind="stable")
    wanted, taken, copies = 0.0, 0, []
    for size, rate in zip(rows["size"].tolist(), rows["rate"].tolist()):
        wanted += size * rate
        low = math.floor(rate)
        c = low + (low < rate and wanted - taken - low * size > size / 2)
        taken += c * size
        copies.append(c)
    copies = _close_gap(np.array(copies), rows["size"].to_numpy(), rows["rate"].to_numpy(), wanted, most)
    return rows.assign(copies=copies)[["doc_id", "size", "source_no", "rate", "copies"]].astype({"copies": "int32"})


def mix_sources(
    docs: DataFrame,
    weights: Callable[[list], list[float]] = cyclic_weights(),
    share: float = 1.5,
    cap: float = 2.0,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    rows_per_block: int = 4096,
    by: tuple[str, ...] = (),
) -> DataFrame:
    """One row per row of docs: id, source, size (words), source_size, target (words wanted of its source), rate, copies, taken (copies * size).

    weights maps the list of sources, by code point with null last, to their weights. A null or empty text has size 0 and
    is never taken; a null source is a source of its own; repeated rows are rounded as rows of their own; an empty table
    gives no rows. Rounding goes by blocks of about rows_per_block rows that a hash of the id picks (of the columns `by`,
    where given), so a source of any size is spread over tasks, and reruns agree. Where more rows than a block has are of
    one id, or of none, a row number spreads them too.
    """
    spark = docs.sparkSession
    id_type = docs.schema[id_col].dataType.simpleString()
    size = F.coalesce(F.regexp_count(F.col(text_col).cast("string"), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")
    slim = written(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), size.alias("size"), F.xxhash64(*(by or [id_col])).alias("order"), F.monotonically_increasing_id().alias("turn")), "mix-sizes")
    counts = slim.groupBy("source", "size").agg(F.count("*").alias("n"))
    per_source = counts.groupBy("source").agg(F.sum("n").alias("rows"), F.sum(F.col("size") * F.col("n")).alias("words")).limit(MAX_SOURCES + 1).collect()
    if len(per_source) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    per_source.sort(key=lambda r: (r.source is None, r.source or ""))
    targets = fill_targets([r.words for r in per_source], weights([r.source for r in per_source]), share, cap)
    sources = [{"no": i, "source": r.source, "rows": r.rows, "words": r.words, "target": float(t)} for i, (r, t) in enumerate(zip(per_source, targets))]
    names = spark.createDataFrame([(s["no"], s["source"]) for s in sources], "source_no int, source string")
    histogram = written(counts.join(F.broadcast(names), counts.source.eqNullSafe(names.source)).select("source_no", "size", "n"), "mix-histogram")
    multipliers = solve_dual(histogram, sources, cap)
    known = spark.createDataFrame(
        [(s["no"], s["source"], s["words"], s["target"], multipliers[s["no"]], s["words"] / s["rows"], -(-s["rows"] // rows_per_block)) for s in sources],
        "source_no int, known_source string, source_size long, target double, at double, mean double, blocks long",
    )
    often = written(slim.groupBy("order").agg(F.count("*").alias("n")).filter(F.col("n") > rows_per_block).select(F.col("order").alias("often")), "mix-often")
    placed = slim.join(often, F.col("order") == F.col("often"), "left").withColumn("turn", F.when(F.col("often").isNotNull(), F.col("turn"))).drop("often")
    tilt = F.when(F.col("size") == 0, 0.0).when(F.col("at") == float("-inf"), 0.0).when(F.col("at") == float("inf"), float(cap)).otherwise(F.least(F.lit(float(cap)), F.exp(F.least(F.col("at") * F.col("size") / F.col("mean"), F.lit(50.0)))))
    rated = placed.join(F.broadcast(known), placed.source.eqNullSafe(F.col("known_source"))).select(
        "doc_id", "source_no", "size", tilt.alias("rate"), "order", F.pmod(F.xxhash64("order", "turn", F.lit("block")), F.col("blocks")).alias("block")
    )
    rounded = rated.groupBy("source_no", "block").applyInPandas(lambda block: _round_block(block, math.floor(cap)), f"doc_id {id_type}, size long, source_no int, rate double, copies int")
    return rounded.join(F.broadcast(known), "source_no").select(
        F.col("doc_id").alias(id_col), F.col("known_source").alias("source"), "size", "source_size", "target", "rate", "copies", (F.col("copies") * F.col("size")).alias("taken")
    )
