"""An index beside the vectors: an inverted file of cells for approximate search, and short codes for exact search in two phases.

The vectors' space is parted into cells around centres that k-means finds in a bounded sample; every vector is filed under
its nearest centre, in a folder of its own for each cell. Beside the vector stands a code of one or two bytes a component and
how far the code is from the vector. An index is two tables:

    centres   cell, centre
    vectors   cell (folder), id, code, scale, error, same (hash of the vector), v

`search` looks into the cells nearest to a query only and computes exact distances there. `search_exact` reads the codes of
all vectors: a vector is as far from a query as its code, give or take the code's error, so only those that may be among
the k nearest are read in full, and only in the cells where they are.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..storage import new_path, written
from .nearest import FOUND, Nearest, best_of, matrix, usable, waves

SAMPLE_BYTES, MOST_CELLS, FILE_ROWS = 16_000_000, 4_096, 250_000


@dataclass
class VectorIndex:
    centres: DataFrame
    vectors: DataFrame
    bits: int

    @property
    def cells(self) -> int:
        return self.centres.count()


def k_means(sample: np.ndarray, cells: int, rounds: int = 12, seed: int = 7) -> np.ndarray:
    """Centres of Lloyd's rounds from random rows of the sample; a centre that loses its rows keeps its place."""
    centres = sample[np.random.default_rng(seed).permutation(len(sample))[:cells]].copy()
    for _ in range(rounds):
        cell = nearest_cells(sample, centres, 1)[:, 0]
        n = np.bincount(cell, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, cell, sample)
        centres[n > 0] = sums[n > 0] / n[n > 0, None]
    return centres


def nearest_cells(vectors: np.ndarray, centres: np.ndarray, probes: int) -> np.ndarray:
    """The `probes` cells nearest to each vector, nearest first."""
    out = np.empty((len(vectors), probes), np.int64)
    step = max(1, 4_000_000 // max(1, len(centres)))
    for a in range(0, len(vectors), step):
        far = (centres**2).sum(1) - 2 * (vectors[a : a + step] @ centres.T)
        near = np.argpartition(far, probes - 1, axis=1)[:, :probes]
        out[a : a + step] = np.take_along_axis(near, np.argsort(np.take_along_axis(far, near, 1), axis=1, kind="stable"), 1)
    return out


def encode(v: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes, scales and errors of vectors: half precision numbers (16), or whole ones from -127 to 127 (8)."""
    scale = np.abs(v).max(axis=1, initial=0) / (127 if bits == 8 else 32_768)
    scale[scale == 0] = 1
    codes = np.rint(v / scale[:, None]).astype(np.int8) if bits == 8 else (v / scale[:, None]).astype(np.float16)
    error = np.sqrt(((v - decode(codes, scale)) ** 2).sum(1)) * (1 + 1e-12)
    return codes, scale, error


def decode(codes: np.ndarray, scale: np.ndarray) -> np.ndarray:
    return codes.astype(np.float64) * scale[:, None]


def build_index(vectors: DataFrame, path: str | None = None, cells: int | None = None, bits: int = 16, id_col: str = "id", vector_col: str = "embedding", seed: int = 7) -> VectorIndex:
    """Write an index of the vectors to path and return it. Ids tell vectors apart.

    cells: by default half the square root of the number of vectors, MOST_CELLS at most. Vectors that are null or hold a null or
    non-finite component are left out, as are those with another number of components than most have. The centres come
    from a sample of SAMPLE_BYTES bytes; every vector is filed. A cell's vectors are dealt to as many tasks and files as
    hold FILE_ROWS of them.
    """
    if bits not in (8, 16):
        raise ValueError("a code has 8 or 16 bits a component")
    spark = vectors.sparkSession
    path = path or new_path(spark, "vector-index")
    rows = usable(vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v")), "v")
    sizes = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    d, n = (sizes.d, sizes["count"]) if sizes else (0, 0)
    rows = rows.filter(F.size("v") == d)
    sample = rows.orderBy(F.xxhash64("id", F.lit(seed))).limit(max(1, SAMPLE_BYTES // (8 * max(1, d)))).select("v").toArrow()["v"].combine_chunks()
    known = matrix(sample, d)[1]
    cells = max(1, min(cells or min(MOST_CELLS, round(math.sqrt(n) / 2)), max(1, len(known))))
    centres = k_means(known, cells, seed=seed) if len(known) else np.zeros((1, d))
    spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centres)], "cell int, centre array<double>").coalesce(1).write.parquet(f"{path}/centres")
    shared = spark.sparkContext.broadcast(centres)

    def file(batches):
        for batch in batches:
            v = matrix(batch.column(1), d)[1]
            codes, scale, error = encode(v, bits)
            raw = pa.array([c.tobytes() for c in codes], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(nearest_cells(v, shared.value, 1)[:, 0], pa.int32()), batch.column(0), raw, pa.array(scale), pa.array(error), batch.column(1)], ["cell", "id", "code", "scale", "error", "v"])

    filed = rows.select("id", "v").mapInArrow(file, "cell int, id long, code binary, scale double, error double, v array<double>")
    filed = written(filed.withColumns({"same": F.xxhash64("v"), "v": F.col("v").cast(vectors.schema[vector_col].dataType)}), "filed")
    files = filed.groupBy("cell").agg(F.ceil(F.count("*") / FILE_ROWS).cast("int").alias("_files"))
    dealt = filed.join(F.broadcast(files), "cell").withColumn("_file", F.pmod(F.xxhash64("id"), "_files"))  # MOST_CELLS rows are broadcast
    dealt.repartition("cell", "_file").drop("_files", "_file").write.partitionBy("cell").parquet(f"{path}/vectors")
    return load_index(spark, path, bits)


def load_index(spark: SparkSession, path: str, bits: int = 16) -> VectorIndex:
    return VectorIndex(spark.read.parquet(f"{path}/centres"), spark.read.parquet(f"{path}/vectors"), bits)


def live(index: VectorIndex, dead: DataFrame | None) -> DataFrame:
    return index.vectors if dead is None else index.vectors.join(dead.select("id").distinct(), "id", "left_anti")


def _asked(index: VectorIndex, queries: DataFrame, probes: int) -> tuple[DataFrame, np.ndarray, int]:
    """The queries with the cells that each looks into, the centres, and their number of components."""
    held = index.centres.orderBy("cell").toArrow()  # MOST_CELLS rows at most
    d = len(held["centre"][0])
    centres = matrix(held["centre"].combine_chunks(), d)[1]
    probes = min(probes, len(centres))
    rows = usable(queries.select(F.col("query_id").cast("long").alias("query_id"), F.col("query").cast("array<double>").alias("query")), "query").filter(F.size("query") == d)
    shared = queries.sparkSession.sparkContext.broadcast(centres)

    def look(batches):
        for batch in batches:
            cells = nearest_cells(matrix(batch.column(1), d)[1], shared.value, probes)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(cells.tolist(), pa.list_(pa.int32())), pa.array(cells[:, 0], pa.int32())], ["query_id", "query", "cells", "first"])

    return rows.mapInArrow(look, "query_id long, query array<double>, cells array<int>, first int"), centres, d


def search(index: VectorIndex, queries: DataFrame, k: int, probes: int = 8, dead: DataFrame | None = None) -> DataFrame:
    """query_id, id, distance, rank: the k nearest live vectors of each query (query_id, query) in the `probes` cells nearest to it.

    Approximate; with as many probes as there are cells it is exact. Queries without a vector, or with another number of
    components than the index, find nothing. Query ids tell queries apart. Queries of one wave are dealt by their nearest
    cell, and only the folders of the cells that a wave looks into are read.
    """
    spark, table = queries.sparkSession, live(index, dead)
    asked, _, d = _asked(index, queries, probes)
    if k <= 0:
        return spark.createDataFrame([], f"{FOUND}, rank int")

    def wave(held: pa.Table) -> DataFrame:
        cells = held["cells"].combine_chunks()
        flat = cells.flatten().to_numpy()
        of = np.repeat(np.arange(len(cells)), np.diff(cells.offsets.to_numpy()))
        order = np.argsort(flat, kind="stable")
        names, starts = np.unique(flat[order], return_index=True)
        lookers = dict(zip(names.tolist(), np.split(of[order], starts[1:]))) if len(names) else {}
        shared = spark.sparkContext.broadcast((held["query_id"].to_numpy(), matrix(held["query"].combine_chunks(), d)[1], lookers))

        def run(batches):
            query_ids, q, lookers = shared.value
            best = Nearest(q, k)
            for cell, ids, v in by_cell(batches, d):
                best.add(v, ids, lookers[cell])
            yield from best.found(query_ids)

        mine = table.filter(F.col("cell").isin(names.tolist())) if len(names) else table.limit(0)
        return mine.select("cell", "id", "v").mapInArrow(run, FOUND)

    return best_of(waves(asked, wave, order="first"), k)


def by_cell(batches, d: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """cell, ids and vectors of each batch's rows of one cell."""
    for batch in batches:
        cell, ids, v = batch.column(0).to_numpy(), batch.column(1).to_numpy(), matrix(batch.column(2), d)[1]
        order = np.argsort(cell, kind="stable")
        for part in np.split(order, np.flatnonzero(np.diff(cell[order])) + 1) if len(order) else []:
            yield int(cell[part[0]]), ids[part], v[part]


class Candidates:
    """Pairs of a query and a vector that may be among its k nearest, by the vectors' codes.

    A query's k-th smallest distance to a code plus that code's error bounds its k-th nearest vector; what is farther than
    that even with its error taken off goes. Of a query's candidates with one and the same vector the k smallest ids are enough.
    """

    LIMIT = 500_000

    def __init__(self, queries: np.ndarray, k: int):
        self.q, self.k, self.square = queries, k, (queries**2).sum(1)
        self.bound = np.full(len(queries), np.inf)
        self.least = np.full((len(queries), k), np.inf)
        self.held: list[tuple[np.ndarray, ...]] = []
        self.n = 0

    def add(self, codes: np.ndarray, error: np.ndarray, columns: tuple[np.ndarray, ...]) -> None:
        """columns: same, cell and id of each code."""
        square = (codes**2).sum(1)
        step = max(1, 1_000_000 // max(1, len(codes)))
        for a in range(0, len(self.q), step):
            rough = self.square[a : a + step][:, None] + square - 2 * (self.q[a : a + step] @ codes.T)
            slack = 1e-6 * np.sqrt(self.square[a : a + step][:, None] + square)  # of the roots of rounded sums
            far = np.sqrt(np.maximum(rough, 0))
            upper, lower = far + error + slack, far - error - slack
            self.least[a : a + step] = np.sort(np.concatenate([self.least[a : a + step], np.partition(upper, min(self.k, len(codes)) - 1, axis=1)[:, : self.k]], axis=1), axis=1)[:, : self.k]
            self.bound[a : a + step] = self.least[a : a + step, -1]
            at, of = np.nonzero(lower <= self.bound[a : a + step][:, None])
            self.held.append((at + a, lower[at, of], upper[at, of], *(c[of] for c in columns)))
            self.n += len(at)
            if self.n > self.LIMIT:
                self._tidy()

    def _tidy(self) -> None:
        q, lower, upper, same, cell, ids = (np.concatenate(c) for c in zip(*self.held))
        kept = np.flatnonzero(lower <= self.bound[q])
        order = kept[np.lexsort((ids[kept], same[kept], q[kept]))]
        new = np.concatenate([[True], (np.diff(q[order]) != 0) | (np.diff(same[order]) != 0)])[: len(order)]
        first = np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
        order = order[np.arange(len(order)) - first < self.k]
        self.held = [tuple(c[order] for c in (q, lower, upper, same, cell, ids))]
        self.n, self.LIMIT = len(order), max(self.LIMIT, 2 * len(order))

    def found(self, query_ids: np.ndarray) -> Iterator[pa.RecordBatch]:
        if self.held:
            self._tidy()
            q, lower, upper, _, cell, ids = self.held[0]
            yield pa.RecordBatch.from_pydict({"query_id": query_ids[q], "id": ids, "cell": cell.astype(np.int32), "lower": lower, "upper": upper})


def search_exact(index: VectorIndex, queries: DataFrame, k: int, dead: DataFrame | None = None) -> DataFrame:
    """query_id, id, distance, rank: the k nearest live vectors of each query, exactly, over codes first.

    The first phase reads code, scale and error of every vector, the second the vectors of the candidates' cells. What holds
    of queries in search() holds here.
    """
    spark, table = queries.sparkSession, live(index, dead)
    if k <= 0:
        return spark.createDataFrame([], f"{FOUND}, rank int")
    asked, _, d = _asked(index, queries, 1)
    kind = np.int8 if index.bits == 8 else np.float16

    def wave(held: pa.Table) -> DataFrame:
        shared = spark.sparkContext.broadcast((held["query_id"].to_numpy(), matrix(held["query"].combine_chunks(), d)[1]))

        def run(batches):
            query_ids, q = shared.value
            maybe = Candidates(q, k)
            for batch in batches:
                codes = np.frombuffer(b"".join(batch.column(2).to_pylist()), kind).reshape(batch.num_rows, d)
                cell, ids, scale, error, same = (batch.column(c).to_numpy() for c in (0, 1, 3, 4, 5))
                maybe.add(decode(codes, scale), error, (same, cell, ids))
            yield from maybe.found(query_ids)

        found = table.select("cell", "id", "code", "scale", "error", "same").mapInArrow(run, "query_id long, id long, cell int, lower double, upper double")
        order = Window.partitionBy("query_id").orderBy("upper")
        ranked = written(found, "candidates").withColumn("_n", F.row_number().over(order))
        bound = ranked.filter(F.col("_n") == k).select(F.col("query_id").alias("_of"), F.col("upper").alias("_bound"))
        near = written(ranked.join(bound, F.col("query_id") == F.col("_of"), "left").filter(F.col("_bound").isNull() | (F.col("lower") <= F.col("_bound"))).select("query_id", "id", "cell"), "candidates")
        cells = [r.cell for r in near.select("cell").distinct().collect()]  # MOST_CELLS at most
        whole = table.filter(F.col("cell").isin(cells)) if cells else table.limit(0)
        pairs = near.join(whole.select("cell", "id", F.col("v").cast("array<double>").alias("v")), ["cell", "id"])
        asked_in = asked.select(F.col("query_id").alias("_q"), "query")
        return pairs.join(asked_in, F.col("query_id") == F.col("_q")).select("query_id", "id", distance("v", "query").alias("distance"))

    return best_of(waves(asked, wave, order="first"), k)


def distance(a: str, b: str):
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def recall(found: DataFrame, exact: DataFrame) -> float:
    """Share of the exact hits (query_id, id) that were found."""
    hit = exact.select("query_id", "id").join(found.select("query_id", "id", F.lit(1).alias("_hit")).distinct(), ["query_id", "id"], "left")
    return float(hit.agg(F.avg(F.coalesce("_hit", F.lit(0)))).first()[0] or 0.0)


def probes_for(index: VectorIndex, target: float = 0.95, k: int = 10, sample: int = 200) -> int:
    """The least number of probes whose recall@k reaches target on `sample` of the index's own vectors; each asks for the others.

    One exact search; the cell of each hit among the query's cells tells how many probes it takes.
    """
    own = index.vectors.orderBy(F.xxhash64("id", F.lit(11))).limit(sample).select(F.col("id").alias("query_id"), F.col("v").alias("query"))
    own = written(own, "own")
    hits = search_exact(index, own, k + 1).filter("id <> query_id").select("query_id", "id")
    placed = hits.join(index.vectors.select("id", "cell"), "id")
    asked, centres, _ = _asked(index, own, MOST_CELLS)
    at = placed.join(asked.select(F.col("query_id").alias("_q"), "cells"), F.col("query_id") == F.col("_q")).select(F.array_position("cells", F.col("cell")).alias("at"))
    need = at.groupBy("at").count().orderBy("at").collect()  # a row for each number of probes
    total, seen = sum(r["count"] for r in need), 0
    for r in need:
        seen += r["count"]
        if seen >= target * total:
            return int(r["at"])
    return len(centres)
