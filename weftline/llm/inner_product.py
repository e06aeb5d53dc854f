"""Exact top-k search by inner product of integer vectors.

Vectors stand in files by descending length. Each is turned by a rotation (the right singular vectors of a sample of the
vectors), so that the first coordinates hold most of its length. A query's product with a vector is summed up over a few
leading parts of the coordinates; what the rest can add is at most the product of both rests' lengths (Cauchy-Schwarz).
A pair whose sum and bound stay below the query's k-th best score so far is left, and once the longest vector that is left
can't reach it either, the query is done with the file. Pairs that no bound prunes are scored anew in whole numbers, so
rotation and rounding decide nothing.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import new_path, written

#: Bytes of vectors for fitting the rotation, and in the head that gives every query its first threshold.
SAMPLE_BYTES, HEAD_BYTES = 16_000_000, 4_000_000
#: Bytes of the queries of one pass over the vectors.
WAVE_BYTES = 16_000_000
#: Vectors of more components aren't rotated; the bounds hold in any coordinates.
ROTATE_UP_TO = 2_048
#: Pairs of one tile; a tile whose share of open pairs is below SPARSE goes on pair by pair.
TILE, SPARSE = 1_000_000, 0.05
FOUND = "query_row long, query_id long, vec_id long, score long"
_SMALLEST = np.iinfo(np.int64).min


def scaled(vector: Column, scale: float = 256.0) -> Column:
    """array<long>: floor(scale * x) of each component x as double."""
    return F.transform(vector, lambda x: F.floor(F.lit(scale) * x.cast("double")))


def complete(vector: Column) -> Column:
    """Does a vector stand there, with no null and no non-finite component?"""
    odd = F.exists(vector, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == F.lit(float("inf"))))
    return vector.isNotNull() & ~F.coalesce(odd, F.lit(True))


def rotation(sample: np.ndarray) -> np.ndarray:
    """Orthogonal d x d: the right singular vectors of the sample's rows, by descending singular value."""
    d = sample.shape[1]
    if d == 0 or d > ROTATE_UP_TO or not len(sample):
        return np.eye(d)
    return np.linalg.eigh(sample.T @ sample)[1][:, ::-1]


def parts(d: int) -> list[int]:
    """Ends of the parts of coordinates: an eighth, a quarter, a half, all."""
    return sorted({max(1, d // 8), max(1, d // 4), max(1, d // 2), d}) if d else [0]


class Side:
    """Vectors of one side, rotated, with the length of what is left after each part."""

    def __init__(self, whole: np.ndarray, turn: np.ndarray):
        self.whole, self.turned = whole, whole.astype(np.float64) @ turn
        square = np.zeros((len(whole), whole.shape[1] + 1))
        square[:, :-1] = np.cumsum((self.turned**2)[:, ::-1], axis=1)[:, ::-1]
        self.rest = np.sqrt(square)
        self.length = self.rest[:, 0]


class Search:
    """The k best (score, id) of each query of a wave among the vectors seen so far."""

    def __init__(self, queries: Side, rows: np.ndarray, floor: np.ndarray, k: int):
        self.q, self.rows, self.k, self.floor = queries, rows, k, floor.copy()
        self.score = np.full((len(rows), k), _SMALLEST)
        self.id = np.zeros((len(rows), k), np.int64)
        self.nameless = np.zeros((len(rows), k), bool)

    def add(self, vectors: Side, rows: np.ndarray, ids: np.ndarray, nameless: np.ndarray) -> None:
        if not len(rows):
            return
        slack = 1e-9 * self.q.length * vectors.length.max() + 0.5
        open_ = np.flatnonzero(self.q.length * vectors.length.max() >= self.floor - slack)
        step = max(1, TILE // len(rows))
        for a in range(0, len(open_), step):
            mine = open_[a : a + step]
            at, of = self._open(mine, vectors, slack[mine])
            other = rows[of] != self.rows[mine[at]]
            at, of = mine[at[other]], of[other]
            if len(at):
                score = np.einsum("ij,ij->i", self.q.whole[at], vectors.whole[of])
                good = score >= self.floor[at]
                self._merge(at[good], score[good], ids[of[good]], nameless[of[good]])

    def _open(self, mine: np.ndarray, vectors: Side, slack: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (place in mine, vector) that the bounds don't prune."""
        need, done, sums, at, of = self.floor[mine] - slack, 0, None, None, None
        q, v = self.q.turned[mine], vectors.turned
        for end in parts(v.shape[1]):
            if at is None:
                sums = q[:, done:end] @ v[:, done:end].T + (0 if sums is None else sums)
                left = sums + np.outer(self.q.rest[mine, end], vectors.rest[:, end]) >= need[:, None]
                if np.count_nonzero(left) <= SPARSE * left.size or end == v.shape[1]:
                    at, of = np.nonzero(left)
                    sums = sums[at, of]
            else:
                sums = sums + np.einsum("ij,ij->i", q[at, done:end], v[of, done:end])
                left = sums + self.q.rest[mine[at], end] * vectors.rest[of, end] >= need[at]
                at, of, sums = at[left], of[left], sums[left]
            done = end
        return at, of

    def _merge(self, query: np.ndarray, score: np.ndarray, ids: np.ndarray, nameless: np.ndarray) -> None:
        touched, place = np.unique(query, return_inverse=True)
        k, old = self.k, np.repeat(np.arange(len(touched)), self.k)
        q = np.concatenate([old, place])
        s, i, n = (np.concatenate([was[touched].ravel(), new]) for was, new in ((self.score, score), (self.id, ids), (self.nameless, nameless)))
        order = np.lexsort((i, n, ~s, q))
        q = q[order]
        first = np.searchsorted(q, np.arange(len(touched)))
        kept = order[first[:, None] + np.arange(k)]
        self.score[touched], self.id[touched], self.nameless[touched] = s[kept], i[kept], n[kept]
        self.floor[touched] = np.maximum(self.floor[touched], self.score[touched, -1])

    def found(self, query_ids: pa.Array) -> pa.Table:
        q, j = np.nonzero(self.score != _SMALLEST)
        ids = pa.array(self.id[q, j], mask=self.nameless[q, j])
        return pa.table({"query_row": self.rows[q], "query_id": query_ids.take(pa.array(q)), "vec_id": ids, "score": self.score[q, j]})


def _matrix(vectors: pa.Array, d: int) -> np.ndarray:
    return vectors.flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False).reshape(len(vectors), d)


def top_inner_products(vectors: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", scale: float = 256.0) -> DataFrame:
    """query_id, rank, vec_id, score: for each query row the k rows with the greatest inner products but its own, ties to the smaller id.

    The vectors are floor(scale * x); is_query is a condition over the columns of `vectors`. Vectors that are null or hold
    a null or non-finite component take no part, nor do those whose squared length doesn't fit 62 bits (no score of theirs
    would fit a long). A query only meets vectors with as many components as it has; empty vectors score 0. Ids are whole numbers, a null id comes last among
    equal scores; rows with equal ids are queries and candidates each, and a query leaves out its own row only. Fewer
    candidates than k give fewer rows, an empty table gives none, other columns aren't read.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.coalesce(is_query, F.lit(False)).alias("is_query"), F.col(vector_col).alias("x")).filter(complete(F.col("x")))
    rows = rows.select("id", "is_query", scaled(F.col("x"), scale).alias("v"), F.size("x").alias("d"))
    square = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    rows = rows.withColumn("square", square).filter(F.col("square") < float(1 << 62)).withColumn("row", F.monotonically_increasing_id())
    # equal lengths are dealt by the row's number, so many of one length spread over the ranges
    files = written(rows.repartitionByRange(F.desc("square"), F.xxhash64("row")).sortWithinPartitions(F.desc("square")), "vectors")
    out, path = None, new_path(spark, "products")
    for r in files.groupBy("d").agg(F.count("*").alias("n"), F.count_if("is_query").alias("queries")).filter("queries > 0 AND n > 1").toLocalIterator():
        _search(spark, files.filter(F.col("d") == r.d), r.d, r.n, r.queries, k, path)
        out = path
    if out is None:
        return spark.createDataFrame([], f"query_id long, rank int, {id_col} long, score long")
    best = spark.read.schema(FOUND).parquet(path)
    order = Window.partitionBy("query_row").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    ranked = best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", F.col("vec_id").alias(id_col), "score")


def _search(spark: SparkSession, rows: DataFrame, d: int, n: int, queries: int, k: int, path: str) -> None:
    """Append each wave's best rows to the table at path."""
    size = 8 * max(1, d)
    sample = rows.orderBy(F.xxhash64("row")).limit(max(1, min(16_384, SAMPLE_BYTES // size))).select("v").toArrow()["v"].combine_chunks()
    turn = rotation(_matrix(sample, d).astype(np.float64))
    head = rows.orderBy(F.desc("square"), "row").limit(max(k + 1, min(4_096, HEAD_BYTES // size))).select("row", "v").toArrow()
    start = spark.sparkContext.broadcast((turn, head["row"].to_numpy(), _matrix(head["v"].combine_chunks(), d)))

    def first_floor(batches):
        turn, head_rows, head_v = start.value
        side = Side(head_v, turn)
        for batch in batches:
            mine, v = batch.column(0).to_numpy(), _matrix(batch.column(2), d)
            search = Search(Side(v, turn), mine, np.full(len(mine), _SMALLEST // 2), k)
            search.add(side, head_rows, np.zeros(len(head_rows), np.int64), np.zeros(len(head_rows), bool))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), batch.column(3), pa.array(search.floor)], ["row", "id", "v", "square", "floor"])

    asked = rows.filter("is_query").select("row", "id", "v", "square").mapInArrow(first_floor, "row long, id long, v array<long>, square double, floor long")
    asked = written(asked, "queries")
    waves = max(1, math.ceil(queries * size / WAVE_BYTES))
    for wave in range(waves):
        mine = asked if waves == 1 else asked.filter(F.pmod(F.xxhash64("row"), F.lit(waves)) == wave)
        held = mine.toArrow()
        if not held.num_rows:
            continue
        # no vector shorter than this reaches any query's floor: the files' row groups are pruned by it
        least = pc.min(pc.divide(held["floor"].cast(pa.float64()), pc.max_element_wise(pc.sqrt(held["square"]), 1e-9))).as_py()
        able = rows.filter(F.col("square") >= least * least * (1 - 1e-6)) if least > 0 else rows
        shared = spark.sparkContext.broadcast((turn, held["row"].to_numpy(), held["id"].combine_chunks(), _matrix(held["v"].combine_chunks(), d), held["floor"].to_numpy()))
        able.select("row", "id", "v").mapInArrow(_searcher(shared, d, k), FOUND).write.mode("append").parquet(path)
        shared.destroy()


def _searcher(shared, d: int, k: int):
    def run(batches):
        turn, rows, query_ids, v, floor = shared.value
        search = Search(Side(v, turn), rows, floor, k)
        for batch in batches:
            ids = batch.column(1)
            search.add(Side(_matrix(batch.column(2), d), turn), batch.column(0).to_numpy(), ids.fill_null(0).to_numpy(), ids.is_null().to_numpy(zero_copy_only=False))
        yield from search.found(query_ids).to_batches()

    return run
