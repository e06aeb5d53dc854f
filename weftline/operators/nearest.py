"""Nearest vectors by squared L2 distance, many queries at a time: a block of vectors against a wave of queries in a task.

A wave of queries is broadcast (its bytes are bounded, the number of waves isn't); each task goes over its vectors
once and hands on the k best of each query. Distances are first taken from products of whole blocks; the pairs that can be
among the best are then computed component by component, so that equal vectors have equal distances.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..storage import new_path

#: Bytes of the queries of one wave, and pairs of one tile of products.
WAVE_BYTES, TILE = 16_000_000, 1_000_000
FOUND = "query_id long, id long, distance double"


def usable(rows: DataFrame, vector: str) -> DataFrame:
    """Rows whose vector is there and has finite components only."""
    odd = F.exists(vector, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == F.lit(float("inf"))))
    return rows.filter(F.col(vector).isNotNull() & ~F.coalesce(odd, F.lit(True)))


def matrix(vectors: pa.Array, d: int) -> tuple[np.ndarray, np.ndarray]:
    """Which rows have d components, and those rows as a matrix."""
    fits = np.flatnonzero(np.diff(vectors.offsets.to_numpy()) == d)
    if len(fits) < len(vectors):
        vectors = vectors.take(pa.array(fits))
    return fits, vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(fits), d)


def pair_distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distance of each row of a to the same row of b, component after component."""
    total = np.zeros(len(a))
    for j in range(a.shape[1]):
        total += (a[:, j] - b[:, j]) ** 2
    return total


class Nearest:
    """The k nearest (distance, id) of each query among the vectors seen so far; of equal distances the smaller id."""

    def __init__(self, queries: np.ndarray, k: int):
        self.q, self.k = queries, k
        self.square = (queries**2).sum(1)
        self.distance = np.full((len(queries), k), np.inf)
        self.id = np.full((len(queries), k), np.iinfo(np.int64).max)

    def add(self, vectors: np.ndarray, ids: np.ndarray, mine: np.ndarray | None = None) -> None:
        """mine: the queries that look at these vectors; all of them by default."""
        mine = np.arange(len(self.q)) if mine is None else mine
        if not len(vectors) or not len(mine):
            return
        square = (vectors**2).sum(1)
        step = max(1, TILE // len(vectors))
        for a in range(0, len(mine), step):
            part = mine[a : a + step]
            rough = self.square[part][:, None] + square - 2 * (self.q[part] @ vectors.T)
            slack = 1e-9 * (self.square[part] + square.max())[:, None]
            worst = self.distance[part, -1]
            if len(vectors) > self.k:  # of this block alone only so many can count
                worst = np.minimum(worst, np.partition(rough, self.k - 1, axis=1)[:, self.k - 1] + slack[:, 0])
            at, of = np.nonzero(rough <= worst[:, None] + slack)
            self._merge(part[at], pair_distances(self.q[part[at]], vectors[of]), ids[of])

    def _merge(self, query: np.ndarray, distance: np.ndarray, ids: np.ndarray) -> None:
        touched, place = np.unique(query, return_inverse=True)
        q = np.concatenate([np.repeat(np.arange(len(touched)), self.k), place])
        d, i = np.concatenate([self.distance[touched].ravel(), distance]), np.concatenate([self.id[touched].ravel(), ids])
        order = np.lexsort((i, d, q))
        first = np.searchsorted(q[order], np.arange(len(touched)))
        kept = order[first[:, None] + np.arange(self.k)]
        self.distance[touched], self.id[touched] = d[kept], i[kept]

    def found(self, query_ids: np.ndarray) -> Iterator[pa.RecordBatch]:
        q, j = np.nonzero(np.isfinite(self.distance))
        yield pa.RecordBatch.from_pydict({"query_id": query_ids[q], "id": self.id[q, j], "distance": self.distance[q, j]})


def best_of(hits: DataFrame, k: int) -> DataFrame:
    """Adds rank: the k nearest hits of each query, ties by id. A task keeps its best k rows of a query before they are shuffled."""
    order = Window.partitionBy("query_id").orderBy("distance", "id")
    return hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def waves(queries: DataFrame, search: Callable[[pa.Table], DataFrame], order: str | None = None, most: int = 100_000) -> DataFrame:
    """search() of each wave of queries (query_id, query, whatever else), all results together.

    A wave has about WAVE_BYTES bytes and `most` queries. One wave stays a plan; several are searched one after the other
    and appended to a table. order: a column by which like queries come into one wave, instead of a hash of the id.
    """
    spark = queries.sparkSession
    size, count = queries.agg(F.sum(F.size("query").cast("long") * 8 + 64), F.count("*")).first()
    n = max(math.ceil((size or 0) / WAVE_BYTES), math.ceil(count / most))
    if n <= 1:
        return search(queries.toArrow())
    path, out = new_path(spark, "waves"), None
    if order:
        cuts = queries.agg(F.percentile_approx(order, [i / n for i in range(1, n)], 100 * n)).first()[0]
        wave = F.aggregate(F.array(*map(F.lit, cuts)), F.lit(0), lambda s, c: s + (F.col(order) > c).cast("int"))
        wave = wave * 8 + F.pmod(F.xxhash64("query_id"), F.lit(8)).cast("int")  # however many are alike
        n *= 8
    else:
        wave = F.pmod(F.xxhash64("query_id"), F.lit(n)).cast("int")
    held = new_path(spark, "queries")
    queries.withColumn("_wave", wave).write.partitionBy("_wave").parquet(held)
    for w in range(n):
        mine = spark.read.parquet(held).filter(F.col("_wave") == w).drop("_wave").toArrow()
        if mine.num_rows:
            out = search(mine)
            out.write.mode("append").parquet(path)
    return spark.read.schema(out.schema).parquet(path)


def by_dimension(table: pa.Table) -> Iterator[tuple[int, pa.Table]]:
    """The table's rows by the number of components of `query`."""
    sizes = np.diff(table["query"].combine_chunks().offsets.to_numpy())
    for d in np.unique(sizes).tolist():
        yield d, table.take(pa.array(np.flatnonzero(sizes == d)))


def scan(rows: DataFrame, queries: DataFrame, k: int, most: int = 100_000) -> DataFrame:
    """query_id, id, distance: of each task's vectors (id, v) the k nearest to each query; best_of() them."""
    spark = rows.sparkSession

    def search(wave: pa.Table) -> DataFrame:
        shared = spark.sparkContext.broadcast([(d, t["query_id"].to_numpy(), matrix(t["query"].combine_chunks(), d)[1]) for d, t in by_dimension(wave)])

        def run(batches):
            kinds = [(d, ids, Nearest(q, k)) for d, ids, q in shared.value]
            for batch in batches:
                for d, _, best in kinds:
                    fits, v = matrix(batch.column(1), d)
                    best.add(v, batch.column(0).to_numpy()[fits])
            for _, ids, best in kinds:
                yield from best.found(ids)

        return rows.select("id", "v").mapInArrow(run, FOUND)

    return waves(queries, search, most=most)
