"""Centroid clustering: Lloyd rounds over integer vectors with Orchard's search for the nearest centroid.

Every component x of a vector becomes the integer floor(``SCALE`` * x), so sums, distances and centroids are
exact and do not depend on the order of the rows. Vectors with another number of components than asked
for, or with a null, NaN or infinite one, are left out.

Orchard's search: each centroid has the list of all others, nearest first. A vector starts at some centroid
(here the one with the most similar length) and walks along its list. A centroid nearer to the vector
than the current one becomes the current one, and the walk goes on from the start of its list; centroids
that were measured are marked and not measured again. The walk ends as soon as the next centroid of the
list is strictly more than twice as far from the current one as the vector is: by the triangle inequality
it and all that follow are farther from the vector. Of equally near centroids the smaller number wins;
an equally near one is at most twice as far away, so the walk meets it.

A task holds a block of vectors. What it returns of a round are a sum and a count per centroid, and what the
driver holds are the centroids: ``clusters`` times ``dims`` numbers. The vectors are written once to the
shared folder; each round is one scan of that table.

Vectors with the same id or the same components are vectors of their own; a null id counts as the empty text.
With fewer vectors than clusters there is a centroid per vector, without any there are no rows. A vector whose
squared length would not leave room for exact distances (2 to the power of 58, in scaled components) is
an error.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.scratch import Scratch

SCALE = 1024
BLOCK_CELLS = 1 << 20
LONGEST = 1 << 58  # squared; four times a squared distance is still a 64-bit number


class Orchard:
    """Nearest centroid of integer vectors."""

    def __init__(self, points: np.ndarray):
        self.points = points
        gaps = points[:, None, :] - points[None, :, :]
        self.between = np.einsum("abd,abd->ab", gaps, gaps)
        numbers = np.arange(len(points))
        # All other centroids, nearest first.
        self.near = np.array([[j for j in np.lexsort((numbers, row)) if j != i] for i, row in enumerate(self.between)],
                             np.int64).reshape(len(points), -1)
        size = np.sqrt(np.einsum("ad,ad->a", points, points, dtype=np.float64))
        self.by_size = np.argsort(size, kind="stable")
        self.middles = (size[self.by_size][1:] + size[self.by_size][:-1]) / 2
        self.measured = 0

    def _distance(self, x: np.ndarray, to: np.ndarray) -> np.ndarray:
        self.measured += len(x)
        gap = x - self.points[to]
        return np.einsum("nd,nd->n", gap, gap)

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number of the nearest centroid and the squared distance to it."""
        size = np.sqrt(np.einsum("nd,nd->n", x, x, dtype=np.float64))
        best = self.by_size[np.searchsorted(self.middles, size)]
        distance = self._distance(x, best)
        place = np.zeros(len(x), np.int64)
        marked = np.zeros((len(x), len(self.points)), bool)
        marked[np.arange(len(x)), best] = True
        walking = np.arange(len(x))
        while True:
            walking = walking[place[walking] < self.near.shape[1]]
            ahead = self.near[best[walking], place[walking]]
            within = self.between[best[walking], ahead] <= 4 * distance[walking]
            walking, ahead = walking[within], ahead[within]
            if not len(walking):
                return best, distance
            place[walking] += 1
            fresh = ~marked[walking, ahead]
            rows, ahead = walking[fresh], ahead[fresh]
            marked[rows, ahead] = True
            far = self._distance(x[rows], ahead)
            nearer = (far < distance[rows]) | ((far == distance[rows]) & (ahead < best[rows]))
            jump = rows[nearer]
            best[jump], distance[jump], place[jump] = ahead[nearer], far[nearer], 0


def integer_vectors(df: DataFrame, vec_id: str, embedding: str, dims: int, scale: int = SCALE) -> DataFrame:
    """id and v of the vectors that take part."""
    values = F.col(embedding)
    broken = F.exists(values, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return df.where((F.size(values) == dims) & ~broken).select(
        F.col(vec_id).alias("id"), F.transform(values, lambda x: F.floor(x.cast("double") * scale)).alias("v"))


def _blocks(batch: pa.RecordBatch, column: int, dims: int, clusters: int) -> Iterator[tuple[int, np.ndarray]]:
    rows = max(1, BLOCK_CELLS // max(dims, clusters))
    for at in range(0, batch.num_rows, rows):
        values = batch.slice(at, rows).column(column).flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)
        if (np.einsum("nd,nd->n", values, values, dtype=np.float64) >= LONGEST).any():
            raise ValueError("a vector is too long for exact distances")
        yield at, values


def round_sums(vectors: DataFrame, points: np.ndarray) -> DataFrame:
    """cluster, place, n, total: count and component sums of each centroid's vectors."""
    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = Orchard(points)
        count, total = np.zeros(len(points), np.int64), np.zeros_like(points)
        for batch in batches:
            for _, x in _blocks(batch, 0, points.shape[1], len(points)):
                best, _ = search.nearest(x)
                n = np.bincount(best, minlength=len(points))
                count += n
                held = np.flatnonzero(n)
                total[held] += np.add.reduceat(x[np.argsort(best, kind="stable")], (np.cumsum(n) - n)[held])
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(len(points), dtype=np.int32)), pa.array(count),
             pa.ListArray.from_arrays(np.arange(0, total.size + 1, points.shape[1], dtype=np.int32), pa.array(total.ravel()))],
            names=["cluster", "n", "totals"])

    parts = vectors.select("v").mapInArrow(sums, "cluster int, n long, totals array<long>").where("n > 0")
    return parts.select("cluster", "n", F.posexplode("totals").alias("place", "total")).groupBy("cluster", "place").agg(
        F.sum("n").alias("n"), F.sum("total").alias("total"))


def assign(vectors: DataFrame, points: np.ndarray) -> DataFrame:
    """id, cluster, distance (squared) of every vector."""
    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = Orchard(points)
        for batch in batches:
            for at, x in _blocks(batch, 1, points.shape[1], len(points)):
                best, distance = search.nearest(x)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, len(x)), pa.array(best.astype(np.int32)), pa.array(distance)],
                    names=["id", "cluster", "distance"])

    schema = T.StructType([vectors.schema["id"], T.StructField("cluster", T.IntegerType()), T.StructField("distance", T.LongType())])
    return vectors.select("id", "v").mapInArrow(nearest, schema)


def first_centroids(vectors: DataFrame, clusters: int, by: Column) -> np.ndarray:
    """The vectors that come first in the given order; equal ones of it by their components."""
    return np.array([r["v"] for r in vectors.orderBy(by, "v").limit(clusters).collect()], np.int64)


def cluster_vectors(df: DataFrame, clusters: int = 8, rounds: int = 10, dims: int = 64, vec_id: str = "vec_id",
                    embedding: str = "embedding", seed: int = 3) -> tuple[DataFrame, DataFrame]:
    """(vec_id, cluster, distance) of every vector, and a row per centroid: cluster, n, centroid, cluster_inertia, inertia.

    The first centroids are the vectors with the smallest SHA-256 of ``seed:id``. Each round assigns all
    vectors and moves every centroid that has any to the floor of their mean; then all are assigned once more.
    """
    spark = df.sparkSession
    scratch = Scratch(spark, "clusters")
    vectors = scratch.save(integer_vectors(df, vec_id, embedding, dims), "vectors")
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    points = first_centroids(vectors, clusters, key)
    if len(points):
        for _ in range(rounds):
            points = points.copy()
            for r in round_sums(vectors, points).collect():
                points[r["cluster"], r["place"]] = r["total"] // r["n"]
        assigned = scratch.save(assign(vectors, points), "assigned")
    else:
        assigned = vectors.select("id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance"))
    # One row per centroid reaches the driver.
    sums = {r["cluster"]: r for r in assigned.groupBy("cluster").agg(F.count("*").alias("n"), F.sum("distance").alias("s")).collect()}
    inertia = sum(r["s"] for r in sums.values())
    rows = [(i, sums[i]["n"] if i in sums else 0, p.tolist(), sums[i]["s"] if i in sums else 0, inertia)
            for i, p in enumerate(points)]
    table = spark.createDataFrame(rows, "cluster int, n long, centroid array<long>, cluster_inertia long, inertia long")
    return assigned.withColumnRenamed("id", vec_id), table
