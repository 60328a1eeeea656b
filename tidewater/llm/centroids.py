"""Centroid clustering of integer vectors, with lower bounds from PCA-rotated coordinates."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.llm.shared import bounded_batches, written

#: Components beyond this (after scaling) could take squared distances of 64 of them past 63 bits.
MOST = 1 << 27


def _rows(batch: pa.RecordBatch, name: str, width: int) -> np.ndarray:
    """An array column whose lists have one width, as a matrix."""
    column = batch.column(batch.schema.get_field_index(name))
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width)


def _moments(vectors: DataFrame, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Mean and covariance of all vectors; tasks send one row for each component, ``size`` rows reach the driver."""

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total, products = 0, np.zeros(size), np.zeros((size, size))
        for batch in batches:
            x = _rows(batch, "v", size).astype(np.float64)
            n, total, products = n + len(x), total + x.sum(axis=0), products + x.T @ x
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(range(size), pa.int32()), pa.array([float(n)] * size), pa.array(total), pa.array(list(products))], names=["i", "n", "total", "products"])

    partial = vectors.select("v").mapInArrow(summed, "i int, n double, total double, products array<double>")
    found = partial.groupBy("i").agg(F.sum("n"), F.sum("total"), *(F.sum(F.get("products", F.lit(j))) for j in range(size))).orderBy("i").collect()
    if not found:
        return np.zeros(size), np.zeros((size, size))
    whole = np.array([r[1:] for r in found], np.float64)
    mean = whole[:, 1] / whole[:, 0]
    return mean, whole[:, 2:] / whole[:, :1] - np.outer(mean, mean)


class Rotation:
    """Principal axes of all vectors: leading coordinates, and the norm of what they leave."""

    def __init__(self, mean: np.ndarray, covariance: np.ndarray, lead: int):
        self.mean = mean
        self.axes = np.linalg.eigh(covariance)[1][:, ::-1][:, :lead]

    def place(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        centred = x - self.mean
        lead = centred @ self.axes
        return lead, np.sqrt(np.maximum(0.0, (centred * centred).sum(axis=1) - (lead * lead).sum(axis=1)))


class Centroids:
    """Integer centroids beside their rotated coordinates."""

    def __init__(self, whole: np.ndarray, rotation: Rotation):
        self.whole = whole
        self.lead, self.rest = rotation.place(whole.astype(np.float64))
        self.squares = (whole.astype(np.float64) ** 2).sum(axis=1)

    def nearest(self, x: np.ndarray, lead: np.ndarray, rest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number of and squared distance to the nearest centroid of each row (ties: the smaller number).

        |lead_x - lead_c|^2 + (rest_x - rest_c)^2 is at most the squared distance. Less a slack that covers
        rounding it is held against the exact distance to the centroid of the least bound; only centroids
        whose bound is not above that are computed, in integers.
        """
        low = ((lead[:, None, :] - self.lead[None]) ** 2).sum(axis=2) + (rest[:, None] - self.rest[None]) ** 2
        low -= 1e-9 * ((x.astype(np.float64) ** 2).sum(axis=1)[:, None] + self.squares[None]) + 1e-6
        first = low.argmin(axis=1)
        best = ((x - self.whole[first]) ** 2).sum(axis=1)
        distance = np.full(low.shape, np.iinfo(np.int64).max)
        rows, numbers = np.nonzero(low <= best[:, None])
        distance[rows, numbers] = ((x[rows] - self.whole[numbers]) ** 2).sum(axis=1)
        found = distance.argmin(axis=1)
        return found, distance[np.arange(len(x)), found]


def _assigned(batches: Iterator[pa.RecordBatch], centroids: Centroids) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]]:
    """(ids, vectors, numbers, distances) in slices of bounded size."""
    size, width = centroids.whole.shape[1], centroids.lead.shape[1]
    for batch in batches:
        for at in range(0, batch.num_rows, 4096):
            part = batch.slice(at, 4096)
            x = _rows(part, "v", size).astype(np.int64)
            numbers, distances = centroids.nearest(x, _rows(part, "lead", width), part.column(part.schema.get_field_index("rest")).to_numpy(zero_copy_only=False))
            yield part.column(0), x, numbers, distances


def _sums(placed: DataFrame, centroids: Centroids) -> list:
    """(cluster, n, sums) of each non-empty cluster: a task sends one row a cluster, and as many reach the driver."""
    k, size = centroids.whole.shape

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, sums = np.zeros(k, np.int64), np.zeros((k, size), np.int64)
        for _, x, numbers, _ in _assigned(batches, centroids):
            counts += np.bincount(numbers, minlength=k)
            np.add.at(sums, numbers, x)
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(counts[some]), pa.array(list(sums[some]), pa.list_(pa.int64()))], names=["cluster", "n", "sums"])

    partial = placed.mapInArrow(summed, "cluster int, n long, sums array<long>")
    return partial.groupBy("cluster").agg(F.sum("n"), *(F.sum(F.get("sums", F.lit(j))) for j in range(size))).collect()


def whole_vector(vector_col: str, size: int, scale: int) -> Column:
    """``floor(scale * x)`` of each component as an array of integers; null for a vector that is not of ``size`` finite components within the exact range."""
    vector = F.col(vector_col).cast("array<double>")
    sound = F.col(vector_col).isNotNull() & (F.size(vector_col) == size) & F.coalesce(F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < MOST / scale)), F.lit(False))
    return F.when(sound, F.transform(vector, lambda x: F.floor(x * scale).cast("int")))


def cluster_vectors(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", size: int = 64, k: int = 16, rounds: int = 3, scale: int = 64, seed: str = "1", lead: int = 8) -> DataFrame:
    """One row per kept vector: vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256.

    A vector is kept if it has ``size`` components, none null or non-finite, and becomes the integers
    ``floor(scale * x)``. The first centroids are the ``k`` vectors with the smallest hash of
    ``seed:id``; each round assigns every vector to the nearest one and replaces each centroid that has
    vectors by the floor of their mean; then vectors are assigned once more.

    Method: the covariance of all vectors gives principal axes (sums of ``size`` rows by task). Each
    vector is stored with its ``lead`` leading coordinates and the norm of the rest, once. For each
    centroid the distance of the leading coordinates and the difference of the norms bound the distance
    from below; centroids that may be nearest are verified in integers, so that the result does not
    depend on the axes. Tasks add up their clusters; k rows a round reach the driver, and k centroids go
    back.

    Vectors with a component of 2^27 or more after scaling, whose distances could pass 63 bits, are left
    out like non-finite ones. A null id hashes last; rows that repeat an id are vectors of their own.
    With fewer vectors than ``k`` each of them is a first centroid. An inertia past 63 bits is null. An
    empty table gives no rows; other columns are not read.
    """
    spark = df.sparkSession
    bounded_batches(spark)
    read = df.select(F.col(id_col).cast("long").alias("vec_id"), whole_vector(vector_col, size, scale).alias("v")).where("v is not null")
    vectors = written(read, "cluster-vectors")
    hashed = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")).cast("binary"), 256)
    first = vectors.select("v", hashed.alias("h")).orderBy(F.col("h").asc_nulls_last(), "v").limit(k).collect()
    if not first:
        return vectors.select("vec_id", *(F.lit(None).cast(t).alias(c) for c, t in (("cluster", "int"), ("distance", "long"), ("cluster_inertia", "long"), ("inertia", "long"), ("centroid_sha256", "string"))))
    lead = min(lead, size)
    rotation = Rotation(*_moments(vectors, size), lead)

    def rotated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            coordinates, rest = rotation.place(_rows(batch, "v", size).astype(np.float64))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(list(coordinates), pa.list_(pa.float64())), pa.array(rest)], names=["vec_id", "v", "lead", "rest"])

    placed = written(vectors.mapInArrow(rotated, "vec_id long, v array<int>, lead array<double>, rest double"), "cluster-places")
    centroids = Centroids(np.array([r.v for r in first], np.int64), rotation)
    for _ in range(rounds):
        whole = centroids.whole.copy()
        for cluster, n, *sums in _sums(placed, centroids):
            whole[cluster] = [s // n for s in sums]
        centroids = Centroids(whole, rotation)

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, _, numbers, distances in _assigned(batches, centroids):
            yield pa.RecordBatch.from_arrays([ids, pa.array(numbers.astype(np.int32)), pa.array(distances)], names=["vec_id", "cluster", "distance"])

    final = written(placed.mapInArrow(nearest, "vec_id long, cluster int, distance long"), "cluster-final")
    inertias = {r.cluster: int(r.s) for r in final.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(28,0)")).alias("s")).collect()}
    fits = lambda x: x if x < 1 << 63 else None
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.whole.tolist()]
    facts = spark.createDataFrame([(c, fits(s), fits(sum(inertias.values())), digests[c]) for c, s in inertias.items()], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    # facts has k rows at most
    return final.join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
