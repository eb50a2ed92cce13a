"""Centroid clustering with block-norm screening.

A vector is cut into segments, and the norms of these are kept beside it. For a vector x and a centroid c, Cauchy and
Schwarz bound the product of each pair of segments by the product of their norms, so
|x|^2 + |c|^2 - 2 * sum of (norm of x's segment * norm of c's segment) is never more than their squared distance. Only
centroids whose bound does not exceed the least distance found so far are compared exactly, in integers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import materialize
from ledgerline.llm.integer_vectors import SLACK, SUMS, Sums, lists, matrix, means, whole_vectors

SEGMENTS = 8


def segment_norms(vectors: np.ndarray, segments: int = SEGMENTS) -> np.ndarray:
    """The norm of each of so many consecutive segments of integer vectors, never less than the true one."""
    starts = np.linspace(0, vectors.shape[1], segments, endpoint=False).astype(int)
    return np.sqrt(np.add.reduceat(vectors * vectors, starts, axis=1)) * (1 + SLACK)


def nearest_centroids(vectors: np.ndarray, squares: np.ndarray, norms: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each vector its nearest centroid (of equally near ones the first), the squared distance, and how many
    centroids it was compared with exactly."""
    products = norms @ segment_norms(centroids, norms.shape[1]).T
    bounds = (squares[:, None].astype(float) + (centroids * centroids).sum(axis=1)) * (1 - SLACK) - 2 * products * (1 + SLACK)
    order = np.argsort(bounds, axis=1, kind="stable")
    place, least = np.zeros(len(vectors), np.int64), np.full(len(vectors), np.iinfo(np.int64).max)
    compared = np.zeros(len(vectors), np.int64)
    for at in order.T:
        # Not strict: an equal distance may belong to a centroid of a smaller number.
        rows = np.flatnonzero(np.take_along_axis(bounds, at[:, None], 1)[:, 0] <= least * (1 + SLACK))
        if not len(rows):
            break  # bounds ascend
        own = at[rows]
        distance = ((vectors[rows] - centroids[own]) ** 2).sum(axis=1)
        better = (distance < least[rows]) | ((distance == least[rows]) & (own < place[rows]))
        place[rows[better]], least[rows[better]] = own[better], distance[better]
        compared[rows] += 1
    return place, least, compared


def _norms_task(batches: Iterator[pa.RecordBatch], dims: int, segments: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x = matrix(batch["x"], dims)
        norms = lists(segment_norms(x, segments).ravel(), np.full(len(x), segments))
        yield pa.record_batch([batch["id"], batch["x"], pa.array((x * x).sum(axis=1)), norms], names=["id", "x", "square", "norms"])


def cluster_vectors(
    table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", dims: int = 64, scale: int = 1024, k: int = 8, rounds: int = 10, seed: int = 3, segments: int = SEGMENTS
) -> tuple[DataFrame, list[list[int]]]:
    """Clusters of the vectors of dims finite components, each taken as floor(scale * component).

    The k vectors whose ids have the smallest sha256 of `<seed>:<id>` are the first centroids; a round assigns each
    vector to the nearest one, the first of equally near ones, and replaces each centroid that has vectors by the floor
    of their exact mean. Returns a row a vector (id, cluster, distance, compared) after a last assignment, and the
    centroids. Other vectors are left out. Rows that share an id are vectors of their own, started from in the order
    of their components; null ids are started from last. With fewer than k vectors there are as many centroids. An
    empty table gives no rows and no centroids. A component too large for distances of 64 bits is an error.
    """
    whole = whole_vectors(table, vector_col, scale, dims, id=id_col)
    id_type = whole.schema["id"].dataType.simpleString()
    vectors = materialize(whole.mapInArrow(lambda b: _norms_task(b, dims, segments), f"id {id_type}, x array<int>, square long, norms array<double>"))
    hashed = vectors.select(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256).alias("hash"), "x")
    centroids = [list(r["x"]) for r in hashed.orderBy(F.asc_nulls_last("hash"), "x").limit(k).collect()]
    if not centroids:
        return vectors.select(F.col("id").alias(id_col), F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance"), F.lit(0).alias("compared")), []

    def assign(batch: pa.RecordBatch, now: np.ndarray) -> tuple[np.ndarray, ...]:
        x = matrix(batch["x"], dims)
        return x, *nearest_centroids(x, batch["square"].to_numpy(), matrix(batch["norms"], segments, float), now)

    for _ in range(rounds):
        now = np.array(centroids, np.int64)

        def gather(batches: Iterator[pa.RecordBatch], now: np.ndarray = now) -> Iterator[pa.RecordBatch]:
            sums = Sums(len(now), dims)
            for batch in batches:
                x, place, *_ = assign(batch, now)
                sums.add(place, x)
            yield sums.rows()

        moved = means(vectors.select("x", "square", "norms").mapInArrow(gather, SUMS))
        if all(centroids[i] == c for i, c in moved.items()):
            break  # further rounds would change nothing
        for i, c in moved.items():
            centroids[i] = c
    last = np.array(centroids, np.int64)

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, place, distance, compared = assign(batch, last)
            yield pa.record_batch([batch["id"], pa.array(place, pa.int32()), pa.array(distance), pa.array(compared, pa.int32())], names=["id", "cluster", "distance", "compared"])

    return materialize(vectors.mapInArrow(label, f"id {id_type}, cluster int, distance long, compared int").withColumnRenamed("id", id_col)), centroids
