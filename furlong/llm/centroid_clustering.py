"""Exact integer k-means by annulus search.

The distance of a vector to a centroid is at least the difference of their norms. So with centroids in order of norm, those
that can be nearer than some bound stand together, in the annulus around the vector's own norm; binary search finds its ends.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from furlong.llm.common import Scratch, named

#: Components up to this size keep squared distances of some thousand components within 64 bits.
LIMIT = 1 << 26
#: How much an annulus is widened, so that rounded norms lose no centroid on its boundary.
SLACK = 1e-6


class Rings:
    """Centroids in order of their norms."""

    def __init__(self, centroids: np.ndarray) -> None:
        norms = np.sqrt((centroids * centroids).sum(axis=1).astype(np.float64))
        self.order = np.argsort(norms, kind="stable")
        self.norms, self.centroids = norms[self.order], centroids[self.order]

    def annulus(self, norms: np.ndarray, bound: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and behind the last place of the centroids within ``bound``, a squared distance, of each norm; ends included."""
        radius = np.sqrt(bound.astype(np.float64)) * (1 + SLACK) + SLACK * (1 + norms)
        return np.searchsorted(self.norms, norms - radius, "left"), np.searchsorted(self.norms, norms + radius, "right")

    def nearest(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number of the nearest centroid, squared distance) of each vector; of equally near ones the smallest number."""
        norms = np.sqrt((vectors * vectors).sum(axis=1).astype(np.float64))
        # The centroid with the nearest norm gives the first bound.
        above = np.minimum(np.searchsorted(self.norms, norms), len(self.norms) - 1)
        below = np.maximum(above - 1, 0)
        place = np.where(norms - self.norms[below] < self.norms[above] - norms, below, above)
        best, number = self.squared(vectors, self.centroids[place]), self.order[place]
        first, end = self.annulus(norms, best)
        for k, centroid in enumerate(self.centroids):
            rows = np.flatnonzero((first <= k) & (k < end))
            found = self.squared(vectors[rows], centroid)
            nearer = (found < best[rows]) | ((found == best[rows]) & (self.order[k] < number[rows]))
            best[rows[nearer]], number[rows[nearer]] = found[nearer], self.order[k]
        return number, best

    @staticmethod
    def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        apart = a - b
        return np.einsum("ij,ij->i", apart, apart)


def integers(column: pa.Array, dim: int, scale: float) -> np.ndarray:
    """floor(scale * x) of the components x, each as double."""
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    x = np.floor(scale * x)
    if np.abs(x).max(initial=0) > LIMIT:
        raise ValueError(f"a component times {scale} is beyond {LIMIT}, so squared distances do not fit 64 bits")
    return x.astype(np.int64)


def _sums(centroids: np.ndarray, scale: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rings, (k, dim) = Rings(centroids), centroids.shape
        total, count = np.zeros((k, dim), dtype=np.int64), np.zeros(k, dtype=np.int64)
        for batch in batches:
            vectors = integers(batch.column(1), dim, scale)
            number, _ = rings.nearest(vectors)
            np.add.at(total, number, vectors)
            count += np.bincount(number, minlength=k)
        held = np.flatnonzero(count)
        columns = [pa.array(held.astype(np.int32)), pa.array(count[held]), *(pa.array(c) for c in total[held].T.copy())]
        yield pa.RecordBatch.from_arrays(columns, ["cluster", "n", *(f"c{i}" for i in range(dim))])

    return run


def _assigned(centroids: np.ndarray, scale: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rings = Rings(centroids)
        for batch in batches:
            number, distance = rings.nearest(integers(batch.column(1), centroids.shape[1], scale))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(number.astype(np.int32)), pa.array(distance)], ["vec_id", "cluster", "distance"])

    return run


def cluster_vectors(
    df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", dim: int = 64, k: int = 40, rounds: int = 5,
    scale: float = 256.0, seed: str = "2",
) -> tuple[DataFrame, list[tuple[int, ...]]]:
    """(vec_id, cluster, distance) of every kept vector, and the final centroids.

    Kept are vectors of exactly ``dim`` components, none null or not finite. Component x counts as the integer
    floor(scale * x). The k kept vectors with the least sha256 of ``seed:id`` are the first centroids; of rows with one id the lesser vector
    comes first, and there are fewer centroids if there are fewer vectors. A round gives each vector to the nearest centroid, by
    squared distance, then to the smaller number, and replaces every centroid that has vectors by the floor of their mean.
    All sums are exact.

    A round is one scan: each task adds up its vectors by cluster, at most k rows leave it, and k rows of sums reach the
    driver whatever the size of the table. So one cluster, or one vector, may hold any share of the rows.

    A null id counts as an empty one. Repeated rows are vectors of their own. Extra columns are ignored. An empty table gives
    an empty result and no centroids. A component beyond LIMIT / scale is an error.
    """
    points = df.select(named(id_col).alias("vec_id"), named(vector_col).alias("vector"))
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    points = points.where((F.size("vector") == dim) & finite)
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    first = points.select(key.alias("key"), "vector").orderBy("key", "vector").limit(k).collect()
    id_type = dict(points.dtypes)["vec_id"]
    out = f"vec_id {id_type}, cluster int, distance long"
    if not first:
        return df.sparkSession.createDataFrame([], out), []
    centroids = np.floor(scale * np.array([r.vector for r in first], dtype=np.float64)).astype(np.int64)
    columns = [f"c{i}" for i in range(dim)]
    for _ in range(rounds):
        summed = points.mapInArrow(_sums(centroids, scale), "cluster int, n long, " + ", ".join(f"{c} long" for c in columns))
        for r in summed.groupBy("cluster").agg(F.sum("n").alias("n"), *[F.sum(c).alias(c) for c in columns]).collect():
            centroids[r.cluster] = [r[c] // r.n for c in columns]
    return points.mapInArrow(_assigned(centroids, scale), out), [tuple(c) for c in centroids.tolist()]


def inertias(assigned: DataFrame) -> tuple[DataFrame, dict[int, int]]:
    """``assigned``, written, and the sum of distances of each of its clusters."""
    assigned = Scratch(assigned.sparkSession).write(assigned)
    sums = assigned.groupBy("cluster").agg(F.sum("distance").alias("total")).collect()
    return assigned, {r.cluster: r.total for r in sums}
