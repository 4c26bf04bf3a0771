"""Centroid clustering by equal-average equal-variance nearest-neighbour search.

Vectors are whole numbers. Centroids are sorted by component mean. For each vector the search
starts at the centroid whose mean is nearest to the vector's and goes outward on both sides. With
sums S and deviations D (the norm of a vector less its mean) of vectors of k components,

    distance^2 >= (S_x - S_c)^2 / k + (D_x - D_c)^2,

so a side is closed when the first term alone is beyond the best distance so far, a centroid is
passed over when both terms are, and the others are finished by an exact integer distance. The
first test is exact on integers; the second leaves a margin for rounding, so nothing that
could win or tie is passed over.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from tabscope.functions.columns import ref
from tabscope.workspace import materialize

SCALE = 256
LARGEST = 1 << 26  # of a component, so that distances of 64 components stay within 64 bits
_FAR = np.iinfo(np.int64).max


@dataclass
class Centroids:
    """Centroids in the order of their component sums, each with its number."""

    number: np.ndarray
    vectors: np.ndarray
    sums: np.ndarray
    deviations: np.ndarray

    @classmethod
    def of(cls, vectors: np.ndarray) -> Centroids:
        sums = vectors.sum(1)
        order = np.argsort(sums, kind="stable")
        return cls(order.astype(np.int64), vectors[order], sums[order], _deviations(vectors)[order])


def _deviations(vectors: np.ndarray) -> np.ndarray:
    return np.sqrt(((vectors - vectors.mean(1, keepdims=True)) ** 2).sum(1))


def nearest(vectors: np.ndarray, centroids: Centroids) -> tuple[np.ndarray, np.ndarray, int]:
    """Number of the nearest centroid (ties: the smaller) and squared distance of each vector, and
    how many distances were computed."""
    n, size = vectors.shape
    k = len(centroids.number)
    sums, deviations = vectors.sum(1), _deviations(vectors)
    best, number, computed = np.full(n, _FAR), np.full(n, k, np.int64), 0
    right = np.searchsorted(centroids.sums, sums)
    left = right - 1
    rows = np.arange(n)
    while len(rows):
        low, high = left[rows], right[rows]
        below = np.where(low >= 0, np.abs(sums[rows] - centroids.sums[np.maximum(low, 0)]), _FAR)
        above = np.where(high < k, np.abs(centroids.sums[np.minimum(high, k - 1)] - sums[rows]), _FAR)
        step = np.minimum(below, above)
        # |S_x - S_c|^2 / size > best closes both sides, as the nearer of the two is tried first
        going = (step != _FAR) & ((best[rows] == _FAR) | (_ceil_square(step, size) <= best[rows]))
        rows, low, high, below, above, step = rows[going], low[going], high[going], below[going], above[going], step[going]
        down = below <= above
        at = np.where(down, low, high)
        left[rows[down]] -= 1
        right[rows[~down]] += 1
        bound = step.astype(float) ** 2 / size + (deviations[rows] - centroids.deviations[at]) ** 2
        tried = bound * (1 - 1e-9) - 1 <= best[rows]
        own, at = rows[tried], at[tried]
        distance = ((vectors[own] - centroids.vectors[at]) ** 2).sum(1)
        computed += len(own)
        names = centroids.number[at]
        wins = (distance < best[own]) | ((distance == best[own]) & (names < number[own]))
        best[own[wins]], number[own[wins]] = distance[wins], names[wins]
    return number, best, computed


def _ceil_square(step: np.ndarray, size: int) -> np.ndarray:
    """The least whole number that is not below step^2 / size; squares stay within 64 bits."""
    step = np.minimum(step, 3_000_000_000)
    return -(-(step * step) // size)


def quantised(df: DataFrame, size: int, id_col: str, vector_col: str) -> DataFrame:
    """``id, v``: floor(256 * x) of the vectors with exactly ``size`` components, all of them finite."""
    bad: Column = F.exists(ref(vector_col), lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    kept = df.where((F.size(ref(vector_col)) == size) & ~bad)
    whole = F.transform(ref(vector_col), lambda x: F.floor(x.cast("double") * SCALE))
    large = F.exists("v", lambda x: (x > LARGEST) | (x < -LARGEST))
    refused = F.raise_error(F.lit(f"a component beyond {LARGEST // SCALE}: squared distances would not fit 64 bits"))
    return kept.select(ref(id_col).alias("id"), whole.alias("v")).withColumn("v", F.when(large, refused).otherwise(F.col("v"))).select("id", F.col("v").cast("array<int>").alias("v"))


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    return column.flatten().to_numpy().astype(np.int64).reshape(-1, size)


def _moved(rows: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The centroids after one round: componentwise floors of the mean; empty ones stay."""
    k, size = centroids.shape

    def partial(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sorted_ = Centroids.of(centroids)
        sums, counts = np.zeros((k, size), np.int64), np.zeros(k, np.int64)
        for batch in batches:
            vectors = _matrix(batch["v"], size)
            number, _, _ = nearest(vectors, sorted_)
            np.add.at(sums, number, vectors)
            counts += np.bincount(number, minlength=k)
        cluster, place = np.divmod(np.arange(k * (size + 1)), size + 1)  # place 0: the count
        yield pa.RecordBatch.from_arrays(
            [pa.array(cluster), pa.array(place), pa.array(np.column_stack([counts, sums]).ravel())], names=["cluster", "place", "total"]
        )

    added = rows.select("v").mapInArrow(partial, "cluster long, place long, total long").groupBy("cluster", "place").agg(F.sum("total").alias("total"))
    totals = np.zeros((k, size + 1), np.int64)
    for r in added.collect():  # k * (size + 1) rows
        totals[r.cluster, r.place] = r.total
    filled = totals[:, 0] > 0
    out = centroids.copy()
    out[filled] = totals[filled, 1:] // totals[filled, :1]
    return out


def cluster_vectors(
    df: DataFrame,
    k: int = 40,
    rounds: int = 5,
    size: int = 64,
    seed: str = "2",
    id_col: str = "vec_id",
    vector_col: str = "embedding",
) -> DataFrame:
    """``id_col, cluster, distance, cluster_inertia, inertia, centroid_sha256`` of every kept vector.

    Kept are vectors of exactly ``size`` components, none null or non-finite. The first centroids
    are the ``k`` kept vectors with the least SHA-256 of ``seed:id`` (equal ids: by their components; a
    null id never starts a cluster, unless all ids are null); with fewer vectors there are fewer centroids. Repeated
    rows are assigned each. An empty table, or one without kept vectors, gives no rows. A
    component beyond 262,144 raises, since squared distances would not fit 64 bits.
    """
    rows = materialize(quantised(df, size, id_col, vector_col), "vectors")
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    first = rows.select(digest.alias("digest"), "v").orderBy(F.asc_nulls_last("digest"), "v").limit(k).collect()
    centroids = np.array([r.v for r in first], np.int64).reshape(-1, size)
    for _ in range(rounds if len(first) else 0):
        centroids = _moved(rows, centroids)

    def assign(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sorted_ = Centroids.of(centroids)
        for batch in batches:
            number, distance, _ = nearest(_matrix(batch["v"], size), sorted_)
            yield pa.RecordBatch.from_arrays([batch["id"], pa.array(number.astype(np.int32)), pa.array(distance)], names=["id", "cluster", "distance"])

    schema = T.StructType([rows.schema["id"], T.StructField("cluster", T.IntegerType()), T.StructField("distance", T.LongType())])
    found = materialize(rows.mapInArrow(assign, schema), "assigned")
    inertia = {r.cluster: r.total for r in found.groupBy("cluster").agg(F.sum("distance").alias("total")).collect()}  # k rows
    of_cluster = [(c, t, hashlib.sha256(",".join(map(str, centroids[c].tolist())).encode()).hexdigest()) for c, t in inertia.items()]
    listed = df.sparkSession.createDataFrame(of_cluster, "cluster int, cluster_inertia long, centroid_sha256 string")
    return found.join(F.broadcast(listed), "cluster").select(
        F.col("id").alias(id_col),
        "cluster",
        "distance",
        "cluster_inertia",
        F.lit(sum(inertia.values())).cast("long").alias("inertia"),
        "centroid_sha256",
    )
