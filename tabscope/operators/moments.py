"""Mergeable co-moments: what two columns have in common, over the rows that have both.

For every pair of columns a state holds the number of common rows, both means over them, the sums
of squared deviations from these means and the sum of their products. States of different
rows are merged by the parallel formula of Chan, Golub and LeVeque, which never subtracts large
sums from each other; a state of a batch is computed around the batch's medians, and anew for a
pair whose common rows lie far from them. So neither a large offset nor an outlier in rows that a
pair does not share takes digits away, and a column that is constant over the common rows has
a sum of squares of exactly zero.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tabscope.session import let_workers_import
from tabscope.workspace import materialize

LOST = 1e-6  # share of a sum of squares left after centring below which it is computed anew


@dataclass
class CoMoments:
    """Matrices by column: ``mean[i, j]`` and ``square[i, j]`` belong to column i over the rows common with j."""

    n: np.ndarray
    mean: np.ndarray
    square: np.ndarray
    product: np.ndarray
    infinite: np.ndarray

    @classmethod
    def none(cls, size: int) -> CoMoments:
        return cls(*(np.zeros((size, size)) for _ in range(5)))

    @classmethod
    def of(cls, x: np.ndarray) -> CoMoments:
        """The state of the rows of ``x``, NaN where a value is missing."""
        there, endless = ~np.isnan(x), np.isinf(x)
        used = there & ~endless
        middle = np.array([np.median(column[own]) if own.any() else 0.0 for column, own in zip(x.T, used.T)])
        v, p = np.where(used, np.where(used, x, 0.0) - middle, 0.0), used.astype(float)
        n, total = p.T @ p, v.T @ p
        around, product = (v * v).T @ p, v.T @ v
        mean = np.divide(total, n, out=np.zeros_like(total), where=n > 0)
        square = around - total * mean
        product = product - total * mean.T
        mean = np.where(n > 0, mean + middle[:, None], 0.0)
        lost = (square <= LOST * around) & (around > 0)
        for i, j in np.argwhere(np.triu(lost | lost.T)):
            rows = used[:, i] & used[:, j]
            a, b = x[rows, i], x[rows, j]
            da, db = (c - c[0] - (c - c[0]).mean() for c in (a, b))
            mean[i, j], mean[j, i] = a[0] + (a - a[0]).mean(), b[0] + (b - b[0]).mean()
            square[i, j], square[j, i], product[i, j] = da @ da, db @ db, da @ db
            product[j, i] = product[i, j]
        met = endless.astype(float).T @ there
        return cls(n, mean, np.maximum(square, 0.0), product, met + met.T)

    def merged(self, other: CoMoments) -> CoMoments:
        n = self.n + other.n
        share = np.divide(other.n, n, out=np.zeros_like(n), where=n > 0)
        apart = np.where((self.n > 0) & (other.n > 0), other.mean - self.mean, 0.0)
        weight = self.n * share
        mean = np.where(self.n > 0, self.mean + apart * share, other.mean)
        return CoMoments(
            n,
            mean,
            self.square + other.square + apart * apart * weight,
            self.product + other.product + apart * apart.T * weight,
            self.infinite + other.infinite,
        )


_STATE = "i int, j int, n double, x double, y double, xx double, yy double, xy double, infinite double"


def partial_states(values: DataFrame) -> DataFrame:
    """One state a task and pair ``i < j`` of DOUBLE columns: count, means, centred sums, infinite rows."""
    size = len(values.columns)

    def states(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = CoMoments.none(size)
        for batch in batches:
            if batch.num_rows:
                found = found.merged(CoMoments.of(np.column_stack([c.to_numpy(zero_copy_only=False).astype(float) for c in batch.columns])))
        i, j = np.triu_indices(size, 1)
        cells = [found.n[i, j], found.mean[i, j], found.mean[j, i], found.square[i, j], found.square[j, i], found.product[i, j], found.infinite[i, j]]
        yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), *map(pa.array, cells)], names=["i", "j", "n", "x", "y", "xx", "yy", "xy", "infinite"])

    let_workers_import(values.sparkSession)
    return values.mapInArrow(states, _STATE)


def merged_states(states: DataFrame) -> DataFrame:
    """One state a pair: the sums of many states around the least of their means.

    Around a mean that some state has, equal means add nothing, so a constant stays exactly constant.
    """
    stored = materialize(states.where("n > 0 OR infinite > 0"), "moments")
    least = stored.groupBy("i", "j").agg(F.min("x").alias("x0"), F.min("y").alias("y0"))  # a row a pair of columns
    x, y = F.col("x") - F.col("x0"), F.col("y") - F.col("y0")
    n = F.col("n")
    sums = stored.join(least, ["i", "j"]).groupBy("i", "j", "x0", "y0").agg(
        F.sum("n").alias("n"),
        F.sum("infinite").alias("infinite"),
        F.sum(n * x).alias("sx"),
        F.sum(n * y).alias("sy"),
        F.sum(F.col("xx") + n * x * x).alias("sxx"),
        F.sum(F.col("yy") + n * y * y).alias("syy"),
        F.sum(F.col("xy") + n * x * y).alias("sxy"),
    )
    over = lambda a, b: F.coalesce(F.try_divide(F.col(a) * F.col(b), n), F.lit(0.0))
    return sums.select(
        "i",
        "j",
        "n",
        "infinite",
        (F.col("sxx") - over("sx", "sx")).alias("xx"),
        (F.col("syy") - over("sy", "sy")).alias("yy"),
        (F.col("sxy") - over("sx", "sy")).alias("xy"),
    )


def pair_correlations(values: DataFrame) -> DataFrame:
    """``i, j, corr`` of every pair of DOUBLE columns, NaN read as missing, in one scan.

    NULL where a column is constant over the common rows, or holds an infinite value there.
    """
    known = (F.col("xx") > 0) & (F.col("yy") > 0) & (F.col("infinite") == 0)
    corr = F.col("xy") / F.sqrt("xx") / F.sqrt("yy")
    bounded = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), corr))
    return merged_states(partial_states(values)).select("i", "j", F.when(known, bounded).alias("corr"))
