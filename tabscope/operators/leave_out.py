"""Cross-validation by subtraction: models that are made of sums.

Least squares, ridge and Gaussian naive Bayes need sums over the training rows only. One scan
adds up the sums of every fold of every repeat; a training set is the total less its fold, so
the models of all folds of all repeats are fitted from that scan. The error of a linear model
on its fold comes from the fold's sums too; the accuracy of naive Bayes takes one more scan, in which each
row meets, for every repeat, the model that has not seen it.

Values are shifted and scaled by the means and deviations of all rows first, so that taking a
fold away from the total costs no digits. What reaches the driver is a matrix a fold, whose size
is the number of columns squared.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tabscope.functions.columns import ref
from tabscope.operators.features import label_encoder, scaling_constants
from tabscope.operators.splitting import repeated_folds
from tabscope.session import let_workers_import
from tabscope.workspace import materialize


def _fold(repeat: int) -> str:
    return f"_fold_{repeat}"


def assigned_folds(rows: DataFrame, stratum: str, key: list[str], columns: list[str], folds: int, repeats: int, seed: str = "cv") -> DataFrame:
    """The complete rows' ``columns`` as DOUBLE, ``_0``, ``_1`` and so on, and a fold for each repeat; written once."""
    complete = reduce(lambda a, b: a & b, [ref(c).isNotNull() for c in [stratum, *columns]])
    numbers = [ref(c).cast("double").alias(f"_{i}") for i, c in enumerate(columns)]
    keys = [ref(k).alias(f"_key_{i}") for i, k in enumerate(key)]
    own = materialize(rows.filter(complete).select(*numbers, *keys, ref(stratum).alias("_stratum")), "rows")
    own = repeated_folds(own, "_stratum", [f"_key_{i}" for i in range(len(key))], folds, repeats, seed)
    return materialize(own.select(*[f"_{i}" for i in range(len(columns))], *[_fold(r) for r in range(repeats)]), "folds")


def _matrix(batch: pa.RecordBatch, width: int, scale: list[tuple[float, float]]) -> np.ndarray:
    x = np.column_stack([batch[f"_{i}"].to_numpy(zero_copy_only=False) for i in range(width)])
    return (x - [m for m, _ in scale]) / [s for _, s in scale]


def fold_sums(assigned: DataFrame, repeats: int, groups: int, size: int, add: Callable[[pa.RecordBatch, np.ndarray, np.ndarray], None]) -> np.ndarray:
    """``(repeats, groups, size)`` sums in one scan; ``add(batch, own, total)`` adds a batch's rows to the
    groups of one repeat, ``own`` being their folds."""

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((repeats, groups, size))
        for batch in batches:
            for repeat in range(repeats if batch.num_rows else 0):
                add(batch, batch[_fold(repeat)].to_numpy(zero_copy_only=False).astype(np.int64), total[repeat])
        place = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(place.astype(np.int64)), pa.array(total.ravel()[place])], names=["place", "value"])

    let_workers_import(assigned.sparkSession)
    out = np.zeros(repeats * groups * size)
    for r in assigned.mapInArrow(scan, "place long, value double").groupBy("place").agg(F.sum("value").alias("value")).collect():
        out[r["place"]] = r["value"]
    return out.reshape(repeats, groups, size)


def _listing(spark, repeats: int, folds: int, values: dict[str, np.ndarray]) -> DataFrame:
    lines = [(r, f, *(float(v[r, f]) for v in values.values())) for r in range(repeats) for f in range(folds)]
    return spark.createDataFrame(lines, "repeat int, fold int, " + ", ".join(f"{name} double" for name in values))


def least_squares(gram: np.ndarray, penalty: float = 0.0) -> np.ndarray:
    """Coefficients from the products of (1, features, target) with themselves: the intercept, then one a feature.

    ``penalty`` times the number of rows is added to each feature's square. A feature that
    the others determine gets the least norm.
    """
    a, b = gram[:-1, :-1].copy(), gram[:-1, -1]
    a[np.arange(1, len(a)), np.arange(1, len(a))] += penalty * gram[0, 0]
    return np.linalg.lstsq(a, b, rcond=1e-12)[0]


def cross_validate_linear(
    rows: DataFrame,
    target: str,
    features: list[str],
    key: list[str],
    folds: int = 6,
    repeats: int = 10,
    penalty: float = 0.0,
    seed: str = "cv",
) -> DataFrame:
    """``repeat, fold, n, mse, rmse, r2, intercept, slope_<i>`` of least squares on every fold.

    The rows are those with all features and the target. ``penalty`` makes it ridge regression on
    features scaled by the deviations of all rows; the intercept is not penalised. A fold without
    rows, or with a constant target for ``r2``, gives NaN.
    """
    columns = [*features, target]
    complete = reduce(lambda a, b: a & b, [ref(c).isNotNull() for c in columns])
    assigned = assigned_folds(rows.filter(complete).withColumn("_all", F.lit(0)), "_all", key, columns, folds, repeats, seed)
    constants = scaling_constants(assigned, [f"_{i}" for i in range(len(columns))])
    scale = [constants[f"_{i}"] for i in range(len(columns))]
    size = len(columns) + 1

    def add(batch: pa.RecordBatch, own: np.ndarray, total: np.ndarray) -> None:
        z = np.column_stack([np.ones(batch.num_rows), _matrix(batch, len(columns), scale)])
        for fold in np.unique(own, return_counts=True)[0]:
            part = z[own == fold]
            total[fold] += (part.T @ part).ravel()

    grams = fold_sums(assigned, repeats, folds, size * size, add).reshape(repeats, folds, size, size)
    training = grams.sum(1, keepdims=True) - grams
    (my, sy), found = scale[-1], np.full((repeats, folds, 4 + len(features) + 1), np.nan)
    for at in np.ndindex(repeats, folds):
        own, n = grams[at], grams[at][0, 0]
        if not n or not training[at][0, 0]:
            continue
        beta = least_squares(training[at], penalty)
        signed = np.append(beta, -1.0)
        mse = max(0.0, signed @ own @ signed / n)
        spread = own[-1, -1] / n - (own[0, -1] / n) ** 2
        slopes = [b * sy / s for b, (_, s) in zip(beta[1:], scale)]
        intercept = my + sy * beta[0] - sum(b * m for b, (m, _) in zip(slopes, scale))
        found[at] = [n, mse * sy**2, np.sqrt(mse) * sy, 1 - mse / spread if spread > 0 else np.nan, intercept, *slopes]
    names = ["n", "mse", "rmse", "r2", "intercept", *(f"slope_{i}" for i in range(len(features)))]
    return _listing(rows.sparkSession, repeats, folds, {name: found[..., i] for i, name in enumerate(names)})


def class_parameters(sums: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Log shares, means and variances by class, from the count, sums and sums of squares of each class.

    As is usual, a 10^-9th of the largest variance is added to every variance.
    """
    width = (sums.shape[-1] - 1) // 2
    n, total, squares = sums[:, :1], sums[:, 1 : 1 + width], sums[:, 1 + width :]
    with np.errstate(divide="ignore", invalid="ignore"):
        mean = np.where(n > 0, total / n, 0.0)
        variance = np.where(n > 0, np.maximum(squares / n - mean**2, 0.0), 0.0)
        share = np.log(n[:, 0] / n.sum())
        whole = sums.sum(0)
        spread = whole[1 + width :] / whole[0] - (whole[1 : 1 + width] / whole[0]) ** 2
    return share, mean, variance + 1e-9 * np.max(spread, initial=0.0)


def cross_validate_gaussian_bayes(
    rows: DataFrame, target: str, features: list[str], key: list[str], folds: int = 6, repeats: int = 10, seed: str = "cv"
) -> DataFrame:
    """``repeat, fold, n, accuracy`` of Gaussian naive Bayes on stratified folds of the complete rows.

    Ties go to the first class in the order of the labels; a class without training rows is never chosen.
    """
    encoder = label_encoder(target).fit(rows.filter(ref(target).isNotNull()))
    classes, width = len(encoder.labelsArray[0]), len(features)
    labelled = encoder.transform(rows.filter(ref(target).isNotNull()))
    assigned = assigned_folds(labelled, target, key, [*features, "label"], folds, repeats, seed)
    constants = scaling_constants(assigned, [f"_{i}" for i in range(width)])
    scale = [constants[f"_{i}"] for i in range(width)]
    label = f"_{width}"

    def add(batch: pa.RecordBatch, own: np.ndarray, total: np.ndarray) -> None:
        z = _matrix(batch, width, scale)
        rows_ = np.column_stack([np.ones(len(z)), z, z * z])
        group = own * classes + batch[label].to_numpy(zero_copy_only=False).astype(np.int64)
        for i in range(rows_.shape[1]):
            total[:, i] += np.bincount(group, rows_[:, i], minlength=len(total))

    size = 1 + 2 * width
    sums = fold_sums(assigned, repeats, folds * classes, size, add).reshape(repeats, folds, classes, size)
    training = sums.sum(1, keepdims=True) - sums
    models = [[class_parameters(training[r, f]) for f in range(folds)] for r in range(repeats)]

    def judge(batch: pa.RecordBatch, own: np.ndarray, total: np.ndarray, repeat: int) -> None:
        z, truth = _matrix(batch, width, scale), batch[label].to_numpy(zero_copy_only=False).astype(np.int64)
        for fold in np.unique(own, return_counts=True)[0]:
            at = own == fold
            share, mean, variance = models[repeat][fold]
            with np.errstate(divide="ignore", invalid="ignore"):
                parts = [s - 0.5 * (np.log(v) + (z[at] - m) ** 2 / v).sum(1) for s, m, v in zip(share, mean, variance)]
            odds = np.nan_to_num(np.column_stack(parts), nan=-np.inf)
            total[fold] += (at.sum(), (odds.argmax(1) == truth[at]).sum())

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((repeats, folds, 2))
        for batch in batches:
            for repeat in range(repeats if batch.num_rows else 0):
                judge(batch, batch[_fold(repeat)].to_numpy(zero_copy_only=False).astype(np.int64), total[repeat], repeat)
        repeat, fold = np.divmod(np.arange(repeats * folds), folds)
        n, hits = total.reshape(-1, 2).T
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in (repeat.astype(np.int32), fold.astype(np.int32), n, hits)], names=["repeat", "fold", "n", "hits"])

    judged = assigned.mapInArrow(scan, "repeat int, fold int, n double, hits double").groupBy("repeat", "fold").agg(F.sum("n").alias("n"), F.sum("hits").alias("hits"))
    return judged.select("repeat", "fold", "n", F.try_divide("hits", "n").alias("accuracy"))
