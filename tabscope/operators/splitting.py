"""Train/test split and stratified folds from reproducible row positions.

Rows never move: a split is a comparison of the row's own position with a few
cut points, so the plan stays a narrow projection over the scan. The key has to
identify a row; rows with equal keys stay together.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import Column, DataFrame, functions as F

from tabscope.functions.columns import ref
from tabscope.functions.hashing import POSITION_BITS, position
from tabscope.operators.joining import attach
from tabscope.operators.ordering import position_cutoffs
from tabscope.workspace import materialize

PLACE = "_place"


def in_test(key: list[str], test_share: float, seed: str) -> Column:
    """True for about ``test_share`` of the rows; needs no pass over the data."""
    cut = int(test_share * (1 << POSITION_BITS))
    return position(seed, *[ref(k) for k in key]) < F.lit(cut)


def train_test_split(
    df: DataFrame, key: list[str], test_share: float = 0.3, seed: str = "40", exact: bool = False
) -> DataFrame:
    """Add ``split`` = 'train' or 'test'.

    ``exact`` makes the test part ``ceil(test_share * n)`` rows, which costs one
    counting pass; otherwise the share holds on average.
    """
    if not exact:
        test = in_test(key, test_share, seed)
        return df.withColumn("split", F.when(test, F.lit("test")).otherwise(F.lit("train")))
    placed = df.withColumn(PLACE, position(seed, *[ref(k) for k in key]))
    cuts = position_cutoffs(
        placed, [], PLACE, 2, sizes=lambda n, part: F.ceil(n * F.lit(test_share)).cast("bigint")
    ).first()
    test = F.lit(True) if cuts is None or not cuts["cuts"] else F.col(PLACE) < F.lit(cuts["cuts"][0])
    return placed.withColumn("split", F.when(test, F.lit("test")).otherwise(F.lit("train"))).drop(PLACE)


def _by_cuts(df: DataFrame, cuts: DataFrame, label: str, place: Column, output: str) -> DataFrame:
    passed = F.filter("cuts", lambda c: c <= place)
    return attach(df, cuts, [label], how="left").withColumn(output, F.coalesce(F.size(passed), F.lit(0))).drop("cuts")


def stratified_folds(
    df: DataFrame, label: str, key: list[str], folds: int = 6, repeat: int = 0, seed: str = "cv"
) -> DataFrame:
    """Add ``fold`` in 0..folds-1; within each label the folds differ by at most one row."""
    placed = df.withColumn(PLACE, position(f"{seed}:{repeat}", *[ref(k) for k in key]))
    return _by_cuts(placed, position_cutoffs(placed, [label], PLACE, folds), label, F.col(PLACE), "fold").drop(PLACE)


def repeated_folds(
    df: DataFrame, label: str, key: list[str], folds: int = 6, repeats: int = 10, seed: str = "cv", output: str = "_fold_", parallelism: int = 8
) -> DataFrame:
    """Add a fold for each repeat, ``_fold_0`` and so on, the same as ``stratified_folds`` gives.

    The rows are counted once and the repeats' cuts found side by side. ``df`` is read for every
    repeat, so it should be stored.
    """
    rows = df.count()

    def cut(repeat: int) -> DataFrame:
        own = df.select(ref(label), position(f"{seed}:{repeat}", *[ref(k) for k in key]).alias(PLACE))
        return materialize(position_cutoffs(own, [label], PLACE, folds, rows=rows), "cuts")

    with ThreadPoolExecutor(parallelism) as pool:
        cuts = list(pool.map(cut, range(repeats)))
    out = df
    for repeat, own in enumerate(cuts):
        out = _by_cuts(out, own, label, position(f"{seed}:{repeat}", *[ref(k) for k in key]), f"{output}{repeat}")
    return out
