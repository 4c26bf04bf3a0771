"""Joining a table to per-group values that are usually few."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from tabscope.functions.columns import ref
from tabscope.workspace import materialize

BROADCAST_ROWS = 100_000


def null_safe_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join on ``keys`` with NULL equal to NULL; the key columns of ``left`` are kept."""
    renamed = right.select(
        *[ref(k).alias(f"_right_{k}") for k in keys],
        *[ref(c) for c in right.columns if c not in keys],
    )
    on = reduce(lambda a, b: a & b, [ref(k).eqNullSafe(ref(f"_right_{k}")) for k in keys])
    return left.join(renamed, on, how).drop(*[f"_right_{k}" for k in keys])


def attach(
    rows: DataFrame, values: DataFrame, keys: list[str], how: str = "inner", limit: int = BROADCAST_ROWS
) -> DataFrame:
    """Bring one ``values`` row per key to ``rows``.

    The values are written and counted first. Up to ``limit`` rows are broadcast;
    beyond it the tables are shuffled on the key and adaptive execution splits the
    partitions that a frequent key makes too large.
    """
    stored = materialize(values, "values")
    if not keys:
        raise ValueError("attach needs key columns")
    if stored.count() <= limit:
        stored = F.broadcast(stored)
    return null_safe_join(rows, stored, keys, how)
