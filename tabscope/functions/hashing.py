"""A reproducible position for every row key.

The position depends on the seed and the key alone, so a split made from it is
the same under any partitioning and after any retry.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

POSITION_BITS = 60


def _marked(key: Column) -> Column:
    return F.coalesce(F.concat(F.lit("|"), F.length(key).cast("string"), F.lit(":"), key), F.lit("|"))


def position(seed: str, *keys: Column) -> Column:
    """BIGINT in [0, 2**60), evenly spread, from the md5 of seed and key.

    Key parts carry their lengths and NULL is marked, so different keys give different texts.
    """
    text = F.concat(F.lit(seed), *[_marked(k.cast("string")) for k in keys])
    return F.conv(F.substring(F.md5(text), 1, POSITION_BITS // 4), 16, 10).cast("bigint")
