"""Number parsing, and rounding on exact binary values."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# The spellings a CSV reader takes for a missing value.
NA_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
    "nan", "null",
]

# Fixed value: text that counts as a number once trimmed.
NUMBER_PATTERN = r"^[+-]?(([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?|(?i:inf|infinity))$"


def to_number(text: Column) -> Column:
    """DOUBLE of the text, NULL when it is not a number (also for suffixes such as ``1d``)."""
    trimmed = F.trim(text)
    return F.when(trimmed.rlike(NUMBER_PATTERN), trimmed.try_cast("double"))


def null_tokens(text: Column) -> Column:
    """NULL for any missing-value spelling, the text otherwise; `` NA `` with blanks is a text."""
    return F.when(~text.isin(NA_TOKENS), text)


_UNITS = 2.0**46


def round_percent(value: Column) -> Column:
    """Two decimals of a value in [0, 100], ties on the exact binary value to even.

    Spark's ``round`` works on the shortest decimal text (2.675 gives 2.68); the
    wanted result follows the stored binary value (2.67). Below 128 a double times
    2**46 fits a BIGINT, so the comparison with one half is done in integers.
    """
    scaled = value * F.lit(_UNITS)
    whole = F.floor(scaled)
    below_unit = (scaled - whole.cast("double")) * F.lit(100.0)
    hundred = whole * F.lit(100)
    cents = F.shiftright(hundred, 46)
    over_half = (hundred - F.shiftleft(cents, 46) - F.lit(2**45)).cast("double") + below_unit
    up = (over_half > 0) | ((over_half == 0) & (F.pmod(cents, F.lit(2)) == 1))
    return (cents + up.cast("bigint")).cast("double") / F.lit(100.0)


def percent(part: Column, whole: Column) -> Column:
    """``part / whole * 100``; NULL for an empty table."""
    return F.try_divide(part.cast("double"), whole.cast("double")) * F.lit(100.0)
