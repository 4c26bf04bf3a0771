"""Projections, filters and cleaning steps."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.feature import Imputer
from pyspark.sql import Column, DataFrame, functions as F

from tabscope.functions.columns import is_complete, numeric_columns, ref, text_columns, without_nan
from tabscope.functions.numbers import to_number


def date_from_text(text: Column, strict: bool = True) -> Column:
    """The first word as a date; a bad value raises unless ``strict`` is off."""
    word = F.split(F.trim(text), r"\s+")[0]
    if strict:
        return F.to_date(word, "yyyy-MM-dd")
    return F.try_to_date(word, "yyyy-MM-dd")


def coerce_numbers(df: DataFrame, columns: list[str]) -> DataFrame:
    """Text columns to DOUBLE, NULL where the text is no number."""
    return df.withColumns({c: to_number(ref(c)) for c in columns})


def drop_where_zero(df: DataFrame, column: str) -> DataFrame:
    """Drop rows where ``column`` is 0; rows where it is missing stay."""
    return df.filter(~ref(column).eqNullSafe(F.lit(0)))


def impute_mean(df: DataFrame, columns: list[str]) -> DataFrame:
    """Missing numbers replaced by their own column's mean."""
    floats = df.withColumns({c: ref(c).cast("double") for c in columns})
    return Imputer(strategy="mean", inputCols=columns, outputCols=columns).fit(floats).transform(floats)


def drop_incomplete(df: DataFrame) -> DataFrame:
    """Rows without any missing value."""
    return df.filter(is_complete(df))


def drop_copies(df: DataFrame) -> DataFrame:
    """Distinct rows, NULL and NaN equal to themselves; copies collapse before the shuffle."""
    return without_nan(df).dropDuplicates()


def split_label(df: DataFrame, label: str) -> tuple[DataFrame, DataFrame]:
    """Feature columns and the label column."""
    return df.drop(label), df.select(ref(label))


@dataclass(frozen=True)
class Roles:
    """Which columns are scaled, which are one-hot encoded, which pass through."""

    numeric: list[str]
    categorical: list[str]
    passthrough: list[str]


def assign_roles(df: DataFrame, label: str, numeric: list[str], first: int | None = None) -> Roles:
    """Named columns are numeric, the other ones of the first ``first`` categorical, the rest passes."""
    features = [c for c in df.columns if c != label]
    head = set(df.columns[: len(df.columns) if first is None else first])
    return Roles(
        numeric=[c for c in features if c in numeric],
        categorical=[c for c in features if c in head and c not in numeric],
        passthrough=[c for c in features if c not in head and c not in numeric],
    )


def columns_by_type(df: DataFrame) -> dict[str, list[str]]:
    return {"numeric": numeric_columns(df), "categorical": text_columns(df)}


def stringify(df: DataFrame, columns: list[str]) -> DataFrame:
    """Dates, timestamps and identifiers as text."""
    return df.withColumns({c: ref(c).cast("string") for c in columns})


def stamp(df: DataFrame, column: str = "date") -> DataFrame:
    """Add the time of the run."""
    return df.withColumn(column, F.current_timestamp())
