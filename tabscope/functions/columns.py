"""Column references, column choice by type, and one meaning of "missing"."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F, types as T

FLOATING = (T.FloatType, T.DoubleType)
TIMES = (T.TimestampType, T.TimestampNTZType)


def ref(name: str) -> Column:
    """Reference a column whatever characters its name holds."""
    return F.col("`" + name.replace("`", "``") + "`")


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType)]


def time_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, TIMES)]


def text_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]


def present(field: T.StructField) -> Column:
    """The column with NaN turned into NULL, so that missing means one thing."""
    column = ref(field.name)
    if isinstance(field.dataType, FLOATING):
        return F.nanvl(column, F.lit(None).cast(field.dataType))
    return column


def as_measure(field: T.StructField) -> Column:
    """The column as DOUBLE: numbers as they are, timestamps as epoch seconds."""
    column = ref(field.name)
    if isinstance(field.dataType, T.TimestampType):
        return F.unix_micros(column).cast("double") / F.lit(1e6)
    if isinstance(field.dataType, T.TimestampNTZType):
        # by its fields, as a wall-clock time has no zone
        whole = F.unix_date(F.to_date(column)).cast("bigint") * 86400 + F.hour(column) * 3600 + F.minute(column) * 60
        return whole.cast("double") + F.date_part(F.lit("SECOND"), column).cast("double")
    return present(field).cast("double")


def without_nan(df: DataFrame) -> DataFrame:
    return df.select(*[present(f).alias(f.name) for f in df.schema])


def is_complete(df: DataFrame) -> Column:
    """True where no column is missing."""
    return reduce(lambda a, b: a & b, [present(f).isNotNull() for f in df.schema], F.lit(True))


def pick(df: DataFrame, columns: list[str] | None, default: list[str]) -> list[T.StructField]:
    names = default if columns is None else columns
    return [df.schema[name] for name in names]


def melt(df: DataFrame, columns: list[str], name: str = "column", value: str = "value", ids: list[str] | None = None) -> DataFrame:
    """One row per listed column and input row; the columns share one type."""
    cells = [F.struct(F.lit(c).alias(name), ref(c).alias(value)) for c in columns]
    return df.select(*[ref(i) for i in ids or []], F.inline(F.array(*cells)))
