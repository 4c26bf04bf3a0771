"""Ways a table enters: delimited text, in-memory frames, stored collections."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from tabscope.functions.columns import ref
from tabscope.functions.numbers import null_tokens, to_number

# Fixed schema of the housing sales table.
SALES_SCHEMA = T.StructType(
    [
        T.StructField("datesold", T.DateType(), True),
        T.StructField("postcode", T.LongType(), True),
        T.StructField("price", T.LongType(), True),
        T.StructField("propertyType", T.StringType(), True),
        T.StructField("bedrooms", T.IntegerType(), True),
    ]
)


def scan_text_columns(spark: SparkSession, path: str) -> DataFrame:
    """Delimited text with a header, every column as text."""
    return spark.read.csv(path, header=True)


def scan_inferred(spark: SparkSession, path: str) -> DataFrame:
    """Delimited text with a header, types inferred by one extra pass over the files."""
    return spark.read.csv(path, header=True, inferSchema=True)


def infer_schema(spark: SparkSession, path: str) -> T.StructType:
    """Types found by one pass, to be kept and passed to ``scan_declared`` from then on."""
    return scan_inferred(spark, path).schema


def scan_declared(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Delimited text with a header and known types; no inference pass."""
    return spark.read.csv(path, header=True, schema=schema, enforceSchema=True)


LINE = "_line"
_QUOTED = r'"[^"]*"'


def split_lines(spark: SparkSession, path: str, multi_line: bool = False) -> tuple[DataFrame, DataFrame]:
    """The lines with as many fields as the header, all columns as text, and the others.

    The others are a table of their own: ``file``, ``block`` (where the part of the file begins that
    a task read, in bytes), ``place`` (of the line among those read there, from 0), ``fields`` (how
    many it has), ``expected`` and ``line``. Nothing is filled up or cut off. Blank lines are no
    lines. Quotes inside quotes are doubled; a separator inside quotes does not count. Both tables
    come from one reading each of the same files.
    """
    names = spark.read.csv(path, header=True, escape='"', multiLine=multi_line).columns
    whole = T.StructType([T.StructField(c, T.StringType()) for c in names] + [T.StructField(LINE, T.StringType())])
    # fields are counted only if a line is parsed whole, whatever columns are used later
    reader = spark.read.schema(whole).option("columnPruning", "false").option("columnNameOfCorruptRecord", LINE)
    raw = reader.csv(path, header=True, escape='"', multiLine=multi_line, enforceSchema=True, mode="PERMISSIVE")
    # always true; a reading of the corrupt lines' column alone, as for a count, is refused
    read = F.length(F.coalesce(ref(names[0]), F.lit(""))) >= 0
    marked = raw.select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("place"),
        *[ref(c) for c in whole.names],
    )
    bare = F.regexp_replace(ref(LINE), _QUOTED, "")
    fields = (F.length(bare) - F.length(F.replace(bare, F.lit(","), F.lit(""))) + 1).alias("fields")
    others = marked.filter(ref(LINE).isNotNull() & read).select("file", "block", "place", fields, F.lit(len(names)).alias("expected"), ref(LINE).alias("line"))
    return raw.filter(ref(LINE).isNull() & read).select(*[ref(c) for c in names]), others


def scan_with_missing(spark: SparkSession, path: str, multi_line: bool = False, ragged: str = "raise") -> DataFrame:
    """Delimited text where every usual spelling of "missing" becomes NULL.

    A quote inside a quoted field is written twice. A column whose present values
    are all numbers becomes BIGINT or, if one does not fit, DOUBLE; one of truth
    values BOOLEAN. One aggregate decides for all columns. ``multi_line`` allows
    line breaks inside quotes; a file is then read by one task.

    A line with fewer fields than the header is filled up with NULL. One with more raises, with the
    file and the place of the first; ``ragged="drop"`` leaves lines with more or fewer out, for callers that
    take them from ``split_lines``.
    """
    if ragged not in ("raise", "drop"):
        raise ValueError(f"unknown treatment of ragged lines: {ragged}")
    if ragged == "drop":
        raw, _ = split_lines(spark, path, multi_line)
    else:
        raw = spark.read.csv(path, header=True, escape='"', multiLine=multi_line)
        _, others = split_lines(spark, path, multi_line)
        first = others.filter("fields > expected").orderBy("file", "block", "place").limit(1).collect()
        if first:
            r = first[0]
            raise ValueError(f"expected {r.expected} fields, saw {r.fields} in {r.file}, block {r.block}, line {r.place}: {r.line[:200]!r}")
    clean = raw.select(*[null_tokens(ref(c)).alias(c) for c in raw.columns])
    checks = clean.agg(
        *[
            F.struct(
                F.count_if(ref(c).isNotNull()),
                F.count_if(ref(c).isNotNull() & to_number(ref(c)).isNull()),
                F.count_if(ref(c).isNotNull() & _whole(ref(c)).isNull()),
                F.count_if(~ref(c).isin("True", "TRUE", "true", "False", "FALSE", "false")),
            )
            for c in raw.columns
        ]
    ).first()

    def typed(i: int, c: str):
        filled, no_number, no_integer, no_truth = checks[i]
        if filled and not no_truth:
            return ref(c).cast("boolean")
        if filled and not no_integer:
            return _whole(ref(c))
        if not no_number:
            return to_number(ref(c))
        return ref(c)

    return clean.select(*[typed(i, c).alias(c) for i, c in enumerate(raw.columns)])


def _whole(text: Column) -> Column:
    trimmed = F.trim(text)
    return F.when(trimmed.rlike("^[+-]?[0-9]+$"), trimmed.try_cast("bigint"))


def from_frame(spark: SparkSession, frame: pd.DataFrame, schema: T.StructType | None = None) -> DataFrame:
    """An in-memory frame as a table, with inferred or declared types."""
    return spark.createDataFrame(frame, schema) if schema is not None else spark.createDataFrame(frame)


def scan_collection(spark: SparkSession, path: str) -> DataFrame:
    """A stored collection without its document id."""
    return spark.read.parquet(path).drop("_id")


def column_names(df: DataFrame) -> list[str]:
    return list(df.columns)
