"""Profiling of any table: completeness, uniqueness, summaries, distributions.

Each operator reads the table once or twice, with only the columns it needs, and
shuffles partial results. NaN counts as missing everywhere.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from itertools import combinations
from math import isfinite

from pyspark.sql import DataFrame, Window, functions as F, types as T

from tabscope.functions.columns import (
    as_measure,
    is_complete,
    melt,
    numeric_columns,
    pick,
    present,
    ref,
    text_columns,
    time_columns,
    without_nan,
)
from tabscope.functions.numbers import percent, round_percent
from tabscope.operators.moments import pair_correlations
from tabscope.operators.ordering import exact_percentiles
from tabscope.workspace import materialize

QUARTILES = [0.25, 0.5, 0.75]


def shape(df: DataFrame) -> DataFrame:
    """One row: ``n_rows, n_columns``."""
    return df.agg(F.count("*").alias("n_rows")).withColumn("n_columns", F.lit(len(df.columns)))


def schema_listing(df: DataFrame) -> DataFrame:
    """``position, name, type`` per column."""
    return df.sparkSession.createDataFrame(
        [(i, name, kind) for i, (name, kind) in enumerate(df.dtypes)],
        "position int, name string, type string",
    )


def _shown(value, rounded: bool):
    return round_percent(value) if rounded else value


def completeness(df: DataFrame, rounded: bool = True) -> DataFrame:
    """One row: share of rows without a missing value, in percent."""
    return df.agg(
        F.count("*").alias("n_rows"), F.count_if(is_complete(df)).alias("complete_rows")
    ).withColumn("complete", _shown(percent(F.col("complete_rows"), F.col("n_rows")), rounded))


def row_digest(df: DataFrame):
    """Two 64-bit hashes of the row's typed cells; 0.0 and -0.0, and NaN and NULL, count as equal.

    They are computed in compiled code and are 16 bytes a row. A hash passes over NULL, so which
    cells are NULL is hashed too. For n different rows the chance that any two have equal
    digests is about n^2 / 2^129: 10^-17 for 10^11 rows. ``by="rows"`` compares the rows themselves.
    """
    cells, gone = [], []
    for f in df.schema:
        if isinstance(f.dataType, (T.StructType, T.ArrayType, T.MapType, T.VariantType)):
            cell = F.to_json(F.struct(ref(f.name).alias("c")), {"ignoreNullFields": "false"})  # NULLs inside it count
        elif isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            cell = present(f) + F.lit(0.0)
        else:
            cell = ref(f.name)
        cells.append(cell)
        gone.append(F.when(cell.isNull(), "1").otherwise("0"))
    if not cells:
        return F.struct(F.lit(0).cast("long").alias("one"), F.lit(0).cast("long").alias("two"))
    marks = F.concat(*gone)
    return F.struct(F.xxhash64(marks, *cells).alias("one"), F.xxhash64(F.lit(1), *cells, marks).alias("two"))


def _row_groups(df: DataFrame, by: str, *extra) -> DataFrame:
    if by == "rows":
        clean = without_nan(df)
        return clean.groupBy(*[ref(c) for c in clean.columns]).agg(F.count("*").alias("_copies"), *extra)
    if by == "digest":
        return df.groupBy(row_digest(df).alias("_digest")).agg(F.count("*").alias("_copies"), *extra)
    raise ValueError(f"unknown comparison: {by}")


def uniqueness(df: DataFrame, rounded: bool = True, by: str = "digest") -> DataFrame:
    """One row: share of distinct rows, in percent.

    Copies collapse before the shuffle, which moves 16 bytes per distinct row.
    ``by='rows'`` compares the rows themselves and moves them whole.
    """
    return (
        _row_groups(df, by)
        .agg(F.coalesce(F.sum("_copies"), F.lit(0)).alias("n_rows"), F.count("*").alias("distinct_rows"))
        .withColumn("unique", _shown(percent(F.col("distinct_rows"), F.col("n_rows")), rounded))
    )


def scorecard(df: DataFrame, rounded: bool = True) -> DataFrame:
    """Shape, completeness and uniqueness in one scan and one shuffle of the rows' digests."""
    marked = df.select(row_digest(df).alias("_digest"), is_complete(df).alias("_complete"))
    groups = marked.groupBy("_digest", "_complete").agg(F.count("*").alias("_copies"))
    totals = groups.agg(
        F.coalesce(F.sum("_copies"), F.lit(0)).alias("n_rows"),
        F.count("*").alias("distinct_rows"),
        F.coalesce(F.sum(F.when(F.col("_complete"), F.col("_copies"))), F.lit(0)).alias("complete_rows"),
    )
    return totals.select(
        "n_rows",
        F.lit(len(df.columns)).alias("n_columns"),
        "complete_rows",
        "distinct_rows",
        _shown(percent(F.col("complete_rows"), F.col("n_rows")), rounded).alias("complete"),
        _shown(percent(F.col("distinct_rows"), F.col("n_rows")), rounded).alias("unique"),
    )


@dataclass(frozen=True)
class Measure:
    """First moments of one numeric or timestamp column (as epoch seconds)."""

    rows: int
    count: int
    mean: float | None
    std: float | None
    min: float | None
    max: float | None


def measures(df: DataFrame, columns: list[str] | None = None, times: bool = True) -> DataFrame:
    """Numeric and timestamp columns as DOUBLE, NaN as NULL."""
    fields = pick(df, columns, numeric_columns(df) + (time_columns(df) if times else []))
    return df.select(*[as_measure(f).alias(f.name) for f in fields])


COLUMNS_PER_SCAN = 20


def measure_stats(values: DataFrame) -> dict[str, Measure]:
    """Moments of all columns of ``measures``; one row per scan reaches the driver."""
    stats: dict[str, Measure] = {}
    for at in range(0, len(values.columns), COLUMNS_PER_SCAN):
        names = values.columns[at : at + COLUMNS_PER_SCAN]
        row = values.agg(
            *[
                F.struct(F.count(ref(c)), F.avg(ref(c)), F.stddev_samp(ref(c)), F.min(ref(c)), F.max(ref(c)))
                for c in names
            ],
            F.count("*"),
        ).first()
        stats.update({c: Measure(row[len(names)], *row[i]) for i, c in enumerate(names)})
    return stats


SUMMARY_SCHEMA = (
    "column string, count bigint, mean double, std double, min double, "
    "p25 double, p50 double, p75 double, max double"
)


def numeric_summary(
    df: DataFrame,
    columns: list[str] | None = None,
    method: str = "exact",
    stats: dict[str, Measure] | None = None,
    **tuning,
) -> DataFrame:
    """Count, mean, sample deviation, extremes and quartiles per numeric or timestamp column.

    Timestamps are epoch seconds, without a deviation. ``method='approx'`` takes
    the quartiles from a sketch in place of the exact search.
    """
    values = measures(df, columns)
    if not values.columns:
        return df.sparkSession.createDataFrame([], SUMMARY_SCHEMA)
    stats = stats or measure_stats(values)
    if method == "approx":
        wanted = F.array(*map(F.lit, QUARTILES))
        row = values.agg(*[F.percentile_approx(ref(c), wanted) for c in values.columns]).first()
        quartiles = {c: row[i] or [None] * 3 for i, c in enumerate(values.columns)}
    else:
        quartiles = {}
        for at in range(0, len(values.columns), COLUMNS_PER_SCAN):
            part = values.columns[at : at + COLUMNS_PER_SCAN]
            spans = {c: (stats[c].count, stats[c].min, stats[c].max) for c in part}
            quartiles.update(exact_percentiles(values, spans, QUARTILES, **tuning))
    times = set(time_columns(df))
    rows = [
        (c, m.count, m.mean, None if c in times else m.std, m.min, *quartiles[c], m.max)
        for c, m in ((c, stats[c]) for c in values.columns)
    ]
    return df.sparkSession.createDataFrame(rows, SUMMARY_SCHEMA)


def _value_counts(df: DataFrame, names: list[str]) -> DataFrame:
    texts = df.select(*[present(df.schema[n]).cast("string").alias(n) for n in names])
    return melt(texts, names).groupBy("column", "value").agg(F.count("*").alias("count"))


def text_summary(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """``count, unique, top, freq`` per column, as shown for tables without numbers."""
    names = df.columns if columns is None else columns
    best = F.struct((-F.col("count")).alias("rank"), F.col("value"))
    return (
        _value_counts(df, names)
        .filter(F.col("value").isNotNull())
        .groupBy("column")
        .agg(
            F.sum("count").alias("count"),
            F.count("*").alias("unique"),
            F.min_by("value", best).alias("top"),
            F.max("count").alias("freq"),
        )
    )


# Fixed value: text the engine itself would cast to a number.
CASTABLE = r"(?i)^\s*([+-]?([0-9]+\.?[0-9]*|\.[0-9]+)(e[+-]?[0-9]+)?[df]?|[+-]?inf(inity)?|nan)\s*$"


def full_summary(df: DataFrame) -> DataFrame:
    """Count, mean, stddev, min and max of numeric and text columns, all as text.

    Same table as the built-in ``describe``; text is tested with a pattern before
    it is cast, as a failing cast of every row is slow.
    """
    fields = [f for f in df.schema if isinstance(f.dataType, (T.NumericType, T.StringType))]
    texts = [f for f in fields if isinstance(f.dataType, T.StringType)]
    numbers = [f for f in fields if f not in texts]
    labels = ["count", "mean", "stddev", "min", "max"]
    line = F.col("id").cast("int")
    shown = {}
    # a group of columns per scan: each scan reads only its own columns
    for kind in (numbers, texts):
        for at in range(0, len(kind), FIELDS_PER_SCAN):
            part = kind[at : at + FIELDS_PER_SCAN]
            stats = _as_text(df, part).scalar()
            shown.update({f.name: stats[i][line].alias(f.name) for i, f in enumerate(part)})
    return (
        df.sparkSession.range(0, len(labels), 1, 1)
        .select(F.array(*map(F.lit, labels))[line].alias("summary"), *[shown[f.name] for f in fields])
    )


FIELDS_PER_SCAN = 5


def _as_text(df: DataFrame, fields: list[T.StructField]) -> DataFrame:
    """One array of arrays: per field its count, mean, stddev, min and max as text."""
    cells, stats = [], []
    for i, f in enumerate(fields):
        number = present(f)
        if isinstance(f.dataType, T.StringType):
            number = F.when(ref(f.name).rlike(CASTABLE), ref(f.name).try_cast("double"))
        cells += [present(f).alias(f"c{i}"), number.alias(f"n{i}")]
        aggregates = [F.count(f"c{i}"), F.avg(f"n{i}"), F.stddev_samp(f"n{i}"), F.min(f"c{i}"), F.max(f"c{i}")]
        stats.append(F.array(*[a.cast("string") for a in aggregates]))
    return df.select(*cells).agg(F.array(*stats).alias("stats"))


HISTOGRAM_SCHEMA = "column string, bin int, low double, high double, count bigint"


def histogram(
    df: DataFrame,
    columns: list[str] | None = None,
    bins: int = 10,
    stats: dict[str, Measure] | None = None,
) -> DataFrame:
    """``column, bin, low, high, count`` over equal-width bins, the last one closed.

    A constant column spans half a unit on both sides, an empty one [0, 1].
    Infinite values lie in no bin; the bins span the finite ones.
    """
    values = measures(df, columns)
    if not values.columns:
        return df.sparkSession.createDataFrame([], HISTOGRAM_SCHEMA)
    stats = dict(stats or measure_stats(values))
    endless = [c for c in values.columns if stats[c].count and not (isfinite(stats[c].min) and isfinite(stats[c].max))]
    if endless:
        finite = [F.when(F.abs(ref(c)) < float("inf"), ref(c)).alias(c) if c in endless else ref(c) for c in values.columns]
        values = values.select(*finite)
        stats.update(measure_stats(values.select(*[ref(c) for c in endless])))
    edges = []
    for c in values.columns:
        low, high = (0.0, 1.0) if stats[c].count == 0 else (stats[c].min, stats[c].max)
        edges.append((c, low - 0.5, high + 0.5) if low == high else (c, low, high))

    cells = [
        F.when(
            ref(c).isNotNull(), F.least(F.floor((ref(c) - low) / (high - low) * bins), F.lit(bins - 1)).cast("int")
        ).alias(c)
        for c, low, high in edges
    ]
    counted = (
        melt(values.select(*cells), values.columns, value="bin")
        .filter(F.col("bin").isNotNull())
        .groupBy("column", "bin")
        .agg(F.count("*").alias("count"))
    )
    every_bin = F.inline(
        F.array(*[F.struct(F.lit(c).alias("column"), F.lit(a).alias("from"), F.lit(b).alias("to")) for c, a, b in edges])
    )
    grid = df.sparkSession.range(1).select(every_bin).withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    width = (F.col("to") - F.col("from")) / bins
    return grid.join(counted, ["column", "bin"], "left").select(
        "column",
        "bin",
        (F.col("from") + width * F.col("bin")).alias("low"),
        (F.col("from") + width * (F.col("bin") + 1)).alias("high"),
        F.coalesce("count", F.lit(0)).alias("count"),
    )


PAIRS_PER_SCAN = 100


def correlation(
    df: DataFrame,
    columns: list[str] | None = None,
    missing: str = "pairwise",
    stats: dict[str, Measure] | None = None,
) -> DataFrame:
    """Pearson correlation of every ordered pair of numeric columns: ``a, b, corr``.

    ``missing='pairwise'`` uses rows with both values, ``missing='zero'`` reads a
    missing value as 0. A column that is constant over the pair's rows, or infinite in
    one of them, gives NULL. Pairs without missing values are plain sums of products
    around the means; the others take one scan together, each over its own rows, by
    mergeable co-moments (``operators.moments``).
    """
    if missing not in ("pairwise", "zero"):
        raise ValueError(f"unknown treatment of missing values: {missing}")
    values = measures(df, columns, times=False)
    if missing == "zero":
        values = values.select(*[F.coalesce(ref(c), F.lit(0.0)).alias(c) for c in values.columns])
    names = values.columns
    spark = df.sparkSession
    if not names:
        return spark.createDataFrame([], "a string, b string, corr double")
    if missing == "zero" or stats is None:
        stats = measure_stats(values)
    diagonal, sums, masked = [], [], []
    endless = {c for c, s in stats.items() if s.count and not (isfinite(s.min) and isfinite(s.max))}
    for c in names:
        flat = stats[c].count == 0 or stats[c].min == stats[c].max or c in endless
        diagonal.append((c, c, None if flat else 1.0))
    spread = {c: s.std * ((s.count - 1) / s.count) ** 0.5 for c, s in stats.items() if s.count > 1 and s.min < s.max}
    for a, b in combinations(names, 2):
        if a not in spread or b not in spread:
            diagonal += [(a, b, None), (b, a, None)]
        elif stats[a].count == stats[a].rows and stats[b].count == stats[b].rows and not {a, b} & endless:
            sums.append((a, b))
        else:
            masked.append((a, b))

    parts = [spark.createDataFrame(diagonal, "a string, b string, corr double")]
    for at in range(0, len(sums), PAIRS_PER_SCAN):
        entries = []
        for a, b in sums[at : at + PAIRS_PER_SCAN]:
            product = F.sum((ref(a) - stats[a].mean) * (ref(b) - stats[b].mean)) / float(stats[a].rows)
            value = (product / (spread[a] * spread[b])).alias("corr")
            entries.append(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), value))
        parts.append(_both_ways(values.agg(F.array(*entries).alias("pairs")).select(F.inline("pairs"))))
    if masked:
        used = [c for c in names if any(c in pair for pair in masked)]
        places = {c: i for i, c in enumerate(used)}
        listed = spark.createDataFrame([(a, b, places[a], places[b]) for a, b in masked], "a string, b string, i int, j int")
        found = pair_correlations(values.select(*[ref(c) for c in used]))
        parts.append(_both_ways(listed.join(found, ["i", "j"], "left").select("a", "b", "corr")))
    return reduce(DataFrame.unionByName, parts)


def _both_ways(pairs: DataFrame) -> DataFrame:
    swapped = F.array(
        F.struct(F.col("a").alias("a"), F.col("b").alias("b"), "corr"),
        F.struct(F.col("b").alias("a"), F.col("a").alias("b"), "corr"),
    )
    return pairs.select(F.inline(swapped))


SENT_VALUES = 100_000


def top_values(df: DataFrame, columns: list[str] | None = None, k: int = 5, sent: int = SENT_VALUES) -> DataFrame:
    """The ``k`` most frequent values per text column, NULL included, ties by value.

    Values are counted by a 128-bit digest, so no text crosses the first shuffle. The k-th largest
    count of a column is the certificate of its list: values with fewer rows cannot be in it. Only for
    the others, ties at that count included, are the texts fetched.
    """
    names = text_columns(df) if columns is None else columns
    if not names:
        return df.sparkSession.createDataFrame([], "column string, rank int, value string, count bigint")
    texts = melt(df.select(*[present(df.schema[n]).cast("string").alias(n) for n in names]), names)
    digest = ["_one", "_two", "_null"]
    marked = texts.select("column", "value", F.xxhash64("value").alias("_one"), F.xxhash64(F.lit(1), "value").alias("_two"), F.col("value").isNull().alias("_null"))
    counts = materialize(marked.groupBy("column", *digest).agg(F.count("*").alias("count")), "counts")
    largest = Window.partitionBy("column").orderBy(F.desc("count"))
    least = counts.withColumn("_place", F.row_number().over(largest)).filter(F.col("_place") <= k).groupBy("column").agg(F.min("count").alias("_least"))
    leading = materialize(counts.join(F.broadcast(least), "column").filter("count >= _least").drop("_least"), "leading")
    few = leading.count() <= sent
    rows = marked.join(F.broadcast(leading) if few else leading, ["column", *digest])
    if few:
        found = rows.groupBy("column", *digest, "count").agg(F.first("value").alias("value"))
    else:  # many ties: of the values with one count, the first k are enough
        alike = Window.partitionBy("column", "count").orderBy(F.asc_nulls_last("value"))
        found = rows.withColumn("_place", F.dense_rank().over(alike)).filter(F.col("_place") <= k).select("column", "value", "count").distinct()
    order = Window.partitionBy("column").orderBy(F.desc("count"), F.asc_nulls_last("value"))
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("column", "rank", "value", "count")


def category_counts(df: DataFrame, column: str) -> DataFrame:
    """Rows per value of ``column``, missing values left out."""
    value = present(df.schema[column])
    return df.filter(value.isNotNull()).groupBy(value.alias(column)).agg(F.count("*").alias("count"))
