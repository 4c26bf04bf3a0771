"""The data-quality report: chosen metrics of one table."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, functions as F

from tabscope.operators import profile as P
from tabscope.sources.history import append_run
from tabscope.sources.landing import land_once

# The metrics by the names that callers use.
METRICS = ("shape", "unique", "complete", "num_dist", "corr", "schema", "cat_dist", "describe")


def chosen(metrics: dict[str, bool] | list[str] | None) -> list[str]:
    """Metric names that are switched on; an unknown name raises."""
    if metrics is None:
        return list(METRICS)
    names = [m for m, on in metrics.items() if on] if isinstance(metrics, dict) else list(metrics)
    unknown = [m for m in names if m not in METRICS]
    if unknown:
        raise KeyError(f"unknown metrics: {', '.join(unknown)}")
    return names


def quality_report(
    df: DataFrame,
    metrics: dict[str, bool] | list[str] | None = None,
    missing: str = "pairwise",
    quartiles: str = "exact",
    unique_by: str = "digest",
) -> dict[str, DataFrame]:
    """One table per chosen metric.

    The moments of all numeric columns are taken in one scan and shared by the
    summary, the histogram and the correlation. Shape, completeness and
    uniqueness share one scan when uniqueness is asked for. Parts that run jobs
    of their own while being built do so side by side.
    """
    names = chosen(metrics)
    wants = set(names)
    counted = "unique" in wants and unique_by == "digest"

    def count_rows() -> DataFrame:
        # one row, taken once for the three metrics that show it
        scored = P.scorecard(df)
        return df.sparkSession.createDataFrame([tuple(scored.first())], scored.schema)

    with ThreadPoolExecutor(PARTS_AT_ONCE) as pool:
        counts = pool.submit(count_rows) if counted else None
        stats = None
        if wants & {"describe", "num_dist", "corr"}:
            values = P.measures(df)
            stats = P.measure_stats(values) if values.columns else {}

        def row_metric(columns: list[str], otherwise: Callable[[], DataFrame]) -> DataFrame:
            return (counts.result() if counted else otherwise()).select(*columns)

        build: dict[str, Callable[[], DataFrame]] = {
            "shape": lambda: row_metric(["n_rows", "n_columns"], lambda: P.shape(df)),
            "unique": lambda: row_metric(["unique"], lambda: P.uniqueness(df, by=unique_by)),
            "complete": lambda: row_metric(["complete"], lambda: P.completeness(df)),
            "num_dist": lambda: P.histogram(df, stats=stats),
            "corr": lambda: P.correlation(df, missing=missing, stats=stats),
            "schema": lambda: P.schema_listing(df),
            "cat_dist": lambda: P.top_values(df),
            "describe": lambda: P.numeric_summary(df, method=quartiles, stats=stats) if stats else P.text_summary(df),
        }
        eager = ["describe"] + [n for n in names if n != "describe"]
        parts = {n: pool.submit(build[n]) for n in eager if n in wants}
        return {n: parts[n].result() for n in names}


PARTS_AT_ONCE = 4

LISTED = {"num_dist", "corr", "schema", "cat_dist", "describe"}


def report_row(report: dict[str, DataFrame]) -> DataFrame:
    """The report as one row with a ``data`` struct, ready for the history.

    Every array is bounded by the number of columns (times bins or top values).
    """
    spark = next(iter(report.values())).sparkSession
    cells = []
    for name, table in report.items():
        line = F.struct(*table.columns)
        if name in LISTED:
            cell = table.agg(F.array_sort(F.collect_list(line)).alias(name)).scalar()
        elif name == "shape":
            cell = table.select(line.alias(name)).scalar()
        else:
            cell = table.select(name).scalar()
        cells.append(cell.alias(name))
    return spark.range(1).select(F.struct(*cells).alias("data"))


def quality_run(source: DataFrame, landing: str, history: str, file_name: str, file_type: str, metrics: dict[str, bool] | list[str] | None = None) -> str:
    """One run from end to end: the table is landed unless it is there, the report is made of what
    is landed, and appended to the history. Returns the run's id."""
    land_once(source, landing)
    row = report_row(quality_report(source.sparkSession.read.parquet(landing), metrics))
    return append_run(row.select(F.lit(file_name).alias("fileName"), F.lit(file_type).alias("fileType"), "data"), history)
