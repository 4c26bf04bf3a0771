"""The monthly sales report: profile, monthly totals and forecast."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tabscope.functions.columns import ref
from tabscope.operators import profile as P, series as S


def sales_report(
    sales: DataFrame,
    months: int,
    model: str = "trend_seasonal",
    date: str = "datesold",
    value: str = "price",
    category: str = "propertyType",
    series: list[str] | None = None,
    alpha: float = 0.3,
    beta: float | None = None,
) -> dict[str, DataFrame]:
    """One table per part of the report; percentages are not rounded."""
    scored = P.scorecard(sales, rounded=False)
    counts = sales.sparkSession.createDataFrame([tuple(scored.first())], scored.schema)
    monthly = S.monthly_totals(sales, date, value, series)
    if model == "trend_seasonal":
        forecast = S.forecast_trend_seasonal(S.fit_trend_seasonal(monthly, series), months, series)
    elif model == "smoothing":
        forecast = S.exponential_smoothing(monthly, months, alpha, beta, series)
    else:
        raise ValueError(f"unknown model: {model}")
    return {
        "shape": counts.select("n_rows", "n_columns"),
        "schema": P.schema_listing(sales),
        "describe": P.full_summary(sales),
        "completeness": counts.select("complete"),
        "uniqueness": counts.select("unique"),
        "numerical_distribution": P.histogram(sales),
        "monthly_sales": monthly,
        "categorical_distribution": P.category_counts(sales, category),
        "forecast": S.last_rows(forecast, months, series),
    }


def sales_row(report: dict[str, DataFrame], model_name: str) -> DataFrame:
    """The whole report as one history row; dates as text, the lines of each part in a fixed order.

    Parts have a line per column, bin, month or category, so a row holds them.
    """
    spark = report["shape"].sparkSession

    def lines(part: str):
        table = report[part]
        texts = {c: ref(c).cast("string") for c, kind in table.dtypes if kind == "date"}
        table = table.withColumns(texts)
        return table.agg(F.array_sort(F.collect_list(F.struct(*[ref(c) for c in table.columns]))).alias("p")).scalar()

    return spark.range(1).select(
        F.struct(
            report["shape"].select(F.struct("n_rows", "n_columns")).scalar().alias("shape"),
            report["completeness"].select("complete").scalar().alias("completeness"),
            report["uniqueness"].select("unique").scalar().alias("uniqueness"),
            *[lines(p).alias(p) for p in ("schema", "describe", "numerical_distribution", "monthly_sales", "categorical_distribution")],
        ).alias("eda"),
        F.struct(
            F.lit(model_name).alias("model_name"),
            lines("forecast").alias("forecasted_sales"),
        ).alias("running_results"),
    )
