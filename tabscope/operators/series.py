"""Monthly series and forecasts, for any number of series side by side.

After the first aggregation a series has one row per calendar month, so windows
and arrays per series are bounded by its length in months.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tabscope.functions.columns import present, ref

# Fixed value: standard normal quantile of an 80 % band.
BAND = 1.2815515655446004


def monthly_totals(df: DataFrame, date: str, value: str, series: list[str] | None = None) -> DataFrame:
    """``series..., ds, y``: sums per calendar month at the month's last day, 0 for empty months.

    Missing values, NaN among them, add nothing. Rows are summed before the shuffle. Gaps are filled from each month to the
    following one, which needs no calendar join.
    """
    keys = [ref(s) for s in series or []]
    month = F.trunc(ref(date), "month")
    sums = (
        df.filter(ref(date).isNotNull())
        .groupBy(*keys, month.alias("_month"))
        .agg(F.coalesce(F.sum(present(df.schema[value])).cast("double"), F.lit(0.0)).alias("_sum"))
    )
    following = F.lead("_month").over(Window.partitionBy(*keys).orderBy("_month"))
    span = F.sequence("_month", F.coalesce(F.add_months("_next", -1), F.col("_month")), F.expr("interval 1 month"))
    return (
        sums.withColumn("_next", following)
        .withColumn("_at", F.explode(span))
        .select(
            *keys,
            F.last_day("_at").alias("ds"),
            F.when(F.col("_at") == F.col("_month"), F.col("_sum")).otherwise(F.lit(0.0)).alias("y"),
        )
    )


def _months_after(last: Column, months: int) -> Column:
    """Array of the next ``months`` month ends."""
    steps = F.sequence(F.lit(1), F.lit(months))
    return F.transform(steps, lambda k: F.last_day(F.add_months(last, k)))


def future_calendar(monthly: DataFrame, months: int, series: list[str] | None = None) -> DataFrame:
    """The ``months`` month ends after each series' history, history left out."""
    keys = [ref(s) for s in series or []]
    last = monthly.groupBy(*keys).agg(F.max("ds").alias("_last"))
    return last.select(*keys, F.explode(_months_after(F.col("_last"), months)).alias("ds"))


def _month_number(ds: Column) -> Column:
    return ((F.year(ds) - 1970) * 12 + F.month(ds) - 1).cast("double")


def fit_trend_seasonal(monthly: DataFrame, series: list[str] | None = None) -> DataFrame:
    """One fitted row per series: linear trend, month-of-year effects, residual deviation."""
    names = series or []
    keys = [ref(s) for s in names]
    whole = Window.partitionBy(*keys)
    t = _month_number(F.col("ds"))
    lined = monthly.withColumn("_t", t).select(
        *keys,
        "ds",
        F.month("ds").alias("_season"),
        F.regr_slope("y", "_t").over(whole).alias("slope"),
        F.regr_intercept("y", "_t").over(whole).alias("intercept"),
        "_t",
        "y",
    )
    rest = F.col("y") - (F.col("intercept") + F.col("slope") * F.col("_t"))
    seasons = lined.withColumn("_rest", rest).groupBy(*keys, "_season").agg(
        F.avg("_rest").alias("_effect"),
        F.count("*").alias("_n"),
        (F.var_pop("_rest") * F.count("*")).alias("_squares"),
        F.max("slope").alias("slope"),
        F.max("intercept").alias("intercept"),
        F.max("ds").alias("_last"),
    )
    return seasons.groupBy(*keys).agg(
        F.max("slope").alias("slope"),
        F.max("intercept").alias("intercept"),
        F.map_from_entries(F.collect_list(F.struct("_season", "_effect"))).alias("effects"),
        F.sqrt(F.try_divide(F.sum("_squares"), F.sum("_n") - 1)).alias("sigma"),
        F.max("_last").alias("last_ds"),
        F.sum("_n").alias("months"),
    )


def forecast_trend_seasonal(fitted: DataFrame, months: int, series: list[str] | None = None) -> DataFrame:
    """``ds, trend, yhat, yhat_lower, yhat_upper`` for the months after the history."""
    keys = [ref(s) for s in series or []]
    trend = F.col("intercept") + F.col("slope") * _month_number(F.col("ds"))
    effect = F.coalesce(F.element_at("effects", F.month("ds")), F.lit(0.0))
    return (
        fitted.withColumn("ds", F.explode(_months_after(F.col("last_ds"), months)))
        .withColumn("trend", trend)
        .withColumn("yhat", F.col("trend") + effect)
        .select(
            *keys,
            "ds",
            "trend",
            "yhat",
            (F.col("yhat") - BAND * F.col("sigma")).alias("yhat_lower"),
            (F.col("yhat") + BAND * F.col("sigma")).alias("yhat_upper"),
        )
    )


def last_rows(forecast: DataFrame, n: int, series: list[str] | None = None) -> DataFrame:
    """The last ``n`` rows of each series by date."""
    latest = Window.partitionBy(*[ref(s) for s in series or []]).orderBy(F.desc("ds"))
    return forecast.withColumn("_at", F.row_number().over(latest)).filter(F.col("_at") <= n).drop("_at")


def exponential_smoothing(
    monthly: DataFrame,
    months: int,
    alpha: float,
    beta: float | None = None,
    series: list[str] | None = None,
) -> DataFrame:
    """Smoothed level, with a smoothed trend when ``beta`` is given: ``ds, yhat``.

    The horizon is one step longer than asked and its first step is dropped, so
    the dates start two months after the history.
    """
    keys = [ref(s) for s in series or []]
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("ds", "y"))), lambda p: p["y"])
    fitted = monthly.groupBy(*keys).agg(F.max("ds").alias("_last"), ordered.alias("_ys"))
    first = F.element_at("_ys", 1)
    slope = F.lit(0.0) if beta is None else F.coalesce(F.get("_ys", F.lit(1)) - first, F.lit(0.0))
    b = 0.0 if beta is None else beta

    def step(state: Column, y: Column) -> Column:
        level = alpha * y + (1.0 - alpha) * (state["level"] + state["slope"])
        return F.struct(
            level.alias("level"),
            (b * (level - state["level"]) + (1.0 - b) * state["slope"]).alias("slope"),
        )

    rest = F.slice("_ys", F.lit(2), F.greatest(F.size("_ys") - 1, F.lit(0)))
    state = F.aggregate(rest, F.struct(first.alias("level"), slope.alias("slope")), step)
    steps = F.explode(F.sequence(F.lit(2), F.lit(months + 1)))
    return (
        fitted.select(*keys, "_last", state.alias("_state"))
        .withColumn("_step", steps)
        .select(
            *keys,
            F.last_day(F.add_months("_last", F.col("_step"))).alias("ds"),
            (F.col("_state.level") + F.col("_step") * F.col("_state.slope")).alias("yhat"),
        )
    )


def actual_and_forecast(monthly: DataFrame, forecast: DataFrame, series: list[str] | None = None) -> DataFrame:
    """History rows with forecast 0, then forecast rows without an actual value."""
    keys = [ref(s) for s in series or []]
    history = monthly.select(*keys, "ds", F.col("y").alias("actual"), F.lit(0.0).alias("forecast"))
    ahead = forecast.select(*keys, "ds", F.lit(None).cast("double").alias("actual"), F.col("yhat").alias("forecast"))
    return history.unionByName(ahead)
