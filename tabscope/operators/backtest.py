"""Forecasts from growing histories, and bands made of their real errors.

Every month that has a long enough history is an origin: the trend and seasonal model fitted
to the months up to it forecasts the months after it. No history is copied: a line fitted to the
months so far is a running regression, and a month's effect is the mean of its earlier values less
the line there, so that

    yhat = mean of the season so far + slope so far * (month - mean month of the season so far)

which windows over a series' calendar give for all origins at once.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window, functions as F

from tabscope.functions.columns import ref
from tabscope.operators.series import _month_number, fit_trend_seasonal, forecast_trend_seasonal

FIRST_HISTORY = 24  # months that an origin has behind it, itself included
LEAST_ERRORS = 8  # errors that a band is made of


def rolling_forecasts(monthly: DataFrame, months: int, series: list[str] | None = None, first: int = FIRST_HISTORY) -> DataFrame:
    """``series..., origin, horizon, ds, y, yhat, error``: forecasts 1 to ``months`` ahead from every origin.

    ``monthly`` has a row for every month of a series, as ``series.monthly_totals`` gives. A month of the
    year without a value before the origin has no effect. A series no longer than ``first`` has no rows.
    """
    keys = [ref(s) for s in series or []]
    by_date = Window.partitionBy(*keys).orderBy("ds")
    so_far = by_date.rowsBetween(Window.unboundedPreceding, 0)
    of_season = Window.partitionBy(*keys, "_season").orderBy("ds")
    lined = monthly.select(*keys, "ds", "y", _month_number(F.col("ds")).alias("_t"), F.month("ds").alias("_season")).withColumns(
        {
            "_slope": F.regr_slope("y", "_t").over(so_far),
            "_intercept": F.regr_intercept("y", "_t").over(so_far),
            "_history": F.row_number().over(by_date),
        }
    )
    laps = range(1, -(-months // 12) + 1)  # of the same month, the last one before a forecast may lie after its origin
    earlier = {lap: of_season.rowsBetween(Window.unboundedPreceding, -lap) for lap in laps}
    lined = lined.withColumns({f"_{c}_{lap}": F.avg(c).over(w) for lap, w in earlier.items() for c in ("y", "_t")})

    def ahead(h: int):
        lap = -(-h // 12)
        at_origin = {"origin": "ds", "slope": "_slope", "intercept": "_intercept", "history": "_history"}
        parts = [F.lag(c, h).over(by_date).alias(n) for n, c in at_origin.items()]
        return F.struct(F.lit(h).alias("horizon"), *parts, F.col(f"_y_{lap}").alias("level"), F.col(f"__t_{lap}").alias("middle"))

    told = lined.withColumn("_ahead", F.array(*[ahead(h) for h in range(1, months + 1)]))
    each = told.select(*keys, "ds", "y", "_t", F.inline("_ahead"))
    level = F.col("level") + F.col("slope") * (F.col("_t") - F.col("middle"))
    yhat = F.coalesce(level, F.col("intercept") + F.col("slope") * F.col("_t"))
    return each.filter(F.col("history") >= max(first, 2)).withColumn("yhat", yhat).select(*keys, "origin", "horizon", "ds", "y", "yhat", (F.col("y") - F.col("yhat")).alias("error"))


def _shares(share: float) -> list[float]:
    return [round((1.0 - share) / 2, 9), round((1.0 + share) / 2, 9)]


def error_bands(rolled: DataFrame, series: list[str] | None = None, share: float = 0.8, least: int = LEAST_ERRORS) -> DataFrame:
    """``series..., horizon, errors, low, high``: the errors between which the middle ``share`` of all lie; NULL for too few."""
    keys = [ref(s) for s in series or []]
    between = F.percentile("error", F.array(*[F.lit(s) for s in _shares(share)]))
    found = rolled.groupBy(*keys, "horizon").agg(F.count("error").alias("errors"), between.alias("_between"))
    enough = F.when(F.col("errors") >= least, F.col("_between"))
    return found.select(*keys, "horizon", "errors", F.get(enough, F.lit(0)).alias("low"), F.get(enough, F.lit(1)).alias("high"))


def forecast_with_error_bands(
    monthly: DataFrame, months: int, series: list[str] | None = None, share: float = 0.8, first: int = FIRST_HISTORY, least: int = LEAST_ERRORS
) -> DataFrame:
    """``series..., ds, horizon, yhat, yhat_lower, yhat_upper, errors``: bands from the errors of the same horizon.

    Where there are fewer than ``least`` errors, the bands are those of the fitted residuals.
    """
    names = series or []
    ahead = forecast_trend_seasonal(fit_trend_seasonal(monthly, series), months, series)
    place = Window.partitionBy(*[ref(s) for s in names]).orderBy("ds")
    ahead = ahead.withColumn("horizon", F.row_number().over(place))
    bands = error_bands(rolling_forecasts(monthly, months, series, first), series, share, least)
    same = reduce(lambda a, b: a & b, [F.col(f"a.{_quoted(c)}").eqNullSafe(F.col(f"b.{_quoted(c)}")) for c in [*names, "horizon"]])
    joined = ahead.alias("a").join(bands.alias("b"), same, "left")
    return joined.select(
        *[F.col(f"a.{_quoted(s)}").alias(s) for s in names],
        "ds",
        "a.horizon",
        "yhat",
        F.coalesce(F.col("yhat") + F.col("low"), F.col("yhat_lower")).alias("yhat_lower"),
        F.coalesce(F.col("yhat") + F.col("high"), F.col("yhat_upper")).alias("yhat_upper"),
        F.coalesce("errors", F.lit(0)).cast("bigint").alias("errors"),
    )


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def band_coverage(rolled: DataFrame, series: list[str] | None = None, share: float = 0.8, least: int = LEAST_ERRORS) -> DataFrame:
    """``series..., horizon, judged, covered``: how many forecasts had a band, and how many of them lay within it.

    A forecast's band is made of the errors that were known at its origin, never of later ones.
    """
    names = series or []
    known = Window.partitionBy(*[ref(s) for s in names], "horizon").orderBy("ds").rowsBetween(Window.unboundedPreceding, 0)
    between = F.percentile("error", F.array(*[F.lit(s) for s in _shares(share)])).over(known)
    bands = rolled.select(*[ref(s) for s in names], "horizon", "ds", between.alias("_between"), F.count("error").over(known).alias("_errors"))
    same = [F.col(f"a.{_quoted(c)}").eqNullSafe(F.col(f"b.{_quoted(c)}")) for c in [*names, "horizon"]]
    joined = rolled.alias("a").join(
        bands.filter(F.col("_errors") >= least).alias("b"), reduce(lambda a, b: a & b, [*same, F.col("a.origin") == F.col("b.ds")])
    )
    inside = F.col("error").between(F.get("_between", F.lit(0)), F.get("_between", F.lit(1)))
    return joined.groupBy(*[F.col(f"a.{_quoted(s)}").alias(s) for s in names], F.col("a.horizon").alias("horizon")).agg(
        F.count("*").alias("judged"), F.count_if(inside).alias("covered")
    )
