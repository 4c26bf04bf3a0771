"""Queries over the monthly series operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabscope.catalog.inputs import derived, sql_of
from tabscope.operators import backtest as B, series as S
from tabscope.plans.sales_report import sales_report, sales_row

SERIES = ["series"]
MONTHS, LONG = 6, 14
ALPHA, BETA = 0.3, 0.1


def _monthly(spark, sf_dir):
    return S.monthly_totals(derived(spark, sf_dir, "gappy_sales"), "datesold", "price", SERIES)


def _rounded(df, *columns):
    return df.withColumns({c: F.round(c, 1) for c in columns})


def monthly_totals(spark, sf_dir):
    return _monthly(spark, sf_dir).withColumn("y", F.round("y", 2))


def monthly_totals_single_series(spark, sf_dir):
    monthly = S.monthly_totals(derived(spark, sf_dir, "gappy_sales"), "datesold", "price")
    return monthly.withColumn("y", F.round("y", 2))


def future_calendar(spark, sf_dir):
    return S.future_calendar(_monthly(spark, sf_dir), MONTHS, SERIES)


def _forecast(spark, sf_dir):
    return S.forecast_trend_seasonal(S.fit_trend_seasonal(_monthly(spark, sf_dir), SERIES), MONTHS, SERIES)


def trend_seasonal_forecast(spark, sf_dir):
    return _rounded(_forecast(spark, sf_dir), "trend", "yhat", "yhat_lower", "yhat_upper")


def last_forecast_rows(spark, sf_dir):
    return _rounded(S.last_rows(_forecast(spark, sf_dir), 2, SERIES).select("series", "ds", "yhat"), "yhat")


def exponential_smoothing(spark, sf_dir):
    return _rounded(S.exponential_smoothing(_monthly(spark, sf_dir), MONTHS, ALPHA, series=SERIES), "yhat")


def exponential_smoothing_with_trend(spark, sf_dir):
    return _rounded(S.exponential_smoothing(_monthly(spark, sf_dir), MONTHS, ALPHA, BETA, SERIES), "yhat")


def actual_and_forecast(spark, sf_dir):
    monthly = _monthly(spark, sf_dir)
    ahead = S.exponential_smoothing(monthly, MONTHS, ALPHA, series=SERIES)
    both = S.actual_and_forecast(monthly, ahead, SERIES)
    return _rounded(both, "forecast").withColumn("actual", F.round("actual", 2))


def rolling_forecasts(spark, sf_dir):
    """Forecasts of one to fourteen months from every month with two years behind it."""
    return _rounded(B.rolling_forecasts(_monthly(spark, sf_dir), LONG, SERIES), "y", "yhat", "error")


def forecast_with_error_bands(spark, sf_dir):
    ahead = B.forecast_with_error_bands(_monthly(spark, sf_dir), MONTHS, SERIES)
    return _rounded(ahead, "yhat", "yhat_lower", "yhat_upper")


def band_coverage(spark, sf_dir):
    """Of the 80 % bands, by horizon: forecasts judged and within."""
    return B.band_coverage(B.rolling_forecasts(_monthly(spark, sf_dir), MONTHS, SERIES), SERIES)


def sales_report_row(spark, sf_dir):
    report = sales_report(derived(spark, sf_dir, "gappy_sales"), MONTHS, category="series")
    return sales_row(report, "trend_seasonal").select(
        "eda.shape.n_rows",
        "eda.shape.n_columns",
        F.round("eda.completeness", 9).alias("completeness"),
        F.round("eda.uniqueness", 9).alias("uniqueness"),
        F.size("running_results.forecasted_sales").alias("months"),
        F.col("running_results.forecasted_sales")[0]["ds"].alias("first_month"),
    )


QUERIES = {
    f.__name__: f
    for f in [
        monthly_totals, monthly_totals_single_series, future_calendar, trend_seasonal_forecast, last_forecast_rows,
        exponential_smoothing, exponential_smoothing_with_trend, actual_and_forecast, sales_report_row,
        rolling_forecasts, forecast_with_error_bands, band_coverage,
    ]
}

_SALES = f"sales AS ({sql_of('gappy_sales')})"
_MONTHLY = f"""{_SALES},
ranges AS (SELECT series, date_trunc('month', MIN(datesold)) AS a, date_trunc('month', MAX(datesold)) AS b FROM sales GROUP BY series),
spine AS (SELECT series, CAST(UNNEST(generate_series(CAST(a AS TIMESTAMP), CAST(b AS TIMESTAMP), INTERVAL 1 MONTH)) AS DATE) AS m FROM ranges),
sums AS (SELECT series, CAST(date_trunc('month', datesold) AS DATE) AS m, SUM(price) AS y FROM sales GROUP BY 1, 2),
monthly AS (SELECT series, last_day(m) AS ds, COALESCE(y, 0) AS y FROM spine LEFT JOIN sums USING (series, m))"""
_LAST = "SELECT series, MAX(ds) AS last_ds FROM monthly GROUP BY series"


def _ahead(source: str, first: int, last: int) -> str:
    return f"""SELECT f.*, last_day(CAST(date_trunc('month', last_ds) AS DATE) + to_months(CAST(k AS INTEGER))) AS ds, k
FROM ({source}) AS f, (SELECT UNNEST(range({first}, {last + 1})) AS k)"""


_T = "CAST((YEAR(ds) - 1970) * 12 + MONTH(ds) - 1 AS DOUBLE)"
_FIT = f"""{_MONTHLY},
lines AS (SELECT series, regr_slope(y, {_T}) AS slope, regr_intercept(y, {_T}) AS intercept, MAX(ds) AS last_ds FROM monthly GROUP BY series),
rest AS (SELECT series, MONTH(ds) AS season, y - (intercept + slope * {_T}) AS e FROM monthly JOIN lines USING (series)),
effects AS (SELECT series, season, AVG(e) AS effect FROM rest GROUP BY series, season),
sigmas AS (SELECT series, STDDEV_SAMP(e - effect) AS sigma FROM rest JOIN effects USING (series, season) GROUP BY series),
ahead AS ({_ahead('SELECT * FROM lines JOIN sigmas USING (series)', 1, MONTHS)}),
forecast AS (
  SELECT a.series, ds, intercept + slope * {_T} AS trend, intercept + slope * {_T} + COALESCE(effect, 0) AS yhat, sigma
  FROM ahead AS a LEFT JOIN effects AS s ON a.series = s.series AND MONTH(ds) = s.season)"""
_NUMBERED = f"""{_MONTHLY},
numbered AS (SELECT series, ds, y, ROW_NUMBER() OVER (PARTITION BY series ORDER BY ds) AS i, COUNT(*) OVER (PARTITION BY series) AS n FROM monthly),
smoothed AS (
  SELECT series, MAX(ds) AS last_ds,
    SUM(CASE WHEN i = 1 THEN y * POWER(1 - {ALPHA}, n - 1) ELSE y * {ALPHA} * POWER(1 - {ALPHA}, n - i) END) AS level
  FROM numbered GROUP BY series),
ahead AS ({_ahead('SELECT * FROM smoothed', 2, MONTHS + 1)})"""



def _rolled(months: int) -> str:
    """Every origin's history copied and fitted anew."""
    return f"""o AS (SELECT series, ds AS origin, ROW_NUMBER() OVER (PARTITION BY series ORDER BY ds) AS history FROM monthly),
past AS (SELECT m.series, o.origin, m.ds, m.y, {_T} AS t FROM monthly AS m JOIN o ON o.series = m.series AND m.ds <= o.origin AND history >= {B.FIRST_HISTORY}),
line AS (SELECT series, origin, regr_slope(y, t) AS slope, regr_intercept(y, t) AS intercept FROM past GROUP BY ALL),
season AS (SELECT p.series, p.origin, MONTH(ds) AS m, AVG(y - (intercept + slope * t)) AS effect FROM past AS p JOIN line AS l ON p.series = l.series AND p.origin = l.origin GROUP BY ALL),
told AS (
  SELECT m.series, l.origin, CAST(datediff('month', l.origin, m.ds) AS INTEGER) AS horizon, m.ds, y, intercept + slope * {_T} + COALESCE(effect, 0) AS yhat
  FROM monthly AS m JOIN line AS l ON l.series = m.series AND m.ds > l.origin AND datediff('month', l.origin, m.ds) <= {months}
  LEFT JOIN season AS s ON s.series = m.series AND s.origin = l.origin AND s.m = MONTH(m.ds)),
rolled AS (SELECT *, y - yhat AS error FROM told)"""


ORACLES = {
    "rolling_forecasts": f"""WITH {_MONTHLY}, {_rolled(LONG)}
SELECT series, origin, horizon, ds, ROUND(y, 1) AS y, ROUND(yhat, 1) AS yhat, ROUND(error, 1) AS error FROM rolled""",
    "forecast_with_error_bands": f"""WITH {_FIT}, {_rolled(MONTHS)},
bands AS (SELECT series, horizon, COUNT(*) AS errors, quantile_cont(error, 0.1) AS low, quantile_cont(error, 0.9) AS high FROM rolled GROUP BY ALL),
f AS (SELECT *, CAST(ROW_NUMBER() OVER (PARTITION BY series ORDER BY ds) AS INTEGER) AS horizon FROM forecast)
SELECT f.series, ds, f.horizon, ROUND(yhat, 1) AS yhat,
  ROUND(CASE WHEN errors >= {B.LEAST_ERRORS} THEN yhat + low ELSE yhat - {S.BAND} * sigma END, 1) AS yhat_lower,
  ROUND(CASE WHEN errors >= {B.LEAST_ERRORS} THEN yhat + high ELSE yhat + {S.BAND} * sigma END, 1) AS yhat_upper, COALESCE(errors, 0) AS errors
FROM f LEFT JOIN bands ON bands.series = f.series AND bands.horizon = f.horizon""",
    "band_coverage": f"""WITH {_MONTHLY}, {_rolled(MONTHS)},
judged AS (
  SELECT a.series, a.horizon, a.origin, ANY_VALUE(a.error) AS error, COUNT(*) AS n, quantile_cont(b.error, 0.1) AS low, quantile_cont(b.error, 0.9) AS high
  FROM rolled AS a JOIN rolled AS b ON a.series = b.series AND a.horizon = b.horizon AND b.ds <= a.origin GROUP BY ALL)
SELECT series, horizon, COUNT(*) AS judged, COUNT(*) FILTER (WHERE error BETWEEN low AND high) AS covered
FROM judged WHERE n >= {B.LEAST_ERRORS} GROUP BY series, horizon""",
    "monthly_totals": f"WITH {_MONTHLY} SELECT series, ds, ROUND(y, 2) AS y FROM monthly",
    "monthly_totals_single_series": f"WITH {_MONTHLY} SELECT ds, ROUND(SUM(y), 2) AS y FROM monthly GROUP BY ds",
    "future_calendar": f"WITH {_MONTHLY} SELECT series, ds FROM ({_ahead(_LAST, 1, MONTHS)})",
    "trend_seasonal_forecast": f"""WITH {_FIT}
SELECT series, ds, ROUND(trend, 1) AS trend, ROUND(yhat, 1) AS yhat,
  ROUND(yhat - {S.BAND} * sigma, 1) AS yhat_lower, ROUND(yhat + {S.BAND} * sigma, 1) AS yhat_upper FROM forecast""",
    "last_forecast_rows": f"""WITH {_FIT}
SELECT series, ds, ROUND(yhat, 1) AS yhat FROM forecast QUALIFY ROW_NUMBER() OVER (PARTITION BY series ORDER BY ds DESC) <= 2""",
    "exponential_smoothing": f"WITH {_NUMBERED} SELECT series, ds, ROUND(level, 1) AS yhat FROM ahead",
    "exponential_smoothing_with_trend": f"""WITH RECURSIVE {_MONTHLY},
numbered AS (SELECT series, ds, y, ROW_NUMBER() OVER (PARTITION BY series ORDER BY ds) AS i FROM monthly),
start AS (SELECT a.series, a.y AS level, b.y - a.y AS slope FROM numbered AS a JOIN numbered AS b ON a.series = b.series AND a.i = 1 AND b.i = 2),
walk(series, i, level, slope) AS (
  SELECT series, CAST(1 AS BIGINT), level, slope FROM start
  UNION ALL
  SELECT w.series, n.i, {ALPHA} * n.y + {1 - ALPHA} * (w.level + w.slope),
    {BETA} * ({ALPHA} * n.y + {1 - ALPHA} * (w.level + w.slope) - w.level) + {1 - BETA} * w.slope
  FROM walk AS w JOIN numbered AS n ON w.series = n.series AND n.i = w.i + 1),
final AS (SELECT w.series, w.level, w.slope, last_ds FROM walk AS w JOIN ({_LAST}) AS l ON w.series = l.series
  WHERE w.i = (SELECT MAX(i) FROM numbered AS n WHERE n.series = w.series))
SELECT series, ds, ROUND(level + k * slope, 1) AS yhat FROM ({_ahead('SELECT * FROM final', 2, MONTHS + 1)})""",
    "actual_and_forecast": f"""WITH {_NUMBERED}
SELECT series, ds, ROUND(y, 2) AS actual, CAST(0 AS DOUBLE) AS forecast FROM monthly
UNION ALL SELECT series, ds, NULL, ROUND(level, 1) FROM ahead""",
    "sales_report_row": f"""WITH {_SALES}
SELECT COUNT(*) AS n_rows, 3 AS n_columns, CAST(100 AS DOUBLE) AS completeness,
  ROUND((SELECT COUNT(*) FROM (SELECT DISTINCT * FROM sales)) / COUNT(*) * 100, 9) AS uniqueness, {MONTHS} AS months,
  strftime(last_day(CAST(date_trunc('month', MAX(datesold)) AS DATE) + INTERVAL 1 MONTH), '%Y-%m-%d') AS first_month
FROM sales""",
}
