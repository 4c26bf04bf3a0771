import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tabscope.operators import backtest as B, series as S
from tabscope.plans.sales_report import sales_report, sales_row


@pytest.fixture(scope="module")
def sales(spark):
    chance = np.random.default_rng(9)
    days = pd.date_range("2019-01-01", "2022-06-30", freq="D")
    frame = pd.DataFrame({"datesold": chance.choice(days, 4000), "price": chance.integers(1, 100, 4000)})
    frame = frame[~((frame.datesold >= "2020-03-01") & (frame.datesold < "2020-06-01"))]
    frame["shop"] = np.where(chance.uniform(size=len(frame)) < 0.8, "big", "small")
    return frame


@pytest.fixture(scope="module")
def table(spark, sales):
    return spark.createDataFrame(sales).withColumn("datesold", F.to_date("datesold"))


def by_key(df, series=True):
    return {((r.shop, r.ds) if series else r.ds): r for r in df.collect()}


def test_monthly_totals_match_resampling(table, sales):
    expected = sales.set_index("datesold")["price"].resample("ME").sum()
    got = by_key(S.monthly_totals(table, "datesold", "price"), series=False)
    assert {k.date(): float(v) for k, v in expected.items()} == {k: r.y for k, r in got.items()}
    assert got[dt.date(2020, 4, 30)].y == 0.0
    split = by_key(S.monthly_totals(table, "datesold", "price", ["shop"]))
    for shop, part in sales.groupby("shop"):
        expected = part.set_index("datesold")["price"].resample("ME").sum()
        assert {(shop, k.date()): float(v) for k, v in expected.items()} == {k: r.y for k, r in split.items() if k[0] == shop}


def test_missing_dates_are_left_out(spark):
    df = spark.createDataFrame([(None, 5), (dt.date(2020, 1, 31), 2), (dt.date(2020, 1, 1), None)], "d date, v int")
    assert [(r.ds, r.y) for r in S.monthly_totals(df, "d", "v").collect()] == [(dt.date(2020, 1, 31), 2.0)]


def brute_trend(y, start, months):
    t = np.arange(start, start + len(y), dtype=float)
    slope, intercept = np.polyfit(t, y, 1)
    rest = y - (intercept + slope * t)
    effect = {m: rest[t % 12 == m].mean() for m in range(12) if (t % 12 == m).any()}
    sigma = np.std(rest - np.array([effect[x % 12] for x in t]), ddof=1)
    ahead = np.arange(start + len(y), start + len(y) + months)
    return [(intercept + slope * x + effect.get(x % 12, 0.0), sigma) for x in ahead]


def test_trend_and_season_match_brute_force(table, sales):
    monthly = S.monthly_totals(table, "datesold", "price", ["shop"])
    got = S.forecast_trend_seasonal(S.fit_trend_seasonal(monthly, ["shop"]), 5, ["shop"]).orderBy("shop", "ds").collect()
    for shop, part in sales.groupby("shop"):
        y = part.set_index("datesold")["price"].resample("ME").sum()
        expected = brute_trend(y.to_numpy(float), (y.index[0].year - 1970) * 12 + y.index[0].month - 1, 5)
        mine = [r for r in got if r.shop == shop]
        assert [r.yhat for r in mine] == pytest.approx([v for v, _ in expected], rel=1e-6)
        assert [r.yhat_upper - r.yhat for r in mine] == pytest.approx([S.BAND * s for _, s in expected], rel=1e-6)
        assert mine[0].ds == dt.date(2022, 7, 31)


@pytest.mark.parametrize("beta", [None, 0.2])
def test_smoothing_matches_brute_force(table, sales, beta):
    y = sales.set_index("datesold")["price"].resample("ME").sum().to_numpy(float)
    level, slope = y[0], 0.0 if beta is None else y[1] - y[0]
    for v in y[1:]:
        before = level
        level = 0.4 * v + 0.6 * (level + slope)
        slope = (beta or 0.0) * (level - before) + (1 - (beta or 0.0)) * slope
    monthly = S.monthly_totals(table, "datesold", "price")
    got = S.exponential_smoothing(monthly, 3, 0.4, beta).orderBy("ds").collect()
    assert [r.ds for r in got] == [dt.date(2022, 8, 31), dt.date(2022, 9, 30), dt.date(2022, 10, 31)]
    assert [r.yhat for r in got] == pytest.approx([level + k * slope for k in (2, 3, 4)])


def test_one_month_of_history(spark):
    df = spark.createDataFrame([(dt.date(2020, 1, 3), 5.0)], "d date, v double")
    monthly = S.monthly_totals(df, "d", "v")
    assert [r.yhat for r in S.exponential_smoothing(monthly, 1, 0.5, 0.5).collect()] == [5.0]
    assert S.future_calendar(monthly, 2).count() == 2
    assert S.forecast_trend_seasonal(S.fit_trend_seasonal(monthly), 2).count() == 2


def test_tables_for_display(table):
    monthly = S.monthly_totals(table, "datesold", "price")
    ahead = S.exponential_smoothing(monthly, 4, 0.3)
    both = S.actual_and_forecast(monthly, ahead)
    assert both.count() == monthly.count() + 4
    assert both.filter("actual IS NULL").count() == 4 and both.filter("actual IS NOT NULL AND forecast = 0").count() == monthly.count()
    assert S.last_rows(ahead, 2).count() == 2


def test_sales_report(table):
    report = sales_report(table, 3, category="shop")
    row = sales_row(report, "trend_seasonal").first()
    assert row.eda.shape.n_columns == 3 and row.eda.completeness == 100.0
    assert len(row.running_results.forecasted_sales) == 3
    assert sales_report(table, 3, model="smoothing", category="shop")["forecast"].count() == 3
    with pytest.raises(ValueError):
        sales_report(table, 3, model="other", category="shop")


def test_nan_adds_nothing_to_a_month(spark):
    df = spark.createDataFrame([("2020-01-05", 2.0), ("2020-01-06", float("nan"))], "d string, v double")
    assert [r.y for r in S.monthly_totals(df.withColumn("d", F.to_date("d")), "d", "v").collect()] == [2.0]


def test_rolling_forecasts_equal_refits(table, sales):
    """Every origin's history fitted by itself; a season may lie after the origin of a long forecast."""
    monthly = S.monthly_totals(table, "datesold", "price", ["shop"])
    rolled = B.rolling_forecasts(monthly, 15, ["shop"], first=7)
    got = {(r.shop, r.origin, r.horizon): r for r in rolled.collect()}
    values = monthly.orderBy("shop", "ds").toPandas()
    expected = {}
    for shop, part in values.groupby("shop"):
        y, dates = part.y.to_numpy(), list(part.ds)
        start = (dates[0].year - 1970) * 12 + dates[0].month - 1
        for n in range(7, len(y)):
            for h, (value, _) in enumerate(brute_trend(y[:n], start, min(15, len(y) - n)), 1):
                expected[shop, dates[n - 1], h] = (dates[n + h - 1], y[n + h - 1], value)
    assert set(got) == set(expected)
    for key, (ds, y, value) in expected.items():
        assert (got[key].ds, got[key].y) == (ds, y) and got[key].yhat == pytest.approx(value, abs=1e-6)


def test_bands_of_real_errors(spark, table):
    monthly = S.monthly_totals(table, "datesold", "price", ["shop"])
    rolled = B.rolling_forecasts(monthly, 3, ["shop"], first=20).toPandas()
    ahead = B.forecast_with_error_bands(monthly, 3, ["shop"], first=20, least=5).collect()
    assert len(ahead) == 6
    for r in ahead:
        own = rolled[(rolled["shop"] == r.shop) & (rolled.horizon == r.horizon)].error
        assert r.errors == len(own)
        assert (r.yhat_lower - r.yhat, r.yhat_upper - r.yhat) == pytest.approx(tuple(own.quantile([0.1, 0.9])))
    covered = {(r.shop, r.horizon): (r.judged, r.covered) for r in B.band_coverage(spark.createDataFrame(rolled), ["shop"], least=5).collect()}
    for (shop, horizon), own in rolled.groupby(["shop", "horizon"]):
        inside = []
        for r in own.itertuples():
            known = own[own.ds <= r.origin].error
            if len(known) >= 5:
                inside.append(known.quantile(0.1) <= r.error <= known.quantile(0.9))
        assert covered[shop, horizon] == (len(inside), sum(inside))


def test_short_series_keep_the_fitted_bands(spark):
    rows = [("a", dt.date(2020, 1, 31), 1.0), ("a", dt.date(2020, 2, 29), 4.0), ("a", dt.date(2020, 3, 31), 2.0), (None, dt.date(2020, 1, 31), 3.0)]
    monthly = spark.createDataFrame(rows, "s string, ds date, y double")
    assert B.rolling_forecasts(monthly, 2, ["s"]).count() == 0
    fitted = S.forecast_trend_seasonal(S.fit_trend_seasonal(monthly, ["s"]), 2, ["s"]).collect()
    banded = B.forecast_with_error_bands(monthly, 2, ["s"]).collect()
    key = lambda r: (r.s or "", r.ds)
    assert [(r.s, r.ds, r.yhat, r.yhat_lower, r.errors) for r in sorted(banded, key=key)] == [(r.s, r.ds, r.yhat, r.yhat_lower, 0) for r in sorted(fitted, key=key)]
    assert B.forecast_with_error_bands(monthly.limit(0), 2, ["s"]).count() == 0
    assert B.rolling_forecasts(monthly.filter("s = 'a'").drop("s"), 1, first=2).count() == 1
