import math

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from tabscope.operators import cleaning as C, profile as P
from tabscope.plans.quality_report import METRICS, quality_report, report_row

NAN = float("nan")
ROWS = [
    (1, 1.0, "a", 5, True),
    (2, None, "b", 5, False),
    (3, NAN, "a", 5, None),
    (4, 4.0, None, 5, True),
    (4, 4.0, None, 5, True),
    (5, -2.5, "c", 5, True),
]
SCHEMA = "k int, v double, t string, c int, f boolean"


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


def lookup(df, *keys):
    return {tuple(r[k] for k in keys) if len(keys) > 1 else r[keys[0]]: r for r in df.collect()}


def test_scorecard(table):
    row = P.scorecard(table).first()
    assert (row.n_rows, row.n_columns, row.complete_rows, row.distinct_rows) == (6, 5, 2, 5)
    assert (row.complete, row.unique) == (33.33, 83.33)


def test_single_metrics_agree_with_scorecard(table):
    row = P.scorecard(table).first()
    assert P.completeness(table).first().complete == row.complete
    assert P.uniqueness(table).first().unique == row.unique
    assert P.uniqueness(table, by="digest").first().unique == row.unique
    with pytest.raises(ValueError):
        P.uniqueness(table, by="guess")


def test_empty_table(spark):
    empty = spark.createDataFrame([], SCHEMA)
    row = P.scorecard(empty).first()
    assert (row.n_rows, row.distinct_rows, row.complete, row.unique) == (0, 0, None, None)
    assert P.numeric_summary(empty).count() == 3
    assert P.histogram(empty).agg(F.sum("count")).first()[0] == 0
    assert all(r["corr"] is None for r in P.correlation(empty).collect())
    assert P.top_values(empty).count() == 0


def test_numeric_summary_matches_pandas(table):
    got = lookup(P.numeric_summary(table), "column")
    expected = pd.Series([r[1] for r in ROWS], dtype=float).describe()
    v = got["v"]
    assert v["count"] == 4
    assert [v["mean"], v["std"], v["min"], v["p25"], v["p50"], v["p75"], v["max"]] == pytest.approx(list(expected[1:]))
    assert got["c"]["std"] == 0.0
    assert set(got) == {"k", "v", "c"}


def test_text_only_table_is_summarised_by_counts(spark):
    texts = spark.createDataFrame([("a", "x"), ("a", None), ("b", "y")], "p string, q string")
    got = lookup(quality_report(texts, ["describe"])["describe"], "column")
    assert got["p"]["count"] == 3 and got["p"]["unique"] == 2 and got["p"]["top"] == "a" and got["p"]["freq"] == 2
    assert got["q"]["count"] == 2 and got["q"]["top"] == "x"


def test_full_summary_equals_builtin(table):
    mine = {r["summary"]: r.asDict() for r in P.full_summary(table).collect()}
    builtin = {r["summary"]: r.asDict() for r in C.without_nan(table).describe().collect()}
    assert mine == builtin


def test_histogram_matches_numpy(spark):
    chance = np.random.default_rng(1)
    values = np.concatenate([chance.normal(size=500), [NAN] * 20])
    df = spark.createDataFrame(pd.DataFrame({"v": values, "c": 3.0}))
    got = lookup(P.histogram(df), "column", "bin")
    counts, edges = np.histogram(values[~np.isnan(values)], 10)
    assert [got["v", b]["count"] for b in range(10)] == list(counts)
    assert [got["v", b]["low"] for b in range(10)] == pytest.approx(list(edges[:-1]))
    assert got["c", 5]["count"] == 520 and got["c", 0]["low"] == 2.5


@pytest.mark.parametrize("missing", ["pairwise", "zero"])
def test_correlation_matches_numpy(spark, missing):
    frame = pd.DataFrame({"a": [1.0, 2, NAN, 4, 7], "b": [2.0, NAN, 5, 1, 3], "c": [1.0, 2, 3, 4, 8], "d": [3.0] * 5})
    got = lookup(P.correlation(spark.createDataFrame(frame), missing=missing), "a", "b")
    expected = (frame.fillna(0) if missing == "zero" else frame).corr()
    for a in frame:
        for b in frame:
            value = expected.loc[a, b]
            assert got[a, b]["corr"] is None if math.isnan(value) else got[a, b]["corr"] == pytest.approx(value)
    assert len(got) == 16


def test_correlation_with_gaps_on_different_rows(spark):
    frame = pd.DataFrame({"a": [NAN, 2.0, 5, 4, 1], "b": [2.0, NAN, 5, 1, 3]})
    got = lookup(P.correlation(spark.createDataFrame(frame)), "a", "b")
    assert got["a", "b"]["corr"] == pytest.approx(frame.corr().loc["a", "b"])


def test_times_are_measured_without_a_zone(spark):
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        df = spark.sql("SELECT TIMESTAMP_NTZ '1970-01-02 00:00:01.5' AS t, TIMESTAMP_NTZ '1969-12-31 23:00:00' AS u")
        row = P.measures(df).first()
        assert (row.t, row.u) == (86401.5, -3600.0)
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_correlation_in_several_scans(spark, monkeypatch):
    monkeypatch.setattr(P, "PAIRS_PER_SCAN", 2)
    chance = np.random.default_rng(3)
    frame = pd.DataFrame(chance.normal(size=(50, 5)), columns=list("abcde"))
    got = lookup(P.correlation(spark.createDataFrame(frame)), "a", "b")
    expected = frame.corr()
    assert all(got[a, b]["corr"] == pytest.approx(expected.loc[a, b]) for a in frame for b in frame)


def test_top_values_ties_by_value(spark):
    df = spark.createDataFrame([(x,) for x in "zzyyxxwwvvuu"] + [(None,)] * 3, "t string")
    got = [(r["rank"], r["value"], r["count"]) for r in P.top_values(df).orderBy("rank").collect()]
    assert got == [(1, None, 3), (2, "u", 2), (3, "v", 2), (4, "w", 2), (5, "x", 2)]


def test_category_counts_leave_out_missing(table):
    assert {r["t"]: r["count"] for r in P.category_counts(table, "t").collect()} == {"a": 2, "b": 1, "c": 1}


def test_report_selects_metrics(table):
    report = quality_report(table, {"shape": True, "corr": False, "complete": True})
    assert set(report) == {"shape", "complete"}
    assert set(quality_report(table)) == set(METRICS)
    with pytest.raises(KeyError):
        quality_report(table, ["shape", "median"])
    row = report_row(report).first()["data"]
    assert row["shape"]["n_rows"] == 6 and row["complete"] == 33.33


@settings(max_examples=8, deadline=None)
@given(
    st.lists(
        st.tuples(st.one_of(st.none(), st.integers(-5, 5)), st.one_of(st.none(), st.sampled_from("ab"))),
        min_size=1,
        max_size=40,
    )
)
def test_profile_properties(spark, rows):
    df = spark.createDataFrame(rows, "n int, t string")
    card = P.scorecard(df.repartition(3)).first()
    assert 0 <= card.complete <= 100 and 0 < card.unique <= 100
    assert card == P.scorecard(df).first()
    filled = sum(1 for n, _ in rows if n is not None)
    assert P.histogram(df).agg(F.sum("count")).first()[0] == filled


def test_cleaning_steps(spark, table):
    assert C.drop_incomplete(table).count() == 2
    assert C.drop_copies(table).count() == 5
    zeros = spark.createDataFrame([(0,), (None,), (3,)], "n int")
    assert sorted(str(r.n) for r in C.drop_where_zero(zeros, "n").collect()) == ["3", "None"]
    filled = C.impute_mean(table, ["v"]).select("v").collect()
    assert sorted(r.v for r in filled) == pytest.approx([-2.5, 1, 1.625, 1.625, 4, 4])
    roles = C.assign_roles(table, "t", ["v"], first=2)
    assert (roles.numeric, roles.categorical, roles.passthrough) == (["v"], ["k"], ["c", "f"])
    dates = spark.createDataFrame([("2020-01-05 10:00:00",), ("bad",)], "d string")
    assert [r.d for r in dates.select(C.date_from_text(F.col("d"), strict=False).alias("d")).collect()][1] is None
    with pytest.raises(Exception):
        dates.select(C.date_from_text(F.col("d"))).collect()


def test_wide_correlation_with_missing_values(spark):
    """60 columns with gaps: one scan, equal to a frame's pairwise correlation."""
    chance = np.random.default_rng(3)
    frame = pd.DataFrame(chance.normal(size=(80, 60)), columns=[f"c{i}" for i in range(60)])
    frame["c1"] = frame["c0"] * 2 + frame["c1"]
    frame = frame.mask(chance.random(frame.shape) < 0.2)
    df = spark.createDataFrame(frame)
    got = {(r.a, r.b): r["corr"] for r in P.correlation(df).collect()}
    expected = frame.corr()
    assert len(got) == 3600
    for (a, b), value in got.items():
        assert value == pytest.approx(expected.loc[a, b], abs=1e-9)


def test_digest_sees_microseconds(spark):
    rows = [("2020-01-01 00:00:00.123456",), ("2020-01-01 00:00:00.123457",)]
    for kind in ("timestamp", "timestamp_ntz"):
        df = spark.createDataFrame(rows, "t string").select(F.col("t").cast(kind).alias("t"))
        assert P.uniqueness(df).first().distinct_rows == 2 == P.scorecard(df).first().distinct_rows


def test_infinite_values_lie_in_no_bin(spark):
    df = spark.createDataFrame([(float("inf"),), (float("-inf"),), (0.0,), (10.0,), (float("nan"),)], "v double")
    bins = P.histogram(df).orderBy("bin").collect()
    assert (bins[0].low, bins[-1].high, sum(b["count"] for b in bins), bins[0]["count"], bins[-1]["count"]) == (0.0, 10.0, 2, 1, 1)


def test_nan_is_no_category(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),), (None,)], "v double")
    assert [(r.v, r["count"]) for r in P.category_counts(df, "v").collect()] == [(1.0, 1)]


def _common(spark, frame, a, b):
    df = spark.createDataFrame(frame)
    there = df.filter(F.col(a).isNotNull() & F.col(b).isNotNull() & ~F.isnan(a) & ~F.isnan(b))
    return there.select(F.corr(a, b)).first()[0]


def test_correlation_of_rows_without_the_outlier(spark):
    """An outlier in a row that a pair does not share, and one that it shares."""
    chance = np.random.default_rng(4)
    x = chance.normal(size=1000)
    frame = pd.DataFrame({"x": np.append(x, 1e15), "y": np.append(2 * x + 0.1 * chance.normal(size=1000), NAN), "z": np.append(chance.normal(size=1000), 1.0)})
    frame.loc[5, "z"] = NAN
    got = lookup(P.correlation(spark.createDataFrame(frame).repartition(5)), "a", "b")
    for a, b in (("x", "y"), ("y", "z"), ("x", "z")):
        assert got[a, b]["corr"] == pytest.approx(_common(spark, frame, a, b), abs=1e-9)
    assert got["x", "y"]["corr"] > 0.99


def test_correlation_with_a_large_offset(spark):
    """Common rows far from the others: nothing is left of the digits if sums are subtracted."""
    chance = np.random.default_rng(5)
    far, near = 1e9 + chance.normal(size=400), chance.normal(size=600)
    frame = pd.DataFrame({"x": np.concatenate([far, near]), "y": np.concatenate([3 * (far - 1e9) + chance.normal(size=400), np.full(600, NAN)])})
    got = lookup(P.correlation(spark.createDataFrame(frame).repartition(7)), "a", "b")
    exact = np.corrcoef(far - 1e9, frame["y"][:400])[0, 1]
    assert got["x", "y"]["corr"] == pytest.approx(exact, abs=1e-7)  # 1e9 leaves 7 digits in the values themselves
    assert got["x", "y"]["corr"] == pytest.approx(_common(spark, frame, "x", "y"), abs=1e-7)


def test_correlation_of_constants_and_infinity(spark):
    frame = pd.DataFrame({"c": [5.1, 5.1, 5.1, 9.0, 2.0], "v": [1.0, 2.0, 4.0, NAN, NAN], "i": [1.0, float("inf"), 2.0, 3.0, 5.0], "w": [NAN, NAN, 1.0, 7.0, 2.0]})
    for parts in (1, 4):
        got = lookup(P.correlation(spark.createDataFrame(frame).repartition(parts)), "a", "b")
        assert got["c", "v"]["corr"] is None  # constant over the common rows only
        assert got["i", "v"]["corr"] is None and got["i", "c"]["corr"] is None and got["i", "i"]["corr"] is None
        assert got["i", "w"]["corr"] == pytest.approx(np.corrcoef([2, 3, 5], [1, 7, 2])[0, 1])


def test_co_moments_merge_like_whole(spark):
    from tabscope.operators.moments import CoMoments

    chance = np.random.default_rng(6)
    x = chance.normal(size=(500, 6)) * 10.0 ** np.arange(6) + 10.0 ** np.arange(6, 12)
    x[chance.random(x.shape) < 0.3] = NAN
    whole, merged = CoMoments.of(x), CoMoments.none(6)
    for part in np.array_split(x, 17):
        merged = merged.merged(CoMoments.of(part))
    for name in ("n", "mean", "square", "product"):
        assert getattr(merged, name) == pytest.approx(getattr(whole, name), rel=1e-7, abs=1e-6)


def test_digest_of_rows_with_missing_and_nested_cells(spark):
    rows = [(None, "x", [1, None], None), ("x", None, [1, None], None), (None, "x", [None, 1], None), (None, "x", None, {"a": 1}), (None, "x", None, {"a": 2}), (None, "x", None, None)]
    df = spark.createDataFrame(rows + rows[:2], "a string, b string, c array<int>, d map<string,int>")
    assert P.uniqueness(df).first().distinct_rows == 6 == P.scorecard(df).first().distinct_rows
    numbers = spark.createDataFrame([(0.0, 1), (-0.0, 1), (NAN, 1), (None, 1), (0.0, None)], "v double, n int")
    assert P.scorecard(numbers).first().distinct_rows == 3


@pytest.mark.parametrize("sent", [0, 100_000])
def test_top_values_among_many_ties(spark, sent):
    """All different, hot, and null values; with and without sending the candidates to all tasks."""
    rows = [(f"v{i:04d}", "hot" if i % 3 else f"w{i:04d}", None if i % 2 else "z") for i in range(900)]
    df = spark.createDataFrame(rows, "a string, b string, c string").repartition(7)
    got = {}
    for r in P.top_values(df, k=3, sent=sent).orderBy("column", "rank").collect():
        got.setdefault(r["column"], []).append((r["value"], r["count"]))
    assert got == {"a": [("v0000", 1), ("v0001", 1), ("v0002", 1)], "b": [("hot", 600), ("w0000", 1), ("w0003", 1)], "c": [("z", 450), (None, 450)]}


def test_no_text_in_the_first_shuffle_of_top_values(spark, monkeypatch):
    seen, store = [], P.materialize
    monkeypatch.setattr(P, "materialize", lambda df, label: seen.append(df) or store(df, label))
    P.top_values(spark.createDataFrame([("a", 1), ("b", 2)], "t string, n int"))
    shown = seen[0]._jdf.queryExecution().executedPlan().toString()
    exchange = shown[shown.index("Exchange") :]
    assert "keys=[column#" in shown and "value#" not in shown.split("Exchange")[0] and "Exchange hashpartitioning(column" in exchange
