"""Properties of the physical plans that matter on large tables."""

import pytest

import __spark_entry__ as entry
from conftest import SF_DIR
from tabscope.catalog.inputs import table
from tabscope.operators import evaluate as E, ordering as O, profile as P, series as S, splitting as X


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def orders(spark):
    return table(spark, SF_DIR, "orders")


@pytest.fixture(scope="module")
def lines(spark):
    return table(spark, SF_DIR, "lineitem")


def test_top_values_are_cut_before_the_shuffle(orders):
    text = plan(P.top_values(orders))
    assert text.count("WindowGroupLimit") == 2 and "Partial" in text


def test_only_needed_columns_are_read(orders, lines):
    assert "ReadSchema: struct<o_totalprice:double>" in plan(P.histogram(orders, ["o_totalprice"]))
    monthly = plan(S.monthly_totals(orders, "o_orderdate", "o_totalprice"))
    assert "o_custkey" not in monthly and "PushedFilters: [IsNotNull(o_orderdate)]" in monthly


def test_groupings_reduce_before_the_shuffle(lines):
    scored = lines.selectExpr("l_linenumber % 2 AS y", "1 AS pred", "l_discount AS score", "l_linestatus AS split")
    for df in (P.scorecard(lines), E.class_counts(scored), P.category_counts(lines, "l_returnflag")):
        text = plan(df)
        assert text.index("Exchange") < text.rindex("partial_count")


def test_folds_are_a_projection_over_the_scan(orders):
    text = plan(X.stratified_folds(orders, "o_orderstatus", ["o_orderkey"]))
    assert "Exchange hashpartitioning" not in text and "BroadcastHashJoin" in text


def test_running_totals_leave_no_window_over_rows(lines):
    per_key = lines.groupBy("l_linestatus", "l_extendedprice").count()
    text = plan(O.running_totals(per_key, ["l_linestatus"], "l_extendedprice", ["count"]))
    assert "SinglePartition" not in text and "_inner_count" in text


def test_running_totals_shuffle_the_rows_once(lines, monkeypatch):
    """After the counts per key there is one exchange, into ranges."""
    seen = []
    monkeypatch.setattr(O, "materialize", lambda df, label: seen.append(plan(df)) or df)
    O.running_totals(lines.groupBy("l_linestatus", "l_extendedprice").count(), ["l_linestatus"], "l_extendedprice", ["count"])
    ranges = seen[0]
    assert ranges.count("Exchange") == 2 and ranges.count("Exchange rangepartitioning") == 1 and "Window" not in ranges


@pytest.mark.parametrize("name", ["roc_curve", "roc_auc", "top_values", "correlation", "histogram", "classification_report", "trend_seasonal_forecast", "scorecard", "drop_copies"])
def test_no_product_of_tables(spark, name):
    text = plan(entry.queries()[name](spark, SF_DIR))
    assert "CartesianProduct" not in text and "NestedLoop" not in text
