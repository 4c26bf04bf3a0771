"""How often rows are read and what is fitted side by side."""

import threading

import pytest
from pyspark.ml import Estimator, Pipeline
from pyspark.ml.feature import SQLTransformer

from tabscope.operators import features
from tabscope.operators.cleaning import Roles
from tabscope.operators.compare import compare_classifiers, compare_regressors, set_up
from tabscope.operators.features import ValueIndexer, column_transformer, label_encoder
from tabscope.operators.models import cross_validate, model_pipeline


class _Meeting(Estimator):
    """Learns a constant, once as many folds as expected are being fitted."""

    def __init__(self, folds):
        super().__init__()
        self.barrier = threading.Barrier(folds, timeout=60)

    def copy(self, extra=None):
        return self

    def _fit(self, dataset):
        self.barrier.wait()
        return SQLTransformer(statement="SELECT *, CAST(1 AS DOUBLE) AS prediction FROM __THIS__")


def _few_rows(spark):
    rows = [(i, float(i % 7), "ab"[i % 2], "yn"[i % 3 == 0]) for i in range(60)]
    return spark.createDataFrame(rows, "id int, x double, c string, y string")


def test_folds_of_one_classifier_are_fitted_side_by_side(spark):
    board = compare_classifiers(set_up(_few_rows(spark), "y", ["id"]), 2, {"meeting": _Meeting(2)}, parallelism=2)
    assert board.select("model", "best").collect() == [("meeting", True)]


def test_folds_of_one_regressor_are_fitted_side_by_side(spark):
    board = compare_regressors(set_up(_few_rows(spark), "x", ["id"]), 2, {"meeting": _Meeting(2)}, parallelism=2)
    assert board.count() == 1


class _Looking(Estimator):
    """Notes whether the rows it is given are held."""

    def __init__(self, seen):
        super().__init__()
        self.seen = seen

    def copy(self, extra=None):
        return self

    def _fit(self, dataset):
        self.seen.append("InMemoryRelation" in dataset._jdf.queryExecution().withCachedData().toString())
        return SQLTransformer(statement="SELECT *, CAST(1 AS DOUBLE) AS prediction FROM __THIS__")


def test_cross_validation_holds_the_encoded_rows_of_a_fold(spark):
    seen = []
    stages = [label_encoder("y"), *column_transformer(Roles(["x"], ["c"], []), unseen="keep"), _Looking(seen)]
    scores = cross_validate(_few_rows(spark), Pipeline(stages=stages), "y", ["id"], folds=2, repeats=1)
    assert seen == [True, True]
    # 40 of 60 rows are y, which is class 1
    assert sorted(r["accuracy"] for r in scores.collect()) == pytest.approx([2 / 3, 2 / 3])
    whole = cross_validate(_few_rows(spark), model_pipeline(Roles(["x"], ["c"], []), "y", "dt", unseen="keep"), "y", ["id"], folds=2, repeats=1)
    assert whole.count() == 2


def test_few_values_are_listed_without_a_stored_table(spark, monkeypatch):
    def refuse(*_):
        raise AssertionError("stored")

    monkeypatch.setattr(features, "distinct_values", refuse)
    rows = spark.createDataFrame([("b", 10), ("a", 9), (None, 9)], "c string, n int")
    fitted = ValueIndexer(inputCols=["c", "n"], outputCols=["i", "j"]).fit(rows)
    assert [list(x) for x in fitted.labelsArray] == [["a", "b"], ["9", "10"]]
