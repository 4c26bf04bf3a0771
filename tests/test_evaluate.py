import random

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.sql import functions as F

from tabscope.operators import evaluate as E

SCHEMA = "y int, pred int, score double, split string"


def scored(spark, rows):
    return spark.createDataFrame([(y, int(s >= 0.5), float(s), "s") for y, s in rows], SCHEMA)


def brute_curve(rows):
    levels = sorted({s for _, s in rows}, reverse=True)
    pos, neg = sum(y for y, _ in rows), sum(1 - y for y, _ in rows)
    points = [(t, sum(1 - y for y, s in rows if s >= t), sum(y for y, s in rows if s >= t)) for t in levels]
    kept = []
    for i, (t, fp, tp) in enumerate(points):
        inner = 0 < i < len(points) - 1
        if inner and points[i + 1][1] - 2 * fp + points[i - 1][1] == 0 and points[i + 1][2] - 2 * tp + points[i - 1][2] == 0:
            continue
        kept.append((t, fp / neg, tp / pos))
    return [(float("inf"), 0.0, 0.0)] + kept


def brute_auc(rows):
    pairs = [(a, b) for y1, a in rows if y1 for y0, b in rows if not y0]
    return sum(1.0 if a > b else 0.5 if a == b else 0.0 for a, b in pairs) / len(pairs)


def random_rows(n, levels, seed=1):
    chance = random.Random(seed)
    return [(chance.randint(0, 1), chance.randint(0, levels) / levels) for _ in range(n)]


@pytest.mark.parametrize("levels", [4, 50, 100000])
def test_curve_and_area_match_brute_force(spark, levels):
    rows = random_rows(300, levels)
    ordered = E.ordered_scores(scored(spark, rows))
    curve = [(r.threshold, r.fpr, r.tpr) for r in E.roc_curve(ordered).orderBy(F.desc("threshold")).collect()]
    flat = [x for point in curve for x in point]
    assert flat == pytest.approx([x for point in brute_curve(rows) for x in point])
    assert E.roc_auc(ordered).first().auc == pytest.approx(brute_auc(rows), abs=1e-12)


def test_area_matches_builtin_evaluator(spark):
    df = scored(spark, random_rows(2000, 300, 4)).withColumn("y", F.col("y").cast("double"))
    builtin = BinaryClassificationEvaluator(rawPredictionCol="score", labelCol="y", numBins=0).evaluate(df)
    assert E.roc_auc(E.ordered_scores(df)).first().auc == pytest.approx(builtin, abs=1e-9)


def test_area_with_one_class_is_null(spark):
    assert E.roc_auc(E.ordered_scores(scored(spark, [(1, 0.2), (1, 0.9)]))).first().auc is None


@settings(max_examples=6, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 1), st.integers(0, 6)), min_size=2, max_size=30).filter(lambda r: 0 < sum(y for y, _ in r) < len(r)))
def test_area_of_mirrored_scores(spark, rows):
    up = scored(spark, rows)
    down = up.withColumn("score", -F.col("score"))
    total = E.roc_auc(E.ordered_scores(up)).first().auc + E.roc_auc(E.ordered_scores(down)).first().auc
    assert total == pytest.approx(1.0)


def test_class_metrics(spark):
    cells = {(0, 0): 50, (0, 1): 10, (1, 0): 5, (1, 1): 35}
    counts = spark.createDataFrame([("s", y, p, n) for (y, p), n in cells.items()], "split string, y int, pred int, count long")
    row = E.class_metrics(counts).first()
    assert row.accuracy == pytest.approx(0.85)
    assert row.balanced_accuracy == pytest.approx((50 / 60 + 35 / 40) / 2)
    assert row.jaccard == pytest.approx(35 / 50)
    assert (row.recall, row.precision) == pytest.approx((35 / 40, 35 / 45))
    assert row.f1 == pytest.approx(70 / 85)
    expected = (60 * 55 + 40 * 45) / 100**2
    assert row.kappa == pytest.approx((0.85 - expected) / (1 - expected))
    assert row.mcc == pytest.approx((35 * 50 - 10 * 5) / (45 * 40 * 60 * 55) ** 0.5)
    assert E.accuracy(counts).first().accuracy == row.accuracy
    assert E.balanced_accuracy(counts).first().balanced_accuracy == row.balanced_accuracy
    assert E.jaccard(counts).first().jaccard == row.jaccard


def test_nothing_positive_counts_as_zero(spark):
    counts = spark.createDataFrame([("s", 0, 0, 4)], "split string, y int, pred int, count long")
    row = E.class_metrics(counts).first()
    assert (row.jaccard, row.recall, row.precision, row.f1, row.mcc) == (0, 0, 0, 0, 0)
    assert E.jaccard(counts).first().jaccard == 0


def test_report_lines(spark):
    rows = [("s", 0, 0, 3), ("s", 0, 2, 1), ("s", 1, 1, 2), ("s", 1, 0, 2)]
    counts = spark.createDataFrame(rows, "split string, y int, pred int, count long")
    got = {(r["class"], r["metric"]): r["value"] for r in E.classification_report(counts).collect()}
    assert got["2", "support"] == 0 and got["2", "recall"] == 0 and got["2", "precision"] == 0
    assert got["0", "precision"] == pytest.approx(0.6) and got["1", "recall"] == pytest.approx(0.5)
    assert got["accuracy", "accuracy"] == pytest.approx(5 / 8)
    assert got["macro avg", "recall"] == pytest.approx((0.75 + 0.5 + 0) / 3)
    assert got["weighted avg", "recall"] == pytest.approx(5 / 8)


def test_confusion_matrix_fills_absent_cells(spark):
    counts = E.class_counts(scored(spark, [(1, 0.9), (1, 0.8)]))
    cells = {(r.y, r.pred): r["count"] for r in E.confusion_matrix(counts, [0, 1]).collect()}
    assert cells == {(0, 0): 0, (0, 1): 0, (1, 0): 0, (1, 1): 2}
    seen = {(r.y, r.pred): r["count"] for r in E.confusion_matrix(counts).collect()}
    assert seen == {(1, 1): 2}


def test_matrix_takes_many_and_missing_labels(spark):
    rows = [("s", i, i, 1) for i in range(40)] + [("s", None, 0, 2)]
    counts = spark.createDataFrame(rows, "split string, y int, pred int, count long")
    matrix = E.confusion_matrix(counts)
    assert matrix.count() == 41 * 41 and matrix.agg(F.sum("count")).first()[0] == 42


def test_balanced_accuracy_of_a_class_never_actual(spark):
    counts = spark.createDataFrame([("s", 0, 0, 3), ("s", 0, 1, 1)], "split string, y int, pred int, count long")
    assert E.balanced_accuracy(E.confusion_matrix(counts)).first().balanced_accuracy == pytest.approx(0.75)


def test_regression_metrics(spark):
    df = spark.createDataFrame([(3.0, 2.0, "s"), (1.0, 1.5, "s"), (0.0, 0.5, "s")], "y double, pred double, split string")
    row = E.regression_metrics(df).first()
    assert row.mae == pytest.approx(2 / 3) and row.mse == pytest.approx(0.5)
    assert row.r2 == pytest.approx(1 - 0.5 / (14 / 9))
    assert row.mape == pytest.approx((1 / 3 + 0.5) / 2)


def test_many_classes_match_brute_force(spark):
    """Area and Matthews correlation of four classes, one of which is absent in a split."""
    import numpy as np

    chance = np.random.default_rng(5)
    rows = []
    for name, n, classes in (("a", 120, 4), ("b", 90, 3), ("c", 5, 1)):
        for _ in range(n):
            y = int(chance.integers(0, classes))
            scores = [float(v) for v in np.round(chance.random(4) + 0.4 * np.eye(4)[y], 1)]
            rows.append((name, y, int(np.argmax(scores)), scores))
    rows += [("b", None, 1, [0.0] * 4), ("b", 2, 2, None)]
    df = spark.createDataFrame(rows, "split string, y int, pred int, scores array<double>")
    areas = {r.split: r.auc for r in E.many_class_auc(df).collect()}
    assert set(areas) == {"a", "b"}  # one class alone has no area
    for name, auc in areas.items():
        own = [(y, s) for split, y, _, s in rows if split == name and y is not None and s is not None]
        sizes = {k: sum(y == k for y, _ in own) for k in range(4)}
        each = {k: brute_auc([(int(y == k), s[k]) for y, s in own]) for k in range(4) if sizes[k]}
        assert auc == pytest.approx(sum(each[k] * sizes[k] for k in each) / sum(sizes.values()), abs=1e-12)
    found = {r.split: r.mcc for r in E.matthews(E.class_counts(df.filter("y IS NOT NULL"))).collect()}
    for name in "ab":
        own = [(y, p) for split, y, p, _ in rows if split == name and y is not None]
        one_hot = [np.eye(4)[[side[i] for side in own]] for i in (0, 1)]
        cov = lambda u, v: ((u - u.mean(0)) * (v - v.mean(0))).sum()
        assert found[name] == pytest.approx(cov(*one_hot) / np.sqrt(cov(one_hot[0], one_hot[0]) * cov(one_hot[1], one_hot[1])))
    two = scored(spark, random_rows(200, 9, 3))
    assert E.matthews(E.class_counts(two)).first().mcc == pytest.approx(E.agreement(E.class_counts(two)).first().mcc)
    assert E.many_class_auc(df.limit(0)).count() == 0 and E.matthews(E.class_counts(df.limit(0))).count() == 0
