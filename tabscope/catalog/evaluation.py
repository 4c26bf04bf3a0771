"""Queries over the evaluation and splitting operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabscope.catalog.inputs import derived, position_sql, sql_of, table
from tabscope.functions.hashing import POSITION_BITS
from tabscope.operators import evaluate as E, splitting as S
from tabscope.operators.compare import leaderboard
from tabscope.plans.churn_report import evaluation_row


def _scored(spark, sf_dir):
    return derived(spark, sf_dir, "scored")


def _counts(spark, sf_dir):
    return E.class_counts(_scored(spark, sf_dir))


def confusion_matrix(spark, sf_dir):
    counts = _counts(spark, sf_dir)
    return E.confusion_matrix(counts, [2])


def accuracy(spark, sf_dir):
    return E.accuracy(_counts(spark, sf_dir)).withColumn("accuracy", F.round("accuracy", 9))


def balanced_accuracy(spark, sf_dir):
    return E.balanced_accuracy(_counts(spark, sf_dir)).withColumn("balanced_accuracy", F.round("balanced_accuracy", 9))


def jaccard(spark, sf_dir):
    return E.jaccard(_counts(spark, sf_dir)).withColumn("jaccard", F.round("jaccard", 9))


def classification_report(spark, sf_dir):
    return E.classification_report(_counts(spark, sf_dir)).withColumn("value", F.round("value", 9))


def agreement(spark, sf_dir):
    return E.agreement(_counts(spark, sf_dir)).select("split", F.round("kappa", 9).alias("kappa"), F.round("mcc", 9).alias("mcc"))


def many_class_metrics(spark, sf_dir):
    """Area and Matthews correlation of three classes."""
    rows = derived(spark, sf_dir, "scored_classes").withColumn("scores", F.array("s0", "s1", "s2"))
    both = E.many_class_auc(rows).join(E.matthews(E.class_counts(rows)), "split")
    return both.select("split", F.round("auc", 9).alias("auc"), F.round("mcc", 9).alias("mcc"))


def roc_curve(spark, sf_dir):
    curve = E.roc_curve(E.ordered_scores(_scored(spark, sf_dir)))
    return curve.select("split", F.round("threshold", 9).alias("threshold"), F.round("fpr", 9).alias("fpr"), F.round("tpr", 9).alias("tpr"))


def roc_auc(spark, sf_dir):
    return E.roc_auc(E.ordered_scores(_scored(spark, sf_dir))).withColumn("auc", F.round("auc", 9))


def evaluation_report(spark, sf_dir):
    """Train and test blocks, validated accuracy and parameters as one history row."""
    row, _, _ = evaluation_row(_scored(spark, sf_dir), "rule", 0.5, [("threshold", "1.25")])
    block = [
        F.round(f"{side}_result.{m}", 9).alias(f"{side}_{m}")
        for side in ("training", "testing")
        for m in ("accuracy", "balanced_accuracy", "jaccard", "roc_score")
    ]
    sizes = [F.size(f"{side}_result.classification_report").alias(f"{side}_lines") for side in ("training", "testing")]
    return row.select("model_name", "cross_validation", F.col("model_params")["threshold"].alias("threshold"), *block, *sizes)


def regression_metrics(spark, sf_dir):
    scored = table(spark, sf_dir, "lineitem").select(
        F.col("l_linestatus").alias("split"),
        F.col("l_extendedprice").alias("y"),
        (F.col("l_quantity") * 1500.0).alias("pred"),
    )
    metrics = E.regression_metrics(scored)
    return metrics.select(
        "split", *[F.round(m, 2).alias(m) for m in ("mae", "mse", "rmse")], *[F.round(m, 8).alias(m) for m in ("r2", "rmsle", "mape")]
    )


_THRESHOLDS = {"low": 0.1, "middle": 0.25, "high": 0.5}


def model_leaderboard(spark, sf_dir):
    """Three decision thresholds as candidates, ranked by accuracy."""
    scored = _scored(spark, sf_dir)
    each = F.inline(F.array(*[F.struct(F.lit(n).alias("model"), F.lit(t).alias("threshold")) for n, t in _THRESHOLDS.items()]))
    decided = scored.select("y", "score", each).select(
        F.col("model").alias("split"), "y", F.when(F.col("score") >= F.col("threshold"), 1).otherwise(0).alias("pred")
    )
    results = E.class_metrics(E.class_counts(decided)).select(
        F.col("split").alias("model"), *[F.round(m, 9).alias(m) for m in ("accuracy", "recall", "precision", "f1")]
    )
    return leaderboard(results, "accuracy")


def train_test_split(spark, sf_dir):
    return S.train_test_split(table(spark, sf_dir, "orders"), ["o_orderkey"]).select("o_orderkey", "split")


def train_test_split_exact(spark, sf_dir):
    return S.train_test_split(table(spark, sf_dir, "orders"), ["o_orderkey"], exact=True).select("o_orderkey", "split")


def stratified_folds(spark, sf_dir):
    """Six folds, ten repeats."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    folded = S.repeated_folds(orders, "o_orderstatus", ["o_orderkey"], 6, 10)
    each = F.inline(F.array(*[F.struct(F.lit(r).alias("repeat"), F.col(f"_fold_{r}").alias("fold")) for r in range(10)]))
    return folded.select("o_orderkey", each)


def mean_fold_accuracy(spark, sf_dir):
    """Mean over the folds of a fixed rule's accuracy."""
    orders = table(spark, sf_dir, "orders")
    rule = orders.select(
        "o_orderkey",
        (F.col("o_orderstatus") == "F").cast("int").alias("y"),
        (F.col("o_totalprice") > 200000).cast("int").alias("pred"),
    )
    folded = S.stratified_folds(rule, "y", ["o_orderkey"], 6)
    scores = E.accuracy(E.class_counts(folded, "fold"))
    return E.mean_score(scores).select(F.round("mean_score", 9).alias("mean_score"))


QUERIES = {
    f.__name__: f
    for f in [
        confusion_matrix, accuracy, balanced_accuracy, jaccard, classification_report, agreement, roc_curve, roc_auc,
        many_class_metrics,
        evaluation_report, regression_metrics, model_leaderboard, train_test_split, train_test_split_exact,
        stratified_folds, mean_fold_accuracy,
    ]
}

_S = f"s AS ({sql_of('scored')})"
_C = f"{_S}, c AS (SELECT split, y, pred, COUNT(*) AS n FROM s GROUP BY ALL)"
_ACC = "SELECT split, SUM(CASE WHEN y = pred THEN n ELSE 0 END) / SUM(n) AS accuracy FROM c GROUP BY split"
_BAL = """SELECT split, AVG(r) AS balanced FROM (
  SELECT split, y, SUM(CASE WHEN y = pred THEN n ELSE 0 END) / SUM(n) AS r FROM c GROUP BY split, y) GROUP BY split"""
_JAC = """SELECT split, SUM(CASE WHEN y = 1 AND pred = 1 THEN n ELSE 0 END) / SUM(CASE WHEN y = 1 OR pred = 1 THEN n ELSE 0 END) AS jaccard
FROM c GROUP BY split"""
_ORDERED = """p AS (
  SELECT split, score, COUNT(*) FILTER (WHERE y = 1) AS pos, COUNT(*) FILTER (WHERE y = 0) AS neg FROM s GROUP BY split, score),
o AS (
  SELECT *, SUM(pos) OVER w AS tp, SUM(neg) OVER w AS fp,
    SUM(pos) OVER (PARTITION BY split) AS all_pos, SUM(neg) OVER (PARTITION BY split) AS all_neg,
    LEAD(pos) OVER w AS next_pos, LEAD(neg) OVER w AS next_neg, ROW_NUMBER() OVER w AS r
  FROM p WINDOW w AS (PARTITION BY split ORDER BY score DESC))"""
_AUC = """SELECT split, CAST(SUM(neg * (2 * (tp - pos) + pos)) AS DOUBLE) / (2.0 * CAST(MAX(all_pos) AS DOUBLE) * CAST(MAX(all_neg) AS DOUBLE)) AS auc
FROM o GROUP BY split"""
_REPORT = """per AS (
  SELECT split, k, SUM(CASE WHEN y = k THEN n ELSE 0 END) AS support, SUM(CASE WHEN pred = k THEN n ELSE 0 END) AS predicted,
    SUM(CASE WHEN y = k AND pred = k THEN n ELSE 0 END) AS hits
  FROM c, (SELECT UNNEST([0, 1]) AS k) GROUP BY split, k),
m AS (
  SELECT split, k, support, hits, COALESCE(hits / NULLIF(predicted, 0), 0) AS precision, COALESCE(hits / NULLIF(support, 0), 0) AS recall,
    COALESCE(2 * hits / NULLIF(predicted + support, 0), 0) AS f1 FROM per)"""


def _lines() -> str:
    parts = []
    for metric, cell in (("precision", "precision"), ("recall", "recall"), ("f1-score", "f1"), ("support", "support")):
        parts.append(f"SELECT split, CAST(k AS VARCHAR) AS class, '{metric}' AS metric, CAST({cell} AS DOUBLE) AS value FROM m")
        macro = "SUM(support)" if metric == "support" else f"AVG({cell})"
        weighted = "SUM(support)" if metric == "support" else f"SUM({cell} * support) / SUM(support)"
        parts.append(f"SELECT split, 'macro avg', '{metric}', CAST({macro} AS DOUBLE) FROM m GROUP BY split")
        parts.append(f"SELECT split, 'weighted avg', '{metric}', CAST({weighted} AS DOUBLE) FROM m GROUP BY split")
    parts.append("SELECT split, 'accuracy', 'accuracy', CAST(SUM(hits) / SUM(support) AS DOUBLE) FROM m GROUP BY split")
    return " UNION ALL ".join(parts)


_FOLD = """SELECT *, CAST(((ROW_NUMBER() OVER (PARTITION BY stratum ORDER BY place) - 1) * 6) // COUNT(*) OVER (PARTITION BY stratum) AS INTEGER) AS fold FROM placed"""
_REPEATS = " UNION ALL ".join(
    f"SELECT o_orderkey, {r} AS repeat, o_orderstatus || {r} AS stratum, {position_sql(f'cv:{r}', 'o_orderkey')} AS place FROM orders"
    for r in range(10)
)
_THRESHOLD_ROWS = ", ".join(f"('{n}', CAST({t} AS DOUBLE))" for n, t in _THRESHOLDS.items())

ORACLES = {
    "many_class_metrics": f"""WITH s AS ({sql_of('scored_classes')}), k AS (SELECT UNNEST(range(3)) AS k),
g AS (SELECT split, k, CASE k WHEN 0 THEN s0 WHEN 1 THEN s1 ELSE s2 END AS score, COUNT(*) FILTER (WHERE y = k) AS p, COUNT(*) FILTER (WHERE y <> k) AS q
  FROM s, k GROUP BY ALL),
b AS (SELECT *, COALESCE(SUM(p) OVER (PARTITION BY split, k ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS above FROM g),
a AS (SELECT split, k, SUM(CAST(q AS DOUBLE) * (2 * above + p)) / (2.0 * SUM(p) * SUM(q)) AS auc, SUM(p) AS n FROM b GROUP BY split, k),
t AS (SELECT split, k, COUNT(*) FILTER (WHERE y = k) AS t, COUNT(*) FILTER (WHERE pred = k) AS p, COUNT(*) FILTER (WHERE y = k AND pred = k) AS h FROM s, k GROUP BY split, k),
m AS (SELECT split, (SUM(h) * SUM(t) - SUM(CAST(t AS DOUBLE) * p)) / SQRT((SUM(t) * SUM(t) - SUM(CAST(t AS DOUBLE) * t)) * (SUM(t) * SUM(t) - SUM(CAST(p AS DOUBLE) * p))) AS mcc
  FROM t GROUP BY split)
SELECT split, ROUND(SUM(auc * n) / SUM(n), 9) AS auc, ROUND(ANY_VALUE(mcc), 9) AS mcc FROM a JOIN m USING (split) GROUP BY split""",
    "confusion_matrix": f"""WITH {_C}, cells AS (
  SELECT split, y, pred FROM (SELECT DISTINCT split FROM s), (SELECT UNNEST([0, 1, 2]) AS y), (SELECT UNNEST([0, 1, 2]) AS pred))
SELECT cells.split, cells.y, cells.pred, COALESCE(n, 0) AS count FROM cells LEFT JOIN c USING (split, y, pred)""",
    "accuracy": f"WITH {_C} SELECT split, ROUND(accuracy, 9) AS accuracy FROM ({_ACC})",
    "balanced_accuracy": f"WITH {_C} SELECT split, ROUND(balanced, 9) AS balanced_accuracy FROM ({_BAL})",
    "jaccard": f"WITH {_C} SELECT split, ROUND(jaccard, 9) AS jaccard FROM ({_JAC})",
    "classification_report": f"WITH {_C}, {_REPORT} SELECT split, class, metric, ROUND(value, 9) AS value FROM ({_lines()})",
    "agreement": f"""WITH {_C}, cells AS (
  SELECT split, CAST(SUM(CASE WHEN y = 1 AND pred = 1 THEN n ELSE 0 END) AS DOUBLE) AS tp, CAST(SUM(CASE WHEN y = 0 AND pred = 1 THEN n ELSE 0 END) AS DOUBLE) AS fp,
    CAST(SUM(CASE WHEN y = 1 AND pred = 0 THEN n ELSE 0 END) AS DOUBLE) AS fn, CAST(SUM(CASE WHEN y = 0 AND pred = 0 THEN n ELSE 0 END) AS DOUBLE) AS tn
  FROM c GROUP BY split),
e AS (SELECT *, tp + fp + fn + tn AS n, ((tp + fn) * (tp + fp) + (tn + fp) * (tn + fn)) / ((tp + fp + fn + tn) * (tp + fp + fn + tn)) AS expected FROM cells)
SELECT split, ROUND(((tp + tn) / n - expected) / (1 - expected), 9) AS kappa,
  ROUND((tp * tn - fp * fn) / SQRT((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)), 9) AS mcc FROM e""",
    "roc_curve": f"""WITH {_S}, {_ORDERED}
SELECT split, ROUND(score, 9) AS threshold, ROUND(fp / all_neg, 9) AS fpr, ROUND(tp / all_pos, 9) AS tpr FROM o
WHERE r = 1 OR next_pos IS NULL OR pos <> next_pos OR neg <> next_neg
UNION ALL SELECT DISTINCT split, CAST('Infinity' AS DOUBLE), 0.0, 0.0 FROM s""",
    "roc_auc": f"WITH {_S}, {_ORDERED} SELECT split, ROUND(auc, 9) AS auc FROM ({_AUC})",
    "evaluation_report": f"""WITH {_C}, {_ORDERED},
a AS ({_ACC}), b AS ({_BAL}), j AS ({_JAC}), u AS ({_AUC}),
r AS (SELECT * FROM a JOIN b USING (split) JOIN j USING (split) JOIN u USING (split))
SELECT 'rule' AS model_name, CAST(0.5 AS DOUBLE) AS cross_validation, '1.25' AS threshold,
  ROUND(t.accuracy, 9) AS training_accuracy, ROUND(t.balanced, 9) AS training_balanced_accuracy,
  ROUND(t.jaccard, 9) AS training_jaccard, ROUND(t.auc, 9) AS training_roc_score,
  ROUND(e.accuracy, 9) AS testing_accuracy, ROUND(e.balanced, 9) AS testing_balanced_accuracy,
  ROUND(e.jaccard, 9) AS testing_jaccard, ROUND(e.auc, 9) AS testing_roc_score,
  17 AS training_lines, 17 AS testing_lines
FROM r AS t, r AS e WHERE t.split = 'train' AND e.split = 'test'""",
    "regression_metrics": """WITH s AS (SELECT l_linestatus AS split, l_extendedprice AS y, l_quantity * 1500.0 AS pred FROM lineitem)
SELECT split, ROUND(AVG(ABS(y - pred)), 2) AS mae, ROUND(AVG((y - pred) * (y - pred)), 2) AS mse, ROUND(SQRT(AVG((y - pred) * (y - pred))), 2) AS rmse,
  ROUND(1 - AVG((y - pred) * (y - pred)) / VAR_POP(y), 8) AS r2, ROUND(SQRT(AVG(POWER(LN(1 + pred) - LN(1 + y), 2))), 8) AS rmsle,
  ROUND(AVG(ABS(y - pred) / ABS(y)), 8) AS mape
FROM s GROUP BY split""",
    "model_leaderboard": f"""WITH {_S}, d AS (
  SELECT model, y, CASE WHEN score >= threshold THEN 1 ELSE 0 END AS pred FROM s, (VALUES {_THRESHOLD_ROWS}) AS t(model, threshold)),
m AS (
  SELECT model, COUNT(*) FILTER (WHERE y = pred) / COUNT(*) AS accuracy,
    COUNT(*) FILTER (WHERE y = 1 AND pred = 1) / COUNT(*) FILTER (WHERE y = 1) AS recall,
    COUNT(*) FILTER (WHERE y = 1 AND pred = 1) / COUNT(*) FILTER (WHERE pred = 1) AS precision,
    2 * COUNT(*) FILTER (WHERE y = 1 AND pred = 1) / (COUNT(*) FILTER (WHERE y = 1) + COUNT(*) FILTER (WHERE pred = 1)) AS f1
  FROM d GROUP BY model)
SELECT model, ROUND(accuracy, 9) AS accuracy, ROUND(recall, 9) AS recall, ROUND(precision, 9) AS precision, ROUND(f1, 9) AS f1,
  ROW_NUMBER() OVER (ORDER BY accuracy DESC, model) = 1 AS best FROM m""",
    "train_test_split": f"""SELECT o_orderkey, CASE WHEN {position_sql('40', 'o_orderkey')} < {int(0.3 * (1 << POSITION_BITS))} THEN 'test' ELSE 'train' END AS split FROM orders""",
    "train_test_split_exact": f"""SELECT o_orderkey, CASE WHEN r <= CEIL(n * 0.3) THEN 'test' ELSE 'train' END AS split
FROM (SELECT o_orderkey, ROW_NUMBER() OVER (ORDER BY {position_sql('40', 'o_orderkey')}) AS r, COUNT(*) OVER () AS n FROM orders)""",
    "stratified_folds": f"WITH placed AS ({_REPEATS}) SELECT o_orderkey, repeat, fold FROM ({_FOLD})",
    "mean_fold_accuracy": f"""WITH placed AS (
  SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS stratum, CASE WHEN o_totalprice > 200000 THEN 1 ELSE 0 END AS pred,
    {position_sql('cv:0', 'o_orderkey')} AS place FROM orders),
scores AS (SELECT fold, AVG(CASE WHEN stratum = pred THEN 1.0 ELSE 0.0 END) AS accuracy FROM ({_FOLD}) GROUP BY fold)
SELECT ROUND(AVG(accuracy), 9) AS mean_score FROM scores""",
}
