"""Evaluation of scored tables ``(y, pred, score)``, per value of ``split``.

Class metrics come from one grouped count; curve metrics from counts per
distinct score, put in order range by range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tabscope.functions.columns import ref
from tabscope.operators.joining import null_safe_join
from tabscope.operators.ordering import running_totals

def class_counts(scored: DataFrame, split: str = "split") -> DataFrame:
    """Rows per ``(split, y, pred)``; every class metric starts from these."""
    return scored.groupBy(ref(split).alias("split"), "y", "pred").agg(F.count("*").alias("count"))


def confusion_matrix(counts: DataFrame, labels: list | None = None) -> DataFrame:
    """``split, y, pred, count`` with a row for every pair of labels, 0 where none occurred.

    A split's labels are its actual and predicted ones, NULL among them, and those listed.
    """
    seen = F.array("y", "pred", *[F.lit(v) for v in labels or []])
    known = counts.select("split", F.explode(seen).alias("label")).distinct()
    pairs = null_safe_join(known.withColumnRenamed("label", "y"), known.withColumnRenamed("label", "pred"), ["split"])
    cells = pairs.select("split", "y", "pred", F.lit(0).cast("bigint").alias("count"))
    return counts.unionByName(cells).groupBy("split", "y", "pred").agg(F.sum("count").alias("count"))


def _right() -> Column:
    return F.sum(F.when(F.col("y") == F.col("pred"), F.col("count")).otherwise(0))


def accuracy(counts: DataFrame) -> DataFrame:
    return counts.groupBy("split").agg((_right() / F.sum("count")).alias("accuracy"))


def balanced_accuracy(counts: DataFrame) -> DataFrame:
    """Mean recall over the classes that occur."""
    recalls = counts.groupBy("split", "y").agg(F.try_divide(_right(), F.sum("count")).alias("recall"))
    return recalls.groupBy("split").agg(F.avg("recall").alias("balanced_accuracy"))


def _total(condition: Column) -> Column:
    return F.sum(F.when(condition, F.col("count")).otherwise(0))


def jaccard(counts: DataFrame, positive=1) -> DataFrame:
    """TP / (TP + FP + FN) of the positive class, 0 when nothing is positive."""
    actual, predicted = F.col("y") == positive, F.col("pred") == positive
    score = F.try_divide(_total(actual & predicted), _total(actual | predicted))
    return counts.groupBy("split").agg(F.coalesce(score, F.lit(0.0)).alias("jaccard"))


def class_totals(counts: DataFrame) -> DataFrame:
    """``split, class, support, predicted, hits`` from the pair counts."""
    none, hit = F.lit(0).cast("bigint"), F.col("y") == F.col("pred")
    sides = F.inline(
        F.array(
            F.struct(
                F.col("y").cast("string").alias("class"),
                F.col("count").alias("actual"),
                none.alias("predicted"),
                F.when(hit, F.col("count")).otherwise(none).alias("hits"),
            ),
            F.struct(
                F.col("pred").cast("string").alias("class"),
                none.alias("actual"),
                F.col("count").alias("predicted"),
                none.alias("hits"),
            ),
        )
    )
    return (
        counts.select("split", sides)
        .groupBy("split", "class")
        .agg(F.sum("actual").alias("support"), F.sum("predicted").alias("predicted"), F.sum("hits").alias("hits"))
    )


def classification_report(counts: DataFrame) -> DataFrame:
    """``split, class, metric, value`` per class, with accuracy, macro and weighted averages."""
    zero = F.lit(0.0)
    per_class = (
        class_totals(counts)
        .withColumn("precision", F.coalesce(F.try_divide("hits", "predicted"), zero))
        .withColumn("recall", F.coalesce(F.try_divide("hits", "support"), zero))
        .withColumn("f1-score", F.coalesce(F.try_divide(2 * F.col("hits"), F.col("predicted") + F.col("support")), zero))
    )
    metrics = ["precision", "recall", "f1-score"]

    def lines(pairs: list[tuple[str, str, Column]]) -> Column:
        return F.inline(
            F.array(*[F.struct(c.alias("class"), F.lit(m).alias("metric"), v.cast("double").alias("value")) for c, m, v in pairs])
        )

    detail = per_class.select("split", lines([(F.col("class"), m, F.col(f"`{m}`")) for m in [*metrics, "support"]]))
    total = F.sum("support")
    averages = per_class.groupBy("split").agg(
        *[F.avg(f"`{m}`").alias(f"macro {m}") for m in metrics],
        *[F.try_divide(F.sum(F.col(f"`{m}`") * F.col("support")), total).alias(f"weighted {m}") for m in metrics],
        total.alias("n"),
        (F.sum("hits") / total).alias("right"),
    )
    summary = averages.select(
        "split",
        lines(
            [(F.lit("accuracy"), "accuracy", F.col("right"))]
            + [(F.lit(f"{kind} avg"), m, F.col(f"`{kind} {m}`")) for kind in ("macro", "weighted") for m in metrics]
            + [(F.lit(f"{kind} avg"), "support", F.col("n")) for kind in ("macro", "weighted")]
        ),
    )
    return detail.unionByName(summary)


def class_metrics(counts: DataFrame, positive=1) -> DataFrame:
    """One row per split with all scalar class metrics, from one pass over the counts.

    Recall, precision, f1, Jaccard and Matthews correlation are those of the
    positive class; 0/0 counts as 0.
    """
    own = F.col("class") == F.lit(positive).cast("string")
    zero = F.lit(0.0)

    def of_positive(column: str) -> Column:
        return F.coalesce(F.max(F.when(own, F.col(column))), F.lit(0)).cast("double")

    totals = class_totals(counts).groupBy("split").agg(
        F.sum("support").cast("double").alias("n"),
        F.sum("hits").cast("double").alias("right"),
        F.avg(F.try_divide("hits", "support")).alias("balanced_accuracy"),
        F.sum(F.col("support").cast("double") * F.col("predicted").cast("double")).alias("chance"),
        of_positive("support").alias("actual"),
        of_positive("predicted").alias("predicted"),
        of_positive("hits").alias("tp"),
    )
    n, actual, predicted, tp = (F.col(c) for c in ("n", "actual", "predicted", "tp"))
    fp, fn, tn = predicted - tp, actual - tp, n - actual - predicted + tp
    observed, expected = F.col("right") / n, F.col("chance") / (n * n)

    def ratio(part: Column, whole: Column) -> Column:
        return F.coalesce(F.try_divide(part, whole), zero)

    return totals.select(
        "split",
        observed.alias("accuracy"),
        "balanced_accuracy",
        ratio(tp, actual + predicted - tp).alias("jaccard"),
        ratio(tp, actual).alias("recall"),
        ratio(tp, predicted).alias("precision"),
        ratio(2 * tp, actual + predicted).alias("f1"),
        ratio(observed - expected, 1 - expected).alias("kappa"),
        ratio(tp * tn - fp * fn, F.sqrt(predicted * actual * (tn + fp) * (tn + fn))).alias("mcc"),
    )


def agreement(counts: DataFrame, positive=1) -> DataFrame:
    """Kappa and, for two classes, Matthews correlation."""
    return class_metrics(counts, positive).select("split", "kappa", "mcc")


def matthews(counts: DataFrame) -> DataFrame:
    """``split, mcc`` of any number of classes, 0 where predictions or labels are all of one class."""
    support, predicted = (F.col(c).cast("double") for c in ("support", "predicted"))
    totals = class_totals(counts).groupBy("split").agg(
        F.sum(support).alias("n"),
        F.sum(F.col("hits").cast("double")).alias("right"),
        F.sum(support * predicted).alias("both"),
        F.sum(support * support).alias("actual"),
        F.sum(predicted * predicted).alias("guessed"),
    )
    n = F.col("n")
    spread = F.sqrt((n * n - F.col("actual")) * (n * n - F.col("guessed")))
    return totals.select("split", F.coalesce(F.try_divide(F.col("right") * n - F.col("both"), spread), F.lit(0.0)).alias("mcc"))


def ordered_scores(scored: DataFrame, split: str = "split", positive=1) -> DataFrame:
    """Positives and negatives per distinct score, in falling order, with their running totals."""
    hit = F.col("y") == positive
    per_score = (
        scored.filter(F.col("y").isNotNull() & F.col("score").isNotNull())
        .groupBy(ref(split).alias("split"), "score")
        .agg(F.count_if(hit).alias("pos"), F.count_if(~hit).alias("neg"))
    )
    return running_totals(per_score, ["split"], "score", ["pos", "neg"], descending=True, look_ahead=["pos", "neg"])


def roc_curve(ordered: DataFrame) -> DataFrame:
    """``split, threshold, fpr, tpr``; starts at (0, 0) with an infinite threshold.

    Inner points on a straight line are left out: those whose counts equal the
    following score's counts.
    """
    first = (F.col("before_pos") == 0) & (F.col("before_neg") == 0)
    straight = (F.col("pos") == F.col("next_pos")) & (F.col("neg") == F.col("next_neg"))
    keep = first | F.col("next_pos").isNull() | ~straight
    point = F.struct(
        F.col("score").alias("threshold"),
        F.try_divide(F.col("before_neg") + F.col("neg"), F.col("all_neg")).alias("fpr"),
        F.try_divide(F.col("before_pos") + F.col("pos"), F.col("all_pos")).alias("tpr"),
    )
    start = F.struct(F.lit(float("inf")).alias("threshold"), F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr"))
    points = F.when(first, F.array(start, point)).otherwise(F.array(point))
    return ordered.filter(keep).select("split", F.inline(points))


def roc_auc(ordered: DataFrame) -> DataFrame:
    """Area under the curve by ranks, ties counted half; NULL when a class is absent."""
    wide = "decimal(19,0)"
    pairs = F.col("neg").cast(wide) * (2 * F.col("before_pos") + F.col("pos")).cast(wide)
    return ordered.groupBy("split").agg(
        F.try_divide(
            F.sum(pairs).cast("double"),
            2.0 * F.max("all_pos").cast("double") * F.max("all_neg").cast("double"),
        ).alias("auc")
    )


def many_class_auc(scored: DataFrame, split: str = "split") -> DataFrame:
    """``split, auc`` of ``(y, scores)``: the areas of each class against the rest, weighted by its rows.

    Class k's score is ``scores[k]``. A class without rows, or without others, has no area and no
    weight; a split without any area is left out. Each row is read once for every class and counted per
    distinct score before anything is shuffled.
    """
    own = (
        scored.filter(F.col("y").isNotNull())
        .select(ref(split).alias("_split"), "y", F.posexplode("scores").alias("_class", "score"))
        .select(F.to_json(F.struct("_split", "_class")).alias("split"), "_split", (F.col("y") == F.col("_class")).cast("int").alias("y"), "score")
    )
    weights = own.groupBy("split", "_split").agg(F.sum("y").alias("_rows"))
    areas = weights.join(roc_auc(ordered_scores(own)).filter("auc IS NOT NULL"), "split")
    return areas.groupBy(F.col("_split").alias("split")).agg(F.try_divide(F.sum(F.col("auc") * F.col("_rows")), F.sum("_rows")).alias("auc"))


def regression_metrics(scored: DataFrame, split: str = "split") -> DataFrame:
    """MAE, MSE, RMSE, R², RMSLE and MAPE of ``(y, pred)`` in one pass."""
    y, pred = F.col("y").cast("double"), F.col("pred").cast("double")
    error = y - pred
    log_gap = F.log1p(F.abs(pred)) - F.log1p(F.abs(y))
    aggregated = scored.groupBy(ref(split).alias("split")).agg(
        F.avg(F.abs(error)).alias("mae"),
        F.avg(error * error).alias("mse"),
        F.var_pop(y).alias("_spread"),
        F.sqrt(F.avg(log_gap * log_gap)).alias("rmsle"),
        F.avg(F.try_divide(F.abs(error), F.abs(y))).alias("mape"),
    )
    return aggregated.select(
        "split",
        "mae",
        "mse",
        F.sqrt("mse").alias("rmse"),
        (1 - F.try_divide("mse", "_spread")).alias("r2"),
        "rmsle",
        "mape",
    )


def mean_score(scores: DataFrame, column: str = "accuracy") -> DataFrame:
    return scores.agg(F.avg(ref(column)).alias("mean_score"))
