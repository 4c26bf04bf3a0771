"""Training and evaluation of one churn model, with its history row."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, functions as F

from tabscope.operators import evaluate as E
from tabscope.operators.cleaning import Roles, assign_roles, coerce_numbers, drop_where_zero
from tabscope.operators.models import classifier, cross_validate, first_parameters, model_pipeline, predictions
from tabscope.operators.splitting import train_test_split
from tabscope.sources.history import append_run, flatten_runs
from tabscope.sources.landing import export_csv
from tabscope.workspace import materialize

# The numeric features of the churn table.
NUMERIC = ["tenure", "MonthlyCharges", "TotalCharges"]


@dataclass
class ChurnReport:
    """Fitted model and the tables of its evaluation; ``row`` is the history entry."""

    model: PipelineModel
    scored: DataFrame
    row: DataFrame
    roc_curve: DataFrame
    confusion: DataFrame
    fold_scores: DataFrame


def clean(df: DataFrame) -> DataFrame:
    """Charges as numbers, customers without any tenure left out."""
    return drop_where_zero(coerce_numbers(df, ["TotalCharges"]), "tenure")


def prepare(df: DataFrame, target: str, key: list[str]) -> tuple[DataFrame, Roles]:
    """Rows with all features present, and their roles."""
    rows = clean(df).dropna(subset=["TotalCharges"])
    return rows, assign_roles(rows.drop(*key), target, NUMERIC)


def evaluation_blocks(counts: DataFrame, auc: DataFrame) -> DataFrame:
    """``split, block``: the scalar metrics, class report and confusion matrix of each split."""
    lines = E.classification_report(counts).groupBy("split").agg(
        F.array_sort(F.collect_list(F.struct("class", "metric", "value"))).alias("classification_report")
    )
    cells = counts.groupBy("split").agg(
        F.array_sort(F.collect_list(F.struct("y", "pred", "count"))).alias("confusion_matrix")
    )
    parts = E.class_metrics(counts).join(auc, "split").join(lines, "split").join(cells, "split")
    block = F.struct(
        "accuracy",
        "balanced_accuracy",
        "jaccard",
        F.col("auc").alias("roc_score"),
        "classification_report",
        "confusion_matrix",
    )
    return parts.select("split", block.alias("block"))


def evaluation_row(scored: DataFrame, model_name: str, cross_validation: float | None, params: list[tuple[str, str]]):
    """Train and test blocks, cross-validated accuracy and first parameters as one row."""
    counts = materialize(E.confusion_matrix(E.class_counts(scored), [0, 1]), "confusion")
    ordered = E.ordered_scores(scored)
    blocks = evaluation_blocks(counts, E.roc_auc(ordered))

    def of(split: str):
        return F.first(F.when(F.col("split") == split, F.col("block")), ignorenulls=True)

    pairs = [x for name, value in params for x in (F.lit(name), F.lit(value))]
    row = blocks.agg(
        of("train").alias("training_result"),
        of("test").alias("testing_result"),
    ).select(
        F.lit(model_name).alias("model_name"),
        F.lit("Processed").alias("Status"),
        "training_result",
        "testing_result",
        F.lit(cross_validation).cast("double").alias("cross_validation"),
        (F.create_map(*pairs) if pairs else F.lit(None)).cast("map<string,string>").alias("model_params"),
    )
    return row, E.roc_curve(ordered), counts


def record_run(row: DataFrame, history: str, export: str) -> DataFrame:
    """Append an evaluation to the history and export all runs, this one among them, as a flat table.

    Returns the runs listed before this one; an empty table before the first.
    """
    spark = row.sparkSession
    earlier = materialize(flatten_runs(spark, history), "earlier")
    append_run(row, history)
    export_csv(flatten_runs(spark, history), export)
    return earlier


def churn_report(
    df: DataFrame,
    model: str,
    key: list[str],
    target: str = "Churn",
    folds: int = 6,
    repeats: int = 10,
    **params,
) -> ChurnReport:
    """Clean, split 70/30, fit on the training rows, evaluate both parts, cross-validate."""
    rows, roles = prepare(df, target, key)
    # read by every fit of the model and of its folds
    rows = materialize(train_test_split(rows, key), "churn")
    fitted = model_pipeline(roles, target, model, **params).fit(rows.filter(F.col("split") == "train"))
    scored = materialize(predictions(fitted, rows, ["split"]), "scored")
    estimator = model_pipeline(roles, target, model, unseen="keep", **params)
    fold_scores = cross_validate(rows, estimator, target, key, folds, repeats)
    mean = E.mean_score(fold_scores).first()[0]
    unfitted = classifier(model, **params)
    row, roc, confusion = evaluation_row(scored, type(unfitted).__name__, mean, first_parameters(unfitted))
    return ChurnReport(fitted, scored, row, roc, confusion, fold_scores)
