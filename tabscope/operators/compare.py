"""Experiment set-up and the comparison of candidate models."""

from __future__ import annotations

import time
from concurrent.futures import Future, ThreadPoolExecutor
from dataclasses import dataclass
from functools import reduce

from pyspark.ml import Pipeline, PipelineModel, classification as C, regression as R
from pyspark.ml.feature import Imputer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from tabscope.functions.columns import TIMES, as_measure, ref
from tabscope.operators import evaluate as E
from tabscope.operators.cleaning import Roles
from tabscope.operators.features import ModeImputer, column_transformer, label_encoder
from tabscope.operators.multiclass import OneAgainstRest
from tabscope.operators.splitting import stratified_folds, train_test_split
from tabscope.workspace import materialize

@dataclass
class Experiment:
    """Feature stages chosen from the column types, and the rows with their split."""

    rows: DataFrame
    target: str
    key: list[str]
    roles: Roles
    hashed: list[str]
    stages: list
    classes: int = 0

    @property
    def train(self) -> DataFrame:
        return self.rows.filter(F.col("split") == "train")

    def described(self) -> DataFrame:
        """``column, role`` as decided by the set-up."""
        lines = [(c, "numeric") for c in self.roles.numeric]
        lines += [(c, "hashed" if c in self.hashed else "categorical") for c in self.roles.categorical]
        lines += [(self.target, "target")] + [(c, "key") for c in self.key]
        return self.rows.sparkSession.createDataFrame(lines, "column string, role string")


def _as_number(field: T.StructField) -> Column | None:
    """Numbers as they are, truth values as 0 and 1, dates as days and timestamps as seconds; None for texts and others."""
    if isinstance(field.dataType, T.DateType):
        return F.unix_date(ref(field.name)).cast("double")
    if isinstance(field.dataType, (T.BooleanType, T.NumericType)):
        return ref(field.name).cast("double")
    return as_measure(field) if isinstance(field.dataType, TIMES) else None


def set_up(
    df: DataFrame, target: str, key: list[str], test_share: float = 0.3, seed: str = "40", hashed: list[str] | None = None
) -> Experiment:
    """Roles by type, mean and mode imputation, encoding and a train/test split.

    ``key`` names the columns that identify a row; they are not features. All values
    of a text column are listed, whatever their number; the columns named in
    ``hashed`` go through a hashing stage instead.
    """
    fields = [f for f in df.schema if f.name != target and f.name not in key]
    measured = {f.name: number for f in fields if (number := _as_number(f)) is not None}
    numbers, hashed = list(measured), list(hashed or [])
    texts = [f.name for f in fields if isinstance(f.dataType, T.StringType)]
    rows = df.filter(ref(target).isNotNull()).withColumns(measured)
    rows = train_test_split(rows, key, test_share, seed)

    stages: list = []
    if texts:
        stages.append(ModeImputer(inputCols=texts))
    if numbers:
        stages.append(Imputer(strategy="mean", inputCols=numbers, outputCols=numbers))
    roles = Roles(numeric=numbers, categorical=texts, passthrough=[])
    stages += column_transformer(roles, hashed=hashed, unseen="keep")
    return Experiment(rows, target, key, roles, hashed, stages)


def classification_candidates(classes: int = 2) -> dict[str, object]:
    """Candidates by name; two-class learners are wrapped for more classes."""
    several = classes > 2

    return {
        "Logistic Regression": C.LogisticRegression(maxIter=50),
        "Decision Tree Classifier": C.DecisionTreeClassifier(maxDepth=5, seed=0),
        "Random Forest Classifier": C.RandomForestClassifier(numTrees=50, maxDepth=6, seed=0),
        "Gradient Boosting Classifier": OneAgainstRest(C.GBTClassifier(maxIter=30, maxDepth=3, seed=0)),
        "Naive Bayes": C.NaiveBayes(modelType="gaussian"),
        "SVM - Linear Kernel": C.OneVsRest(classifier=C.LinearSVC(maxIter=50)) if several else C.LinearSVC(maxIter=50),
        "Factorization Machine": OneAgainstRest(C.FMClassifier(factorSize=4, stepSize=0.05, maxIter=50, seed=0)),
    }


def regression_candidates() -> dict[str, object]:
    return {
        "Linear Regression": R.LinearRegression(maxIter=50),
        "Generalized Linear Regression": R.GeneralizedLinearRegression(family="gaussian", regParam=0.01),
        "Decision Tree Regressor": R.DecisionTreeRegressor(maxDepth=5, seed=0),
        "Random Forest Regressor": R.RandomForestRegressor(numTrees=50, maxDepth=6, seed=0),
        "Gradient Boosting Regressor": R.GBTRegressor(maxIter=30, maxDepth=3, seed=0),
        "Factorization Machine": R.FMRegressor(factorSize=4, stepSize=0.05, maxIter=50, seed=0),
    }


def leaderboard(results: DataFrame, metric: str, ascending: bool = False) -> DataFrame:
    """Candidates from best to worst, ties by name, the best one marked.

    A candidate whose metric is NULL or NaN comes last and is never the best.
    ``results`` has one row per candidate, so its order fits one task.
    """
    value = F.nanvl(ref(metric).cast("double"), F.lit(None))
    order = value.asc_nulls_last() if ascending else value.desc_nulls_last()
    place = F.row_number().over(Window.orderBy(order, "model"))
    ranked = results.withColumn("_place", place).orderBy("_place")
    return ranked.withColumn("best", (F.col("_place") == 1) & value.isNotNull()).drop("_place")


CLASS_METRICS = ["accuracy", "auc", "recall", "precision", "f1", "kappa", "mcc"]
VALUE_METRICS = ["mae", "mse", "rmse", "r2", "rmsle", "mape"]


def compare_classifiers(
    experiment: Experiment,
    folds: int = 10,
    candidates: dict | None = None,
    sort: str = "accuracy",
    parallelism: int = 8,
) -> DataFrame:
    """Leaderboard of cross-validated class metrics on the training rows.

    The encoding stages are fitted on the training part of each fold. With more than two
    classes recall, precision, F1 and AUC (each class against the rest) are weighted by the classes' rows. AUC
    is NULL for models that do not score.
    """
    train = materialize(experiment.train, "train")
    encoder = label_encoder(experiment.target).fit(train)
    classes = len(encoder.labelsArray[0])
    candidates = candidates or classification_candidates(classes)
    assigned = materialize(
        stratified_folds(encoder.transform(train), experiment.target, experiment.key, folds), "folds"
    )

    def scored(model, part: DataFrame, fold: int) -> DataFrame:
        out = model.transform(part)
        scores = F.lit(None).cast("array<double>")
        if "probability" in out.columns:
            scores = vector_to_array("probability")
        elif "rawPrediction" in out.columns:
            scores = vector_to_array("rawPrediction")
        return out.select(
            F.lit(fold).alias("split"),
            F.col("label").cast("int").alias("y"),
            F.col("prediction").cast("int").alias("pred"),
            *([F.get(scores, F.lit(1)).alias("score")] if classes == 2 else [scores.alias("scores")]),
        )

    def metrics(rows: DataFrame) -> DataFrame:
        counts = materialize(E.class_counts(rows), "counts") if classes > 2 else E.class_counts(rows)
        table = E.class_metrics(counts)
        if classes > 2:
            report = E.classification_report(counts).filter(F.col("class") == "weighted avg")
            weighted = report.groupBy("split").pivot("metric", ["precision", "recall", "f1-score"]).agg(F.first("value"))
            table = table.drop("precision", "recall", "f1").join(weighted.withColumnRenamed("f1-score", "f1"), "split")
            table = table.drop("mcc").join(E.matthews(counts), "split")
            return table.join(E.many_class_auc(rows), "split", "left")
        return table.join(E.roc_auc(E.ordered_scores(rows)), "split", "left")

    return _compare(experiment, assigned, folds, candidates, scored, metrics, CLASS_METRICS, sort, False, parallelism)


def compare_regressors(
    experiment: Experiment,
    folds: int = 10,
    candidates: dict | None = None,
    sort: str = "r2",
    parallelism: int = 8,
) -> DataFrame:
    """Leaderboard of cross-validated error metrics on the training rows."""
    train = materialize(experiment.train.withColumn("label", ref(experiment.target).cast("double")).withColumn("_all", F.lit(0)), "train")
    assigned = materialize(stratified_folds(train, "_all", experiment.key, folds), "folds")

    def scored(model, part: DataFrame, fold: int) -> DataFrame:
        return model.transform(part).select(
            F.lit(fold).alias("split"), F.col("label").alias("y"), F.col("prediction").alias("pred")
        )

    return _compare(
        experiment,
        assigned,
        folds,
        candidates or regression_candidates(),
        scored,
        E.regression_metrics,
        VALUE_METRICS,
        sort,
        sort != "r2",
        parallelism,
    )


def fit_best(experiment: Experiment, board: DataFrame, candidates: dict | None = None) -> PipelineModel:
    """The leaderboard's best candidate, refitted with its encoding on all training rows.

    For a classifier the first stage encodes the label, as in ``models.model_pipeline``.
    """
    best = board.filter("best").first()
    if best is None:
        raise ValueError("no candidate has a metric")
    if "r2" in board.columns:
        name = ref(experiment.target).cast("double").alias("label")
        estimator = (candidates or regression_candidates())[best["model"]]
        return Pipeline(stages=[*experiment.stages, estimator]).fit(experiment.train.select("*", name))
    encoder = label_encoder(experiment.target).fit(experiment.train)
    estimator = (candidates or classification_candidates(len(encoder.labelsArray[0])))[best["model"]]
    return Pipeline(stages=[encoder, *experiment.stages, estimator]).fit(experiment.train)


def _compare(
    experiment, assigned, folds, candidates, scored, metrics, names, sort, ascending, parallelism
) -> DataFrame:
    """Encode each fold once, fit every candidate on it, average the metrics over the folds.

    Folds of one candidate are fitted side by side too, so that the slowest candidate's do not follow each other.
    """
    spark = assigned.sparkSession

    def encode(fold: int) -> DataFrame:
        fitted = Pipeline(stages=experiment.stages).fit(assigned.filter(F.col("fold") != fold))
        return materialize(fitted.transform(assigned).select("label", "features", "fold"), "encoded")

    with ThreadPoolExecutor(parallelism) as pool:
        encoded = list(pool.map(encode, range(folds)))

    def fit(estimator, fold: int) -> tuple[DataFrame, float]:
        rows, begun = encoded[fold], time.monotonic()
        model = estimator.fit(rows.filter(F.col("fold") != fold))
        spent = time.monotonic() - begun
        return scored(model, rows.filter(F.col("fold") == fold), fold), spent

    def one(name: str, fits: list[Future]) -> tuple:
        parts, spent = zip(*[f.result() for f in fits])
        # scored once, read by every metric
        held_out = materialize(reduce(DataFrame.unionByName, parts), "scored")
        means = metrics(held_out).agg(*[F.avg(m) for m in names]).first()
        return (name, *means, sum(spent) / folds)

    with ThreadPoolExecutor(parallelism) as pool:
        # a fit never waits for another task, and all fits stand in the queue before the first that waits for them
        fits = {name: [pool.submit(fit, estimator.copy(), fold) for fold in range(folds)] for name, estimator in candidates.items()}
        lines = [f.result() for f in [pool.submit(one, name, own) for name, own in fits.items()]]
    schema = "model string, " + ", ".join(f"{m} double" for m in names) + ", seconds double"
    return leaderboard(spark.createDataFrame(lines, schema), sort, ascending)
