"""Model training, batch scoring and cross-validated accuracy."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark import StorageLevel
from pyspark.ml import Estimator, Pipeline, PipelineModel
from pyspark.ml.classification import (
    DecisionTreeClassifier,
    GBTClassifier,
    LogisticRegression,
    RandomForestClassifier,
)
from pyspark.ml.functions import vector_to_array
from pyspark.ml.wrapper import JavaEstimator
from pyspark.sql import DataFrame, functions as F

from tabscope.functions.columns import ref
from tabscope.functions.numbers import round_percent
from tabscope.operators.boosting import StumpBoosting
from tabscope.operators.cleaning import Roles
from tabscope.operators.features import column_transformer, label_encoder
from tabscope.operators.multiclass import OneAgainstRest
from tabscope.operators.splitting import repeated_folds
from tabscope.workspace import materialize

# Parameter presets per model key; callers override any of them.
PRESETS = {
    "lr": (LogisticRegression, {"maxIter": 100}),
    "dt": (DecisionTreeClassifier, {"maxDepth": 5, "seed": 0}),
    "rf": (RandomForestClassifier, {"numTrees": 100, "maxDepth": 8, "seed": 0}),
    "gb": (GBTClassifier, {"maxIter": 100, "maxDepth": 3, "stepSize": 0.1, "seed": 0}),
    "xgb": (GBTClassifier, {"maxIter": 100, "maxDepth": 6, "stepSize": 0.3, "seed": 0}),
    "ada": (StumpBoosting, {"maxIter": 50, "stepSize": 1.0}),
}


def classifier(key: str, **params):
    """An unfitted classifier of any number of classes by its key: lr, dt, rf, gb, xgb or ada."""
    if key not in PRESETS:
        raise ValueError(f"unknown model: {key}")
    kind, preset = PRESETS[key]
    made = kind(**{**preset, **params})
    return OneAgainstRest(made) if kind is GBTClassifier else made


def model_pipeline(roles: Roles, target: str, key: str, unseen: str = "error", **params) -> Pipeline:
    """Label encoding, feature stages and classifier as one estimator."""
    return Pipeline(stages=[label_encoder(target), *column_transformer(roles, unseen=unseen), classifier(key, **params)])


def class_labels(model: PipelineModel) -> list[str]:
    return list(model.stages[0].labelsArray[0])


def _without_label_stage(model: PipelineModel) -> PipelineModel:
    return PipelineModel(stages=model.stages[1:])


def _probabilities(scored: DataFrame):
    """Array of class probabilities, from the model's vector or the boosted vote."""
    if "probability" in scored.columns:
        return vector_to_array("probability")
    return F.array(1 - F.col("positive_probability"), F.col("positive_probability"))


def predictions(model: PipelineModel, rows: DataFrame, keep: list[str]) -> DataFrame:
    """``keep..., y, pred, score``: encoded label, predicted class, probability of class 1."""
    scored = model.transform(rows)
    return scored.select(
        *keep,
        F.col("label").cast("int").alias("y"),
        F.col("prediction").cast("int").alias("pred"),
        F.get(_probabilities(scored), F.lit(1)).alias("score"),
    )


def score(model: PipelineModel, rows: DataFrame, keep: list[str], output: str = "prediction_label") -> DataFrame:
    """Predicted class name and its probability in percent; the rows need no label."""
    labels = F.array(*[F.lit(v) for v in class_labels(model)])
    scored = _without_label_stage(model).transform(rows)
    chosen = F.col("prediction").cast("int")
    return scored.select(
        *keep,
        F.get(labels, chosen).alias(output),
        round_percent(F.get(_probabilities(scored), chosen) * 100.0).alias("prob"),
    )


def split_last(estimator) -> tuple[Pipeline, object]:
    """The stages before a pipeline's last one, and that one; no stages before any other estimator."""
    stages = estimator.getStages() if isinstance(estimator, Pipeline) else [estimator]
    if not stages or not isinstance(stages[-1], Estimator):
        return Pipeline(stages=[]), estimator
    return Pipeline(stages=stages[:-1]), stages[-1]


def read_by(estimator, columns: list[str]) -> list[str]:
    """Of ``columns`` the label, the fold and those that a learner of Spark's names; all of them for any other."""
    if not isinstance(estimator, JavaEstimator):
        return columns
    named = {value for param, value in estimator.extractParamMap().items() if param.name.endswith("Col")}
    return [c for c in columns if c in named | {"label", "fold"}]


def cross_validate(
    rows: DataFrame,
    estimator,
    target: str,
    key: list[str],
    folds: int = 6,
    repeats: int = 10,
    seed: str = "cv",
    parallelism: int = 8,
) -> DataFrame:
    """``repeat, fold, accuracy`` of repeated stratified folds; the whole estimator is refitted each time.

    The rows are stored, then written with a fold column for each repeat. A pipeline's last stage reads its
    rows many times: what the fitted stages before it make of them is held in memory, or on disk, meanwhile.
    """
    assigned = materialize(repeated_folds(materialize(rows, "rows"), target, key, folds, repeats, seed), "folds")
    names = [f"_fold_{repeat}" for repeat in range(repeats)]

    def one(job: tuple[int, int]) -> tuple[int, int, float]:
        repeat, fold = job
        own = assigned.withColumnRenamed(names[repeat], "_own").drop(*names).withColumnRenamed("_own", "fold")
        before, last = split_last(estimator.copy())
        encoded = before.fit(own.filter(F.col("fold") != fold)).transform(own)
        encoded = encoded.select(*[ref(c) for c in read_by(last, encoded.columns)]).persist(StorageLevel.MEMORY_AND_DISK)
        try:
            model = last.fit(encoded.filter(F.col("fold") != fold))
            held_out = model.transform(encoded.filter(F.col("fold") == fold))
            share = held_out.agg(F.avg((F.col("label") == F.col("prediction")).cast("int"))).first()[0]
        finally:
            encoded.unpersist()
        return repeat, fold, share

    jobs = [(repeat, fold) for repeat in range(repeats) for fold in range(folds)]
    with ThreadPoolExecutor(parallelism) as pool:
        scores = list(pool.map(one, jobs))
    return rows.sparkSession.createDataFrame(scores, "repeat int, fold int, accuracy double")


def first_parameters(estimator, n: int = 5) -> list[tuple[str, str]]:
    """The first ``n`` parameters by name, with their values as text."""
    values = {p.name: str(v) for p, v in estimator.extractParamMap().items()}
    return sorted(values.items())[:n]
