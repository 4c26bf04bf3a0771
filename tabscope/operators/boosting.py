"""Adaptive boosting (SAMME) of decision stumps."""

from __future__ import annotations

import math

from pyspark import keyword_only
from pyspark.ml import Estimator, PipelineModel
from pyspark.ml.classification import DecisionTreeClassifier
from pyspark.ml.feature import SQLTransformer
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasFeaturesCol, HasLabelCol, HasMaxIter, HasStepSize
from pyspark.sql import DataFrame, functions as F

from tabscope.operators.multiclass import WeightedVotes, class_count
from tabscope.workspace import materialize

WEIGHT = "_weight"


class StumpBoosting(Estimator, HasFeaturesCol, HasLabelCol, HasMaxIter, HasStepSize):
    """Fits to a ``PipelineModel`` of the stumps and one stage that adds up their votes.

    A stump of K classes is of use if its weighted error is below 1 - 1/K; its vote is
    log((1 - error) / error) + log(K - 1). Row weights are a column. Every ``storeEvery`` rounds the weighted table is
    written, which keeps the plan of a round short.
    """

    storeEvery = Param(Params._dummy(), "storeEvery", "rounds between stored weights", TypeConverters.toInt)

    @keyword_only
    def __init__(self, *, featuresCol="features", labelCol="label", maxIter=50, stepSize=1.0, storeEvery=5):
        super().__init__()
        self._setDefault(featuresCol="features", labelCol="label", maxIter=50, stepSize=1.0, storeEvery=5)
        self._set(**self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> PipelineModel:
        features, label = self.getFeaturesCol(), self.getLabelCol()
        rows = dataset.select(features, F.col(label).cast("double").alias(label), F.lit(1.0).alias(WEIGHT))
        rows = materialize(rows, "boosting")
        classes = class_count(rows, label)
        stumps, votes = [], []
        for i in range(self.getMaxIter()):
            name = f"_stump_{i}"
            stump = DecisionTreeClassifier(
                featuresCol=features,
                labelCol=label,
                weightCol=WEIGHT,
                maxDepth=1,
                seed=i,
                predictionCol=name,
                rawPredictionCol=f"_raw_{i}",
                probabilityCol=f"_probability_{i}",
            ).fit(rows)
            missed = (F.col(name) != F.col(label)).cast("double")
            voted = stump.transform(rows).drop(f"_raw_{i}", f"_probability_{i}")
            total, wrong = voted.agg(F.sum(WEIGHT), F.sum(F.col(WEIGHT) * missed)).first()
            error = wrong / total
            if error >= 1.0 - 1.0 / classes:
                if not stumps:
                    stumps.append(stump)
                    votes.append(1.0)
                break
            vote = 1.0 if error <= 0 else self.getStepSize() * (math.log((1.0 - error) / error) + math.log(classes - 1))
            stumps.append(stump)
            votes.append(vote)
            if error <= 0:
                break
            weight = F.col(WEIGHT) / total * F.exp(vote * missed)
            rows = voted.select(features, label, weight.alias(WEIGHT))
            if (i + 1) % self.getOrDefault(self.storeEvery) == 0:
                rows = materialize(rows, "boosting")
        return PipelineModel(stages=[*stumps, _vote(votes) if classes == 2 else WeightedVotes(classes=classes, votes=votes)])


def _vote(votes: list[float]) -> SQLTransformer:
    """Weighted mean of the votes in [-1, 1], its logistic value as the probability of class 1."""
    parts = " + ".join(f"{v!r}D * (2 * `_stump_{i}` - 1)" for i, v in enumerate(votes))
    decision = f"(({parts}) / {sum(votes)!r}D)"
    drop = ", ".join(c for i in range(len(votes)) for c in (f"`_stump_{i}`", f"`_raw_{i}`", f"`_probability_{i}`"))
    return SQLTransformer(
        statement=(
            f"SELECT * EXCEPT ({drop}), IF({decision} > 0, 1.0D, 0.0D) AS prediction, "
            f"1 / (1 + EXP(-{decision})) AS positive_probability FROM __THIS__"
        )
    )
