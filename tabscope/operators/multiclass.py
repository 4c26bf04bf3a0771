"""Classifiers of two classes made to tell any number of classes apart."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark import keyword_only
from pyspark.ml import Estimator, PipelineModel, Transformer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasFeaturesCol, HasLabelCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame, functions as F

from tabscope.workspace import materialize


def class_count(dataset: DataFrame, label: str) -> int:
    """Classes are numbered from 0; there are two at least."""
    highest = dataset.agg(F.max(F.col(label))).first()[0]
    return max(2, int(highest or 0) + 1)


def _chosen(scores: Column) -> Column:
    """Number of the class with the highest score, the smallest of equal ones."""
    return (F.array_position(scores, F.array_max(scores)) - 1).cast("double")


class ShareOfScores(Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """Each class's probability by its own model, divided by their sum; the largest is predicted.

    Class k's model has left the vector ``_rest_probability_k``. Without any probability above 0 all
    classes are alike.
    """

    classes = Param(Params._dummy(), "classes", "number of classes", TypeConverters.toInt)

    @keyword_only
    def __init__(self, *, classes=2):
        super().__init__()
        self._setDefault(classes=2)
        self._set(**self._input_kwargs)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        n = self.getOrDefault("classes")
        own = F.array(*[F.get(vector_to_array(f"_rest_probability_{k}"), F.lit(1)) for k in range(n)])
        scored = dataset.withColumn("_own", own)
        total = F.aggregate("_own", F.lit(0.0), lambda a, v: a + v)
        shares = F.transform("_own", lambda v: F.when(F.col("_total") > 0, v / F.col("_total")).otherwise(1.0 / n))
        scored = scored.withColumn("_total", total).withColumn("_shares", shares)
        left = [f"_rest_{part}_{k}" for part in ("raw", "probability", "prediction") for k in range(n)]
        return scored.withColumns({"prediction": _chosen(F.col("_shares")), "probability": array_to_vector("_shares")}).drop(
            "_own", "_total", "_shares", *left
        )


class OneAgainstRest(Estimator, HasFeaturesCol, HasLabelCol):
    """Any classifier of two classes: fits it as it is, or once for each of more classes.

    With more than two classes the encoded rows are stored, a model is fitted for each class against
    the rest, several side by side, and ``ShareOfScores`` compares their probabilities. A class number without rows has
    a model as well, of rows that are all the rest.
    """

    def __init__(self, inner: Estimator, parallelism: int = 4):
        super().__init__()
        self._setDefault(featuresCol=inner.getFeaturesCol(), labelCol=inner.getLabelCol())
        self.inner, self.parallelism = inner, parallelism

    def _fit(self, dataset: DataFrame):
        features, label = self.getFeaturesCol(), self.getLabelCol()
        classes = class_count(dataset, label)
        if classes == 2:
            return self.inner.copy().fit(dataset)  # a shared learner may be fitted by several threads
        rows = materialize(dataset.select(features, F.col(label).cast("int").alias("_class")), "one_against_rest")

        def one(k: int):
            columns = {"rawPredictionCol": f"_rest_raw_{k}", "probabilityCol": f"_rest_probability_{k}", "predictionCol": f"_rest_prediction_{k}"}
            own = self.inner.copy({self.inner.getParam(name): column for name, column in columns.items()})
            return own.fit(rows.withColumn(label, (F.col("_class") == k).cast("double")))

        with ThreadPoolExecutor(self.parallelism) as pool:
            models = list(pool.map(one, range(classes)))
        return PipelineModel(stages=[*models, ShareOfScores(classes=classes)])


class WeightedVotes(Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """The votes of boosted stumps (columns ``_stump_i``) for more than two classes.

    A vote counts fully for its class and -1 / (classes - 1) for each other; the probability is
    the softmax of the mean vote divided by classes - 1.
    """

    classes = Param(Params._dummy(), "classes", "number of classes", TypeConverters.toInt)
    votes = Param(Params._dummy(), "votes", "weight of each stump", TypeConverters.toListFloat)

    @keyword_only
    def __init__(self, *, classes=3, votes=None):
        super().__init__()
        self._setDefault(classes=3, votes=[])
        self._set(**self._input_kwargs)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        n, votes = self.getOrDefault("classes"), self.getOrDefault("votes")
        cast = F.array(*[F.struct(F.col(f"_stump_{i}").alias("k"), F.lit(v).alias("v")) for i, v in enumerate(votes)])
        against = -1.0 / (n - 1)

        def mean(k: Column) -> Column:
            return F.aggregate("_cast", F.lit(0.0), lambda a, c: a + c["v"] * F.when(c["k"] == k, 1.0).otherwise(against)) / sum(votes)

        every = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), mean)
        scored = dataset.withColumn("_cast", cast).withColumn("_decision", every)
        scored = scored.withColumn("_powers", F.transform("_decision", lambda d: F.exp(d / (n - 1))))
        scored = scored.withColumn("_total", F.aggregate("_powers", F.lit(0.0), lambda a, v: a + v))
        shares = F.transform("_powers", lambda v: v / F.col("_total"))
        left = [f"_{part}_{i}" for part in ("stump", "raw", "probability") for i in range(len(votes))]
        return scored.withColumns({"prediction": _chosen(F.col("_decision")), "probability": array_to_vector(shares)}).drop(
            "_cast", "_decision", "_powers", "_total", *left
        )
