"""Feature stages: scaling, one-hot and label encoding, assembled into one pipeline."""

from __future__ import annotations

from pyspark import keyword_only
from pyspark.ml import Estimator, Pipeline, PipelineModel
from pyspark.ml.feature import (
    FeatureHasher,
    IndexToString,
    OneHotEncoder,
    SQLTransformer,
    StringIndexerModel,
    VectorAssembler,
)
from pyspark.ml.param.shared import HasHandleInvalid, HasInputCols, HasOutputCols
from pyspark.sql import DataFrame, functions as F

from tabscope.functions.columns import ref
from tabscope.operators.cleaning import Roles
from tabscope.operators.dictionary import ValueDictionaryModel, distinct_values, first_values, store_dictionary
from tabscope.operators.profile import COLUMNS_PER_SCAN, top_values

HASH_WIDTH = 1 << 10


def _sql_name(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def _sql_text(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def scaling_constants(df: DataFrame, columns: list[str]) -> dict[str, tuple[float, float]]:
    """Mean and population deviation per column; a constant column keeps deviation 1."""
    constants: dict[str, tuple[float, float]] = {}
    for at in range(0, len(columns), COLUMNS_PER_SCAN):
        names = columns[at : at + COLUMNS_PER_SCAN]
        row = df.agg(
            *[F.struct(F.avg(ref(c).cast("double")), F.stddev_pop(ref(c).cast("double"))) for c in names]
        ).first()
        constants.update({c: (row[i][0] or 0.0, row[i][1] or 1.0) for i, c in enumerate(names)})
    return constants


class PopulationScaler(Estimator, HasInputCols, HasOutputCols):
    """Z-scores with the population deviation; fits to a stage that is a plain projection."""

    @keyword_only
    def __init__(self, *, inputCols=None, outputCols=None):
        super().__init__()
        self._set(**self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> SQLTransformer:
        inputs, outputs = self.getOrDefault("inputCols"), self.getOrDefault("outputCols")
        constants = scaling_constants(dataset, inputs)
        scaled = [
            f"(CAST({_sql_name(i)} AS DOUBLE) - ({constants[i][0]!r}D)) / {constants[i][1]!r}D AS {_sql_name(o)}"
            for i, o in zip(inputs, outputs)
        ]
        return SQLTransformer(statement=f"SELECT *, {', '.join(scaled)} FROM __THIS__")


def _indexer_model(spark, labels: list[list[str]], inputs: list[str], outputs: list[str], invalid: str) -> StringIndexerModel:
    # the constructor that takes lists fills them up to equal length with nulls
    gateway = spark.sparkContext._gateway
    arrays = gateway.new_array(gateway.jvm.java.lang.String, len(labels), 0)
    for i, own in enumerate(labels):
        arrays[i] = gateway.new_array(gateway.jvm.java.lang.String, len(own))
        for j, label in enumerate(own):
            arrays[i][j] = label
    model = StringIndexerModel._create_from_java_class("org.apache.spark.ml.feature.StringIndexerModel", arrays)
    return model.setInputCols(inputs).setOutputCols(outputs).setHandleInvalid(invalid)


LISTED_VALUES = 10_000


class ValueIndexer(Estimator, HasInputCols, HasOutputCols, HasHandleInvalid):
    """Places of a column's values in their own order: numbers by value, texts by letter.

    Columns of up to ``LISTED_VALUES`` values become a list in the model; of the others one value more
    reaches the driver, they are numbered on Spark and stay a table (``operators.dictionary``).
    """

    @keyword_only
    def __init__(self, *, inputCols=None, outputCols=None, handleInvalid="error"):
        super().__init__()
        self._setDefault(handleInvalid="error")
        self._set(**self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> StringIndexerModel | ValueDictionaryModel | PipelineModel:
        inputs, outputs = self.getOrDefault("inputCols"), self.getOrDefault("outputCols")
        spark, invalid = dataset.sparkSession, self.getOrDefault("handleInvalid")
        listed = {c: first_values(dataset, c, LISTED_VALUES + 1) for c in inputs}
        short = [c for c in inputs if len(listed[c]) <= LISTED_VALUES]
        long = [c for c in inputs if c not in short]
        output = dict(zip(inputs, outputs))
        stages: list = []
        if short:
            stages.append(_indexer_model(spark, [listed[c] for c in short], short, [output[c] for c in short], invalid))
        if long:
            folder, sizes = store_dictionary(spark, [distinct_values(dataset, c) for c in long])
            stages.append(ValueDictionaryModel(inputCols=long, outputCols=[output[c] for c in long], handleInvalid=invalid, folder=folder, sizes=sizes))
        return stages[0] if len(stages) == 1 else PipelineModel(stages=stages)


class ModeImputer(Estimator, HasInputCols):
    """Fills each text column's missing values with its most frequent one, ties by letter; fits to a projection."""

    @keyword_only
    def __init__(self, *, inputCols=None):
        super().__init__()
        self._set(**self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> SQLTransformer:
        inputs = self.getOrDefault("inputCols")
        found = top_values(dataset.select(*[ref(c) for c in inputs]), inputs, k=2).filter(F.col("value").isNotNull())
        modes = {r["column"]: r["value"] for r in found.orderBy("column", F.desc("rank")).collect()}
        filled = [f"COALESCE({_sql_name(c)}, {_sql_text(modes.get(c, ''))}) AS {_sql_name(c)}" for c in inputs]
        names = ", ".join(_sql_name(c) for c in inputs)
        return SQLTransformer(statement=f"SELECT * EXCEPT ({names}), {', '.join(filled)} FROM __THIS__")


def column_transformer(
    roles: Roles, output: str = "features", hashed: list[str] | None = None, unseen: str = "error"
) -> list:
    """Pipeline stages: scaled numbers, then one-hot categories, then untouched columns.

    Columns in ``hashed`` have too many values to list and go through a hashing stage.
    ``unseen='keep'`` gives categories absent from the fitted rows a place of their own.
    """
    hashed = hashed or []
    listed = [c for c in roles.categorical if c not in hashed]
    stages: list = []
    parts: list[str] = []
    if roles.numeric:
        scaled = [f"_scaled_{i}" for i, _ in enumerate(roles.numeric)]
        stages.append(PopulationScaler(inputCols=roles.numeric, outputCols=scaled))
        parts += scaled
    if listed:
        indexed = [f"_index_{i}" for i, _ in enumerate(listed)]
        vectors = [f"_onehot_{i}" for i, _ in enumerate(listed)]
        stages.append(
            ValueIndexer(inputCols=listed, outputCols=indexed, handleInvalid=unseen)
        )
        stages.append(OneHotEncoder(inputCols=indexed, outputCols=vectors, dropLast=False))
        parts += vectors
    if hashed:
        stages.append(FeatureHasher(inputCols=hashed, outputCol="_hashed", numFeatures=HASH_WIDTH))
        parts.append("_hashed")
    parts += roles.passthrough
    stages.append(VectorAssembler(inputCols=parts, outputCol=output, handleInvalid="error"))
    return stages


def label_encoder(column: str, output: str = "label") -> ValueIndexer:
    """Classes in ascending order become 0..n-1."""
    return ValueIndexer(inputCols=[column], outputCols=[output], handleInvalid="error")


def label_decoder(fitted: StringIndexerModel, column: str, output: str) -> IndexToString:
    return IndexToString(inputCol=column, outputCol=output, labels=list(fitted.labelsArray[0]))


def feature_pipeline(roles: Roles, **options) -> Pipeline:
    return Pipeline(stages=column_transformer(roles, **options))
