"""Places of a column's values in their own order, as a table instead of a list.

The different values of a column are ordered by ranges on Spark, numbered by running totals and
stored as Parquet. A fitted dictionary is attached to rows by a join: sent to all tasks while its
counted size allows, by a shuffle beyond it. No list of values reaches the driver.
"""

from __future__ import annotations

from pyspark import keyword_only
from pyspark.ml import Model
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasHandleInvalid, HasInputCols, HasOutputCols
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsReader, DefaultParamsWriter, MLWritable
from pyspark.sql import DataFrame, SparkSession, functions as F

from tabscope.functions.columns import ref
from tabscope.operators.joining import BROADCAST_ROWS
from tabscope.operators.ordering import running_totals
from tabscope.workspace import materialize, new_path

TABLE = "dictionary"


def _values(df: DataFrame, column: str) -> DataFrame:
    values = df.select(ref(column).alias("v")).where("v IS NOT NULL").distinct()
    return values.select("v", F.col("v").cast("string").alias("t"))


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    """``v`` and its text ``t``, one row per value that is present."""
    return materialize(_values(df, column), "values")


def first_values(df: DataFrame, column: str, n: int) -> list[str]:
    """The texts of the column's first ``n`` values in their own order, found in one job."""
    return [r["t"] for r in _values(df, column).orderBy("v").limit(n).collect()]


def numbered(values: DataFrame) -> DataFrame:
    """``t, place``: numbers by value, texts by letter, from 0."""
    placed = running_totals(values.withColumn("one", F.lit(1).cast("long")), [], "v", ["one"])
    return placed.select("t", F.col("before_one").alias("place"))


def store_dictionary(spark: SparkSession, values: list[DataFrame]) -> tuple[str, list[int]]:
    """Numbers the values of several columns and stores them; the folder, and how many each column has."""
    folder = new_path(spark, TABLE)
    for i, own in enumerate(values):
        numbered(own).write.parquet(f"{folder}/column={i}")
    return folder, [own.count() for own in values]


class ValueDictionaryModel(Model, HasInputCols, HasOutputCols, HasHandleInvalid, DefaultParamsReadable, MLWritable):
    """Adds each input column's place as a DOUBLE. Values that were not fitted, and NULL, raise
    (``error``), get the place after the last (``keep``), or their rows go (``skip``)."""

    folder = Param(Params._dummy(), "folder", "where the dictionaries are stored", TypeConverters.toString)
    sizes = Param(Params._dummy(), "sizes", "values of each column", TypeConverters.toListInt)

    @keyword_only
    def __init__(self, *, inputCols=None, outputCols=None, handleInvalid="error", folder=None, sizes=None):
        super().__init__()
        self._setDefault(handleInvalid="error")
        self._set(**self._input_kwargs)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        spark, invalid = dataset.sparkSession, self.getOrDefault("handleInvalid")
        folder, sizes = self.getOrDefault(self.folder), self.getOrDefault(self.sizes)
        out = dataset
        for i, (column, output) in enumerate(zip(self.getInputCols(), self.getOutputCols())):
            own = spark.read.schema("t string, place long").parquet(f"{folder}/column={i}")
            own = own.select(F.col("t").alias(f"_text_{i}"), F.col("place").alias(f"_place_{i}"))
            if sizes[i] <= BROADCAST_ROWS:
                own = F.broadcast(own)
            joined = out.join(own, ref(column).cast("string") == ref(f"_text_{i}"), "inner" if invalid == "skip" else "left")
            place = ref(f"_place_{i}").cast("double")
            if invalid == "keep":
                place = F.coalesce(place, F.lit(float(sizes[i])))
            elif invalid == "error":
                said = F.concat(F.lit(f"value of {column} that was not fitted: "), F.coalesce(ref(column).cast("string"), F.lit("NULL")))
                place = F.when(place.isNull(), F.raise_error(said)).otherwise(place)
            out = joined.select(*[ref(c) for c in out.columns], place.alias(output))
        return out

    def write(self) -> DefaultParamsWriter:
        return _Writer(self)

    @classmethod
    def read(cls) -> DefaultParamsReader:
        return _Reader(cls)


class _Writer(DefaultParamsWriter):
    """The dictionaries go with the model."""

    def saveImpl(self, path: str) -> None:
        super().saveImpl(path)
        model, spark = self.instance, self.sparkSession
        for i in range(len(model.getInputCols())):
            spark.read.parquet(f"{model.getOrDefault(model.folder)}/column={i}").write.parquet(f"{path}/{TABLE}/column={i}")


class _Reader(DefaultParamsReader):
    def load(self, path: str) -> ValueDictionaryModel:
        model = super().load(path)
        return model._set(folder=f"{path}/{TABLE}")
