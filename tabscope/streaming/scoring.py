"""Scoring of records as they arrive."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml import PipelineModel
from pyspark.ml.feature import StringIndexerModel
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery

from tabscope.functions.columns import ref
from tabscope.operators.cleaning import Roles
from tabscope.operators.dictionary import ValueDictionaryModel
from tabscope.operators.models import score


def arriving_files(spark: SparkSession, folder: str, schema: T.StructType, files_per_batch: int = 100) -> DataFrame:
    """A stream of the Parquet files that land in ``folder``."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def score_stream(
    model: PipelineModel, records: DataFrame, keep: list[str], target_folder: str, checkpoint: str
) -> StreamingQuery:
    """Score all files present, batch by batch, and stop; a restart continues at the checkpoint.

    Scoring a record needs no other record, so there is no state and no watermark.
    """
    return (
        score(model, records, keep)
        .writeStream.format("parquet")
        .option("path", target_folder)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )


PROBLEMS = "problems"


def _stages(model: PipelineModel) -> list:
    return [inner for s in model.stages for inner in (_stages(s) if isinstance(s, PipelineModel) else [s])]


def _problem(name: str, wrong: Column, what: str) -> Column:
    return F.when(F.coalesce(wrong, F.lit(True)), F.lit(f"{name}: {what}"))


def checked(model: PipelineModel, records: DataFrame, roles: Roles) -> DataFrame:
    """``records`` with ``problems``, an array of what keeps the model from scoring a record; empty for a good one.

    A number must be present and finite, a category one of the fitted values. Columns of
    many values, whose places are a stored table, are joined with it.
    """
    found = [
        _problem(c, ~F.abs(ref(c).cast("double")).between(0.0, 1.7976931348623157e308), "no number")
        for c in [*roles.numeric, *roles.passthrough]
    ]
    added: list[str] = []
    for stage in _stages(model)[1:]:
        if isinstance(stage, StringIndexerModel):
            for c, labels in zip(stage.getInputCols(), stage.labelsArray):
                found.append(_problem(c, ~ref(c).cast("string").isin(list(labels)), "not fitted"))
        elif isinstance(stage, ValueDictionaryModel):
            columns = stage.getOrDefault("inputCols")
            places = [f"_place_of_{i}" for i, _ in enumerate(columns)]
            looked = stage.copy({stage.outputCols: places, stage.handleInvalid: "keep"})
            records = looked.transform(records)
            sizes = stage.getOrDefault("sizes")
            found += [_problem(c, F.col(p) >= n, "not fitted") for c, p, n in zip(columns, places, sizes)]
            added += places
    return records.withColumn(PROBLEMS, F.array_compact(F.array(*found)) if found else F.expr("CAST(array() AS ARRAY<STRING>)")).drop(*added)


def batch_writer(
    model: PipelineModel, roles: Roles, keep: list[str], target_folder: str, side_folder: str
) -> Callable[[DataFrame, int], None]:
    """Writes a batch's scores and its unusable records, each to a folder named by the batch's number.

    A batch that comes again, after a failure between writing and committing, replaces its
    own folders, so no record is there twice.
    """

    def write(batch: DataFrame, number: int) -> None:
        known = checked(model, batch, roles)
        good = known.filter(F.size(PROBLEMS) == 0).drop(PROBLEMS)
        score(model, good, keep).write.mode("overwrite").parquet(f"{target_folder}/batch={number}")
        known.filter(F.size(PROBLEMS) > 0).write.mode("overwrite").parquet(f"{side_folder}/batch={number}")

    return write


def score_good_records(
    model: PipelineModel, records: DataFrame, roles: Roles, keep: list[str], target_folder: str, side_folder: str, checkpoint: str
) -> StreamingQuery:
    """As ``score_stream``, but a record that the model cannot score goes to ``side_folder`` with its problems.

    Both folders have a column ``batch``. A stream must keep its checkpoint as long as its
    folders: a new checkpoint numbers its batches from 0 and would replace them.
    """
    write = batch_writer(model, roles, keep, target_folder, side_folder)
    return records.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
