"""History of runs: one row per run, appended to a Parquet table."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F


def append_run(run: DataFrame, path: str) -> str:
    """Append the one-row ``run`` with a new ``_id`` and the time; returns the id."""
    identity = str(uuid.uuid4())
    stamped = run.select(F.lit(identity).alias("_id"), F.current_timestamp().alias("date"), *run.columns)
    stamped.write.mode("append").parquet(path)
    return identity


# What every run has; what a flattened run is made of.
RUN = "_id string, date timestamp"
EVALUATION_RUN = (
    "_id string, model_name string, date timestamp, training_result struct<accuracy: double, roc_score: double>,"
    " testing_result struct<accuracy: double, roc_score: double>, cross_validation double"
)


def _exists(spark: SparkSession, path: str) -> bool:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def list_runs(spark: SparkSession, path: str, schema: str = RUN) -> DataFrame:
    """All runs stored so far, id as text; none before the first run. Read it before appending to
    leave the current run out."""
    if not _exists(spark, path):
        return spark.createDataFrame([], schema)
    runs = spark.read.option("mergeSchema", True).parquet(path)
    return runs.withColumn("_id", F.col("_id").cast("string"))


def find_run(spark: SparkSession, path: str, identity: str, columns: list[str] | None = None) -> DataFrame:
    """The run with this id, all columns or the named ones."""
    schema = ", ".join([RUN, *(f"{c} string" for c in columns or [] if c not in ("_id", "date"))])
    run = list_runs(spark, path, schema).filter(F.col("_id") == identity)
    return run.select(*columns) if columns else run


def flatten_runs(spark: SparkSession, path: str) -> DataFrame:
    """Evaluation runs as a flat table for reporting tools."""
    return list_runs(spark, path, EVALUATION_RUN).select(
        "_id",
        "model_name",
        "date",
        F.col("training_result.accuracy").alias("training_accuracy"),
        F.col("testing_result.accuracy").alias("testing_accuracy"),
        "cross_validation",
        F.col("training_result.roc_score").alias("training_roc_score"),
        F.col("testing_result.roc_score").alias("testing_roc_score"),
    )
