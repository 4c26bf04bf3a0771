"""Writing tables: once, or in place of an earlier export."""

from __future__ import annotations

import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession

#: What Spark's committer leaves in a folder whose table is whole.
MARKER = "_SUCCESS"


def _files(spark: SparkSession, path: str):
    """The file context of the path's store, and the path."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), spark.sparkContext._jsc.hadoopConfiguration()), target


def _exists(spark: SparkSession, path: str) -> bool:
    files, target = _files(spark, path)
    return files.util().exists(target)


def is_landed(spark: SparkSession, path: str) -> bool:
    """A folder without the marker of a finished write holds nothing that counts."""
    return _exists(spark, f"{path}/{MARKER}")


def _move(spark: SparkSession, source: str, path: str) -> bool:
    """Rename unless something is there, in one step of the store; False if something is."""
    files, target = _files(spark, path)
    gateway = spark.sparkContext._gateway
    jvm = spark.sparkContext._jvm
    none = gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
    try:
        files.rename(jvm.org.apache.hadoop.fs.Path(source), target, none)
    except Py4JJavaError as error:
        if "FileAlreadyExistsException" in error.java_exception.getClass().getName():
            return False
        raise
    return True


def _drop(spark: SparkSession, path: str) -> None:
    files, target = _files(spark, path)
    if files.util().exists(target):
        files.delete(target, True)


def land_once(df: DataFrame, path: str) -> bool:
    """Store the table unless a whole one is there already; says whether this call stored it.

    The table is written beside its place and takes it by a rename, which the store does in one
    step: readers see all of it or none. A write that fails leaves no trace at the place, and its
    error is raised; the next landing stores its own rows. Of two landings at once the
    first to finish takes the place, and the other drops what it wrote. A folder that
    another tool left without a marker of completion is put aside as ``<path>.incomplete-<id>``.
    """
    spark = df.sparkSession
    path = path.rstrip("/")
    if is_landed(spark, path):
        return False
    mark = uuid.uuid4().hex
    staged = f"{path}.landing-{mark}"
    try:
        df.write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "true").parquet(staged)
        while not _move(spark, staged, path):
            if is_landed(spark, path):
                return False
            _move(spark, path, f"{path}.incomplete-{mark}")
        return True
    finally:
        _drop(spark, staged)


def export_csv(df: DataFrame, path: str) -> None:
    """Delimited text with a header, replacing an earlier export."""
    df.write.mode("overwrite").option("header", True).csv(path)
