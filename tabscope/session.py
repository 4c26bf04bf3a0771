"""Session settings the library relies on."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"

SETTINGS = {
    "spark.sql.ansi.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # call sites of column expressions are for error messages only and slow down plan building
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def get_session(app_name: str = "tabscope", master: str | None = None, **extra: str) -> SparkSession:
    """Create or reuse a session. Shuffle width and memory stay with the cluster's own settings."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def let_workers_import(spark: SparkSession) -> None:
    """Name this checkout on the path of the Python workers, and bound what is sent to them at once.

    Executors on other machines need the package themselves (``--py-files`` or an
    installation); there the path is not found and ignored. A batch of rows is cut by its
    bytes, as texts may be long; a session's own setting stays.
    """
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    environment = spark.sparkContext.environment
    paths = [p for p in environment.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        environment["PYTHONPATH"] = os.pathsep.join([root, *paths])
    if spark.sparkContext.getConf().get(BATCH_BYTES) is None:
        spark.conf.set(BATCH_BYTES, str(8 << 20))
