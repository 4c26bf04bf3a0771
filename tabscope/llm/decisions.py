"""Carrying an operator's decisions back to the documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tabscope.functions.columns import ref
from tabscope.workspace import materialize

SENT_KEYS = 1_000_000  # keys that are sent to the documents; more are joined by a shuffle


def row_key(id_col: str = "doc_id", text_col: str = "text") -> Column:
    """What tells rows apart whose ids are equal but whose texts are not; never null."""
    return F.struct(ref(id_col).alias("id"), F.xxhash64(ref(text_col)).alias("text"))


def _unused(docs: DataFrame, name: str = "_key") -> str:
    """A name that no column of ``docs`` has."""
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name += "_"
    return name


def without(docs: DataFrame, keys: DataFrame, sent: int = SENT_KEYS) -> DataFrame:
    """``docs`` less the rows whose ``row_key`` is in ``keys`` (column ``key``)."""
    return _matched(docs, keys, "left_anti", sent)


def _matched(docs: DataFrame, keys: DataFrame, how: str, sent: int = SENT_KEYS) -> DataFrame:
    name = _unused(docs)
    stored = materialize(keys.select(F.col("key").alias(name)).distinct(), "keys")
    if stored.count() <= sent:
        stored = F.broadcast(stored)
    return docs.join(stored, row_key() == F.col(name), how)


def one_of_each(docs: DataFrame, found: DataFrame) -> DataFrame:
    """The first document of each group: ``found`` has ``key, component_id`` (a key) of every row.

    Of rows whose id and text are both equal, one stays.
    """
    found = materialize(found.select("key", "component_id"), "groups")
    kept = without(docs, found.where("key <> component_id"))
    repeated = found.where("key = component_id").groupBy("key").count().where("count > 1").select("key")
    repeated = materialize(repeated, "repeated")
    if repeated.isEmpty():
        return kept
    name = _unused(docs)
    once = _matched(kept, repeated, "left_semi").withColumn(name, row_key()).dropDuplicates([name]).drop(name)
    return without(kept, repeated).unionByName(once)
