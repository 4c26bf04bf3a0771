"""A training corpus from raw documents, in five stages.

Each stage gets what the stage before it kept; toxic documents, all but one of each group of
near copies, and documents contaminated by benchmark items go, secrets are masked in the
texts, and what is left is packed into sequences.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from tabscope.llm.decisions import one_of_each, row_key, without
from tabscope.llm.decontaminate import contamination
from tabscope.llm.packing import packed, pieces
from tabscope.llm.queries import table
from tabscope.llm.secrets import find_secrets, masked, train
from tabscope.llm.simhash import near_duplicates
from tabscope.llm.toxicity import without_toxic
from tabscope.workspace import materialize


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the classifier, fitted on ``labels``, takes for toxic.

    A null or empty text is scored like any other; an empty table gives no rows. Equal rows
    are kept or go together.
    """
    return without_toxic(docs, table(spark, sf_dir, "labels"))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies; null and texts without words are one group.

    Of rows equal in id and text one stays. A row without an id is a document of its own.
    """
    found = near_duplicates(docs.select(row_key().alias("key"), "text"), id_col="key")
    return one_of_each(docs, found)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that passages of ``benchmark`` fill to a twentieth or more.

    Null and empty texts have no words and stay, and so does every document if the benchmark is empty. Equal rows
    are kept or go together.
    """
    found = contamination(docs.select(row_key().alias("key"), "text"), table(spark, sf_dir, "benchmark"), id_col="key")
    return without(docs, found.where("contaminated"))


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, with its secrets masked and ``n_chars`` that of the masked text.

    Texts without a secret, null and empty ones among them, stay as they are. Other columns are
    carried under names of their own, so none clashes with what the search adds.
    """
    read = ("doc_id", "text", "n_chars")
    own = docs.toDF(*[c if c in read else f"_held_{i}" for i, c in enumerate(docs.columns)])
    found = masked(find_secrets(own, train(own)))
    length = F.when(F.size("spans") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return found.withColumn("n_chars", length).select(*own.columns).toDF(*docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences of at most 2048 tokens; a null or empty text is its end token alone."""
    return packed(pieces(docs, public_tokenizers.path("word_bpe_49k.json"), slice_bytes=1 << 20))


STAGES = [
    ("toxicity", toxicity_stage),
    ("near_dedup", near_dedup_stage),
    ("decontamination", decontamination_stage),
    ("secrets", secrets_stage),
    ("packing", packing_stage),
]

#: Tokenizers, hashes and fitted models are beyond SQL; tests hold the rows against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
