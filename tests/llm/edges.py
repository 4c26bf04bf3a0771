"""Rows that every operator must take, and the operators as functions of a table."""

from __future__ import annotations

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tabscope.llm import cross_entropy, decontaminate, fingerprints, language, licenses, packing, secrets, simhash, tokens, toxicity
from tabscope.session import let_workers_import

LONG = "Lorem ipsum dolor sit amet, under the MIT License. " * 4000
TEXTS = [
    (1, None), (2, ""), (3, " \n\t "), (4, "a"), (5, LONG), (6, "token = 0123456789abcdef0123456789abcdef01234567"),
    (7, "éß日本語 \U0001f600 \x00 <|endoftext|>"), (8, "same words here again"), (9, "same words here again"),
    (9, "same words here again"), (9, "another text of the same id"), (None, "a row without an id"), (10, "2 ² Ⅷ !!"),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, row string, key int, label string, score string, bucket int, word string, spans string, base_spans int, _tried string, _hex int, _key string, c0 string, `a.b` int"


def documents(spark: SparkSession, rows: list | None = None) -> DataFrame:
    """The rows with columns whose names the operators use inside."""
    let_workers_import(spark)
    rows = TEXTS if rows is None else rows
    return spark.createDataFrame([(i, t, "en" if i else None, "s", len(t or ""), 7, "r", 1, "l", "x", 0, "w", "s", 2, "t", 3, "k", "c", 4) for i, t in rows], SCHEMA)


def labels(spark: SparkSession, rows: list | None = None) -> DataFrame:
    rows = [(4, 1, 0), (5, 1, 1), (5, 0, 0), (8, None, None), (None, 1, 1), (99, 1, 1)] if rows is None else rows
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def benchmark(spark: SparkSession, rows: list | None = None) -> DataFrame:
    rows = [("b", "same words here again"), ("a", "Same, words: here AGAIN"), ("b", None), (None, "a"), ("c", ""), ("c", LONG)] if rows is None else rows
    return spark.createDataFrame(rows, "item_id string, text string")


PIECES, BYTES, WORDS = (public_tokenizers.path(n) for n in ("piece_bpe_32k.model", "byte_bpe_50k.json", "word_bpe_49k.json"))

OPERATORS = {
    "licenses": licenses.license_scan,
    "secrets": secrets.secret_scan,
    "simhash": simhash.near_duplicates,
    "tokens": lambda docs: tokens.token_counts(docs, BYTES),
    "decontaminate": lambda docs: decontaminate.contamination(docs, benchmark(docs.sparkSession)),
    "language": lambda docs: language.identify(docs, PIECES),
    "toxicity": lambda docs: toxicity.toxicity(docs, labels(docs.sparkSession)),
    "cross_entropy": lambda docs: cross_entropy.cross_entropy_difference(docs, labels(docs.sparkSession)),
    "packing": lambda docs: packing.packed(packing.pieces(docs, WORDS)),
    "fingerprints": fingerprints.edited_fingerprints,
}
STAGES = dict(corpus_pipeline.STAGES)
