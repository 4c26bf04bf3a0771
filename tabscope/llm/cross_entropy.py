"""Cross-entropy difference: target and background n-gram models over one vocabulary.

Both models are interpolated n-gram models of four characters, smoothed alike at every order
towards the order below. The background is all documents, the target those that labels call
good. The vocabulary of both is the characters of the basic plane and one unknown. A
document's score is the mean, over its characters, of the background's loss less the
target's (Moore and Lewis, "Intelligent selection of language model training data", 2010).

The texts are stored in slices of a few MB. Tasks count the n-grams of each slice and send each
distinct one once; all further tables are sums of that one. An n-gram of any document is an n-gram of the
background, so none is unknown when documents are scored. The losses are joined to the slices'
n-grams by a shuffle and meet a slice's texts in one task, which holds no more of the model than
the slice needs; nothing of the model passes the driver.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F, types as T

from tabscope.functions.columns import ref
from tabscope.llm.texts import slices
from tabscope.operators.joining import attach
from tabscope.workspace import materialize

ORDER = 4
UNKNOWN, BEGIN = 0xFFFF, 0xFFFE  # code points that are no characters
PRIOR = 5.0  # n-grams that the lower order counts for
SENT_IDS = 1_000_000  # target ids that are sent to the texts; more are joined by a shuffle
_SLICE = 4 << 20


def ngrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The n-gram that ends at each character, four codes of 16 bits, and where each text begins (and the last ends)."""
    lead = chr(BEGIN) * (ORDER - 1)
    codes = np.frombuffer(lead.join(["", *texts]).encode("utf-32-le"), np.uint32)
    codes = np.where(codes > 0xFFFF, UNKNOWN, codes).astype(np.uint64)
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    grams = codes.copy()
    for i in range(1, ORDER):
        grams[i:] |= codes[:-i] << np.uint64(16 * i)
    own = np.ones(len(codes), bool)
    begins = np.cumsum(lengths) - lengths + (ORDER - 1) * np.arange(len(texts))
    for i in range(ORDER - 1):
        own[begins + i] = False
    return grams[own], np.concatenate([[0], np.cumsum(lengths)])


def numbered(texts: DataFrame) -> DataFrame:
    """``texts`` (``id, text, good``) stored with the number of the slice that each row belongs to."""

    def number(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 33
        for n, batch in enumerate(slices(batches, max_bytes=_SLICE)):
            yield batch.append_column("slice", pa.array(np.full(batch.num_rows, first + n, np.int64)))

    schema = T.StructType([*texts.select("id", "text", "good").schema.fields, T.StructField("slice", T.LongType())])
    return materialize(texts.select("id", "text", "good").mapInArrow(number, schema), "texts")


def count(texts: DataFrame) -> DataFrame:
    """``slice, gram, n, target``: how often each n-gram stands in a slice's texts and in its target texts.

    A slice that is read in parts has a row for each part.
    """

    def parts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, max_bytes=_SLICE):
            own = batch["slice"].to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(own)) + 1).tolist(), batch.num_rows]
            yield from (batch.slice(i, j - i) for i, j in zip(cuts, cuts[1:]))

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            grams, ends = ngrams(batch["text"].to_pylist())
            good = np.repeat(np.asarray(batch["good"].to_pylist(), bool), np.diff(ends))
            found, n = np.unique(grams, return_counts=True)
            own, times = np.unique(grams[good], return_counts=True)
            target = np.zeros(len(found), np.int64)
            target[np.searchsorted(found, own)] = times
            number = np.full(len(found), batch["slice"][0].as_py(), np.int64)
            columns = [number, found.view(np.int64), n, target]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["slice", "gram", "n", "target"])

    return texts.select("text", "good", "slice").mapInArrow(scan, "slice long, gram long, n long, target long")


def _suffix(gram: Column, characters: int) -> Column:
    return gram.bitwiseAND(F.lit((1 << 16 * characters) - 1)) if characters < 4 else gram


def losses(counts: DataFrame, prior: float = PRIOR) -> DataFrame:
    """``gram, background, target``: minus the binary logarithm of each model's probability of the n-gram's last character."""
    totals = counts.agg(F.sum("n").alias("n"), F.sum("target").alias("target")).first()
    size = float(1 << 16)
    lower = None
    for length in range(1, ORDER + 1):
        grams = counts.groupBy(_suffix(F.col("gram"), length).alias("gram")).agg(F.sum("n").alias("n"), F.sum("target").alias("target"))
        if lower is None:
            shares = [((F.col(c) + 1.0) / (float(totals[c] or 0) + size)).alias(f"p_{c}") for c in ("n", "target")]
            lower = grams.select("gram", *shares)
            continue
        context = F.shiftrightunsigned("gram", 16)
        heads = grams.groupBy(context.alias("head")).agg(F.sum("n").alias("all_n"), F.sum("target").alias("all_target"))
        below = lower.select(F.col("gram").alias("tail"), "p_n", "p_target")
        joined = grams.withColumns({"head": context, "tail": _suffix(F.col("gram"), length - 1)}).join(heads, "head").join(below, "tail")
        shares = [((F.col(c) + prior * F.col(f"p_{c}")) / (F.col(f"all_{c}") + prior)).alias(f"p_{c}") for c in ("n", "target")]
        lower = joined.select("gram", *shares)
    return lower.select("gram", (-F.log2("p_n")).alias("background"), (-F.log2("p_target")).alias("target"))


def cross_entropy_difference(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
) -> DataFrame:
    """One row per document: ``id_col, n_tokens, background_loss, target_loss, score``.

    The losses are bits per character, ``score`` is their difference: the higher, the more
    like the target. A text that is null or empty has no characters: its losses are null
    and its score 0. Without target documents the target model is uniform. An id with labels
    0 and 1 is a target. Repeated rows are counted and scored each; an empty table gives no
    rows; other columns are not read.
    """
    target = labels.where((ref(label_col) == 1) & ref(id_col).isNotNull()).select(ref(id_col).alias("id"), F.lit(True).alias("good")).distinct()
    rows = docs.select(ref(id_col).alias("id"), F.coalesce(ref(text_col), F.lit("")).alias("text"))
    flagged = attach(rows, target, ["id"], "left", SENT_IDS).withColumn("good", F.coalesce("good", F.lit(False)))
    texts = numbered(flagged)
    found = materialize(count(texts), "ngrams")
    counts = materialize(found.groupBy("gram").agg(F.sum("n").alias("n"), F.sum("target").alias("target")), "counts")
    needed = found.select("slice", "gram").join(materialize(losses(counts), "losses"), "gram")
    schema = T.StructType(
        [
            T.StructField("id", docs.schema[id_col].dataType),
            T.StructField("n_tokens", T.LongType()),
            T.StructField("background", T.DoubleType()),
            T.StructField("target", T.DoubleType()),
        ]
    )

    def score(texts: pa.Table, model: pa.Table) -> pa.Table:
        keys, first = np.unique(model["gram"].to_numpy().view(np.uint64), return_index=True)
        grams, ends = ngrams(texts["text"].to_pylist())
        at = np.searchsorted(keys, grams)  # every n-gram of a slice is among its own
        sums = []
        for name in ("background", "target"):
            total = np.concatenate([[0.0], np.cumsum(model[name].to_numpy()[first][at])])
            sums.append(pa.array(total[ends[1:]] - total[ends[:-1]]))
        return pa.Table.from_arrays([texts["id"], pa.array(np.diff(ends)), *sums], names=[f.name for f in schema])

    sums = texts.select("id", "text", "slice").groupBy("slice").cogroup(needed.groupBy("slice")).applyInArrow(score, schema)
    return sums.select(
        ref("id").alias(id_col),
        "n_tokens",
        F.try_divide("background", "n_tokens").alias("background_loss"),
        F.try_divide("target", "n_tokens").alias("target_loss"),
    ).withColumn("score", F.coalesce(F.col("background_loss") - F.col("target_loss"), F.lit(0.0)))
