"""Benchmark decontamination by winnowing.

Items and documents are reduced to fingerprints: of every ``window - gram + 1`` consecutive
hashes of ``gram`` words the least is kept, all of them when several are equal. A passage of
``window`` shared words holds one such run, and both sides keep the same hash of it, so no
shared passage is missed. The fingerprints are joined, and each hit is extended: every
window of the document that holds the hit is compared, word by word, with the items' windows.
Items shorter than a window are one window of their own length, of which every hash is kept.

The items are read in blocks of bounded size. A block reaches each task as a table of its
windows; all documents are run against it, and what the blocks found is joined per document.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from tabscope.functions.columns import ref
from tabscope.llm.texts import flat, gram_hashes, keyed_text, slices, span_hashes, words
from tabscope.workspace import materialize

GRAM = 7
BLOCK_BYTES = 32 << 20
SLICE = 1 << 18  # bytes of text that a task looks through at a time; its arrays take some 40 times as much


def kept(hashes: np.ndarray, span: int) -> np.ndarray:
    """Places of hashes that are the least of some ``span`` consecutive ones."""
    if len(hashes) < span:
        return np.empty(0, np.int64)
    least = hashes[: len(hashes) - span + 1].copy()
    for i in range(1, span):
        np.minimum(least, hashes[i : i + len(least)], out=least)
    # a hash is kept if it equals the largest of the minima of the spans it stands in
    padded = np.concatenate([np.zeros(span - 1, np.uint64), least, np.zeros(span - 1, np.uint64)])
    most = padded[: len(hashes)].copy()
    for i in range(1, span):
        np.maximum(most, padded[i : i + len(hashes)], out=most)
    return np.flatnonzero(most == hashes)


@dataclass
class Block:
    """The windows of some items, by their words, and their fingerprints by gram length."""

    window: int
    gram: int
    windows: dict[bytes, set[str | None]] = field(default_factory=dict)
    prints: dict[int, np.ndarray] = field(default_factory=dict)  # window length -> sorted hashes

    @classmethod
    def of(cls, items: list[tuple[str | None, str]], window: int, gram: int) -> Block:
        block, found = cls(window, gram), {}
        for item, text in items:
            lower, starts, ends, _ = words(*flat(pa.array([text], pa.string())))
            n = min(window, len(starts))
            if not n:
                continue
            own = [lower[a:b].tobytes() for a, b in zip(starts, ends)]
            for i in range(len(own) - n + 1):
                block.windows.setdefault(b" ".join(own[i : i + n]), set()).add(item)
            hashes = gram_hashes(span_hashes(lower, starts, ends), block.gram_of(n))
            found.setdefault(n, []).append(hashes[kept(hashes, n - block.gram_of(n) + 1)])
        block.prints = {n: np.unique(np.concatenate(h)) for n, h in found.items()}
        return block

    def gram_of(self, n: int) -> int:
        """Words to a hash for windows of ``n``; short windows are hashed whole."""
        return min(self.gram, n) if n == self.window else n


def document_hits(texts: pa.Array, block: Block) -> Iterator[tuple[int, np.ndarray, set[str | None]]]:
    """Number of words, marks of the words hit, and the items, for each text."""
    lower, starts, ends, first = words(*flat(texts))
    hashes = span_hashes(lower, starts, ends)
    hit = np.zeros(len(starts) + 1, np.int32)
    items: dict[int, set[str]] = {}
    for n, prints in block.prints.items():
        gram = block.gram_of(n)
        grams = gram_hashes(hashes, gram)
        at = kept(grams, n - gram + 1)  # runs over two documents add places, they take none away
        if not len(at):
            continue
        near = prints[np.minimum(np.searchsorted(prints, grams[at]), len(prints) - 1)] == grams[at]
        begins = np.unique((at[near][:, None] - np.arange(n - gram + 1)).ravel())
        begins = begins[(begins >= 0) & (begins + n <= len(starts))]
        doc = np.searchsorted(first, begins, "right") - 1
        inside = begins + n <= first[doc + 1]
        for begin, row in zip(begins[inside].tolist(), doc[inside].tolist()):
            key = b" ".join(lower[a:b].tobytes() for a, b in zip(starts[begin : begin + n], ends[begin : begin + n]))
            owners = block.windows.get(key)
            if owners:
                hit[begin] += 1
                hit[begin + n] -= 1
                items.setdefault(row, set()).update(owners)
    marks = np.cumsum(hit)[:-1] > 0
    for row in range(len(texts)):
        yield int(first[row + 1] - first[row]), marks[first[row] : first[row + 1]], items.get(row, set())


def _spans(marks: np.ndarray) -> list[list[int]]:
    edges = np.flatnonzero(np.diff(np.concatenate([[False], marks, [False]]).astype(np.int8)))
    return edges.reshape(-1, 2).tolist()


#: Spans that overlap or meet made one.
_MERGED = """aggregate(array_sort(spans), CAST(array() AS ARRAY<ARRAY<BIGINT>>), (done, s) ->
  IF(size(done) > 0 AND element_at(done, -1)[1] >= s[0],
     concat(slice(done, 1, size(done) - 1), array(array(element_at(done, -1)[0], greatest(element_at(done, -1)[1], s[1])))),
     concat(done, array(s))))"""


def contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    window: int = 13,
    gram: int = GRAM,
    one_in: int = 20,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """One row per document: ``id_col, n_words, n_hit, n_items, items, hit_spans, items_sha256, contaminated``.

    ``items``: the ids of the items with a window in the document, as text, sorted;
    ``hit_spans``: first word and the one after the last of each run of hit words;
    ``contaminated``: some word is hit, and one in ``one_in`` or more. A null text has no
    words; an item without words is no window; items of equal id count once. Items without an
    id hit like any other and count as one item in ``n_items``, but have no place in ``items``. Repeated
    documents give a row each. Without items every document is clean; an empty table gives
    no rows.
    """
    if not 1 <= gram <= window:
        raise ValueError("gram must lie between 1 and window")
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType
    schema = T.StructType(
        [
            T.StructField("id", kind),
            T.StructField("row", T.LongType()),
            T.StructField("n_words", T.LongType()),
            T.StructField("spans", T.ArrayType(T.ArrayType(T.LongType()))),
            T.StructField("items", T.ArrayType(T.StringType())),
            T.StructField("unnamed", T.BooleanType()),
        ]
    )
    items = materialize(
        benchmark.select(ref(item_col).cast("string").alias("item"), ref(item_text_col).alias("text")).where("text IS NOT NULL"),
        "items",
    )
    total = items.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0
    blocks = max(1, -(-total // block_bytes))
    part = F.pmod(F.xxhash64("item", "text"), F.lit(blocks))
    texts = keyed_text(docs, id_col, text_col)
    if blocks > 1:  # rows are told apart by a number while what the blocks found is joined
        texts = materialize(texts.withColumn("row", F.monotonically_increasing_id()), "texts")
    else:
        texts = texts.withColumn("row", F.lit(0).cast("long"))

    def scanned(number: int) -> DataFrame:
        rows = items.where(part == number).collect()  # about block_bytes
        shared = spark.sparkContext.broadcast(Block.of([(r.item, r.text) for r in rows], window, gram))

        def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches, max_bytes=SLICE):
                n_words, spans, owners, unnamed = [], [], [], []
                for n, marks, ids in document_hits(batch["text"], shared.value):
                    n_words.append(n)
                    spans.append(_spans(marks) if ids else [])
                    owners.append(sorted(i for i in ids if i is not None))
                    unnamed.append(None in ids)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch["id"],
                        batch["row"],
                        pa.array(n_words, pa.int64()),
                        pa.array(spans, pa.list_(pa.list_(pa.int64()))),
                        pa.array(owners, pa.list_(pa.string())),
                        pa.array(unnamed, pa.bool_()),
                    ],
                    names=[f.name for f in schema],
                )

        return texts.select("id", "row", "text").mapInArrow(scan, schema)

    found = reduce(DataFrame.unionByName, map(scanned, range(blocks)))
    if blocks > 1:
        found = (
            found.groupBy("id", "row", "n_words")
            .agg(F.flatten(F.collect_list("spans")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), F.bool_or("unnamed").alias("unnamed"))
            .withColumn("spans", F.expr(_MERGED))
        )
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda total, s: total + s[1] - s[0])
    return found.select(
        ref("id").alias(id_col),
        "n_words",
        n_hit.alias("n_hit"),
        (F.size("items") + F.col("unnamed").cast("int")).cast("long").alias("n_items"),
        "items",
        F.col("spans").alias("hit_spans"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
    ).withColumn("contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") * one_in >= F.col("n_words")))
