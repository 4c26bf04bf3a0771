"""Toxicity by a linear classifier over character n-grams.

A feature is the presence of an n-gram of the lower-cased text's characters; white space is one
mark, which is also set where a word begins or ends. Its value is the naive Bayes
log-count ratio of the n-gram in toxic and other texts (Wang and Manning, "Baselines and
bigrams", 2012). The n-grams that tell the labels apart most, by the chi-square of their presence,
are kept; a logistic regression on their scaled values is fitted on a bounded sample of
labelled rows. Every text is scored whole.

Short n-grams are hashed to a table. Long ones are many and each rare, so they have hashes
of 43 bits; they are counted in toxic texts first, and in the others where they could reach the
chi-square needed.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import DataFrame, functions as F, types as T

from tabscope.functions.columns import ref
from tabscope.llm.texts import bucket_of, keyed_text, slices
from tabscope.workspace import materialize

SHORT, LONG = (2, 3, 4, 5), (6, 8, 10)
HASH_BITS = 21
LONG_BITS, ROW_BITS = 43, 20
FILTER_BITS = 24
FEATURES = 32_768
TRAIN_ROWS = 20_000
LEAST_TEXTS = 3
SLICE = 1 << 19  # bytes of text whose n-grams are counted at a time
BLOCK = 1 << 15  # characters of text whose n-grams are made at a time; few, to stay in the processor's cache
NEAR_BITS = 18
WAITING = 1 << 20  # keys that wait to be merged
LEAST_CHI = 24.0  # of hundreds of thousands of n-grams, few reach this by chance
REGULARIZATION = 3e-5


@cache
def _classes() -> np.ndarray:
    """Of each code point: 1 in words (letters, digits and their marks), 2 white space, 0 other."""
    return np.frombuffer(bytes(1 if unicodedata.category(c)[0] in "LNM" else 2 * c.isspace() for c in map(chr, range(0x110000))), np.uint8)


def _coded(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Characters and their rows, in blocks; each begins with the last characters of the one before."""
    parts = [f"\n{t.lower()}\n" for t in texts]
    begins = np.cumsum([0, *map(len, parts)], dtype=np.int64)
    whole, classes, mark = "".join(parts), _classes(), np.uint32(32)
    codes, rows, last = np.empty(0, np.uint32), np.empty(0, np.int64), np.uint8([2])
    for low in range(0, len(whole), BLOCK):
        code = np.frombuffer(whole[low : low + BLOCK].encode("utf-32-le"), np.uint32)
        kind = classes.take(code, mode="clip")
        before = np.append(last, kind[:-1])
        last = kind[-1:]
        first, end = np.searchsorted(begins, (low, low + len(code) - 1), "right") + (-1, 0)  # the block's rows
        bounds = np.clip(begins[first : end + 1] - low, 0, len(code))
        again = (kind & before) == 2
        again[bounds[:-1][begins[first:end] >= low]] = False  # the white space before is another row's
        gone, edge = np.flatnonzero(again), np.flatnonzero((kind ^ before) == 1)
        code = np.insert(np.where(kind == 2, mark, code)[~again], edge - np.searchsorted(gone, edge), mark)
        row = np.repeat(np.arange(first, end), np.diff(bounds - np.searchsorted(gone, bounds) + np.searchsorted(edge, bounds)))
        code, row = np.concatenate([codes, code]), np.concatenate([rows, row])
        yield code, row
        codes, rows = code[1 - LONG[-1] :], row[1 - LONG[-1] :]


def _hashed(codes: np.ndarray, orders: tuple[int, ...]) -> Iterator[tuple[int, np.ndarray]]:
    """Each order, and 64-bit hashes of the n-grams from every place on, also those that run into the next row."""
    codes = codes.astype(np.uint64)
    h, high = np.zeros(len(codes), np.uint64), np.empty(len(codes), np.uint64)
    for i in range(min(orders[-1], len(codes))):
        h = h[: len(codes) - i]
        h += codes[i:]
        h *= np.uint64(0x9E3779B97F4A7C15)
        h ^= np.right_shift(h, np.uint64(32), out=high[: len(h)])
        if i + 1 in orders:
            yield i + 1, (h + np.uint64(i)) * np.uint64(0xBF58476D1CE4E5B9)


def _looked_up(table: np.ndarray, h: np.ndarray) -> np.ndarray:
    """The table's entries by the first bits of hashes."""
    return table.take((h >> np.uint64(65 - len(table).bit_length())).view(np.int64), mode="clip")


def _within(rows: np.ndarray, order: int) -> np.ndarray:
    """Of each place, whether an n-gram from it on ends in the same row."""
    return rows[: len(rows) - order + 1] == rows[order - 1 :]


def short_present(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Row and hash of every short n-gram that a text holds."""

    def keys() -> Iterator[np.ndarray]:
        for codes, rows in _coded(texts):
            for order, h in _hashed(codes, SHORT):
                key = rows[: len(h)] << HASH_BITS | (h >> np.uint64(64 - HASH_BITS)).view(np.int64)
                yield key[_within(rows, order)]

    key = _distinct(keys(), np.int64)
    return key >> HASH_BITS, key & ((1 << HASH_BITS) - 1)


def long_counts(texts: list[str], wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every long n-gram and the number of texts that hold it; ``wanted`` tells by the first bits which to count."""

    def keys(some: list[str]) -> Iterator[np.ndarray]:
        for codes, rows in _coded(some):
            for order, h in _hashed(codes, LONG):
                own = _within(rows, order)
                if wanted is not None:
                    own &= _looked_up(wanted, h)
                yield h[own] >> np.uint64(64 - LONG_BITS) << np.uint64(ROW_BITS) | rows[: len(h)][own].view(np.uint64)

    parts = [_distinct(keys(texts[at : at + (1 << ROW_BITS)]), np.uint64) for at in range(0, len(texts), 1 << ROW_BITS)]
    found = np.sort(np.concatenate([np.empty(0, np.uint64), *parts]) >> np.uint64(ROW_BITS))
    first = np.flatnonzero(_first(found))
    return found[first], np.diff(np.append(first, len(found)))


def _first(sorted_keys: np.ndarray) -> np.ndarray:
    """Of each sorted key, whether it is not the one before."""
    first = np.ones(len(sorted_keys), bool)
    np.not_equal(sorted_keys[1:], sorted_keys[:-1], out=first[1:])
    return first


def _once(keys: np.ndarray) -> np.ndarray:
    keys = np.sort(keys)
    return keys[_first(keys)]


def _distinct(parts: Iterable[np.ndarray], kind: type) -> np.ndarray:
    """The keys of all parts, sorted, each once. They are merged when more wait than are known, so
    the repeats of a very long text take no room."""
    known, waiting, n = np.empty(0, kind), [], 0
    for part in parts:
        waiting.append(_once(part))
        n += len(waiting[-1])
        if n > max(WAITING, len(known)):
            known, waiting, n = _once(np.concatenate([known, *waiting])), [], 0
    return _once(np.concatenate([known, *waiting]))


@dataclass
class Model:
    table: np.ndarray  # of all hashes of short n-grams: the feature's number from 1, or 0
    weights: np.ndarray  # by number; 0 for number 0
    bias: float
    long: np.ndarray = field(default_factory=lambda: np.empty(0, np.uint64))  # sorted hashes of long n-grams
    numbers: np.ndarray = field(default_factory=lambda: np.empty(0, np.int64))  # and the features' numbers

    def present(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Row and number of every feature that a text holds.

        Texts are read in blocks, so one that is very long takes no more room than others.
        """
        size = len(self.weights)
        near = np.zeros((2, 1 << NEAR_BITS), bool)  # whether the hash of a short or long feature begins so
        near[0, np.flatnonzero(self.table) >> (HASH_BITS - NEAR_BITS)] = True
        near[1, self.long >> np.uint64(LONG_BITS - NEAR_BITS)] = True

        def keys() -> Iterator[np.ndarray]:
            for codes, rows in _coded(texts):
                for order, h in _hashed(codes, SHORT + LONG if len(self.long) else SHORT):
                    at = np.flatnonzero(_looked_up(near[int(order in LONG)], h))
                    at = at[rows[at] == rows[at + (order - 1)]]
                    if order in LONG:
                        found = h[at] >> np.uint64(64 - LONG_BITS)
                        place = np.minimum(np.searchsorted(self.long, found), len(self.long) - 1)
                        number = np.where(self.long[place] == found, self.numbers[place], 0)
                    else:
                        number = _looked_up(self.table, h[at]).astype(np.int64)
                    own = np.flatnonzero(number)
                    yield rows[at[own]] * size + number[own]

        key = _distinct(keys(), np.int64)
        return key // size, key % size

    def scores(self, texts: list[str]) -> np.ndarray:
        total = np.full(len(texts), self.bias)
        if len(self.weights) > 1:
            row, feature = self.present(texts)
            total += np.bincount(row, self.weights[feature], len(texts))
        return 1.0 / (1.0 + np.exp(-np.clip(total, -700, 700)))


def train(labelled: DataFrame, features: int = FEATURES, smoothing: float = 1.0) -> Model:
    """``labelled``: ``id, text, label`` (0 or 1), a sample of bounded size. With one label or none, a
    constant: (toxic rows + 0.5) / (rows + 2)."""
    spark = labelled.sparkSession
    rows = {r.label: r["count"] for r in labelled.groupBy("label").count().collect()}
    toxic, other = rows.get(1, 0), rows.get(0, 0)
    if not toxic or not other:
        share = (toxic + 0.5) / (toxic + other + 2)
        return Model(np.zeros(1 << HASH_BITS, np.uint16), np.zeros(1), float(np.log(share / (1 - share))))

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = np.zeros((2, 1 << HASH_BITS), np.int32)  # a task's sums
        for batch in slices(batches, max_bytes=SLICE):
            label = batch["label"].to_numpy(zero_copy_only=False)
            row, feature = short_present(batch["text"].to_pylist())
            for k in (0, 1):
                np.add.at(both[k], feature[label[row] == k], 1)
        kept = np.flatnonzero(both.any(0))
        for i in range(0, len(kept), 1 << 16):
            part = kept[i : i + (1 << 16)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(part), *(pa.array(both[k][part].astype(np.int64)) for k in (1, 0))], names=["feature", "toxic", "other"]
            )

    counts = labelled.mapInArrow(count, "feature long, toxic long, other long").groupBy("feature").agg(
        F.sum("toxic").cast("double").alias("a"), F.sum("other").cast("double").alias("b")
    )
    all_rows, a, b = float(toxic + other), F.col("a"), F.col("b")

    def count_long(batches: Iterable[pa.RecordBatch], wanted=None) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, max_bytes=SLICE):
            found, n = long_counts(batch["text"].to_pylist(), wanted.value if wanted else None)
            for i in range(0, len(found), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(found[i : i + (1 << 16)].view(np.int64)), pa.array(n[i : i + (1 << 16)])], names=["feature", "n"])

    def long_sums(label: int, wanted=None) -> DataFrame:
        own = labelled.where(F.col("label") == label).mapInArrow(lambda batches: count_long(batches, wanted), "feature long, n long")
        return own.groupBy("feature").agg(F.sum("n").cast("double").alias("b" if wanted else "a"))

    # with no other text that holds it, an n-gram's chi-square is the greatest it can be
    reach = F.try_divide(all_rows * a * other, (all_rows - a) * toxic)
    often = materialize(long_sums(1).where((a >= LEAST_TEXTS) & (reach >= LEAST_CHI)), "ngrams")
    first = often.select(F.shiftrightunsigned("feature", LONG_BITS - FILTER_BITS).cast("int").alias("first")).distinct().toArrow()
    bits = np.zeros(1 << FILTER_BITS, bool)
    bits[first["first"].to_numpy()] = True
    both = often.join(long_sums(0, spark.sparkContext.broadcast(bits)), "feature", "left").fillna(0.0, ["b"])
    counts = counts.withColumn("long", F.lit(False)).unionByName(both.withColumn("long", F.lit(True)))
    spread = (a + b) * (all_rows - a - b)
    chi = F.try_divide(all_rows * F.pow(a * (other - b) - b * (toxic - a), F.lit(2.0)), spread * float(toxic) * float(other))
    chosen = (
        counts.where(a + b >= LEAST_TEXTS).withColumn("chi", chi).where(F.col("chi") >= LEAST_CHI).orderBy(F.desc("chi"), "long", "feature").limit(features).collect()
    )
    table = np.zeros(1 << HASH_BITS, np.uint16)
    ratios = np.zeros(len(chosen) + 1)
    toxic_all, other_all = sum(r.a + smoothing for r in chosen), sum(r.b + smoothing for r in chosen)
    for i, r in enumerate(chosen, 1):
        if not r.long:
            table[r.feature] = i
        ratios[i] = np.log((r.a + smoothing) / toxic_all) - np.log((r.b + smoothing) / other_all)
    long = sorted((r.feature, i) for i, r in enumerate(chosen, 1) if r.long)
    model = Model(table, ratios, 0.0, np.array([h for h, _ in long], np.uint64), np.array([i for _, i in long], np.int64))
    shared = spark.sparkContext.broadcast(model)

    def scaled(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sparse vectors, made where the texts are read: a second Python step would give each task a second worker, kept from then on."""
        weights = shared.value.weights
        for batch in slices(batches, max_bytes=SLICE):
            row, feature = shared.value.present(batch["text"].to_pylist())
            ends = pa.array(np.searchsorted(row, np.arange(batch.num_rows + 1)), pa.int32())
            n = np.ones(batch.num_rows, np.int32)
            parts = {
                "type": pa.array(0 * n, pa.int8()),  # sparse
                "size": pa.array(len(weights) * n),
                "indices": pa.ListArray.from_arrays(ends, pa.array(feature, pa.int32())),
                "values": pa.ListArray.from_arrays(ends, pa.array(weights[feature])),
            }
            vectors = pa.StructArray.from_arrays([*parts.values()], names=[*parts])
            yield pa.RecordBatch.from_arrays([batch["label"].cast(pa.float64()), vectors], names=["label", "features"])

    points = labelled.mapInArrow(scaled, T.StructType([T.StructField("label", T.DoubleType()), T.StructField("features", VectorUDT())]))
    fitted = LogisticRegression(regParam=REGULARIZATION, standardization=False, maxIter=50).fit(points)
    return Model(table, fitted.coefficients.toArray() * ratios, float(fitted.intercept), model.long, model.numbers)


def sample(
    docs: DataFrame, labels: DataFrame, held_out: int, rows: int, id_col: str, text_col: str, label_col: str
) -> DataFrame:
    """About ``rows`` labelled texts outside the held-out part, ``id, text, label``; a text with both labels is toxic.

    Every n-th id by its hash is taken, n being such that about ``rows`` are, so the labels
    that are sent to the texts are few however many there are.
    """
    known = labels.where(ref(label_col).isin(0, 1) & ref(id_col).isNotNull() & (bucket_of(id_col, held_out) != 0))
    nth = max(1, -(-known.count() // rows))
    few = known.where(F.pmod(F.xxhash64(ref(id_col).cast("string")), F.lit(nth)) == 0)
    few = few.groupBy(ref(id_col).alias("id")).agg(F.max(ref(label_col)).cast("int").alias("label"))
    return materialize(keyed_text(docs, id_col, text_col).join(F.broadcast(few), "id"), "labelled")


def toxicity(
    docs: DataFrame,
    labels: DataFrame,
    held_out: int = 5,
    train_rows: int = TRAIN_ROWS,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
) -> DataFrame:
    """One row per document: ``id_col, held_out, score, predicted``.

    Labels are learned from rows whose crc32 of the id, modulo ``held_out``, is not 0. A null
    text is empty; an empty text has no n-grams, its score comes from the intercept. Labels
    that are null or neither 0 nor 1 are not learned from; a null id is not held out. Repeated rows give a row each, an
    empty table none; other columns are not read.
    """
    model = docs.sparkSession.sparkContext.broadcast(train(sample(docs, labels, held_out, train_rows, id_col, text_col, label_col)))
    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType), T.StructField("score", T.DoubleType())])

    def score(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, max_bytes=2 * SLICE):
            yield pa.RecordBatch.from_arrays([batch["id"], pa.array(model.value.scores(batch["text"].to_pylist()))], names=["id", "score"])

    return keyed_text(docs, id_col, text_col).mapInArrow(score, schema).select(
        ref("id").alias(id_col), F.coalesce(bucket_of("id", held_out) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


def without_toxic(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """``docs`` less those that ``toxicity`` predicts to be toxic; all columns are kept."""
    model = docs.sparkSession.sparkContext.broadcast(train(sample(docs, labels, 5, train_rows, id_col, text_col, label_col)))

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        parts = slices([pa.RecordBatch.from_arrays([texts], names=["text"])], max_bytes=2 * SLICE)
        scores = [model.value.scores(part["text"].to_pylist()) for part in parts]
        return pa.array(np.concatenate(scores) if scores else np.empty(0))

    return docs.where(score(F.coalesce(ref(text_col), F.lit(""))) < 0.5)
