"""Language identification by unigram piece models, summed over all segmentations.

The pieces are those of a public vocabulary. Each language has a probability of every piece,
estimated by expectation maximisation: the pieces' expected counts over all ways to cut the
training words into pieces. A text is the words in it, in lower case and led by the mark of
a word's begin; a word's probability is the sum over all its segmentations, found by the
forward algorithm, and the words' probabilities are multiplied.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, functions as F, types as T

from tabscope.functions.columns import ref
from tabscope.llm.texts import bucket_of, gram_hashes, keyed_text, mixed, slices
from tabscope.llm.tokens import LETTERS, classes
from tabscope.workspace import materialize

MARK = "▁"
LONGEST = 16  # characters of a piece
RUN = 64  # longer words are scored in runs of so many characters, whose probabilities a double can hold
TRAIN_ROWS = 8_000
LEAST_TEXTS = 100  # of a language that has as many
ROUNDS = 4
KEPT_WORDS = 250_000
_FILTER_BITS = 20


class Vocabulary:
    """Pieces by the hash of their characters; number 0 is a character that is no piece."""

    def __init__(self, path: str):
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
        self.names = [n for n in dict.fromkeys(names) if 0 < len(n) <= LONGEST and n == n.lower()]
        self.size = len(self.names) + 1
        self.by_length: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for length in range(1, LONGEST + 1):
            own = [(self._hash(n, length), i) for i, n in enumerate(self.names, 1) if len(n) == length]
            own.sort()
            self.by_length[length] = np.array([h for h, _ in own], np.uint64), np.array([i for _, i in own], np.int64)

    @staticmethod
    def _hash(name: str, length: int) -> int:
        return int(gram_hashes(mixed(np.array([ord(c) for c in name], np.uint64)), length)[0])

    def arcs(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """All ways pieces can stand in the words: from node, to node, piece, and each word's first node.
        A word of n characters has n + 1 nodes, numbered on."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        codes = mixed(np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.uint64))
        ends = np.cumsum(lengths)
        first = ends - lengths + np.arange(len(words))
        word = np.repeat(np.arange(len(words)), lengths)
        rest = ends[word] - np.arange(len(codes))  # characters to the word's end
        froms, tos, pieces = [], [], []
        for length, (hashes, numbers) in self.by_length.items():
            grams = gram_hashes(codes, length)
            if not len(hashes) or not len(grams):
                at, piece = np.empty(0, np.int64), np.empty(0, np.int64)
            else:
                maybe = np.zeros(1 << _FILTER_BITS, bool)
                maybe[hashes >> np.uint64(64 - _FILTER_BITS)] = True
                at = np.flatnonzero(maybe[grams >> np.uint64(64 - _FILTER_BITS)] & (rest[: len(grams)] >= length))
                place = np.minimum(np.searchsorted(hashes, grams[at]), len(hashes) - 1)
                same = hashes[place] == grams[at]
                at, piece = at[same], numbers[place[same]]
            if length == 1:  # any other character is the unknown piece
                known = np.zeros(len(codes), np.int64)
                known[at] = piece
                at, piece = np.arange(len(codes)), known
            froms.append(at + word[at])
            tos.append(at + word[at] + length)
            pieces.append(piece)
        return np.concatenate(froms), np.concatenate(tos), np.concatenate(pieces), first


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def _swept(order: np.ndarray, depth: np.ndarray) -> Iterator[np.ndarray]:
    """Arcs in groups of equal depth, which ``order`` sorts."""
    cuts = np.flatnonzero(np.diff(depth[order])) + 1
    yield from np.split(order, cuts) if len(order) else []


def forward(froms: np.ndarray, tos: np.ndarray, weights: np.ndarray, first: np.ndarray, nodes: int) -> np.ndarray:
    """Of each node, the sum over all paths from its word's first node; columns are languages."""
    sums = np.zeros((nodes, weights.shape[1]))
    sums[first] = 1.0
    depth = tos - first[np.searchsorted(first, froms, "right") - 1]
    for arcs in _swept(np.lexsort((tos, depth)), depth):
        at, begins = np.unique(tos[arcs], return_index=True)
        sums[at] = np.add.reduceat(sums[froms[arcs]] * weights[arcs], begins, axis=0)
    return sums


def backward(froms: np.ndarray, tos: np.ndarray, weights: np.ndarray, last: np.ndarray, nodes: int) -> np.ndarray:
    """Of each node, the sum over all paths to its word's last node."""
    sums = np.zeros((nodes, weights.shape[1]))
    sums[last] = 1.0
    depth = last[np.searchsorted(last, tos)] - froms
    for arcs in _swept(np.lexsort((froms, depth)), depth):
        at, begins = np.unique(froms[arcs], return_index=True)
        sums[at] = np.add.reduceat(sums[tos[arcs]] * weights[arcs], begins, axis=0)
    return sums


def words_of(texts: list[str]) -> tuple[list[str], np.ndarray]:
    """Runs of letters in lower case, led by the mark, long ones cut; and the first word of each text
    (and the number of words)."""
    lower = [t.lower() for t in texts]
    whole = "\n".join(lower) + "\n"
    letter = np.zeros(len(whole) + 1, bool)
    letter[1:] = classes()[np.frombuffer(whole.encode("utf-32-le"), np.uint32)] <= max(LETTERS)
    edges = np.flatnonzero(letter[1:] != letter[:-1]).reshape(-1, 2)
    begins = np.cumsum([0, *(len(t) + 1 for t in lower)])
    words, more = [], {}
    for i, (a, b) in enumerate(edges.tolist()):
        words.append(MARK + whole[a : min(b, a + RUN)])
        if b - a > RUN:
            more[i] = [whole[k : min(b, k + RUN)] for k in range(a + RUN, b, RUN)]
    first = np.searchsorted(edges[:, 0], begins)
    if more:
        grown = np.zeros(len(words) + 1, np.int64)
        for i, rest in more.items():
            grown[i + 1] = len(rest)
        words = [w for i, word in enumerate(words) for w in (word, *more.get(i, ()))]
        first = first + np.cumsum(grown)[first]
    return words, first


@dataclass
class Model:
    path: str
    languages: list[str]
    prior: np.ndarray
    pieces: np.ndarray  # probability by piece and language
    place: dict[str, int] = field(default_factory=dict)
    scores: np.ndarray | None = None

    def __getstate__(self):
        return self.__dict__ | {"place": {}, "scores": None}

    def _learn(self, words: list[str]) -> None:
        froms, tos, piece, first = vocabulary(self.path).arcs(words)
        nodes = int(first[-1]) + len(words[-1]) + 1
        sums = forward(froms, tos, self.pieces[piece], first, nodes)
        last = np.append(first[1:] - 1, nodes - 1)
        self.place.update(zip(words, range(len(self.place), len(self.place) + len(words))))
        own = np.log(np.maximum(sums[last], 1e-300))
        self.scores = own if self.scores is None else np.concatenate([self.scores, own])

    def log_likelihoods(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Of each text and language, and each text's number of words."""
        words, first = words_of(texts)
        if len(self.place) > KEPT_WORDS:
            self.place, self.scores = {}, None
        found = list(map(self.place.get, words))
        if None in found:
            self._learn(list(dict.fromkeys(w for w, at in zip(words, found) if at is None)))
            found = list(map(self.place.__getitem__, words))
        total = np.zeros((len(texts), len(self.languages)))
        if found:
            sums = np.concatenate([np.zeros((1, len(self.languages))), np.cumsum(self.scores[np.array(found)], axis=0)])
            total = sums[first[1:]] - sums[first[:-1]]
        return total, np.diff(first)

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        total, n_words = self.log_likelihoods(texts)
        if not self.languages:
            return ["und"] * len(texts), np.zeros(len(texts))
        total = total + np.log(self.prior)
        best = total.argmax(1)
        share = 1.0 / np.exp(total - total.max(1, keepdims=True)).sum(1)
        return [self.languages[b] if n else "und" for b, n in zip(best, n_words)], np.where(n_words > 0, share, 0.0)


def train(docs: DataFrame, path: str, rows: int = TRAIN_ROWS, rounds: int = ROUNDS, smoothing: float = 0.1) -> Model:
    """``docs``: ``id, text, lang`` to learn from. Of each language every n-th id by its hash is taken, n being
    such that about ``rows`` are in all; languages of few texts are taken whole, and of none are
    fewer than about ``LEAST_TEXTS`` asked for. The words of these texts are counted whole; the prior is of all texts."""
    known = docs.where("lang IS NOT NULL")
    spark = docs.sparkSession
    texts = {r.lang: r["count"] for r in known.groupBy("lang").count().collect()}
    left, rates = rows, []
    for i, (lang, n) in enumerate(sorted(texts.items(), key=lambda kv: (kv[1], kv[0]))):
        share = max(LEAST_TEXTS, left // (len(texts) - i))
        rates.append((lang, max(1, -(-n // share))))
        left = max(0, left - min(n, share))
    nth = spark.createDataFrame(rates, "lang string, nth long")
    taken = known.join(F.broadcast(nth), "lang").where(F.expr("pmod(xxhash64(CAST(id AS STRING)), nth) = 0"))

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            words, first = words_of(batch["text"].to_pylist())
            langs = batch["lang"].to_pylist()
            found = Counter()
            for lang, a, b in zip(langs, first, first[1:]):
                found.update((lang, w) for w in words[a:b])
                found[lang, ""] += 1  # texts
            keys = list(found)
            yield pa.RecordBatch.from_arrays(
                [pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string()), pa.array(list(found.values()), pa.int64())],
                names=["lang", "word", "n"],
            )

    counted = materialize(
        taken.select("id", "text", "lang").mapInArrow(count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")), "words"
    )
    languages = sorted(r.lang for r in counted.where("word = ''").select("lang").collect())
    pieces = vocabulary(path)
    model = Model(path, languages, np.array([texts[k] for k in languages], float) / max(1, sum(texts[k] for k in languages)), np.full((pieces.size, len(languages)), 1.0 / pieces.size))
    if not languages:
        return model

    def expected(batches: Iterable[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
        chances = shared.value
        sums = np.zeros_like(chances)
        for batch in batches:
            lang = np.array([languages.index(x) for x in batch["lang"].to_pylist()])
            words, n = batch["word"].to_pylist(), batch["n"].to_numpy(zero_copy_only=False)
            for k in np.unique(lang):
                rows = np.flatnonzero(lang == k)
                froms, tos, piece, first = vocabulary(path).arcs([words[i] for i in rows])
                nodes = int(first[-1]) + len(words[rows[-1]]) + 1
                last = np.append(first[1:] - 1, nodes - 1)
                weights = chances[piece][:, [k]]
                before, after = forward(froms, tos, weights, first, nodes)[:, 0], backward(froms, tos, weights, last, nodes)[:, 0]
                owner = np.searchsorted(first, froms, "right") - 1
                total = np.maximum(before[last], 1e-300)
                sums[:, k] += np.bincount(piece, before[froms] * weights[:, 0] * after[tos] / total[owner] * n[rows][owner], len(sums))
        piece, lang = np.nonzero(sums)
        yield pa.RecordBatch.from_arrays(
            [pa.array(piece.astype(np.int32)), pa.array(lang.astype(np.int32)), pa.array(sums[piece, lang])], names=["piece", "lang", "n"]
        )

    for _ in range(rounds):
        shared = spark.sparkContext.broadcast(model.pieces)
        sums = np.zeros_like(model.pieces)
        found = counted.where("word <> ''").mapInArrow(lambda batches, s=shared: expected(batches, s), "piece int, lang int, n double")
        for r in found.groupBy("piece", "lang").agg(F.sum("n").alias("n")).collect():  # of the vocabulary's size
            sums[r.piece, r.lang] = r.n
        model.pieces = (sums + smoothing) / (sums.sum(0) + smoothing * len(sums))
    return model


def identify(
    docs: DataFrame, path: str, held_out: tuple[int, int] = (4, 2), train_rows: int = TRAIN_ROWS, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang"
) -> DataFrame:
    """One row per document: ``id_col, held_out, lang_pred, score``.

    ``path``: a model file of sentencepiece. Learned from documents of known language whose
    crc32 of the id, modulo ``held_out[0]``, is not ``held_out[1]``. ``score``: the predicted
    language's share of the probability. A text that is null or has no letter is ``und`` with
    score 0, as are all if no language is known; a null id is not held out. Repeated rows give a row each, an empty table
    none; other columns are not read.
    """
    divisor, left_out = held_out
    texts = docs.select(ref(id_col).alias("id"), F.coalesce(ref(text_col), F.lit("")).alias("text"), ref(lang_col).cast("string").alias("lang"))
    shared = docs.sparkSession.sparkContext.broadcast(train(texts.where(F.coalesce(bucket_of("id", divisor), F.lit(left_out)) != left_out), path, train_rows))
    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def predict(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, max_bytes=4 << 20):
            found, share = shared.value.predict(batch["text"].to_pylist())
            yield pa.RecordBatch.from_arrays([batch["id"], pa.array(found, pa.string()), pa.array(share)], names=[f.name for f in schema])

    return keyed_text(docs, id_col, text_col).mapInArrow(predict, schema).select(
        ref("id").alias(id_col), F.coalesce(bucket_of("id", divisor) == left_out, F.lit(False)).alias("held_out"), "lang_pred", "score"
    )
