"""Token counts by finite-state transducers.

Two transducers run one after the other. The first cuts a text into the pieces that are
encoded by themselves: its states are few, so every chunk of text becomes a map from the
state before it to the state after it, and the maps of all chunks are composed by a parallel
prefix scan before a second pass reads each chunk from its true state. The second transducer
(``transducer.py``) reads a piece; its transitions carry the number of tokens they add.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F, types as T

from tabscope.functions.columns import ref
from tabscope.llm import transducer
from tabscope.llm.texts import flat, kept_model, keyed_text, slices

CHUNK = 256
KEPT_PIECES = 150_000  # of each of two generations

# classes of characters; R, V, L and the one-letter endings S matter only after an apostrophe
LETTER, END_S, LETTER_R, LETTER_V, LETTER_L, LETTER_E, NUMBER, BLANK, SPACE, APOSTROPHE, OTHER, STOP = range(12)
LETTERS = (LETTER, END_S, LETTER_R, LETTER_V, LETTER_L, LETTER_E)
# states: what the open piece is so far
(NONE, WORD, DIGITS, SIGNS, ONE_BLANK, ONE_SPACE, TO_BLANK, TO_SPACE, QUOTE, QUOTE_R, QUOTE_V, QUOTE_L) = range(12)
HERE, ONE_BACK = 1, 2  # emitted: a piece begins at this character, or at the one before


@lru_cache(maxsize=1)
def classes() -> np.ndarray:
    """The class of every code point."""
    points = "".join(chr(c) if not 0xD800 <= c < 0xE000 else "�" for c in range(0x110000))
    table = np.full(0x110000, OTHER, np.uint8)
    for pattern, kind in ((r"\p{L}+", LETTER), (r"\p{N}+", NUMBER), (r"\p{White_Space}+", SPACE)):
        for found in regex.finditer(pattern, points):
            table[found.start() : found.end()] = kind
    for character, kind in zip(" 'stmdrvle", (BLANK, APOSTROPHE, *[END_S] * 4, LETTER_R, LETTER_V, LETTER_L, LETTER_E)):
        table[ord(character)] = kind
    return table


@lru_cache(maxsize=1)
def cutter() -> tuple[np.ndarray, np.ndarray]:
    """Next state and emission for class * 16 + state, of the pattern
    ``'s|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+``."""
    follow, emit = np.zeros(256, np.uint8), np.zeros(256, np.uint8)
    run_of = {**dict.fromkeys(LETTERS, WORD), NUMBER: DIGITS, APOSTROPHE: SIGNS, OTHER: SIGNS}
    alone = {**run_of, APOSTROPHE: QUOTE, BLANK: ONE_BLANK, SPACE: ONE_SPACE, STOP: NONE}
    longer = {BLANK: TO_BLANK, SPACE: TO_SPACE}
    endings = {QUOTE_R: LETTER_E, QUOTE_V: LETTER_E, QUOTE_L: LETTER_L}
    for state in range(12):
        for kind in range(12):
            target, out = alone[kind], HERE  # a new piece begins here, unless told otherwise below
            if state in (WORD, DIGITS, SIGNS) and run_of.get(kind) == state:
                target, out = state, 0
            elif state in (ONE_BLANK, ONE_SPACE, TO_BLANK, TO_SPACE) and kind in longer:
                target, out = longer[kind], 0
            elif state == ONE_BLANK and kind in run_of:  # the blank leads the run
                target, out = run_of[kind], 0
            elif state == TO_BLANK and kind in run_of:  # only the last blank does
                target, out = run_of[kind], ONE_BACK
            elif state == TO_SPACE and kind in run_of:
                out = HERE | ONE_BACK
            elif state == QUOTE and kind == END_S:
                target, out = NONE, 0
            elif state == QUOTE and kind in (LETTER_R, LETTER_V, LETTER_L):
                target, out = {LETTER_R: QUOTE_R, LETTER_V: QUOTE_V, LETTER_L: QUOTE_L}[kind], 0
            elif state == QUOTE and run_of.get(kind) == SIGNS:
                target, out = SIGNS, 0
            elif state in endings:
                if kind == endings[state]:
                    target, out = NONE, 0
                else:  # the apostrophe stays alone and the letter begins a word
                    target, out = (WORD, ONE_BACK) if kind in LETTERS else (target, out | ONE_BACK)
            follow[kind << 4 | state], emit[kind << 4 | state] = target, out
    return follow, emit


def piece_starts(kinds: np.ndarray) -> np.ndarray:
    """Where pieces begin in a row of classes; every text in it ends in ``STOP``."""
    follow, emit = cutter()
    n = -(-len(kinds) // CHUNK)
    padded = np.full(n * CHUNK, STOP, np.uint8)
    padded[: len(kinds)] = kinds
    by_step = np.ascontiguousarray((padded << np.uint8(4)).reshape(n, CHUNK).T)
    maps = np.tile(np.arange(12, dtype=np.uint8), (n, 1))
    for step in by_step:
        maps = follow[step[:, None] | maps]
    reach = 1
    while reach < n:  # after this, maps[i] leads from the beginning to the end of chunk i
        maps[reach:] = np.take_along_axis(maps[reach:], maps[:-reach].astype(np.intp), 1)
        reach *= 2
    state = np.zeros(n, np.uint8)
    state[1:] = maps[:-1, NONE]
    out = np.empty((CHUNK, n), np.uint8)
    for i, step in enumerate(by_step):
        at = step | state
        out[i], state = emit[at], follow[at]
    emitted = out.T.reshape(-1)[: len(kinds)]
    begins = (emitted & HERE).astype(bool)
    begins[:-1] |= (emitted[1:] & ONE_BACK).astype(bool)
    return np.flatnonzero(begins)


class Counter:
    """Counts the tokens of many texts; keeps the counts of pieces it has seen."""

    def __init__(self, path: str, special: tuple[str, ...]):
        self.model = transducer.load(path)
        self.special = regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True)))) if special else None
        self.known: dict[str, int] = {}
        self.older: dict[str, int] = {}  # pieces that come again move on to the next generation

    def _piece(self, piece: str) -> int:
        found = self.known.get(piece) or self.older.get(piece) or self.model.count(piece.encode().decode("latin-1"))
        if len(self.known) >= KEPT_PIECES:
            self.older, self.known = self.known, {}
        self.known[piece] = found
        return found

    def counts(self, texts: list[str]) -> np.ndarray:
        parts, owner, extra = [], [], np.zeros(len(texts), np.int64)
        for i, text in enumerate(texts):
            found = self.special.split(text) if self.special else [text]
            extra[i] = len(found) - 1
            parts += found
            owner += [i] * len(found)
        whole = "".join(parts)
        codes = classes()[np.frombuffer(whole.encode("utf-32-le"), np.uint32)]
        lengths = np.fromiter(map(len, parts), np.int64, len(parts))
        ends = np.cumsum(lengths)
        kinds = np.full(len(codes) + len(parts), STOP, np.uint8)
        for i, (begin, end) in enumerate(zip(ends - lengths, ends)):
            kinds[begin + i : end + i] = codes[begin:end]
        starts = piece_starts(kinds)
        part = np.searchsorted(ends + np.arange(len(parts)), starts)  # each part's STOP stands at its end
        begin = starts[kinds[starts] != STOP]
        part = part[kinds[starts] != STOP]
        begin = begin - part
        stop = np.append(begin[1:], len(whole))
        stop = np.minimum(stop, ends[part])
        get = self.known.get
        pieces = [whole[a:b] for a, b in zip(begin.tolist(), stop.tolist())]
        found = list(map(get, pieces))
        if None in found:
            for i, count in enumerate(found):
                if count is None:
                    found[i] = get(pieces[i]) or self._piece(pieces[i])
        totals = np.bincount(np.asarray(owner, np.int64)[part], np.asarray(found, np.float64), len(texts)) if found else 0
        return extra + np.asarray(totals).astype(np.int64)


def counter(path: str, special: tuple[str, ...]) -> Counter:
    return kept_model(("tokens", path, special), lambda: Counter(path, special))


def token_counts(
    docs: DataFrame, path: str, limit: int = 512, special: tuple[str, ...] = ("<|endoftext|>",), id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Bytes and tokens of every text: ``id_col, n_bytes, n_tokens, over_limit``.

    ``path``: a byte-level BPE file of the tokenizers library with the pattern of
    ``cutter``; ``special``: strings that are one token wherever they stand. A null text
    counts as empty and has no tokens; copies and repeated ids each give a row; other
    columns are not read. An empty table gives no rows.
    """
    schema = T.StructType(
        [T.StructField("id", docs.schema[id_col].dataType), T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())]
    )

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = counter(path, special)
        for batch in slices(batches, keep=True):
            totals = model.counts(batch["text"].to_pylist())
            yield pa.RecordBatch.from_arrays(
                [batch["id"], pa.array(np.diff(flat(batch["text"])[1])), pa.array(totals)], names=["id", "n_bytes", "n_tokens"]
            )

    counted = keyed_text(docs, id_col, text_col).mapInArrow(count, schema)
    return counted.select(ref("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
