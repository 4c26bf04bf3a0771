"""Best-fit packing of token sequences.

Texts are encoded once and cut into pieces; only the pieces' lengths are packed. A piece has
a demand of three kinds: tokens, one document, and the cost of attention over its own tokens
(its length squared). A bin that is open has a residual of each. Pieces go from the longest
to the shortest; of the bins in which every residual suffices, one is selected by the
weighted dot product of residual and demand (the least, which is the tightest bin), or by
the weighted norm of the residual that would be left (the least). Pieces of the full length
need no search. The rest is dealt evenly over groups of bounded size, each packed by
one task; a group leaves at most about one bin that is not full.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F, types as T
from tokenizers import Tokenizer, normalizers

from tabscope.functions.columns import ref
from tabscope.llm.texts import SLICE_BYTES, kept_model, keyed_text, slices
from tabscope.workspace import materialize

GROUP_PIECES = 4096
KEPT_WORDS = 120_000  # of each of two generations
SPACE, LETTER, NUMBER, SIGN = range(4)


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    points = "".join(chr(c) for c in range(0x3000))  # lower case of some letters below U+0250 lies there
    table = np.full(0x3000, SIGN, np.uint8)
    for pattern, kind in ((r"\p{L}", LETTER), (r"\p{N}", NUMBER), (r"\p{White_Space}", SPACE)):
        for found in regex.finditer(pattern, points):
            table[found.start()] = kind
    return table


_PLAIN = regex.compile(r"[\x00-ɏ]*")


class WordEncoder:
    """Ids of texts under a lower-casing word BPE of the tokenizers library.

    Texts of characters below U+0250 in composed form are cut into words here and each word
    is encoded once; others, and those that hold a special token, go to the library.
    """

    def __init__(self, path: str):
        self.path = path
        # words that are cut and lower-cased already need no normalizer
        self.bare = Tokenizer.from_file(path)
        self.bare.normalizer = normalizers.Sequence([])
        suffix = self.bare.model.end_of_word_suffix
        self.word_end: np.ndarray | None = None
        if suffix:
            size = self.bare.get_vocab_size(with_added_tokens=True)
            self.word_end = np.fromiter(((self.bare.id_to_token(i) or "").endswith(suffix) for i in range(size)), bool, size)
        self.special = tuple(t.content for t in self.bare.get_added_tokens_decoder().values())
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}  # words that come again move on to the next generation

    @cached_property
    def library(self) -> Tokenizer:
        """The whole tokenizer, for texts that are not plain."""
        return Tokenizer.from_file(self.path)

    def _encoded(self, words: list[str]) -> list[bytes]:
        """Ids of different words; those that no recent slice had are encoded in one call, blanks between them."""
        if len(self.known) + len(words) > KEPT_WORDS:
            self.older, self.known = self.known, {}
        known, older = self.known, self.older
        found = [known.get(w) or older.get(w) for w in words]
        missing = [w for w, ids in zip(words, found) if ids is None]
        if missing:
            fresh = iter(self._together(missing))
            found = [next(fresh) if f is None else f for f in found]
        known.update(zip(words, found))
        return found

    def _together(self, words: list[str]) -> list[bytes]:
        joined = " ".join(words)
        if self.word_end is None:
            made = self.bare.encode(joined, add_special_tokens=False)
            ends = np.diff(np.asarray(made.word_ids, np.int64), append=-1) != 0
        else:  # leaves out the offsets
            (made,) = self.bare.encode_batch_fast([joined], add_special_tokens=False)
        ids = np.asarray(made.ids, "<u4")
        cuts = np.flatnonzero(ends if self.word_end is None else self.word_end[ids]) + 1
        if len(cuts) != len(words):
            raise ValueError("the tokenizer cuts words another way")
        held, cuts = ids.tobytes(), (4 * cuts).tolist()
        return [held[a:b] for a, b in zip([0, *cuts], cuts)]

    def plain(self, text: str) -> bool:
        # U+0130 lower-cases to a letter and a combining mark; no other of these characters grows or composes
        return bool(_PLAIN.fullmatch(text)) and "İ" not in text and not any(s in text for s in self.special)

    @staticmethod
    def words(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where the words of a lower-cased plain text start and stop, and its code points: runs of
        letters, single numbers, runs of signs, and the endings 's 't 're 've 'm 'll 'd where an
        apostrophe does not stand in a run of signs."""
        codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        kinds = _classes()[codes]
        n = len(kinds)
        begins = np.ones(n, bool)
        begins[1:] = (kinds[1:] != kinds[:-1]) | (kinds[1:] == NUMBER)
        if "'" in text:
            quote = np.flatnonzero((codes == 39) & begins)
            one, two = (np.pad(codes, (0, 2))[quote + i] for i in (1, 2))
            short = np.isin(one, [ord(c) for c in "stmd"])
            long = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
            begins[quote[short | long] + 1] = False
            for ending, size in ((quote[short], 2), (quote[long], 3)):
                ending = ending[ending + size < n] + size
                begins[ending] = True
        starts = np.flatnonzero(begins)
        stops = np.append(starts[1:], n)
        kept = kinds[starts] != SPACE
        return starts[kept], stops[kept], codes

    def _plain_ids(self, texts: list[str]) -> list[bytes]:
        """All texts are cut together, a line break between them; different words are encoded once."""
        lowered = [t.lower() for t in texts]
        ends = np.cumsum([len(t) + 1 for t in lowered])
        whole = "\n".join(lowered)
        starts, stops, codes = self.words(whole)
        if not len(starts):
            return [b""] * len(texts)
        size = 1 + (codes >= 0x80).astype(np.int8) + (codes >= 0x800)  # bytes of each character
        at = np.zeros(len(codes) + 1, np.int64)
        np.cumsum(size, out=at[1:])
        inside = np.zeros(len(codes) + 1, np.int8)
        inside[starts] += 1
        inside[stops] -= 1
        letters = np.frombuffer(whole.encode(), np.uint8)[np.repeat(np.cumsum(inside[:-1], dtype=np.int8) > 0, size)]
        places = np.concatenate([[0], np.cumsum(at[stops] - at[starts])]).astype(np.int32)
        coded = pa.StringArray.from_buffers(len(starts), pa.py_buffer(places), pa.py_buffer(np.ascontiguousarray(letters))).dictionary_encode()
        word = coded.indices.to_numpy()
        encoded = self._encoded(coded.dictionary.to_pylist())
        sizes = np.fromiter(map(len, encoded), np.int64, len(encoded)) // 4
        flat = np.frombuffer(b"".join(encoded), "<u4")
        first = np.cumsum(sizes) - sizes
        counts = sizes[word]
        upto = np.concatenate([[0], np.cumsum(counts)])
        ids = flat[np.repeat(first[word] - upto[:-1], counts) + np.arange(upto[-1])].tobytes()
        cuts = 4 * upto[np.searchsorted(starts, ends)]
        return [ids[a:b] for a, b in zip([0, *cuts[:-1].tolist()], cuts.tolist())]

    def ids(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        out = [b""] * len(texts)
        plain = [i for i, text in enumerate(texts) if text and self.plain(text)]
        for i, own in zip(plain, self._plain_ids([texts[i] for i in plain]) if plain else []):
            out[i] = own
        for i in set(range(len(texts))).difference(plain):
            if texts[i]:
                out[i] = np.asarray(self.library.encode(texts[i], add_special_tokens=False).ids, "<u4").tobytes()
        return out


def encoder(path: str) -> WordEncoder:
    return kept_model(("words", path), lambda: WordEncoder(path))


def pieces(
    docs: DataFrame, path: str, length: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", slice_bytes: int = SLICE_BYTES
) -> DataFrame:
    """Every document's ids and ``end_id``, cut after each ``length`` tokens:
    ``id_col, piece, start, length, ids_crc32``. A null text is empty and has one token.
    ``slice_bytes`` of text are encoded at a time; fewer take less memory and more time."""
    schema = T.StructType(
        [
            T.StructField("id", docs.schema[id_col].dataType),
            T.StructField("piece", T.IntegerType()),
            T.StructField("start", T.LongType()),
            T.StructField("length", T.LongType()),
            T.StructField("ids_crc32", T.LongType()),
        ]
    )
    last = np.asarray([end_id], "<u4").tobytes()

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = encoder(path)
        for batch in slices(batches, max_bytes=slice_bytes, keep=True):
            rows, at = [], []
            for row, ids in enumerate(words.ids(batch["text"].to_pylist())):
                ids += last
                for i, start in enumerate(range(0, len(ids), 4 * length)):
                    part = ids[start : start + 4 * length]
                    at.append(row)
                    rows.append((i, start // 4, len(part) // 4, zlib.crc32(part)))
            columns = list(zip(*rows))
            yield pa.RecordBatch.from_arrays(
                [batch["id"].take(pa.array(at)), *(pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int64(), pa.int64(), pa.int64())))],
                names=[f.name for f in schema],
            )

    return keyed_text(docs, id_col, text_col).mapInArrow(cut, schema).withColumnRenamed("id", id_col)


def best_fit(
    lengths: np.ndarray, capacity: tuple[float, float, float], weights: tuple[float, float, float] = (1.0, 0.0, 0.0), select: str = "dot"
) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each length. ``capacity``: tokens, documents, attention cost; a piece that
    fits no empty bin gets one of its own. Weights apply to shares of the capacities."""
    scale = np.asarray(weights) / np.asarray(capacity) ** 2
    residual = np.empty((0, 3))
    label = np.empty(0, np.int64)
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    least, opened, n_open = (lengths.min() if len(lengths) else 0), 0, 0
    for i in np.argsort(-lengths, kind="stable"):
        demand = np.array([lengths[i], 1.0, float(lengths[i]) ** 2])
        left = residual[:n_open] - demand
        fits = (left >= 0).all(1)
        if fits.any():
            if select == "dot":
                score = residual[:n_open] @ (scale * demand)
            else:
                score = (left * left) @ scale
            at = int(np.where(fits, score, np.inf).argmin())
        else:
            if n_open == len(residual):
                residual = np.concatenate([residual, np.empty((max(64, n_open), 3))])
                label = np.concatenate([label, np.empty(max(64, n_open), np.int64)])
            at, n_open = n_open, n_open + 1
            residual[at], label[at] = capacity, opened
            opened += 1
        bins[i], offsets[i] = label[at], capacity[0] - residual[at, 0]
        residual[at] -= demand
        if residual[at, 0] < least or residual[at, 1] < 1 or residual[at, 2] < float(least) ** 2:  # nothing fits any more
            n_open -= 1
            residual[at], label[at] = residual[n_open], label[n_open]
    return bins, offsets


def packed(
    pieces: DataFrame,
    length: int = 2048,
    documents: int | None = None,
    attention: float | None = None,
    weights: tuple[float, float, float] = (1.0, 1.0, 1.0),
    select: str = "dot",
    group_pieces: int = GROUP_PIECES,
) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``.

    A sequence holds ``length`` tokens, ``documents`` pieces and ``attention`` summed squared
    lengths at most. By default the last two do not bind, but their residuals weigh as much as
    that of the tokens when a bin is selected. Repeated rows are packed each.
    An empty table gives no rows. ``pieces`` is written once, since it is counted and packed.
    """
    capacity = (float(length), float(documents or length), float(attention or length**2))
    columns = pieces.columns
    stored = materialize(pieces.withColumn("_row", F.monotonically_increasing_id()), "pieces")
    full = (F.col("length") >= length) | (F.col("length") * F.col("length") >= capacity[2])
    groups = max(1, -(-stored.filter(~full).count() // group_pieces))
    schema = T.StructType([*pieces.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def pack(group: pa.Table) -> pa.Table:
        number = group["group"][0].as_py()
        bins, offsets = best_fit(group["length"].to_numpy(), capacity, weights, select)
        out = group.select(columns).append_column("sequence_id", pa.array(2 * (number + groups * bins)))
        return out.append_column("offset", pa.array(offsets))

    rest = stored.filter(~full).withColumn("group", F.pmod(F.xxhash64("_row"), F.lit(groups)))
    fitted = rest.groupBy("group").applyInArrow(pack, schema)
    alone = stored.filter(full).drop("_row").withColumns(
        {"sequence_id": F.monotonically_increasing_id() * 2 + 1, "offset": F.lit(0).cast("long")}
    )
    return fitted.unionByName(alone)
