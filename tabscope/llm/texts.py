"""Text columns inside tasks: slices of bounded size, words by bytes, rolling hashes."""

from __future__ import annotations

import ctypes
import ctypes.util
import gc
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from tabscope.functions.columns import ref

SLICE_BYTES = 2 << 20


def keyed_text(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The id and the text alone, as ``id`` and ``text``; a null text is empty."""
    return df.select(ref(id_col).alias("id"), F.coalesce(ref(text_col), F.lit("")).alias("text"))


_models: dict[tuple, object] = {}


def kept_model(key: tuple, build: Callable[[], object]) -> object:
    """A large model that a worker keeps from task to task; it keeps one."""
    if key not in _models:
        let_go()
        _models[key] = build()
        give_back()
    return _models[key]


@lru_cache(maxsize=1)
def _c_library() -> ctypes.CDLL | None:
    name = ctypes.util.find_library("c")
    library = ctypes.CDLL(name) if name else None
    return library if hasattr(library, "malloc_trim") else None


def give_back() -> None:
    """Return freed memory to the machine, as a worker that waits for its next task holds it otherwise."""
    pa.default_memory_pool().release_unused()
    if (library := _c_library()) is not None:
        library.malloc_trim(0)


def let_go() -> None:
    """Free the model that an operator before has left in this worker."""
    if _models:
        _models.clear()
        gc.collect()
        give_back()


def slices(
    batches: Iterable[pa.RecordBatch], column: str = "text", max_bytes: int = SLICE_BYTES, keep: bool = False
) -> Iterator[pa.RecordBatch]:
    """The batches cut so that each holds ``max_bytes`` of text at most, or a single row.

    Unless told to ``keep`` it, the worker lets go of another operator's model.
    """
    if not keep:
        let_go()
    try:
        for batch in batches:
            if not batch.num_rows:
                continue
            ends = np.cumsum(pc.fill_null(pc.binary_length(batch[column]), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
            at = 0
            while at < len(ends):
                before = ends[at - 1] if at else 0
                upto = max(at + 1, int(np.searchsorted(ends, before + max_bytes, "right")))
                yield batch.slice(at, upto - at)
                at = upto
    finally:
        give_back()


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all rows in one array, and where each row begins (and the last ends)."""
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    if not ends[-1] - ends[0]:
        return np.empty(0, np.uint8), np.zeros(len(ends), np.int64)
    return np.frombuffer(data, np.uint8)[ends[0] : ends[-1]], ends - ends[0]


#: Of the 256 bytes: lower case for A-Z, and whether it belongs to a word of digits, letters and
#: all characters beyond ASCII, whose UTF-8 bytes are all 128 or more.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
IN_WORD = np.zeros(256, bool)
IN_WORD[48:58] = IN_WORD[97:123] = IN_WORD[128:] = True


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of lower-cased rows: the lower-cased bytes, each word's start and end, and the first
    word of each row (and the number of words)."""
    lower = LOWER[data]
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = IN_WORD[lower]
    starts = np.flatnonzero(inside[1:-1] & ~inside[:-2])
    ends = np.flatnonzero(inside[1:-1] & ~inside[2:]) + 1
    joints = offsets[1:-1]  # a word does not go on from one row to the next
    joints = np.unique(joints[(joints > 0) & (joints < len(data))])
    joints = joints[inside[joints] & inside[joints + 1]]
    if len(joints):
        starts, ends = np.union1d(starts, joints), np.union1d(ends, joints)
    return lower, starts, ends, np.searchsorted(starts, offsets)


def runs(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the runs of marked bytes start and end; a run does not go on from one row to the next."""
    framed = np.zeros(len(inside) + 2, bool)
    framed[1:-1] = inside
    starts = np.flatnonzero(framed[1:-1] & ~framed[:-2])
    ends = np.flatnonzero(framed[1:-1] & ~framed[2:]) + 1
    joints = offsets[1:-1]
    joints = joints[(joints > 0) & (joints < len(inside))]
    joints = joints[framed[joints] & framed[joints + 1]]
    joints = joints[np.append(True, np.diff(joints) > 0)] if len(joints) else joints  # empty rows repeat an offset
    if len(joints):
        starts, ends = (np.sort(np.concatenate([a, joints]), kind="stable") for a in (starts, ends))
    return starts, ends


_BASE = np.uint64(0x9E3779B97F4A7C15)  # odd, so that it has an inverse modulo 2^64
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))


_known: dict[int, np.ndarray] = {}


def _powers(base: np.uint64, n: int) -> np.ndarray:
    """The first ``n`` powers; those for slices of the usual size are kept, as many as were asked for so far."""
    known = _known.get(int(base))
    if known is None or len(known) < n:
        usual = n <= SLICE_BYTES + 2
        out = np.full(min(1 << max(n - 1, 0).bit_length(), SLICE_BYTES + 2) if usual else n, base, np.uint64)
        out[0] = 1
        known = np.multiply.accumulate(out, out=out)
        if usual:
            _known[int(base)] = known
    return known[:n]


def mixed(h: np.ndarray) -> np.ndarray:
    """Bits stirred, so that any of them can serve as a hash."""
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each span, equal for equal bytes wherever they stand."""
    if not len(starts):
        return np.empty(0, np.uint64)
    sums = np.zeros(len(data) + 1, np.uint64)
    own = np.add(data, np.uint64(1), out=sums[1:])
    np.cumsum(np.multiply(own, _powers(_BASE, len(data)), out=own), out=own)
    return mixed((sums[ends] - sums[starts]) * _powers(_INVERSE, len(data) + 1)[starts])


def gram_hashes(hashes: np.ndarray, n: int) -> np.ndarray:
    """A hash of each run of ``n`` consecutive items, from the items' own hashes."""
    if len(hashes) < n:
        return np.empty(0, np.uint64)
    out = np.zeros(len(hashes) - n + 1, np.uint64)
    for i in range(n):
        out *= _BASE
        out += hashes[i : i + len(out)]
    return mixed(out)


def bucket_of(id_col: str, divisor: int) -> Column:
    """crc32 of the id as text, modulo ``divisor``."""
    return F.crc32(ref(id_col).cast("string").cast("binary")) % divisor
