"""Document fingerprints: invertible Bloom lookup sketches of paragraph digests.

A text is cut into paragraphs (lines, long ones into blocks of words), each with a digest;
a paragraph that comes again gets another digest each time. A sketch has three tables of
cells; a digest is added to one cell of each: the cell counts it and takes the exclusive or
of the digest and of its check value. The sketch of one version less that of another holds
only what differs. A cell with a single digest left gives it away; taking it out of its
other cells uncovers more, until the difference is known on both sides. If cells remain, both
versions are sketched again with twice the cells and other places.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F, types as T

from tabscope.functions.columns import ref
from tabscope.llm.texts import keyed_text, mixed, slices

CELLS = 24
BLOCK_WORDS = 12
TABLES = 3
BUCKET_BYTES = 4 << 20
MAX_BUCKETS = 65_536


def paragraphs(text: str) -> np.ndarray:
    """A 64-bit digest of each paragraph, all different."""
    seen: dict[bytes, int] = {}
    out = []
    for line in text.encode().split(b"\n"):
        words = line.split(b" ")
        for i in range(0, len(words), BLOCK_WORDS):
            block = b" ".join(words[i : i + BLOCK_WORDS])
            if block:
                again = seen[block] = seen.get(block, -1) + 1
                out.append(xxhash.xxh64_intdigest(block, again))
    return np.array(out, np.uint64)


def _check(digests: np.ndarray) -> np.ndarray:
    return mixed(digests ^ np.uint64(0xA24BAED4963EE407)) & np.uint64(0xFFFFFFFF)


def _places(digests: np.ndarray, cells: int, table: int) -> np.ndarray:
    """The digest's cell in a table, chosen anew for every size."""
    size = cells // TABLES
    salt = np.uint64((table + 1) * cells * 0x9FB21C651E98DF25 & 0xFFFFFFFFFFFFFFFF)
    return (mixed(digests + salt) % np.uint64(size)).astype(np.int64) + table * size


class Sketches:
    """The sketches of many texts, with the same number of cells."""

    def __init__(self, n: int, cells: int):
        self.cells = cells
        self.count = np.zeros((n, cells), np.int32)
        self.digest = np.zeros((n, cells), np.uint64)
        self.check = np.zeros((n, cells), np.uint64)

    def add(self, rows: np.ndarray, digests: np.ndarray, sign: np.ndarray | int = 1) -> None:
        check = _check(digests)
        for table in range(TABLES):
            at = rows, _places(digests, self.cells, table)
            np.add.at(self.count, at, sign)
            np.bitwise_xor.at(self.digest, at, digests)
            np.bitwise_xor.at(self.check, at, check)

    @classmethod
    def of(cls, texts: list[np.ndarray], cells: int) -> Sketches:
        out = cls(len(texts), cells)
        if texts:
            out.add(np.repeat(np.arange(len(texts)), [len(t) for t in texts]), np.concatenate(texts))
        return out

    def less(self, other: Sketches) -> Sketches:
        out = Sketches(0, self.cells)
        out.count, out.digest, out.check = self.count - other.count, self.digest ^ other.digest, self.check ^ other.check
        return out

    def written(self) -> list[str]:
        """Each sketch as text: counts, digests and checks of its cells."""
        parts = [self.count.astype("<i4"), self.digest.astype("<u8"), self.check.astype("<u4")]
        return [base64.b64encode(b"".join(p[i].tobytes() for p in parts)).decode() for i in range(len(self.count))]

    def peel(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Row, digest and side (1 or -1) of everything recovered, and whether each row is done."""
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        active = np.arange(len(self.count))
        for _ in range(self.cells + 1):
            count, digest, check = self.count[active], self.digest[active], self.check[active]
            row, cell = np.nonzero((np.abs(count) == 1) & (_check(digest) == check))
            if not len(row):
                break
            # a digest may stand alone in several of its cells; it is taken once
            pure = np.unique(np.rec.fromarrays([active[row], digest[row, cell], count[row, cell]], names="row,digest,side"))
            _, once = np.unique(np.rec.fromarrays([pure.row, pure.digest]), return_index=True)
            rows, digests, side = pure.row[once], pure.digest[once], pure.side[once]
            self.add(rows, digests, -side)
            found.append((rows, digests, side))
            active = np.unique(rows)
        done = ~(self.count.any(1) | self.digest.any(1) | self.check.any(1))
        rows, digests, side = (np.concatenate(c) for c in zip(*found)) if found else (np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.int32))
        return rows, digests, side, done


def differences(old: list[np.ndarray], new: list[np.ndarray], cells: int = CELLS) -> list[tuple[np.ndarray, np.ndarray]]:
    """The digests only in the old and only in the new version, for each pair."""
    out: list[tuple[np.ndarray, np.ndarray]] = [(np.empty(0, np.uint64),) * 2] * len(old)
    sizes = np.array([len(a) + len(b) for a, b in zip(old, new)])
    least = np.array([abs(len(a) - len(b)) for a, b in zip(old, new)])  # so many differ for certain
    left = np.arange(len(old))
    while len(left):
        now = left[cells >= 1.2 * least[left]]
        rest = left[cells < 1.2 * least[left]]
        failed = []
        for i in range(0, len(now), max(1, (1 << 18) // cells)):
            part = now[i : i + max(1, (1 << 18) // cells)]
            a, b = [old[k] for k in part], [new[k] for k in part]
            rows, digests, side, done = Sketches.of(a, cells).less(Sketches.of(b, cells)).peel()
            order = np.argsort(rows, kind="stable")
            rows, digests, side = rows[order], digests[order], side[order]
            ends = np.searchsorted(rows, np.arange(len(part) + 1))
            for k, ok, low, high in zip(part, done, ends, ends[1:]):
                if ok:
                    out[k] = digests[low:high][side[low:high] > 0], digests[low:high][side[low:high] < 0]
                elif cells > 64 * sizes[k]:  # two digests that share all their places at every size: compare the lists
                    out[k] = np.setdiff1d(old[k], new[k]), np.setdiff1d(new[k], old[k])
                else:
                    failed.append(k)
        left = np.concatenate([rest, np.array(failed, np.int64)]).astype(np.int64)
        cells *= 2
    return out


def likeness(old: list[np.ndarray], new: list[np.ndarray], cells: int = CELLS) -> np.ndarray:
    """Paragraphs in common over all paragraphs, from the recovered differences; 1 for two empty texts."""
    return np.array(
        [
            (len(a) - len(gone)) / (len(a) + len(added)) if len(a) + len(added) else 1.0
            for a, b, (gone, added) in zip(old, new, differences(old, new, cells))
        ]
    )


def _cuts(docs: DataFrame, bucket_bytes: int) -> np.ndarray:
    """Ids that cut the rows into ranges of about ``bucket_bytes`` of text."""
    size = docs.agg(F.sum(F.octet_length("text") + 64).alias("bytes")).first().bytes or 0
    buckets = int(min(MAX_BUCKETS, size // bucket_bytes + 1))
    if buckets == 1:
        return np.empty(0, np.int64)
    shares = [i / buckets for i in range(1, buckets)]
    found = docs.agg(F.percentile_approx("id", F.lit(shares), F.lit(20 * buckets)).alias("cuts")).first().cuts
    return np.unique(np.array(found, np.int64))


def next_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """Rows dealt by ranges of ids and sorted so that each is followed by the next one of
    descending id, the last row by the first: ``bucket, guest, id, text``. A guest row ends a
    bucket; it is the first row of the bucket that follows. Rows of equal id are ordered by text;
    a null id comes after all others."""
    rows = docs.select(
        F.coalesce(ref(id_col).cast("long"), F.lit(-(1 << 63))).alias("id"),
        F.coalesce(ref(text_col), F.lit("")).alias("text"),
        ref(id_col).isNull().alias("unnamed"),
    )
    cuts = _cuts(rows, bucket_bytes)

    @F.arrow_udf("int")
    def bucket_of(ids: pa.Array) -> pa.Array:
        return pa.array(np.searchsorted(-cuts[::-1], -ids.to_numpy(zero_copy_only=False), "left").astype(np.int32))

    heads = sorted((r.bucket, r.head) for r in rows.select("id").groupBy(bucket_of("id").alias("bucket")).agg(F.max("id").alias("head")).collect())
    before = {head: heads[i - 1][0] for i, (_, head) in enumerate(heads)}  # the last bucket comes before the first
    head_ids = np.array(sorted(before), np.int64)
    earlier = np.array([before[h] for h in sorted(before)], np.int32)

    @F.arrow_udf("int")
    def guest_in(ids: pa.Array) -> pa.Array:
        values = ids.to_numpy(zero_copy_only=False)
        if not len(head_ids):
            return pa.nulls(len(values), pa.int32())
        at = np.minimum(np.searchsorted(head_ids, values), len(head_ids) - 1)
        return pa.array(earlier[at], mask=head_ids[at] != values)

    own = F.struct(bucket_of("id").alias("bucket"), F.lit(False).alias("guest"))
    visit = F.struct(guest_in("id").alias("bucket"), F.lit(True).alias("guest"))
    placed = rows.withColumn("place", F.explode(F.array(own, visit))).where("place.bucket IS NOT NULL")
    return (
        placed.select("place.bucket", "place.guest", "id", "unnamed", "text")
        .repartition("bucket")
        .sortWithinPartitions("bucket", "guest", F.desc("id"), "text")
    )


def edited_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", cells: int = CELLS) -> DataFrame:
    """Every text beside its edited version, whose last third is the beginning of the next text:
    ``id_col, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next``.

    ``id_col`` holds whole numbers. The next text is that of the next smaller id, and of the
    largest after the smallest; a single document is its own next. A null text is empty; an
    empty text has an empty sketch and is like another empty text. Repeated ids give a row
    each and follow one another in the order of their texts. An empty table gives no rows.
    """
    schema = T.StructType(
        [
            T.StructField("id", T.LongType()),
            T.StructField("n_chars", T.LongType()),
            *(T.StructField(c, T.StringType()) for c in ("edited_sha256", "fingerprint", "edited_fingerprint")),
            *(T.StructField(c, T.DoubleType()) for c in ("near_edited", "near_next")),
        ]
    )
    types = [pa.int64(), pa.int64(), *[pa.string()] * 3, *[pa.float64()] * 2]

    def compare(rows: list[tuple]) -> pa.RecordBatch:
        """rows: bucket, guest, id, text, paragraphs; each but the last is compared with its follower."""
        pairs = [(a, b) for a, b in zip(rows, rows[1:]) if not a[1] and a[0] == b[0]]
        own = [a[4] for a, _ in pairs]
        edited = []
        for (_, _, _, text, _), (_, _, _, follower, _) in pairs:
            changed = len(text) // 3
            edited.append(text[: len(text) - changed] + follower[:changed])
        versions = [paragraphs(t) for t in edited]
        columns = [
            [a[2] for a, _ in pairs],
            [len(a[3]) for a, _ in pairs],
            [hashlib.sha256(t.encode()).hexdigest() for t in edited],
            Sketches.of(own, cells).written(),
            Sketches.of(versions, cells).written(),
            likeness(own, versions, cells),
            likeness(own, [b[4] for _, b in pairs], cells),
        ]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=[f.name for f in schema])

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[tuple] = []
        for batch in slices(batches, max_bytes=4 << 20):
            names = ("bucket", "guest", "id", "unnamed", "text")
            bucket, guest, ids, unnamed, texts = (batch[c].to_pylist() for c in names)
            ids = [None if u else i for i, u in zip(ids, unnamed)]
            rows = waiting + list(zip(bucket, guest, ids, texts, map(paragraphs, texts)))
            yield compare(rows)
            waiting = rows[-1:]

    return next_documents(docs, id_col, text_col).mapInArrow(scan, schema).withColumnRenamed("id", id_col)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", cells: int = CELLS) -> DataFrame:
    """``id_col, n_paragraphs, fingerprint`` of every text alone; null texts count as empty."""
    schema = T.StructType(
        [T.StructField("id", docs.schema[id_col].dataType), T.StructField("n_paragraphs", T.LongType()), T.StructField("fingerprint", T.StringType())]
    )

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, max_bytes=4 << 20):
            digests = [paragraphs(t) for t in batch["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch["id"], pa.array([len(d) for d in digests], pa.int64()), pa.array(Sketches.of(digests, cells).written())],
                names=["id", "n_paragraphs", "fingerprint"],
            )

    return keyed_text(docs, id_col, text_col).mapInArrow(scan, schema).withColumnRenamed("id", id_col)
