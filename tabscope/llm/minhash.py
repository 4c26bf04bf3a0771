"""MinHash near-duplicates by tensored banding, every link verified on the full sets.

A document is the set of its distinct word shingles. Two small collections of ``rows``-wide
minhash bands are made per distinct set (16 bands in all, 32 minhashes); a table key is a
pair of one band of each collection, so that 8 + 8 bands serve 64 tables of twice the width.
Sets of similarity s meet in some table with probability (1 - (1 - s^rows)^bands)^2; with two
minhashes a band and eight bands a collection that is 0.9999 at s = 0.85 and 0.999997 at 0.9.

Only distinct sets move. Sets that share a key form a bucket; the pairs of a bucket are never
listed if it is large:

1. *Stars.* In each bucket every set is verified against one centre, the set that meets most
   others in all its buckets; then, among what is left, against a second. Links give components.
2. *Rest.* Only buckets that still hold several components are looked at. Small ones list their
   pairs between components. In large ones every set is described by its difference from a
   centre of its family: what it adds and what it lacks. If two sets are linked, and one of them is not
   linked to the centre, their differences share so much that the first shared shingle, in
   an order that puts rare ones first, stands early in both. A join on the shingles of the differences
   finds these candidates, and they are verified too.

No pair of a bucket that could be a link is left out, and no bucket is cut.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F, types as T

from tabscope.functions.columns import ref
from tabscope.llm.components import components
from tabscope.llm.texts import LOWER, flat, gram_hashes, keyed_text, mixed, runs, slices, span_hashes
from tabscope.workspace import materialize

BANDS, ROWS = 8, 2
SMALL = 16  # sets in a bucket up to which its pairs are listed
SENT_SETS = 200_000  # counted rows of (digest, node) sent to all tasks; more are joined by a shuffle

#: White space that separates words: \x20 and \x09-\x0D.
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_OTHER = np.uint64(0xD6E8FEB86659FD93)


def shingle_sets(texts: pa.Array, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of every row, one after the other, and where each row begins.

    A row with fewer words than ``shingle`` has its whole sequence as one; no words, no shingle.
    """
    data, offsets = flat(texts)
    lower = LOWER[data]
    starts, ends = runs(~_SPACE[lower], offsets)
    first = np.searchsorted(starts, offsets)
    own = span_hashes(lower, starts, ends)
    count = np.diff(first)
    grams = gram_hashes(own, shingle)
    row_of = np.repeat(np.arange(len(count)), count)
    row_of_gram = row_of[: len(grams)]
    whole = row_of_gram == row_of[shingle - 1 :]  # the window does not reach into the next row
    rows, hashes = [row_of_gram[whole]], [grams[whole]]
    for words in range(1, shingle):
        short = np.flatnonzero(count == words)
        if len(short):
            rows.append(short)
            parts = [own[first[short] + i] for i in range(words)]
            total = np.full(len(short), words, np.uint64)
            for part in parts:
                total = mixed(total * _OTHER + part)
            hashes.append(total)
    row, value = np.concatenate(rows), np.concatenate(hashes)
    order = np.lexsort((value, row))
    row, value = row[order], value[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (value[1:] != value[:-1])
    row, value = row[new], value[new]
    return value, np.searchsorted(row, np.arange(len(count) + 1))


def _seeds(n: int, seed: int) -> np.ndarray:
    return mixed(np.arange(1, n + 1, dtype=np.uint64) * _OTHER + np.uint64(seed)) | np.uint64(1)


def bands(values: np.ndarray, begins: np.ndarray, n_bands: int, width: int) -> np.ndarray:
    """Bands of both collections, ``2 * n_bands`` a row, of the rows that have shingles."""
    factors = _seeds(2 * n_bands * width, 11)
    out = np.empty((2 * n_bands, len(begins)), np.uint64)
    for band in range(2 * n_bands):
        key = np.full(len(begins), band, np.uint64)
        for i in range(width):
            key = mixed(key * _OTHER + np.minimum.reduceat(mixed(values * factors[band * width + i]), begins))
        out[band] = key
    return out.T


def _digests(values: np.ndarray, begins: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit digests of each set, in whatever order its members come."""
    return tuple(
        mixed(np.add.reduceat(mixed(values * factor), begins) + sizes.astype(np.uint64) * _OTHER).view(np.int64) for factor in _seeds(2, 5)
    )


def _read(docs: DataFrame, id_col: str, text_col: str, shingle: int, n_bands: int, width: int) -> DataFrame:
    """``id, n, d1, d2, near, far``: set size, digest and the bands of both collections."""
    longs = T.ArrayType(T.LongType())
    fields = [("id", docs.schema[id_col].dataType), ("n", T.LongType()), ("d1", T.LongType()), ("d2", T.LongType()), ("near", longs), ("far", longs)]
    schema = T.StructType([T.StructField(*f) for f in fields])

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            values, begins = shingle_sets(batch["text"], shingle)
            sizes = np.diff(begins)
            full = np.flatnonzero(sizes)
            there = pa.array(np.where(sizes > 0, np.cumsum(sizes > 0) - 1, 0), mask=sizes == 0)
            if len(full):
                one, two = _digests(values, begins[full], sizes[full])
                both = bands(values, begins[full], n_bands, width).view(np.int64)
                near, far = (
                    pa.ListArray.from_arrays(np.arange(0, n_bands * (len(full) + 1), n_bands, dtype=np.int32), both[:, half].ravel())
                    for half in (slice(0, n_bands), slice(n_bands, None))
                )
                rest = [pa.array(one).take(there), pa.array(two).take(there), near.take(there), far.take(there)]
            else:
                rest = [pa.nulls(len(sizes), pa.int64())] * 2 + [pa.nulls(len(sizes), pa.list_(pa.int64()))] * 2
            yield pa.RecordBatch.from_arrays([batch["id"], pa.array(sizes.astype(np.int64)), *rest], names=schema.names)

    return keyed_text(docs, id_col, text_col).mapInArrow(scan, schema)


def _whole_sets(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame:
    """``node, members`` of the wanted sets (``node, d1, d2``), their hashes sorted, as bytes."""

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            values, begins = shingle_sets(batch["text"], shingle)
            sizes = np.diff(begins)
            full = np.flatnonzero(sizes)
            if not len(full):
                continue
            one, two = _digests(values, begins[full], sizes[full])
            held = pa.LargeBinaryArray.from_buffers(
                pa.large_binary(), len(full), [None, pa.py_buffer((np.append(begins[full], begins[-1]) * 8).astype(np.int64)), pa.py_buffer(values)]
            )
            yield pa.RecordBatch.from_arrays([pa.array(one), pa.array(two), held.cast(pa.binary())], names=["d1", "d2", "members"])

    read = keyed_text(docs, id_col, text_col).mapInArrow(scan, "d1 long, d2 long, members binary")
    if wanted.count() <= SENT_SETS:
        wanted = F.broadcast(wanted)
    return materialize(read.join(wanted, ["d1", "d2"]).groupBy("node").agg(F.first("members").alias("members")), "members")


def _shared(a: bytes, b: bytes) -> int:
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    if len(x) > len(y):
        x, y = y, x
    at = np.searchsorted(y, x)
    at[at == len(y)] = 0
    return int((y[at] == x).sum())


def _both_sets(pairs: DataFrame, members: DataFrame) -> DataFrame:
    left, right = (members.select(F.col("node").alias(c), F.col("members").alias(f"set_{c}")) for c in "ab")
    return pairs.join(left, "a").join(right, "b")


def _verified(pairs: DataFrame, members: DataFrame, percent: int) -> DataFrame:
    """Of ``a, b``, the pairs whose sets are similar enough."""

    def check(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = zip(batch["set_a"].to_pylist(), batch["set_b"].to_pylist())
            both = np.fromiter((_shared(a, b) for a, b in sets), np.int64, batch.num_rows)
            sizes = sum(pc.binary_length(batch[c]).to_numpy(zero_copy_only=False).astype(np.int64) // 8 for c in ("set_a", "set_b"))
            yield batch.select(["a", "b"]).filter(pa.array(100 * both >= percent * (sizes - both)))

    return materialize(_both_sets(pairs, members).select("a", "b", "set_a", "set_b").mapInArrow(check, "a long, b long"), "links")


def _sizes_agree(a: str, b: str, percent: int):
    return 100 * F.least(a, b) >= percent * F.greatest(a, b)


def _labelled(rows: DataFrame, links: DataFrame) -> DataFrame:
    """``rows`` (``node``, ...) with ``comp``, the component of their node."""
    roots = components(links)
    return rows.drop("comp").join(roots, "node", "left").withColumn("comp", F.coalesce("root", "node")).drop("root")


def _stars(rows: DataFrame, members: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """Rows ``key, node, n, weight, comp`` with the ``centre`` of their bucket, and the links found to it."""
    best = rows.groupBy("key").agg(F.max(F.struct("weight", "node", "n", "comp")).alias("best"))
    rows = rows.join(
        best.select("key", F.col("best.node").alias("centre"), F.col("best.n").alias("centre_n"), F.col("best.comp").alias("centre_comp")), "key"
    )
    rows = materialize(rows, "stars")
    pairs = rows.where((F.col("comp") != F.col("centre_comp")) & _sizes_agree("n", "centre_n", percent))
    return rows, _verified(pairs.select(F.col("centre").alias("a"), F.col("node").alias("b")).distinct(), members, percent)


def _open(rows: DataFrame) -> DataFrame:
    """Rows of the buckets that hold more than one component."""
    mixed_keys = rows.groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low < high").select("key")
    return rows.join(mixed_keys, "key", "left_semi")


def _differences(spokes: DataFrame, members: DataFrame) -> DataFrame:
    """``spokes`` (``centre, centre_comp, node, n, comp``) with ``added, lacking`` and one row for
    each ``element`` of the difference from the centre, ``new`` if it is added."""
    schema = "centre long, node long, added long, lacking long, element long, new boolean"

    def differ(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, x, y in zip(*(batch[c].to_pylist() for c in ("a", "b", "set_a", "set_b"))):
                centre, own = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                added, lacking = (np.setdiff1d(u, v, assume_unique=True) for u, v in ((own, centre), (centre, own)))
                total = len(added) + len(lacking)
                yield pa.RecordBatch.from_arrays(
                    [
                        *(pa.array(np.full(total, v, np.int64)) for v in (a, b, len(added), len(lacking))),
                        pa.array(np.concatenate([added, lacking]).view(np.int64)),
                        pa.array(np.arange(total) < len(added)),
                    ],
                    names=["centre", "node", "added", "lacking", "element", "new"],
                )

    pairs = spokes.select(F.col("centre").alias("a"), F.col("node").alias("b"))
    found = _both_sets(pairs, members).select("a", "b", "set_a", "set_b").mapInArrow(differ, schema)
    return materialize(found.join(spokes, ["centre", "node"]), "differences")


def _spokes(rows: DataFrame) -> DataFrame:
    """``centre, centre_comp, node, n, comp``: what the sets of large buckets are described by.

    A bucket takes the heaviest centre that any of its sets has in any bucket, so that the buckets
    of one family of copies are described by the same set, though it is not in all.
    """
    rows = rows.select("key", "node", "n", "weight", "comp")
    top = F.max("top").alias("top")
    of_key = rows.groupBy("key").agg(F.max(F.struct("weight", "node", "comp")).alias("top"))
    of_node = rows.join(of_key, "key").groupBy("node").agg(top)
    of_key = rows.join(of_node, "node").groupBy("key").agg(top)
    spokes = rows.join(of_key, "key").select(F.col("top.node").alias("centre"), F.col("top.comp").alias("centre_comp"), "node", "n", "comp")
    return materialize(spokes.distinct(), "spokes")


def _middle(spokes: DataFrame, found: DataFrame) -> DataFrame:
    """``spokes`` with the centre of each family moved to the set nearest to what most of the family have.

    ``found`` has the differences from the first centre. Those that most of the family share are the
    centre's own edits; a set that shares them all and has few others is the least edited.
    """
    sizes = spokes.groupBy("centre").agg(F.count("*").alias("family"))
    usual = found.groupBy("centre", "element").agg(F.count("*").alias("times")).join(sizes, "centre").where("2 * times > family")
    usual = usual.select("centre", "element", F.lit(1).alias("usual"))
    score = found.join(usual, ["centre", "element"], "left").groupBy("centre", "node").agg(
        (F.first("added") + F.first("lacking") - 2 * F.count("usual")).alias("far")
    )
    score = spokes.join(score, ["centre", "node"], "left").withColumn("far", F.coalesce("far", F.lit(0)))  # the centre itself
    best = score.groupBy("centre").agg(F.min(F.struct("far", "node", "comp")).alias("best"))
    moved = spokes.drop("centre_comp").join(best, "centre").withColumn("centre", F.col("best.node")).withColumn("centre_comp", F.col("best.comp"))
    return materialize(moved.drop("best").distinct(), "spokes")


def _crowded_pairs(rows: DataFrame, members: DataFrame, percent: int) -> DataFrame:
    """Candidates ``a, b`` between the components of large buckets (``rows``: ``key, node, n, weight, comp``).

    The shingles of a difference are put in order: added ones first, then lacking ones, rare ones of the
    family before frequent ones. The first that two differences share leaves room for as many shared
    ones as come after it in the shorter rest; a link needs half of what the differences have beyond the limit.
    """
    spokes = _spokes(rows)
    apart = F.col("node") != F.col("centre")
    spokes = _middle(spokes, _differences(spokes.where(apart), members)).where(apart)
    found = _differences(spokes, members)
    times = found.groupBy("centre", "element").agg(F.count("*").alias("times"))
    within = Window.partitionBy("centre", "node").orderBy(F.desc("new"), "times", "element")
    found = found.join(times, ["centre", "element"]).withColumn("room", F.col("added") + F.col("lacking") + 1 - F.row_number().over(within))
    found = materialize(found.drop("times"), "ordered")
    away = found.where("comp <> centre_comp").select(*[F.col(c).alias(f"a_{c}") for c in found.columns])
    other = found.select(*[F.col(c).alias(f"b_{c}") for c in found.columns])
    same = (F.col("a_centre") == F.col("b_centre")) & (F.col("a_element") == F.col("b_element")) & (F.col("a_comp") != F.col("b_comp"))
    # |a - b| + |b - a| <= (100 - percent) / (100 + percent) * (|a| + |b|) for every link
    limit = (100 - percent) * (F.col("a_n") + F.col("b_n"))
    lacking = F.abs(F.col("a_lacking") - F.col("b_lacking"))
    met = F.abs(F.col("a_added") - F.col("b_added")) + lacking
    disjoint = F.col("a_added") + F.col("b_added") + lacking  # if the first that is shared is lacking, none that is added is shared
    beyond = (100 + percent) * (F.col("a_added") + F.col("a_lacking") + F.col("b_added") + F.col("b_lacking")) - limit
    possible = ((100 + percent) * F.when(F.col("a_new"), met).otherwise(disjoint) <= limit) & _sizes_agree("a_n", "b_n", percent)
    enough = 2 * (100 + percent) * F.least("a_room", "b_room") >= beyond
    pairs = away.join(other, same & possible & enough).select(F.least("a_node", "b_node").alias("a"), F.greatest("a_node", "b_node").alias("b"))
    # a set that is linked to its centre without having met it in a bucket
    linked = (100 + percent) * (F.col("added") + F.col("lacking")) * percent <= (100 - percent) * F.col("n") * (100 + percent)
    unmet = found.where((F.col("comp") != F.col("centre_comp")) & linked).select(F.col("centre").alias("a"), F.col("node").alias("b"))
    return pairs.unionByName(unmet).distinct()


def _listed_pairs(rows: DataFrame, percent: int) -> DataFrame:
    """Candidates ``a, b`` between the components of small buckets."""
    left, right = (rows.select("key", *[F.col(c).alias(f"{s}_{c}") for c in ("node", "n", "comp")]) for s in "ab")
    apart = (F.col("a_node") < F.col("b_node")) & (F.col("a_comp") != F.col("b_comp")) & _sizes_agree("a_n", "b_n", percent)
    return left.join(right, "key").where(apart).select(F.col("a_node").alias("a"), F.col("b_node").alias("b")).distinct()


def linked_sets(docs: DataFrame, sets: DataFrame, shingle: int, percent: int, id_col: str, text_col: str, small: int = SMALL) -> DataFrame:
    """Links ``a, b`` between nodes of ``sets`` that connect all sets similar enough (and meeting in a table)."""
    keys = (
        sets.select("node", "n", "far", F.posexplode("near").alias("i", "x"))
        .select("node", "n", "i", "x", F.posexplode("far").alias("j", "y"))
        .select("node", "n", F.xxhash64("i", "j", "x", "y").alias("key"))
    )
    met = keys.groupBy("key").agg(F.count("*").alias("held")).where("held > 1")
    rows = materialize(keys.join(met, "key"), "buckets")
    weights = rows.groupBy("node").agg(F.sum("held").alias("weight"))
    rows = rows.join(weights, "node").withColumn("comp", F.col("node"))
    members = _whole_sets(docs, materialize(sets.join(weights, "node", "left_semi").select("node", "d1", "d2"), "wanted"), id_col, text_col, shingle)

    rows, links = _stars(rows, members, percent)
    rows = materialize(_open(_labelled(rows.drop("centre", "centre_n", "centre_comp"), links)), "open")
    firsts = rows.groupBy("key").agg(F.max(F.struct("weight", "node", "comp")).alias("first"))
    firsts = firsts.select("key", F.col("first.comp").alias("first_comp"))
    left = rows.join(firsts, "key").where("comp <> first_comp").drop("first_comp")
    _, more = _stars(left, members, percent)
    links = links.unionByName(more)

    rows = materialize(_open(_labelled(rows, links)), "rest")
    rest = _listed_pairs(rows.where(F.col("held") <= small), percent).unionByName(
        _crowded_pairs(rows.where(F.col("held") > small), members, percent)
    )
    return links.unionByName(_verified(rest.distinct(), members, percent))


def near_duplicates(
    docs: DataFrame,
    shingle: int = 3,
    percent: int = 85,
    n_bands: int = BANDS,
    width: int = ROWS,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """``id_col, n_shingles, component_id, kept`` of every document.

    Documents are linked if 100 times the size of the intersection of their shingle sets is
    ``percent`` times that of the union or more; ``component_id`` is the least id that can be
    reached over links, the document's own included. Texts without words (null, empty, white
    space) have no shingle and are linked with nothing. Copies and repeated ids give a row each
    (a repeated id is kept in each row whose component it names); an empty table gives
    none; a null id is the least only among null ids. Other columns are not read.
    """
    rows = materialize(_read(docs, id_col, text_col, shingle, n_bands, width), "minhashes")
    full = rows.where("n > 0")
    distinct = full.groupBy("d1", "d2").agg(F.min("id").alias("first"), F.first("n").alias("n"), F.first("near").alias("near"), F.first("far").alias("far"))
    sets = materialize(distinct.withColumn("node", F.monotonically_increasing_id()), "sets")
    roots = materialize(components(linked_sets(docs, sets, shingle, percent, id_col, text_col)), "roots")
    joined = sets.select("node", "d1", "d2", "first").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = joined.groupBy("root").agg(F.min("first").alias("component"))
    of_set = joined.join(least, "root").select("d1", "d2", "component")
    own = rows.join(of_set, ["d1", "d2"], "left")
    component = F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("id"))
    return own.select(
        ref("id").alias(id_col),
        F.col("n").alias("n_shingles"),
        component.alias("component_id"),
        F.col("id").eqNullSafe(component).alias("kept"),
    )
