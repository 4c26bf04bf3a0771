"""Running totals and order statistics without a single-task window.

A window with an ORDER BY and few groups puts every group on one task. Here the
rows are cut into ranges of the order, each range is handled on its own, and
only one summary row per range crosses between them.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from tabscope.functions.columns import ref
from tabscope.functions.hashing import POSITION_BITS
from tabscope.operators.joining import attach
from tabscope.session import let_workers_import
from tabscope.workspace import materialize

SLICE = "_slice"
BUCKET = "_bucket"


def _carry(group: list[str], totals: list[str], ahead: list[str]):
    """Sums before each row and the row after it, within the groups of one sorted range."""

    def tables(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[pa.Table, bool]]:
        held = None  # the last row waits for the one that follows it
        for batch in batches:
            if batch.num_rows:
                rows = pa.Table.from_batches([batch])
                rows = rows if held is None else pa.concat_tables([held, rows])
                held = rows.slice(rows.num_rows - 1)
                yield rows.combine_chunks(), False
        if held is not None:
            yield held.combine_chunks(), True

    def carry(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = TaskContext.get().partitionId()
        carried = np.zeros(len(totals), np.int64)
        for rows, last in tables(batches):
            n = rows.num_rows
            same = np.ones(n, bool)  # the row after belongs to the same group
            same[-1] = False
            for g in group:
                code = rows[g].combine_chunks().dictionary_encode("encode").indices.to_numpy()
                same[:-1] &= code[1:] == code[:-1]
            begins = np.flatnonzero(~np.append(True, same[:-1]))
            out = n if last else n - 1
            values = [pc.fill_null(rows[c], 0).to_numpy().astype(np.int64) for c in totals]
            inner = []
            for i, own in enumerate(values):
                before = np.concatenate([[0], np.cumsum(own)[:-1]])
                start = np.zeros(n, np.int64)
                start[begins] = np.diff(before[begins], prepend=0) if len(begins) else 0
                before = before - np.cumsum(start)
                before[: begins[0] if len(begins) else n] += carried[i]
                inner.append(before)
                carried[i] = before[-1]  # what stands before the row that is held
            columns = [*(rows[c].combine_chunks().slice(0, out) for c in rows.column_names), pa.array(np.full(out, place, np.int32))]
            columns += [pa.array(x[:out]) for x in inner]
            names = [*rows.column_names, SLICE, *(f"_inner_{c}" for c in totals)]
            if ahead:
                after = pa.array(np.where(same, np.arange(1, n + 1), -1))
                after = pc.if_else(pc.less(after, 0), None, after)
                following = [rows[c].combine_chunks().take(after) for c in ahead]
                struct = pa.StructArray.from_arrays(following, names=ahead, mask=pa.array(~same))
                columns.append(struct.slice(0, out))
                names.append("_next")
            if out:
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return carry


def running_totals(
    df: DataFrame,
    group: list[str],
    order: str,
    totals: list[str],
    descending: bool = False,
    look_ahead: list[str] | None = None,
) -> DataFrame:
    """Add ``before_<c>`` and ``all_<c>`` per total, and ``next_<c>`` per look-ahead column.

    ``df`` holds one row per group and order value (collapse copies first).
    ``before_<c>`` is the sum over the earlier rows of the group, ``all_<c>`` the
    sum over the group, ``next_<c>`` the following row's value. Totals are whole
    numbers.

    The rows are shuffled once, into ranges; each task sorts its range and carries the sums
    from row to row. The ranges are written, and a use of the result joins one row per range.
    """
    ahead = look_ahead or []
    groups = [ref(g) for g in group]
    key = F.desc(order) if descending else F.asc(order)
    dealt = df.repartitionByRange(*groups, key).sortWithinPartitions(*groups, key)
    fields = [*df.schema.fields, T.StructField(SLICE, T.IntegerType()), *(T.StructField(f"_inner_{c}", T.LongType()) for c in totals)]
    if ahead:
        fields.append(T.StructField("_next", T.StructType([df.schema[c] for c in ahead])))
    let_workers_import(df.sparkSession)
    ranged = materialize(dealt.mapInArrow(_carry(group, totals, ahead), T.StructType(fields)), "ranges")
    keys = [*group, SLICE]

    first = F.max_by if descending else F.min_by
    summary = [F.sum(c).alias(f"_sum_{c}") for c in totals]
    if ahead:
        summary.append(first(F.struct(*ahead), F.col(order)).alias("_head"))
    ends = ranged.groupBy(*keys).agg(*summary)

    across = Window.partitionBy(*groups).orderBy(SLICE)
    before = across.rowsBetween(Window.unboundedPreceding, -1)
    everything = across.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    starts = ends.select(
        *keys,
        *[F.coalesce(F.sum(f"_sum_{c}").over(before), F.lit(0)).alias(f"_start_{c}") for c in totals],
        *[F.sum(f"_sum_{c}").over(everything).alias(f"all_{c}") for c in totals],
        *([F.lead("_head").over(across).alias("_next_head")] if ahead else []),
    )
    following = F.coalesce(F.col("_next"), F.col("_next_head")) if ahead else None
    return attach(ranged, starts, keys).select(
        *df.columns,
        *[(F.col(f"_start_{c}") + F.col(f"_inner_{c}")).alias(f"before_{c}") for c in totals],
        *[F.col(f"all_{c}") for c in totals],
        *[following[c].alias(f"next_{c}") for c in ahead],
    )


BINS = 1024
ZOOMS = 3
LISTED_ROWS = 50_000


@dataclass
class Bracket:
    """A closed value range of one column known to hold the wanted ranks."""

    column: str
    low: float
    high: float
    below: int
    inside: int
    ranks: list[int]


def exact_percentiles(
    df: DataFrame, spans: dict[str, tuple[int, float, float]], probabilities: list[float], **tuning
) -> dict[str, list[float | None]]:
    """Exact percentiles, linear between neighbours, of DOUBLE columns.

    ``spans`` gives each column's non-null count, minimum and maximum.
    """
    places = {c: [p * (n - 1) for p in probabilities] for c, (n, _, _) in spans.items() if n}
    brackets = [
        Bracket(c, spans[c][1], spans[c][2], 0, spans[c][0], sorted({r for x in xs for r in (int(x), -int(-x // 1))}))
        for c, xs in places.items()
    ]
    at_rank = values_at_ranks(df, brackets, **tuning)
    result: dict[str, list[float | None]] = {c: [None] * len(probabilities) for c in spans}
    for c, xs in places.items():
        for i, x in enumerate(xs):
            low, high = at_rank[c, int(x)], at_rank[c, -int(-x // 1)]
            result[c][i] = low + (high - low) * (x - int(x))
    return result


def values_at_ranks(
    df: DataFrame, brackets: list[Bracket], zooms: int = ZOOMS, listed_rows: int = LISTED_ROWS
) -> dict[tuple[str, int], float]:
    """The values at given ranks, found by narrowing brackets.

    Each zoom is one scan that counts equal-width bins inside the open brackets.
    What is left then is short enough to list per bracket, or is put in order
    by ``running_totals``; both are exact.
    """
    found: dict[tuple[str, int], float] = {}
    open_brackets = _settle(brackets, found)
    for _ in range(zooms):
        if sum(b.inside for b in open_brackets) <= listed_rows:
            break
        finite = [b for b in open_brackets if math.isfinite(b.high - b.low)]
        endless = [b for b in open_brackets if b not in finite]
        open_brackets = endless + (_settle(_zoom(df, finite), found) if finite else [])
    short = [b for b in open_brackets if b.inside <= listed_rows]
    long = [b for b in open_brackets if b.inside > listed_rows]
    if short:
        lists = _members(df, short).groupBy("id").agg(F.sort_array(F.collect_list("value")).alias("values"))
        wanted = F.create_map(
            *[x for i, b in enumerate(short) for x in (F.lit(i), F.array(*[F.lit(r - b.below) for r in b.ranks]))]
        )
        picked = lists.select("id", F.transform(wanted[F.col("id")], lambda r: F.get("values", r)).alias("values"))
        for row in picked.collect():
            bracket = short[row["id"]]
            found.update({(bracket.column, r): v for r, v in zip(bracket.ranks, row["values"])})
    if long:
        copies = _members(df, long).groupBy("id", "value").agg(F.count("*").alias("copies"))
        placed = running_totals(copies, ["id"], "value", ["copies"])
        wanted = F.create_map(
            *[x for i, b in enumerate(long) for x in (F.lit(i), F.array(*[F.lit(r - b.below) for r in b.ranks]))]
        )
        hits = placed.withColumn("rank", F.explode(wanted[F.col("id")])).filter(
            (F.col("before_copies") <= F.col("rank")) & (F.col("rank") < F.col("before_copies") + F.col("copies"))
        )
        for row in hits.select("id", "rank", "value").collect():
            bracket = long[row["id"]]
            found[bracket.column, row["rank"] + bracket.below] = row["value"]
    return found


def _settle(brackets: list[Bracket], found: dict) -> list[Bracket]:
    """Keep the brackets that still hold different values."""
    for b in brackets:
        if b.low == b.high:
            found.update({(b.column, r): b.low for r in b.ranks})
    return [b for b in brackets if b.low < b.high]


def _by_column(brackets: list[Bracket]) -> dict[str, list[int]]:
    places: dict[str, list[int]] = {}
    for i, b in enumerate(brackets):
        places.setdefault(b.column, []).append(i)
    return places


def _choose(brackets: list[Bracket], places: list[int], value) -> Column:
    """CASE over the brackets of one column, which never overlap."""
    choice = F
    for i in places:
        b = brackets[i]
        choice = choice.when(ref(b.column).between(b.low, b.high), value(i, b))
    return choice


def _members(df: DataFrame, brackets: list[Bracket]) -> DataFrame:
    """``id, value`` for every value inside a bracket."""
    entries = [
        F.struct(_choose(brackets, places, lambda i, b: F.lit(i)).alias("id"), ref(c).alias("value"))
        for c, places in _by_column(brackets).items()
    ]
    return df.select(F.inline(F.array(*entries))).filter(F.col("id").isNotNull())


def _zoom(df: DataFrame, brackets: list[Bracket]) -> list[Bracket]:
    def cell(i: int, b: Bracket) -> Column:
        share = (ref(b.column) - b.low) / (b.high - b.low)
        return F.least(F.floor(share * BINS), F.lit(BINS - 1)).cast("int") + F.lit(i * BINS)

    entries = [
        F.struct(_choose(brackets, places, cell).alias("cell"), ref(c).alias("value"))
        for c, places in _by_column(brackets).items()
    ]
    # at most BINS rows per bracket come back
    rows = (
        df.select(F.inline(F.array(*entries)))
        .filter(F.col("cell").isNotNull())
        .groupBy("cell")
        .agg(F.count("*").alias("rows"), F.min("value").alias("low"), F.max("value").alias("high"))
        .collect()
    )
    narrowed = []
    for i, b in enumerate(brackets):
        below = b.below
        for row in sorted((r for r in rows if r["cell"] // BINS == i), key=lambda r: r["cell"]):
            ranks = [r for r in b.ranks if below <= r < below + row["rows"]]
            if ranks:
                narrowed.append(Bracket(b.column, row["low"], row["high"], below, row["rows"], ranks))
            below += row["rows"]
    return narrowed


def position_cutoffs(df: DataFrame, group: list[str], place: str, parts: int, sizes=None, rows: int | None = None) -> DataFrame:
    """Positions that cut each group into consecutive parts of prescribed size.

    ``place`` is an evenly spread BIGINT (see ``functions.hashing``). ``sizes``
    gives, from the group's row count ``n`` and a part number 1..parts-1, how many
    rows precede that part; by default the parts differ by at most one row.

    Rows are counted per leading bits of the position, about as many buckets as
    a bucket has rows; only the few buckets that hold a cut are looked at row by
    row. ``rows`` saves counting them. Returns ``group..., cuts`` (ascending).
    """
    bits = min(POSITION_BITS, max(8, ((df.count() if rows is None else rows).bit_length() + 1) // 2))
    start_of = sizes or (lambda n, part: F.ceil(n * part / F.lit(parts)).cast("bigint"))
    bucket = F.shiftright(ref(place), POSITION_BITS - bits)
    keys = [ref(g) for g in group]
    slim = df.select(*keys, ref(place), bucket.alias(BUCKET))

    per_bucket = slim.groupBy(*keys, BUCKET).agg(F.count("*").alias("rows"))
    order = Window.partitionBy(*keys).orderBy(BUCKET)
    placed = per_bucket.select(
        *keys,
        BUCKET,
        "rows",
        F.coalesce(F.sum("rows").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"),
        F.sum("rows").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("n"),
    )
    part = F.explode(F.sequence(F.lit(1), F.lit(parts - 1)))
    cut = (
        placed.withColumn("part", part)
        .withColumn("start", start_of(F.col("n"), F.col("part")))
        .filter((F.col("before") <= F.col("start")) & (F.col("start") < F.col("before") + F.col("rows")))
        .groupBy(*keys, BUCKET)
        .agg(F.collect_list(F.struct("part", (F.col("start") - F.col("before")).alias("offset"))).alias("targets"))
    )

    near = attach(slim, cut, [*group, BUCKET])
    values = near.groupBy(*keys, BUCKET, "targets", ref(place)).agg(F.count("*").alias("copies"))
    inside = Window.partitionBy(*keys, BUCKET).orderBy(place).rowsBetween(Window.unboundedPreceding, -1)
    found = (
        values.withColumn("before", F.coalesce(F.sum("copies").over(inside), F.lit(0)))
        .withColumn("target", F.explode("targets"))
        .filter(
            (F.col("before") <= F.col("target.offset"))
            & (F.col("target.offset") < F.col("before") + F.col("copies"))
        )
    )
    return found.groupBy(*keys).agg(F.array_sort(F.collect_list(ref(place))).alias("cuts"))
