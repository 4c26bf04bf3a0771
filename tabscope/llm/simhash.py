"""SimHash near-duplicates by the generalised pigeonhole principle.

Fingerprints are made in the tasks that read the texts; from then on only distinct
fingerprints move. Their 64 bits are grouped into parts, correlated bits together. If the
thresholds of ``m`` parts add up to ``distance - m + 1``, two fingerprints within the
distance agree within the threshold in some part (a part of threshold -1 is not looked at).
The thresholds are dealt to the parts by dynamic programming on the estimated number of
candidates, from how often values of each part occur among all fingerprints. Fingerprints
are filed under each part's value, looked up under all values within the part's threshold,
and candidates are verified on all bits.

Fingerprints that share a value with very many others are linked another way, which makes no
pairs: each is sent to itself and its 64 neighbours at distance one, and all that arrive at
the same place link to the least of them. Two fingerprints meet somewhere exactly if they
differ in two bits or fewer; this serves distances up to 2. For larger ones all candidates
are verified.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import reduce
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from tabscope.functions.columns import ref
from tabscope.llm.components import components
from tabscope.llm.texts import keyed_text, slices
from tabscope.workspace import materialize

BITS = 64
HOT = 64  # fingerprints under one value beyond which they are linked without pairs
PARTS = (2, 3, 4)
_BLOCK = 1 << 14


def fingerprint(text: bytes, shingle: int = 3) -> int:
    """Bit i is set if it is set in over half the hashes of the text's word shingles."""
    found = text.lower().split()  # bytes: A-Z alone is lowered, \x20 and \x09-\x0D alone separate
    if not found:
        return 0
    if len(found) <= shingle:
        hashes = [xxhash.xxh64_intdigest(b" ".join(found), 42)]
    else:
        whole = b" ".join(found)
        ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
        starts = np.concatenate([[0], ends[:-1] + 1])
        digest = xxhash.xxh64_intdigest
        hashes = [digest(whole[a:b], 42) for a, b in zip(starts[: 1 - shingle].tolist(), ends[shingle - 1 :].tolist())]
    values = np.array(hashes, "<u8")
    counts = np.zeros(BITS, np.int64)
    for i in range(0, len(values), _BLOCK):
        bits = np.unpackbits(values[i : i + _BLOCK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(values), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, print``: the fingerprint as a signed long. A null text has no words."""
    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType), T.StructField("print", T.LongType())])

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = np.array([fingerprint(t, shingle) for t in batch["text"].cast(pa.binary()).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch["id"], pa.array(found.view(np.int64))], names=["id", "print"])

    return keyed_text(docs, id_col, text_col).mapInArrow(scan, schema)


def _statistics(prints: DataFrame) -> tuple[int, np.ndarray]:
    """How many fingerprints there are and, of every two bits, how many have both: partial sums of tasks, then one sum."""
    schema = "i int, j int, n long"

    def partial(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = np.zeros((BITS, BITS), np.int64)
        rows = 0
        for batch in batches:
            values = np.ascontiguousarray(batch["print"].to_numpy(zero_copy_only=False)).astype("<i8")
            bits = np.unpackbits(values.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
            both += (bits.T @ bits).astype(np.int64)
            rows += len(values)
        if rows:
            i, j = np.divmod(np.arange(BITS * BITS + 1), BITS)
            yield pa.RecordBatch.from_arrays(
                [pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(np.append(both.ravel(), rows))], names=["i", "j", "n"]
            )

    sums = prints.select("print").mapInArrow(partial, schema).groupBy("i", "j").agg(F.sum("n").alias("n")).collect()  # 64 x 64 + 1
    both, rows = np.zeros((BITS, BITS)), 0
    for r in sums:
        if r.i == BITS:
            rows = r.n
        else:
            both[r.i, r.j] = r.n
    return rows, both


def grouped_bits(both: np.ndarray, rows: int, parts: int) -> list[list[int]]:
    """Bits in parts of near-equal size; each part takes up the bits most correlated with its own."""
    share = np.diag(both) / max(rows, 1)
    deviation = np.sqrt(np.maximum(share * (1 - share), 1e-12))
    related = np.abs((both / max(rows, 1) - np.outer(share, share)) / np.outer(deviation, deviation))
    np.fill_diagonal(related, 0)
    left, out = list(range(BITS)), []
    for part in range(parts):
        size = len(left) // (parts - part)
        first = max(left, key=lambda b: (related[b, left].sum(), -b))
        own = [first]
        left.remove(first)
        while len(own) < size:
            nearest = max(left, key=lambda b: (related[b, own].sum(), -b))
            own.append(nearest)
            left.remove(nearest)
        out.append(sorted(own))
    return out


def _mask(bits: Iterable[int]) -> int:
    value = sum(1 << b for b in bits)
    return value - (1 << BITS) if value >> (BITS - 1) else value


def dealt_thresholds(costs: list[list[float]], total: int) -> tuple[float, list[int]]:
    """The least sum of costs and its thresholds: ``costs[part][t + 1]`` for thresholds t from -1, which add up to ``total``."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for part in costs:
        following: dict[int, tuple[float, list[int]]] = {}
        for used, (cost, chosen) in best.items():
            for t, own in enumerate(part, -1):
                if cost + own < following.get(used + t, (float("inf"), []))[0]:
                    following[used + t] = (cost + own, [*chosen, t])
        best = following
    return best[total]


def _within(part: list[int], share: np.ndarray, t: int) -> float:
    """How many times likelier two fingerprints are to differ in ``t`` bits of a part or fewer than
    in none, bits taken as independent."""
    differ = 2 * share[part] * (1 - share[part])
    chance = np.zeros(t + 1)
    chance[0] = 1.0
    for p in differ:
        chance[1:] = chance[1:] * (1 - p) + chance[:-1] * p
        chance[0] *= 1 - p
    return float(chance.sum() / max(chance[0], 1e-300))


def plan(prints: DataFrame, distance: int, parts: Iterable[int] = PARTS) -> list[tuple[list[int], int]]:
    """Parts of bits and their thresholds, of the number of parts that is estimated cheapest."""
    rows, both = _statistics(prints)
    share = np.diag(both) / max(rows, 1)
    choices = {m: grouped_bits(both, rows, m) for m in parts}
    filed = F.explode(
        F.array(
            *(
                F.struct(F.lit(m).alias("m"), F.lit(i).alias("part"), F.col("print").bitwiseAND(F.lit(_mask(own))).alias("value"))
                for m, groups in choices.items()
                for i, own in enumerate(groups)
            )
        )
    )
    counted = prints.select(filed.alias("f")).select("f.*").groupBy("m", "part", "value").count()
    # buckets beyond HOT make no pairs but 65 places for each fingerprint
    cost = F.when(F.col("count") > HOT, F.col("count") * float(BITS + 1)).otherwise(F.col("count").cast("double") * F.col("count"))
    equal = {(r.m, r.part): r.cost for r in counted.groupBy("m", "part").agg(F.sum(cost).alias("cost")).collect()}
    best = (float("inf"), [])
    for m, groups in choices.items():
        costs = []
        for i, own in enumerate(groups):
            row = [0.0]
            for t in range(distance + 1):
                looked_up = sum(comb(len(own), k) for k in range(t + 1))
                row.append(equal.get((m, i), 0.0) * _within(own, share, t) + 4.0 * rows * (1 + looked_up * (t > 0)))
            costs.append(row)
        cost, chosen = dealt_thresholds(costs, distance - m + 1)
        if cost < best[0]:
            best = (cost, [(own, t) for own, t in zip(groups, chosen) if t >= 0])
    return best[1]


def _values(part: list[int], threshold: int) -> Column:
    """The values of a part's bits that differ from the fingerprint's in ``threshold`` bits or fewer."""
    flips = [_mask(flip) for k in range(threshold + 1) for flip in combinations(part, k)]
    own = F.col("print").bitwiseAND(F.lit(_mask(part)))
    return F.transform(F.array(*[F.lit(f) for f in flips]), lambda f: own.bitwiseXOR(f))


def links(prints: DataFrame, distance: int = 2, hot: int = HOT) -> DataFrame:
    """Links ``a, b`` of distinct fingerprints (``print``, stored): as many as connect all within the distance."""
    parts = plan(prints, distance)

    def filed(look_up: bool) -> DataFrame:
        rows = [
            prints.select("print", F.lit(i).alias("part"), F.explode(_values(own, t if look_up else 0)).alias("value"))
            for i, (own, t) in enumerate(parts)
        ]
        return reduce(DataFrame.unionByName, rows)

    probes, exact = filed(True), all(t == 0 for _, t in parts)
    if distance > 2:
        index, asked, crowd = filed(False), probes, None
    else:
        sizes = probes.groupBy("part", "value").count()
        full = materialize(sizes.where(F.col("count") > hot).select("part", "value"), "crowded")
        crowded = full.count()
        if crowded:
            some = F.broadcast(full) if crowded <= 100_000 else full
            asked = probes.join(some, ["part", "value"], "left_anti")
            index = filed(False).join(some, ["part", "value"], "left_anti")
            crowd = materialize(probes.join(some, ["part", "value"], "left_semi").select("print").distinct(), "crowd")
        else:
            index, asked, crowd = filed(False), probes, None
    on = (F.col("i.part") == F.col("q.part")) & (F.col("i.value") == F.col("q.value"))
    near = F.bit_count(F.col("i.print").bitwiseXOR(F.col("q.print"))) <= distance
    order = F.col("i.print") < F.col("q.print") if exact else F.col("i.print") != F.col("q.print")
    pairs = index.alias("i").join(asked.alias("q"), on & near & order).select(F.col("i.print").alias("a"), F.col("q.print").alias("b"))
    if crowd is None:
        return pairs
    flips = F.array(F.lit(0).cast("long"), *[F.lit(_mask([b])) for b in range(BITS)])
    places = crowd.select("print", F.explode(F.transform(flips, lambda f: F.col("print").bitwiseXOR(f))).alias("place"))
    met = places.withColumn("least", F.min("print").over(Window.partitionBy("place"))).where("print <> least")  # 65 rows a place at most
    return pairs.unionByName(met.select(F.col("least").alias("a"), F.col("print").alias("b")).distinct())


def near_duplicates(docs: DataFrame, shingle: int = 3, distance: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, fingerprint, component_id`` of every document.

    Documents whose fingerprints differ in ``distance`` bits or fewer are linked;
    ``component_id`` is the least id that can be reached over links, the document's own
    included. Texts of no words (null, empty, white space) have fingerprint zero and are linked
    like any other. Copies and repeated ids give a row each; an empty table gives none; a
    null id is the least only among null ids. Other columns are not read.
    """
    rows = materialize(fingerprints(docs, shingle, id_col, text_col), "fingerprints")
    firsts = materialize(rows.groupBy("print").agg(F.min("id").alias("first")), "prints")
    roots = components(links(firsts, distance)).select(F.col("node").alias("print"), "root")
    joined = firsts.join(roots, "print", "left").select("print", "first", F.coalesce("root", "print").alias("root"))
    least = joined.groupBy("root").agg(F.min("first").alias("component"))
    member = joined.join(least, "root").select("print", "component")
    return rows.join(member, "print").select(
        ref("id").alias(id_col), F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id")
    )
