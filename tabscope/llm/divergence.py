"""Source divergence audit over a frequent-pattern tree of term rows.

Every kept term of a language is a row: the counts it has in the language's sources, nonzero
ones alone, ordered by source. Equal rows are one pattern with a multiplicity. For two sources
the sum over all terms of f(p, q) is

    V f(p0, q0)                                            as if no term occurred in either
    + sum over terms in the one  of f(p, q0) - f(p0, q0)     from how often each p occurs
    + sum over terms in the other of f(p0, q) - f(p0, q0)
    + sum over terms in both of f(p, q) - f(p, q0) - f(p0, q) + f(p0, q0)

with p0, q0 the values of a count of zero. The last line is gathered from a frequent-pattern
tree: patterns are inserted with their multiplicities, terms whose rows begin alike share a
path, and every combination of a node and one of its ancestors adds its correction once, times the
multiplicity of the node. Patterns are dealt to the tasks in ranges of their order, so that shared
paths stay together; a task builds the tree of a bounded batch of its sorted patterns at a time.
A path cut between two trees is two nodes with a part of the multiplicity each, and the
sums are the same. All arithmetic is on integers.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from tabscope.functions.columns import ref
from tabscope.llm.texts import LOWER, flat, runs, slices
from tabscope.operators.joining import attach
from tabscope.workspace import materialize

UNIT = 1_000_000_000
_LETTER = np.zeros(256, bool)
_LETTER[97:123] = _LETTER[128:] = True  # after A-Z are lower-cased; all bytes of characters beyond ASCII


def terms(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All terms of the rows, one after the other, and the row of each."""
    data, offsets = flat(texts)
    lower = LOWER[data]
    inside = _LETTER[lower]
    starts, ends = runs(inside, offsets)
    sizes = ends - starts
    places = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    letters = lower[inside]  # the terms follow each other without gaps
    found = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(places), pa.py_buffer(np.ascontiguousarray(letters)))
    return found, np.searchsorted(offsets, starts, "right") - 1


def term_counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """``lang, source, term, n, docs``: partial counts of occurrences and documents, to be summed."""
    read = docs.select(*[F.coalesce(ref(c).cast("string"), F.lit("")).alias(n) for c, n in ((text_col, "text"), (lang_col, "lang"), (source_col, "source"))])

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found, row = terms(batch["text"])
            if not len(found):
                continue
            coded = found.dictionary_encode()
            code, words = coded.indices.to_numpy().astype(np.int64), coded.dictionary
            lang, source = (batch[c].dictionary_encode() for c in ("lang", "source"))
            group = lang.indices.to_numpy().astype(np.int64) * len(source.dictionary) + source.indices.to_numpy()
            in_row, times = np.unique(row * len(words) + code, return_counts=True)
            row, code = np.divmod(in_row, len(words))
            in_group = group[row] * len(words) + code
            order = np.argsort(in_group, kind="stable")
            in_group = in_group[order]
            first = np.flatnonzero(np.append(True, np.diff(in_group) != 0))
            key, n, n_docs = in_group[first], np.add.reduceat(times[order], first), np.diff(np.append(first, len(order)))
            own, word = np.divmod(key, len(words))
            yield pa.RecordBatch.from_arrays(
                [
                    lang.dictionary.take(pa.array(own // len(source.dictionary))),
                    source.dictionary.take(pa.array(own % len(source.dictionary))),
                    words.take(pa.array(word)).cast(pa.string()),
                    pa.array(n.astype(np.int64)),
                    pa.array(n_docs.astype(np.int64)),
                ],
                names=["lang", "source", "term", "n", "docs"],
            )

    return read.mapInArrow(count, "lang string, source string, term string, n long, docs long")


def share(count: Column, total: Column) -> Column:
    """1 + floor(1e9 * (count + 1) / total) by long division in three digits of base 1000, which
    stays within 64 bits for totals below 9e15."""
    rest, out = count + 1, F.lit(1).cast("long")
    for digit in (1_000_000, 1_000, 1):
        rest = rest * 1_000
        out = out + _div(rest, total) * digit
        rest = rest % total
    return out


def _div(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def gap(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / q)."""
    return _div((p - q) * (p - q), q)


def _gap(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // q


class PatternTree:
    """Nodes of a frequent-pattern tree: source, its p and p0, parent and multiplicity."""

    def __init__(self, offsets: np.ndarray, source: np.ndarray, p: np.ndarray, p0: np.ndarray, times: np.ndarray):
        """``offsets``: where each pattern of the sorted list begins (and the last ends)."""
        size = np.diff(offsets)
        nodes, parents, totals = [], [], []
        above = np.full(len(size), -1, np.int64)  # the node of each pattern one level up
        rows, level = np.arange(len(size)), 0
        while True:
            rows = rows[size[rows] > level]
            if not len(rows):
                break
            at = offsets[rows] + level
            new = np.ones(len(rows), bool)
            new[1:] = (above[rows[1:]] != above[rows[:-1]]) | (source[at[1:]] != source[at[:-1]]) | (p[at[1:]] != p[at[:-1]])
            before = sum(map(len, nodes))
            first = np.flatnonzero(new)
            nodes.append(at[first])
            parents.append(above[rows[first]])
            totals.append(np.add.reduceat(times[rows], first))
            above[rows] = before + np.cumsum(new) - 1
            level += 1
        place = np.concatenate(nodes) if nodes else np.empty(0, np.int64)
        self.source, self.p, self.p0 = source[place], p[place], p0[place]
        self.parent = np.concatenate(parents) if parents else place
        self.times = np.concatenate(totals) if totals else place

    def corrections(self, n_sources: int) -> tuple[np.ndarray, np.ndarray]:
        """Sums by ``group * n_sources + item`` over every node and ancestor, both ways round."""
        keys, sums = np.empty(0, np.int64), np.empty(0, np.int64)
        node, ancestor = np.arange(len(self.parent)), self.parent.copy()
        while True:
            there = ancestor >= 0
            node, ancestor = node[there], ancestor[there]
            if not len(node):
                return keys, sums
            for a, b in ((node, ancestor), (ancestor, node)):
                both = _gap(self.p[a], self.p[b]) - _gap(self.p[a], self.p0[b]) - _gap(self.p0[a], self.p[b]) + _gap(self.p0[a], self.p0[b])
                keys, place = np.unique(np.concatenate([keys, self.source[a] * n_sources + self.source[b]]), return_inverse=True)
                added = np.zeros(len(keys), np.int64)
                np.add.at(added, place, np.concatenate([sums, both * self.times[node]]))
                sums = added
            ancestor = self.parent[ancestor]


def _tree_corrections(patterns: DataFrame) -> DataFrame:
    """``lang, source, item, value`` summed over the trees of all tasks (``patterns``: ``lang, row, times``)."""

    def build(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = batch["lang"].dictionary_encode()
            code = langs.indices.to_numpy()
            cuts = np.flatnonzero(np.diff(code)) + 1  # sorted by language first
            for a, b in zip(np.append(0, cuts), np.append(cuts, len(code))):
                part = batch.slice(a, b - a)
                if not len(part):
                    continue
                row = part["row"]
                cells = row.flatten()
                names = cells.field("source").dictionary_encode()
                tree = PatternTree(
                    np.concatenate([[0], np.cumsum(pc.list_value_length(row).to_numpy())]).astype(np.int64),
                    names.indices.to_numpy().astype(np.int64),
                    cells.field("p").to_numpy(),
                    cells.field("p0").to_numpy(),
                    part["times"].to_numpy(),
                )
                keys, sums = tree.corrections(len(names.dictionary))
                if len(keys):
                    one, two = (names.dictionary.take(pa.array(k)) for k in np.divmod(keys, len(names.dictionary)))
                    yield pa.RecordBatch.from_arrays([pa.array([part["lang"][0].as_py()] * len(keys)), one, two, pa.array(sums)], names=["lang", "source", "item", "value"])

    dealt = patterns.repartitionByRange("lang", "row").sortWithinPartitions("lang", "row")
    found = dealt.mapInArrow(build, "lang string, source string, item string, value long")
    return found.groupBy("lang", "source", "item").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("value"))


def divergence_audit(
    docs: DataFrame,
    min_docs: int = 3,
    top: int = 200,
    text_col: str = "text",
    lang_col: str = "lang",
    source_col: str = "source",
) -> DataFrame:
    """``lang, source, part, item, value, rank``: how far each source is from the others of its
    language (part ``pair``, all of them) and from the language's terms (part ``term``, the
    ``top`` terms that it has more of).

    Null text, language and source are read as ''. A language keeps the terms of ``min_docs``
    documents or more; repeated rows count each. A source without kept terms takes part with counts of zero;
    if a language keeps none, its pairs have value 0. Ties are ordered by item. A lone
    source has no pair. An empty table gives no rows; other columns are not read.
    """
    groups = docs.select(*[F.coalesce(ref(c).cast("string"), F.lit("")).alias(n) for c, n in ((lang_col, "lang"), (source_col, "source"))]).distinct()
    counted = term_counts(docs, text_col, lang_col, source_col).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    by_term = counted.groupBy("lang", "term").agg(
        F.sum("n").alias("total"), F.sum("docs").alias("docs"), F.sort_array(F.collect_list(F.struct("source", "n"))).alias("row")
    )
    kept = materialize(by_term.where(F.col("docs") >= min_docs).select("lang", "term", "total", "row"), "terms")
    cells = kept.select("lang", "term", "total", F.inline("row"))

    langs = kept.groupBy("lang").agg(F.count("*").alias("V"), F.sum("total").alias("lang_n"))  # a row a language
    sums = cells.groupBy("lang", "source").agg(F.sum("n").alias("group_n"))
    sized = groups.join(sums, ["lang", "source"], "left").join(langs, "lang", "left")
    zero = [F.coalesce(F.col(c), F.lit(0)).alias(c) for c in ("group_n", "V", "lang_n")]
    total = F.greatest(F.col("group_n") + F.col("V"), F.lit(1))
    sized = materialize(sized.select("lang", "source", *zero).withColumn("p0", share(F.lit(0).cast("long"), total)), "groups")

    own = attach(cells, sized, ["lang", "source"]).withColumn("p", share(F.col("n"), F.col("group_n") + F.col("V")))
    own = materialize(own.withColumn("q", share(F.col("total"), F.col("lang_n") + F.col("V"))), "shares")
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    over = own.where("p > q").select("lang", "source", F.col("term").alias("item"), gap(F.col("p"), F.col("q")).alias("value"))
    over = over.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).withColumn("part", F.lit("term"))

    patterns = own.groupBy("lang", "term").agg(F.sort_array(F.collect_list(F.struct("source", "p", "p0"))).alias("row"))
    patterns = patterns.where(F.size("row") > 1).groupBy("lang", "row").agg(F.count("*").alias("times"))
    both = _tree_corrections(patterns)

    one, two = (sized.select("lang", F.col("source").alias(n), F.col("p0").alias(f"{n}_p0"), "V") for n in ("source", "item"))
    none = gap(F.col("source_p0"), F.col("item_p0"))
    wide = lambda c: c.cast("decimal(38,0)")
    base = one.join(two.drop("V"), "lang").where("source <> item").select("lang", "source", "item", (wide(none) * F.col("V")).cast("decimal(38,0)").alias("value"))
    seen = own.groupBy("lang", "source", "p", "p0").agg(F.count("*").alias("times"))
    singles = []
    for name, other, first in (("source", "item", True), ("item", "source", False)):
        hist = seen.select("lang", F.col("source").alias(name), "p", F.col("p0").alias(f"{name}_p0"), "times")
        met = hist.join((two if first else one).drop("V"), "lang").where("source <> item")
        there = gap(F.col("p"), F.col("item_p0")) if first else gap(F.col("source_p0"), F.col("p"))
        singles.append(met.groupBy("lang", "source", "item").agg(F.sum(wide((there - none) * F.col("times"))).cast("decimal(38,0)").alias("value")))
    pairs = base.unionByName(singles[0]).unionByName(singles[1]).unionByName(both)
    pairs = pairs.groupBy("lang", "source", "item").agg(F.sum("value").cast("long").alias("value"))
    pairs = pairs.withColumn("rank", F.row_number().over(order)).withColumn("part", F.lit("pair"))
    columns = ["lang", "source", "part", "item", "value", "rank"]
    return pairs.select(columns).unionByName(over.select(columns))
