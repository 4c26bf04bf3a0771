"""Licence scan: ordered signature rules behind a keyword prefilter.

One pass of an Aho-Corasick automaton over the words of a slice of texts finds the rules'
anchors. A rule runs only in the surroundings of its own anchor. Of the detections, those of
higher priority stand first; one whose words lie within the words of a detection that
stands is suppressed, so "licensed under the Apache License, Version 2.0" does not also count
as an unspecific "Apache License". Base phrases have the highest priority and always stand.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from functools import lru_cache
from typing import NamedTuple

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, types as T

from tabscope.llm.license_rules import BASE, Rule, rules
from tabscope.llm.texts import IN_WORD, LOWER, keyed_text, slices

REACH = 64  # words on either side of an anchor in which its rules look; no rule spans as many, whatever their length


class Detection(NamedTuple):
    label: str
    rule: int
    first: int  # word
    last: int  # word after the last
    weight: float


class Scanner:
    def __init__(self, rules: list[Rule]):
        self.rules = rules
        self.order = sorted({r.priority for r in rules}, reverse=True)
        self.patterns = [re.compile(rf"(?<![^ ])(?:{r.pattern})(?= )") for r in rules]
        self.by_anchor: dict[str, list[int]] = {}
        for i, rule in enumerate(rules):
            self.by_anchor.setdefault(rule.anchor, []).append(i)
        self.automaton = ahocorasick.Automaton()
        for anchor in self.by_anchor:
            self.automaton.add_word(anchor, anchor)
        self.automaton.make_automaton()

    def matches(self, text: str, anchors: dict[str, list[tuple[int, int]]]) -> list[Detection]:
        """What the rules find in words that are joined, and each followed, by a space."""
        found = set()
        spaces = np.flatnonzero(np.frombuffer(text.encode("latin-1"), np.uint8) == 32)
        starts = np.concatenate([[0], spaces + 1])  # of the words, and the text's end
        for anchor, places in anchors.items():
            windows: list[list[int]] = []
            first = np.searchsorted(starts, [begin for begin, _ in places], "right") - 1 - REACH
            last = np.searchsorted(starts, [end for _, end in places], "left") + REACH
            for low, high in zip(starts[np.maximum(first, 0)].tolist(), starts[np.minimum(last, len(starts) - 1)].tolist()):
                if windows and low <= windows[-1][1]:
                    windows[-1][1] = high
                else:
                    windows.append([low, high])
            for i in self.by_anchor[anchor]:
                for low, high in windows:
                    found.update((i, m.start(), m.end()) for m in self.patterns[i].finditer(text, low, high))
        return [
            Detection(self.rules[i].label, i, int(np.searchsorted(spaces, a)), int(np.searchsorted(spaces, b)) + 1, self.rules[i].weight)
            for i, a, b in sorted(found)
        ]

    def resolve(self, detections: list[Detection]) -> list[Detection]:
        """Those that stand: by priority, not contained in one that stands already; of equal
        priority the longer, then the earlier rule, contains the other."""
        standing: list[Detection] = []
        for priority in self.order:
            level = sorted(
                (d for d in detections if self.rules[d.rule].priority == priority), key=lambda d: (d.first, -d.last, d.rule)
            )
            if not level:
                continue
            before = sorted((d.first, d.last) for d in standing)
            starts = np.array([b[0] for b in before])
            reach = np.maximum.accumulate([b[1] for b in before]) if before else starts
            own = -1
            for d in level:
                at = np.searchsorted(starts, d.first, "right") - 1
                if d.last <= own or at >= 0 and d.last <= reach[at]:
                    continue
                standing.append(d)
                own = max(own, d.last)
        return standing

    def scan(self, texts: list[bytes]) -> Iterator[tuple[int, list[Detection], list[Detection]]]:
        """Number of words, all detections, and those that stand, of each text."""
        blob = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
        lower = LOWER[blob]
        inside = IN_WORD[lower]
        ending = np.zeros(len(blob), bool)
        ending[1:] = inside[:-1] & ~inside[1:]
        lower[ending] = 32
        kept = inside | ending
        ends = np.cumsum([len(t) + 1 for t in texts])
        n_words = np.diff(np.cumsum(ending)[ends - 1], prepend=0)
        borders = np.concatenate([[0], np.cumsum(kept)[ends - 1]])
        joined = lower[kept].tobytes().decode("latin-1")
        places: dict[int, dict[str, list[tuple[int, int]]]] = {}
        for last, anchor in self.automaton.iter(joined):
            row = int(np.searchsorted(borders, last, "right")) - 1
            begin = last + 1 - len(anchor) - int(borders[row])
            if begin >= 0:
                places.setdefault(row, {}).setdefault(anchor, []).append((begin, begin + len(anchor)))
        for row, n in enumerate(n_words.tolist()):
            found = self.matches(joined[borders[row] : borders[row + 1]], places[row]) if row in places else []
            yield n, found, self.resolve(found)


@lru_cache(maxsize=1)
def scanner() -> Scanner:
    return Scanner(rules())


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``id_col, n_words, n_base, first_word, last_word, base_labels, labels, score, detections``.

    ``n_base`` counts the places of base phrases, ``first_word`` and ``last_word`` are their
    least and largest first word (null if there is none). ``detections`` are the standing
    ones as (label, first word, word after the last, weight); ``score`` is one less the
    product of what their labels' best weights leave. A null text has no words, nothing is
    found in it and its score is 0. Copies and repeated ids give a row each, an empty
    table none; other columns are not read.
    """
    detection = T.StructType(
        [
            T.StructField("label", T.StringType()),
            T.StructField("first", T.LongType()),
            T.StructField("last", T.LongType()),
            T.StructField("weight", T.DoubleType()),
        ]
    )
    schema = T.StructType(
        [
            T.StructField("id", docs.schema[id_col].dataType),
            *(T.StructField(c, T.LongType()) for c in ("n_words", "n_base", "first_word", "last_word")),
            *(T.StructField(c, T.StringType()) for c in ("base_labels", "labels")),
            T.StructField("score", T.DoubleType()),
            T.StructField("detections", T.ArrayType(detection)),
        ]
    )
    kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]
    kinds.append(pa.list_(pa.struct([("label", pa.string()), ("first", pa.int64()), ("last", pa.int64()), ("weight", pa.float64())])))

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = []
            for n, found, standing in scanner().scan(batch["text"].cast(pa.binary()).to_pylist()):
                base = [d for d in found if d.rule < len(BASE)]
                best: dict[str, float] = {}
                for d in standing:
                    best[d.label] = max(best.get(d.label, 0.0), d.weight)
                rows.append(
                    (
                        n,
                        len(base),
                        min((d.first for d in base), default=None),
                        max((d.first for d in base), default=None),
                        ",".join(sorted({d.label for d in base})),
                        ",".join(sorted(best)),
                        1.0 - float(np.prod([1.0 - best[label] for label in sorted(best)])),
                        [{"label": d.label, "first": d.first, "last": d.last, "weight": d.weight} for d in standing],
                    )
                )
            yield pa.RecordBatch.from_arrays(
                [batch["id"], *(pa.array(c, k) for c, k in zip(zip(*rows), kinds))], names=[f.name for f in schema]
            )

    return keyed_text(docs, id_col, text_col).mapInArrow(scan, schema).withColumnRenamed("id", id_col)
