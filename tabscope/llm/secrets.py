"""Secret scan in DataFrame functions alone.

Patterns give the base spans: assignments to telling names, access keys, long hexadecimal
runs. Strings that no pattern knows are judged by two character Markov models, one of
random strings and one of ordinary identifiers: a candidate is taken for a secret if its
log-likelihood ratio is high enough. The models are trained from labelled samples of a
bounded number of rows: the values in base spans and strings derived from hashes of the rows'
ids are random, the other identifiers in their texts are ordinary. A model is a table of pairs
of characters, so its size does not grow with the data.
"""

from __future__ import annotations

from collections.abc import Callable
from math import log
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F

from tabscope.functions.columns import ref

#: kind: pattern, and what a match must satisfy to be kept. Fixed values.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_LEAST = 8
ACCESS = r"AKIA[A-Z0-9]{12,}"  # AKIA[A-Z0-9]+ of 16 characters or more
HEX = r"[0-9a-f]{32,}"  # [0-9a-f]+ of 32 characters or more
KINDS = ("assign", "access", "hex", "random")

CANDIDATE = r"[A-Za-z0-9+/=_-]{20,}"
IDENTIFIER = r"[A-Za-z][A-Za-z0-9_-]{5,39}"
FIRST, SYMBOLS = 43, 80  # the characters + to z, among them all that candidates are made of
TRAIN_ROWS = 20_000
MIN_RATIO = 25.0
MASK = "[SECRET]"

#: Stands for characters of base spans while candidates are looked for; a Unicode noncharacter.
_BLANK = "\uffff"
_LONE = rf"(?<![{_BLANK}A-Za-z0-9+/=_-]){CANDIDATE}(?![{_BLANK}A-Za-z0-9+/=_-])"

_NO_SPANS = "CAST(array() AS ARRAY<STRUCT<start: INT, kind: INT, end: INT, value: STRING>>)"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _chunks(items: Column) -> Column:
    """The array in about as many pieces as a piece has items. Arrays that grow item by item inside a
    piece cost its size squared, so all of them cost the number of items times its root."""

    def cut(own: Column) -> Column:
        width = F.greatest(F.lit(1), F.ceil(F.sqrt(F.size(own)))).cast("int")
        last = F.greatest(F.lit(0), F.ceil(F.size(own) / width).cast("int") - 1)
        return F.transform(F.sequence(F.lit(0), last), lambda i: F.slice(own, i * width + 1, width))

    return _let(items, cut)


def _before(pieces: Column, grow: Callable[[Column, Column], Column]) -> Column:
    """For each piece what ``grow`` has made, from 0, of the pieces before it."""

    def step(done: Column, piece: Column) -> Column:
        return F.struct(grow(done["at"], piece).alias("at"), F.concat(done["before"], F.array(done["at"])).alias("before"))

    begin = F.struct(F.lit(0).alias("at"), F.expr("CAST(array() AS ARRAY<INT>)").alias("before"))
    return F.aggregate(pieces, begin, step)["before"]


def _matches(text: Column, pattern: str, kind: int) -> Column:
    """Leftmost matches that do not overlap, as structs of start, kind, end, value in code points.

    The pieces between the matches tell where these stand.
    """
    parts = F.arrays_zip(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("value"), F.split(text, pattern, -1).alias("between"))

    def step(done: Column, part: Column) -> Column:
        start = done["at"] + F.length(part["between"])
        end = start + F.length(part["value"])
        span = F.struct(start.alias("start"), F.lit(kind).alias("kind"), end.alias("end"), part["value"].alias("value"))
        return F.struct(end.alias("at"), F.concat(done["spans"], F.array(span)).alias("spans"))

    def moved(span: Column, by: Column) -> Column:
        return F.struct((span["start"] + by).alias("start"), span["kind"].alias("kind"), (span["end"] + by).alias("end"), span["value"].alias("value"))

    begin = F.struct(F.lit(0).alias("at"), F.expr(_NO_SPANS).alias("spans"))
    local = F.transform(_chunks(F.filter(parts, lambda p: p["value"].isNotNull())), lambda chunk: F.aggregate(chunk, begin, step))
    placed = _let(local, lambda own: F.flatten(F.zip_with(own, _before(own, lambda at, c: at + c["at"]), lambda c, by: F.transform(c["spans"], lambda s: moved(s, by)))))
    return F.when(text.rlike(pattern), placed).otherwise(F.expr(_NO_SPANS))


def _kept_assign(value: Column) -> Column:
    return F.length(F.regexp_extract(value, ASSIGN, 2)) >= ASSIGN_LEAST


def _blanked(text: Column) -> Column:
    """The text with as many blanks in place of every kept assignment."""
    parts = F.arrays_zip(F.regexp_extract_all(text, F.lit(ASSIGN), F.lit(0)).alias("value"), F.split(text, ASSIGN, -1).alias("between"))
    clear = lambda p: F.concat(
        p["between"], F.when(p["value"].isNull(), "").when(_kept_assign(p["value"]), F.repeat(F.lit(_BLANK), F.length(p["value"]))).otherwise(p["value"])
    )
    return F.when(text.rlike(ASSIGN), F.array_join(F.transform(parts, clear), "")).otherwise(text)


def _candidates(text: Column, base: str) -> Column:
    """Candidates that no base span overlaps.

    Access keys and hexadecimal runs consist of a candidate's characters, so one that overlaps
    a candidate lies within it. Assignments are blanked before; a candidate must not touch a blank.
    """
    free = F.filter(_matches(_blanked(text), _LONE, 3), lambda c: ~c["value"].rlike(HEX) & ~c["value"].rlike(ACCESS))
    every = F.filter(_matches(text, CANDIDATE, 3), lambda c: ~F.exists(base, lambda b: (b["start"] < c["end"]) & (b["end"] > c["start"])))
    return F.when(F.contains(text, F.lit(_BLANK)), every).otherwise(free)


def _base_spans(text: Column) -> list[Column]:
    return [F.filter(_matches(text, ASSIGN, 0), lambda s: _kept_assign(s["value"])), _matches(text, ACCESS, 1), _matches(text, HEX, 2)]


def _pairs(value: Column) -> Column:
    """Every two neighbouring characters."""
    characters = F.split(value, "")
    most = F.greatest(F.size(characters) - 1, F.lit(0))
    return F.zip_with(F.slice(characters, 1, most), F.slice(characters, 2, most), lambda a, b: F.concat(a, b))


class Model(NamedTuple):
    ratios: str  # of all pairs of symbols, row by row, joined by commas
    pairs: int  # that it was trained from


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rows: int = TRAIN_ROWS, smoothing: float = 0.5) -> Model:
    """Log-likelihood ratios of all pairs of characters, random over ordinary.

    Every n-th row by a hash of its id is taken, n being such that about ``rows`` are.
    """
    total = docs.count()
    nth = F.pmod(F.xxhash64(ref(id_col).cast("string")), F.lit(max(1, -(-total // rows)))) == 0
    sample = docs.where(nth).select(ref(id_col).cast("string").alias("id"), F.coalesce(ref(text_col), F.lit("")).alias("text"))
    known = sample.select(
        "id", "text", *[s.alias(k) for k, s in zip(("assign", "access", "hex"), _base_spans(F.col("text")))]
    ).withColumn("base", F.concat("assign", "access", "hex"))
    digest = lambda salt: F.sha2(F.concat(F.coalesce("id", F.lit("")), F.lit(salt)).cast("binary"), 256)
    packed = F.base64(F.unhex(digest("b")))
    random = F.concat(
        F.transform("base", lambda s: F.when(s["kind"] == 0, F.regexp_extract(s["value"], ASSIGN, 2)).otherwise(s["value"])),
        F.array(F.substring(digest("a"), 1, 40), packed, F.translate(packed, "+/", "-_"), F.upper(F.translate(packed, "+/=", ""))),
    )
    ordinary = F.filter(
        F.regexp_extract_all("text", F.lit(IDENTIFIER), F.lit(0)), lambda w: F.length(F.translate(w, "0123456789", "")) >= F.length(w) - 4
    )
    strings = known.select(F.explode(F.array(F.struct(F.lit(1).alias("label"), random.alias("s")), F.struct(F.lit(0).alias("label"), ordinary.alias("s")))).alias("c"))
    strings = strings.select("c.label", F.explode("c.s").alias("s"))
    pairs = strings.select("label", F.explode(_pairs(F.col("s"))).alias("pair")).groupBy("label", "pair").count()
    counts = {(r.label, r.pair): r["count"] for r in pairs.collect()}  # of a fixed alphabet
    alphabet = [chr(FIRST + i) for i in range(SYMBOLS)]
    totals = {(label, a): sum(counts.get((label, a + b), 0) for b in alphabet) for label in (0, 1) for a in alphabet}

    def chance(label: int, a: str, b: str) -> float:
        return log((counts.get((label, a + b), 0) + smoothing) / (totals[label, a] + smoothing * SYMBOLS))

    ratios = [chance(1, a, b) - chance(0, a, b) for a in alphabet for b in alphabet]
    return Model(",".join(f"{r:.4f}" for r in ratios), sum(counts.values()))


def log_ratio(value: Column, model: Model) -> Column:
    """Sum of the ratios of a candidate's pairs."""
    table = F.split(F.lit(model.ratios), ",").cast("array<double>")
    code = lambda c: F.ascii(c) - FIRST

    def weight(pair: Column) -> Column:
        return F.get(table, code(pair) * SYMBOLS + code(F.substring(pair, 2, 1)))

    return F.aggregate(_pairs(value), F.lit(0.0), lambda total, pair: total + weight(pair))


def find_secrets(docs: DataFrame, model: Model, min_ratio: float = MIN_RATIO, text_col: str = "text") -> DataFrame:
    """``docs`` with ``base_spans`` and ``spans``, arrays of (start, kind, end, value), by start, then kind.

    ``kind`` is a place in ``KINDS``; ``spans`` holds the base spans and the candidates whose
    log ratio is ``min_ratio`` or more and that no base span overlaps. A null text is empty and
    has none. Every row is kept as it is, also repeated ones; the work for a text grows with its
    length and, for n matches, with n times the root of n. Columns named ``base_spans``
    or ``spans`` are replaced.
    """
    text = F.coalesce(ref(text_col), F.lit(""))
    named = ("_assign", "_access", "_hex")
    based = docs.withColumns({n: s for n, s in zip(named, _base_spans(text))})
    based = based.withColumn("base_spans", F.array_sort(F.concat(*named))).drop(*named)
    tried = based.withColumn("_tried", _candidates(text, "base_spans"))
    added = F.filter("_tried", lambda c: log_ratio(c["value"], model) >= min_ratio)
    return tried.withColumn("spans", F.array_sort(F.concat("base_spans", added))).drop("_tried")


def listed(spans: str) -> Column:
    """The spans as kind:start:end, joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def secret_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", train_rows: int = TRAIN_ROWS, min_ratio: float = MIN_RATIO) -> DataFrame:
    """One row per document: ``id_col, n_assign, n_access, n_hex, base_sha256, spans, n_random``.

    ``spans`` lists all spans, ``base_sha256`` is the digest of the list of base spans. An empty
    table gives no rows.
    """
    own = docs.select(ref(id_col).alias(id_col), ref(text_col).alias(text_col))
    found = find_secrets(own, train(own, id_col, text_col, train_rows), min_ratio, text_col)
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        ref(id_col),
        *[count(i).alias(f"n_{k}") for i, k in enumerate(KINDS[:3])],
        F.sha2(listed("base_spans").cast("binary"), 256).alias("base_sha256"),
        listed("spans").alias("spans"),
        count(3).alias("n_random"),
    )


def masked(docs: DataFrame, mask: str = MASK, text_col: str = "text") -> DataFrame:
    """``docs`` with the found spans (column ``spans``) replaced by ``mask``; spans that overlap are one."""
    text = ref(text_col)

    def clear(chunk: Column, begin: Column) -> Column:
        """What a chunk of spans leaves of the text from ``begin`` on, a mask after each clear piece."""
        end = F.greatest(begin, F.array_max(F.transform(chunk, lambda s: s["end"])))

        def walk(own: Column) -> Column:
            def step(done: Column, span: Column) -> Column:
                piece = F.concat(F.substring(own, done["at"] - begin + 1, span["start"] - done["at"]), F.lit(mask))
                out = F.when(span["start"] < done["at"], done["out"]).otherwise(F.concat(done["out"], F.array(piece)))
                return F.struct(F.greatest(done["at"], span["end"]).alias("at"), out.alias("out"))

            start = F.struct(begin.alias("at"), F.expr("CAST(array() AS ARRAY<STRING>)").alias("out"))
            return F.array_join(F.aggregate(chunk, start, step)["out"], "")

        return _let(F.substring(text, begin + 1, end - begin), walk)

    def whole(chunks: Column) -> Column:
        furthest = lambda at, chunk: F.greatest(at, F.array_max(F.transform(chunk, lambda s: s["end"])))
        last = F.array_max(F.transform(F.flatten(chunks), lambda s: s["end"]))
        return F.concat(F.array_join(F.zip_with(chunks, _before(chunks, furthest), clear), ""), F.substring(text, last + 1, F.length(text)))

    return docs.withColumn(text_col, F.when(F.size("spans") > 0, _let(_chunks(F.col("spans")), whole)).otherwise(text))
