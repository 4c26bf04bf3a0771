"""Each operator's method against brute force, the library it stands for, or held-out accuracy."""

import hashlib
import random
import re
import time
import tracemalloc
import zlib
from collections import Counter
from math import log2

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from conftest import SF_DIR
from edges import BYTES, PIECES, WORDS
from tokenizers import Tokenizer

from tabscope.llm import components, cross_entropy, decontaminate, fingerprints, language, licenses, packing, queries, secrets, simhash, tokens, toxicity, transducer
from tabscope.llm import texts as shared_texts
from tabscope.llm.license_rules import BASE, rules
from tabscope.session import let_workers_import
from tabscope.workspace import materialize

GOOD = queries.QUERIES


@pytest.fixture(scope="module")
def texts(spark):
    let_workers_import(spark)
    return {r.doc_id: r.text for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text").collect()}


def words(text):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", text.translate({c: c + 32 for c in range(65, 91)}))


def rows(spark, name, key="doc_id"):
    return {r[key]: r for r in GOOD[name](spark, SF_DIR).collect()}


def random_texts(seed, n, alphabet):
    source = random.Random(seed)
    return ["".join(source.choices(alphabet, k=source.randrange(40))) for _ in range(n)]


# licences


def test_license_base(spark, texts):
    found = rows(spark, "op1_license_scan")
    for doc, text in texts.items():
        own = words(text)
        at = [(i, label) for phrase, label in BASE for i in range(len(own)) if own[i : i + len(phrase.split())] == phrase.split()]
        r = found[doc]
        assert (r.n_words, r.n_base, r.base_labels) == (len(own), len(at), ",".join(sorted({b for _, b in at})))
        assert (r.first_word, r.last_word) == ((min(at)[0], max(at)[0]) if at else (None, None))
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(","))


def test_license_rules():
    own = rules()
    scan = licenses.Scanner(own)
    assert len(own) > 300
    cases = {
        "SPDX-License-Identifier: GPL-2.0-or-later": {"gpl-2"},
        "Licensed under the Apache License, Version 2.0 (the License)": {"apache-2"},
        "licensed under the GNU General Public License, version 3.": {"gpl-3"},
        "under the GNU General Public License": {"gpl"},
        "Licensed under CC BY-NC 4.0.": {"cc-by-nc"},
        "published under GPLv3 and parts under the MIT license": {"gpl-3", "mit"},
        "a mit license": {"mit"},
        "GNU GPL version 2 only": {"gpl-2"},
        "terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License": {"gpl-3"},
        "Neither the name of Città nor the names of its contributors may be used to endorse or promote": {"bsd-3-clause"},
        f"Neither the name of {'x' * 60} {' '.join(['y' * 70] * 9)} nor the names of its contributors may be used to endorse or promote": {"bsd-3-clause"},
        "admit licenses": set(),
    }
    for text, labels in cases.items():
        ((_, found, standing),) = scan.scan([text.encode()])
        assert {d.label for d in standing} == labels, text
        for d in found:  # what does not stand lies within something that does
            assert d in standing or any(s.first <= d.first and d.last <= s.last for s in standing)


def test_no_rule_spans_the_words_that_are_looked_at():
    """The most words of a rule, counted as the spaces its pattern can match, stay below the reach."""
    import re._parser as parser

    def spaces(parsed):
        most = 0
        for op, value in parsed:
            name = str(op)
            if name == "LITERAL":
                most += value == 32
            elif name == "SUBPATTERN":
                most += spaces(value[-1])
            elif name == "BRANCH":
                most += max(map(spaces, value[1]))
            elif name in ("MAX_REPEAT", "MIN_REPEAT"):
                own = spaces(value[2])
                most += own * int(value[1]) if own else 0
            elif name == "IN":
                assert (parser.LITERAL, 32) not in value
        return most

    assert max(spaces(parser.parse(r.pattern)) for r in rules()) < licenses.REACH - 2


# secrets


def test_secret_base(spark, texts):
    kinds = ("assign", "access", "hex")
    parts = ["token", "Secret", "pass", "password", "api_key", "APIKEY", "=", ":", " ", "  ", '"', "'", "abc", "AKIA", "ABCDEFGH1234", "0123456789abcdef", "deadbeef", "é", "\U0001f600", ".", "\n", "xX9/+"]
    docs = dict(enumerate(random_texts(2, 1500, parts))) | {10_000 + k: t for k, t in texts.items()}
    table = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    assign = re.compile(secrets.ASSIGN, re.ASCII)
    for r in secrets.secret_scan(table).collect():
        text = docs[r.doc_id]
        base = [(m.start(), 0, m.end()) for m in assign.finditer(text) if len(m[2]) >= 8]
        base += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
        base += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
        shown = [f"{kinds[k]}:{a}:{b}" for a, k, b in sorted(base)]
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(k == i for _, k, _ in base) for i in range(3))
        assert r.base_sha256 == hashlib.sha256(",".join(shown).encode()).hexdigest()
        assert [s for s in r.spans.split(",") if not s.startswith("random")] == (shown or [""]) or set(shown) < set(r.spans.split(","))


def test_secrets_in_a_text_of_very_many(spark):
    """100,000 digests in one text, other kinds between them: base spans, candidates and masking stay whole."""
    let_workers_import(spark)
    source = random.Random(12)
    digests = [f"{source.getrandbits(160):040x}" for _ in range(100_000)]
    parts = [f"{d}  file{i}.txt\n" for i, d in enumerate(digests)]
    parts[500] = "token = " + "Zq9" * 10 + " é\n"
    parts[777] = "AKIA" + "Q7" * 10 + "\n"
    text = "".join(parts)
    table = spark.createDataFrame([(1, text)], "doc_id long, text string")
    model = secrets.train(spark.read.parquet(f"{SF_DIR}/documents.parquet"))
    begun = time.monotonic()
    (found,) = secrets.find_secrets(table, model).collect()
    (clean,) = secrets.masked(secrets.find_secrets(table, model)).select("text").collect()
    spent = time.monotonic() - begun
    base = [(m.start(), 2, m.end()) for m in re.finditer(secrets.HEX, text)]
    base += [(m.start(), 0, m.end()) for m in re.finditer(secrets.ASSIGN, text)] + [(m.start(), 1, m.end()) for m in re.finditer(secrets.ACCESS, text)]
    assert [(s.start, s.kind, s.end) for s in found.base_spans] == sorted(base)
    pieces, at = [], 0
    for s in found.spans:
        if s.start >= at:
            pieces.append(text[at : s.start] + secrets.MASK)
        at = max(at, s.end)
    assert clean.text == "".join(pieces) + text[at:]
    assert spent < 60, spent


def test_candidates_beside_base_spans(spark):
    """The search in the blanked text finds what a comparison of all spans finds, also with the blank itself in the text."""
    let_workers_import(spark)
    parts = ["token=", "password: ", "abcdefgh", "Zq9xT2", "Wm4kP8vR1", "AKIA", "ABCDEFGH1234", "0123456789abcdef", "deadbeef", ".", " ", "\n", "-", "\uffff", "é"]
    docs = [(i, t) for i, t in enumerate(random_texts(21, 3000, parts))]
    model = secrets.train(spark.read.parquet(f"{SF_DIR}/documents.parquet"))
    for r in secrets.find_secrets(spark.createDataFrame(docs, "doc_id long, text string"), model, min_ratio=-1e9).collect():
        base = [(s.start, s.end) for s in r.base_spans]
        runs = [(m.start(), m.end()) for m in re.finditer(secrets.CANDIDATE, r.text)]
        assert [(s.start, s.end) for s in r.spans if s.kind == 3] == [(a, b) for a, b in runs if not any(x < b and y > a for x, y in base)]


def test_secret_model(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    model = secrets.train(docs)
    strings = {
        "wJalrXUtnFEMIK7MDENGbPxRfiCYEXAMPLEKEY": True,
        "ghp_16C7e42F292c6912E7710c838347Ae178B4a": True,
        "dGhpc0lzQVNlY3JldEtleTEyMzQ1Njc4OTA": True,
        "configuration_manager_factory": False,
        "getElementsByClassName": False,
        "------------------------------": False,
        "internationalisation": False,
    }
    table = spark.createDataFrame([(i, f"see {s} there") for i, s in enumerate(strings)], "doc_id long, text string")
    found = {r.doc_id: r.spans for r in secrets.find_secrets(table, model).collect()}
    assert {s: bool(found[i]) for i, s in enumerate(strings)} == strings


# SimHash


def roots(n, links):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]


def near(values, distance=2):
    values = np.array(values, np.uint64)
    for a in range(len(values)):
        for b in np.flatnonzero(np.bitwise_count(values ^ values[a]) <= distance):
            yield a, int(b)


def test_simhash(spark, texts):
    import xxhash

    found = rows(spark, "op3_simhash_near_dedup")
    ids = sorted(texts)
    prints = []
    for doc in ids:
        own = texts[doc].encode().lower().split()
        grams = [b" ".join(own[i : i + 3]) for i in range(max(1, len(own) - 2))] if own else []
        hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
        prints.append(sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)))
        assert found[doc].fingerprint == f"{prints[-1]:016x}"
    assert [found[d].component_id for d in ids] == [ids[r] for r in roots(len(ids), near(prints))]


@pytest.mark.parametrize("hot", [64, 8, 10**9])
def test_simhash_crowds(spark, hot):
    source = np.random.default_rng(0)
    values = set()
    for base in source.integers(0, 2**63, 4, dtype=np.uint64):
        for _ in range(250):
            flips = source.integers(0, 64, source.integers(0, 6))
            values.add(int(base) ^ int(np.bitwise_xor.reduce(np.uint64(1) << flips.astype(np.uint64), initial=np.uint64(0))))
    values = sorted(values)
    signed = [v - (v >> 63 << 64) for v in values]
    prints = materialize(spark.createDataFrame([(v,) for v in signed], "print long"), "prints")
    root = {r.node: r.root for r in components.components(simhash.links(prints, 2, hot)).collect()}
    expected = roots(len(values), near(values))
    pairs = {(root.get(v, v), e) for v, e in zip(signed, expected)}
    assert len(pairs) == len({a for a, _ in pairs}) == len({b for _, b in pairs})


def test_threshold_allocation():
    source = random.Random(3)
    for m in (2, 3, 4):
        costs = [[source.random() for _ in range(4)] for _ in range(m)]
        every = [[]]
        for _ in range(m):
            every = [[*e, t] for e in every for t in range(-1, 3)]
        for total in (2 - m + 1, 1 - m + 1):
            best = min(sum(c[t + 1] for c, t in zip(costs, e)) for e in every if sum(e) == total)
            cost, chosen = simhash.dealt_thresholds(costs, total)
            assert cost == pytest.approx(best) and sum(chosen) == total


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(300)] + [(1000, 1001 + i) for i in range(200)] + [(5, 5), (7, 3)]
    found = {r.node: r.root for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert len(found) == 301 + 201 and len({found[i] for i in range(301)}) == 1 and len(set(found.values())) == 2


# tokens


TRICKY = [
    "", "   ", " a", "\n\na b", "don't he'll we've 'rx 'vx 'lx 'so ''s !'s \n's  's 're'", "'r", "x'l", "a\t b", "<|endoftext|>x<|endoftext|>",
    "<|endoftext", "\x00\x1c\x1f a\x85b　c", "Ⅷ½²3", "日本語 テキスト", "\U0010ffff a", "a'", "1'2's", "'ll'll'l", "İ ẞ ǅ ΑΣ ſs", "é é", "a" * 5000,
]
ALPHABET = list("'strvemldSTREVMLD  \n\taZ1!é。_É½")


def test_token_counts_equal_the_library():
    library, own = Tokenizer.from_file(BYTES), tokens.Counter(BYTES, ("<|endoftext|>",))
    cases = TRICKY + random_texts(1, 4000, ALPHABET) + [f"a{chr(c)}1{chr(c)} {chr(c)}!" for c in range(0x3100)]
    assert own.counts(cases).tolist() == [len(e.ids) for e in library.encode_batch(cases, add_special_tokens=False)]


def test_token_counts_over_chunks():
    library, own = Tokenizer.from_file(BYTES), tokens.Counter(BYTES, ("<|endoftext|>",))
    source = random.Random(4)
    cases = ["".join(source.choices(ALPHABET, k=tokens.CHUNK * source.randrange(1, 5) + source.randrange(-1, 2))) for _ in range(200)]
    assert own.counts(cases).tolist() == [len(e.ids) for e in library.encode_batch(cases, add_special_tokens=False)]


def test_token_count_query(spark, texts):
    library = Tokenizer.from_file(BYTES)
    for doc, r in rows(spark, "op4_token_counts").items():
        n = len(library.encode(texts[doc], add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(texts[doc].encode()), n, n > 512)


def test_pairs_fit_by_definition():
    model = transducer.load(WORDS)
    source = random.Random(5)
    names = list(model.ids)
    for a, b in zip(source.choices(names, k=4000), source.choices(names, k=4000)):
        if not any(ord(c) >= transducer.END for c in a):
            assert model.fits(a, b) == (model.merged(a + b) == [a, b])


def test_transducer_starts_anew():
    small = transducer.Transducer(transducer.load(BYTES).ids, list(transducer.load(BYTES).rank), max_states=50)
    for word in (" international", "thhatiesting", "aaaaaaaaaa") * 3:
        assert small.count(word) == len(small.merged(word)) == len(small.encode(word))


# benchmark decontamination


def test_winnowing_keeps_one_of_every_span():
    source = np.random.default_rng(1)
    for high in (3, 1000):
        hashes = source.integers(0, high, 500).astype(np.uint64)
        kept = decontaminate.kept(hashes, 7)
        expected = {i for j in range(494) for i in range(j, j + 7) if hashes[i] == hashes[j : j + 7].min()}
        assert set(kept.tolist()) == expected


@pytest.mark.parametrize("block_bytes", [1 << 25, 300])
def test_contamination(spark, block_bytes):
    let_workers_import(spark)
    source = random.Random(6)
    item = [" ".join(source.choices("abcdefg", k=source.choice([1, 3, 12, 13, 14, 40]))) for _ in range(30)]
    docs = []
    for i in range(60):
        own = source.choices("abcdefgxyz", k=source.randrange(80))
        at = source.randrange(len(own) + 1)
        docs.append((i, " ".join(own[:at] + source.choice(item).split()[source.randrange(3) :] + own[at:])))
    table = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame(list(enumerate(item)), "item_id long, text string")
    for r in decontaminate.contamination(table, bench, block_bytes=block_bytes).collect():
        own = words(dict(docs)[r.doc_id])
        hit, found = set(), set()
        for number, text in enumerate(item):
            other = words(text)
            n = min(13, len(other))
            spans = {tuple(other[i : i + n]) for i in range(len(other) - n + 1)}
            for i in range(len(own) - n + 1):
                if tuple(own[i : i + n]) in spans:
                    hit |= set(range(i, i + n))
                    found.add(str(number))
        assert (r.n_words, r.n_hit, r.items) == (len(own), len(hit), sorted(found))
        assert {w for a, b in r.hit_spans for w in range(a, b)} == hit


def test_decontamination_arrays_take_little_room(spark, monkeypatch):
    vocabulary = [f"w{i}" for i in range(3000)]
    source = random.Random(3)
    texts = [" ".join(source.choices(vocabulary, k=800)) for _ in range(1000)]  # 5 MB in one batch
    scans = []
    docs = spark.createDataFrame([(0, "a")], "doc_id long, text string")
    run = type(docs).mapInArrow
    monkeypatch.setattr(type(docs), "mapInArrow", lambda df, scan, schema: scans.append(scan) or run(df, scan, schema))
    decontaminate.contamination(docs, spark.createDataFrame([("x", texts[7])], "item_id string, text string"))
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array([0] * len(texts)), pa.array(texts)], names=["id", "row", "text"])
    shared_texts._known.clear()
    tracemalloc.start()
    try:
        hits = sum(sum(map(bool, found["items"].to_pylist())) for found in scans[0]([batch]))
        most = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert hits == 1 and most < 24e6
    assert sum(p.nbytes for p in shared_texts._known.values()) < 8e6  # held by an idle worker


def test_span_hashes_follow_their_definition():
    for n in (1, 2, 3, 1000, 100):
        data = np.random.default_rng(n).integers(0, 256, n).astype(np.uint8)
        starts = np.arange(n)
        ends = np.minimum(starts + 5, n)
        base = int(shared_texts._BASE)
        plain = [sum((int(c) + 1) * pow(base, i, 1 << 64) for i, c in enumerate(data[a:b])) % (1 << 64) for a, b in zip(starts, ends)]
        assert (shared_texts.span_hashes(data, starts, ends) == shared_texts.mixed(np.array(plain, np.uint64))).all()


# language


def test_forward_sums_all_segmentations():
    pieces = language.vocabulary(PIECES)
    names = {n: i for i, n in enumerate(pieces.names, 1)}
    chance = np.random.default_rng(2).random((pieces.size, 2))

    def total(word, k):
        sums = [1.0] + [0.0] * len(word)
        for j in range(1, len(word) + 1):
            for i in range(max(0, j - language.LONGEST), j):
                piece = names.get(word[i:j], 0 if j - i == 1 else None)
                sums[j] += sums[i] * chance[piece, k] if piece is not None else 0.0
        return sums[-1]

    own = ["▁the", "▁internationalen", "▁日x", "▁a"]
    froms, tos, piece, first = pieces.arcs(own)
    nodes = int(first[-1]) + len(own[-1]) + 1
    last = np.append(first[1:] - 1, nodes - 1)
    sums = language.forward(froms, tos, chance[piece], first, nodes)
    back = language.backward(froms, tos, chance[piece], last, nodes)
    for i, word in enumerate(own):
        for k in (0, 1):
            assert sums[last[i], k] == pytest.approx(total(word, k)) == pytest.approx(back[first[i], k])


def test_language_accuracy(spark):
    found = rows(spark, "op6_language_id")
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()}
    held = [r for r in found.values() if r.held_out]
    assert {r.doc_id for r in held} == {d for d in found if zlib.crc32(str(d).encode()) % 4 == 2}
    assert sum(r.lang_pred == lang[r.doc_id] for r in held) >= 0.97 * len(held)


def test_language_of_few_texts_is_learned(spark):
    let_workers_import(spark)
    docs = [(i, "the house is here", "en") for i in range(900)] + [(i, "das haus ist hier", "de") for i in range(900, 903)]
    model = language.train(spark.createDataFrame(docs, "id long, text string, lang string"), PIECES, rows=10, rounds=1)
    assert model.languages == ["de", "en"] and model.prior.tolist() == [3 / 903, 900 / 903]


# toxicity


def test_toxicity_accuracy(spark):
    folder = SF_DIR.replace("sf0.001", "sf0.01")
    found = {r.doc_id: r for r in GOOD["op7_toxicity"](spark, folder).collect()}
    label = {r.doc_id: r.toxic for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    held = [r for r in found.values() if r.held_out and r.doc_id in label]
    assert {r.doc_id for r in found.values() if r.held_out} == {d for d in found if zlib.crc32(str(d).encode()) % 5 == 0}
    assert sum(r.predicted == label[r.doc_id] for r in held) >= 0.9 * len(held)


def test_toxicity_of_words_told_apart_by_long_ngrams(spark):
    let_workers_import(spark)
    source, docs = random.Random(5), []
    for doc in range(400):
        own = ["réeumé", "paréeuxal", *(["réeuxal"] if doc % 2 else []), *source.choices(["de", "la", "que", "pour"], k=8)]
        source.shuffle(own)
        docs.append((doc, " ".join(own)))
    label = spark.createDataFrame([(doc, doc % 2) for doc, _ in docs], "doc_id long, toxic int")
    found = toxicity.toxicity(spark.createDataFrame(docs, "doc_id long, text string"), label).where("held_out").collect()
    assert len(found) > 50 and all(r.predicted == r.doc_id % 2 for r in found)


def test_toxicity_training_vectors_take_one_python_step(spark, texts, monkeypatch):
    own, fitted = list(texts.items())[:120], []

    class Fit(toxicity.LogisticRegression):
        def fit(self, points):
            fitted.append(points)
            return super().fit(points)

    monkeypatch.setattr(toxicity, "LogisticRegression", Fit)
    labelled = [(doc, text or "", i % 3 == 0) for i, (doc, text) in enumerate([*own, (-1, "")])]
    labelled = [(doc, text + " réeuxal mañosix" * toxic, int(toxic)) for doc, text, toxic in labelled]
    stored = materialize(spark.createDataFrame(labelled, "id long, text string, label int"), "labelled")
    model = toxicity.train(stored)
    plan = fitted[0]._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall("MapInArrow|MapInPandas|EvalPython", plan)) == 1  # each more is one more worker to a task

    points = fitted[0].collect()
    held = [[(r.label, i) for i in r.features.indices.tolist()] for r in points]
    row, number = model.present([text for _, text, _ in labelled])
    assert sorted(held) == sorted([(float(labelled[i][2]), int(k)) for k in number[row == i]] for i in range(len(labelled)))
    assert {len(r.features) for r in points} == {len(model.weights)} and any(held)
    counts = Counter(pair for own in held for pair in own)
    all_of = [sum(counts[label, i] + 1 for i in range(1, len(model.weights))) for label in (0.0, 1.0)]
    for r in points:
        ratios = [np.log((counts[1.0, i] + 1) / all_of[1]) - np.log((counts[0.0, i] + 1) / all_of[0]) for i in r.features.indices.tolist()]
        np.testing.assert_allclose(r.features.values, ratios, rtol=1e-9, atol=1e-12)


def test_toxicity_ngrams_over_blocks(monkeypatch):
    texts = ["", "Ab,c  d\n", "абвгдежзик", "x" * 30, "один два, три"]

    def coded(text):
        return re.sub(r"\s+", " ", re.sub(r"(?<=\w)(?=[^\w\s])|(?<=[^\w\s])(?=\w)", " ", f" {text.lower()} "))

    for block in (1, 3, 1 << 19):
        monkeypatch.setattr(toxicity, "BLOCK", block)
        row, _ = toxicity.short_present(texts)
        grams = [{c[i : i + k] for k in toxicity.SHORT for i in range(len(c) - k + 1)} for c in map(coded, texts)]
        assert np.bincount(row, minlength=len(texts)).tolist() == list(map(len, grams))
        _, n = toxicity.long_counts(texts)
        held = Counter(g for c in map(coded, texts) for g in {c[i : i + k] for k in toxicity.LONG for i in range(len(c) - k + 1)})
        assert sorted(n.tolist()) == sorted(held.values())


def test_toxicity_scoring_hashes_a_character_once(monkeypatch):
    """Features of both lengths in one pass, and the same ones in blocks of any size, however few keys wait."""
    texts = ["", "Ab,c  d\n", "абвгдежзик " * 3, "x" * 30, "один два, три", "c  d, один два"]
    hashed, hashes = [], toxicity._hashed
    monkeypatch.setattr(toxicity, "_hashed", lambda codes, *rest: hashed.append(len(codes)) or hashes(codes, *rest))
    row, short = toxicity.short_present(texts)
    long, _ = toxicity.long_counts(texts)
    table = np.zeros(1 << toxicity.HASH_BITS, np.uint16)
    chosen = np.unique(short)[::3]
    table[chosen] = np.arange(1, len(chosen) + 1)
    every = long[::2]
    model = toxicity.Model(table, np.ones(len(chosen) + len(every) + 1), 0.0, every, np.arange(len(every)) + len(chosen) + 1)
    least = {(r, n) for r, n in zip(row.tolist(), table[short].tolist()) if n}
    for r, text in enumerate(texts):
        least |= {(r, len(chosen) + 1 + int(i)) for i in np.flatnonzero(np.isin(every, toxicity.long_counts([text])[0]))}
    hashed.clear()
    for block, waiting in ((1 << 15, 1 << 20), (3, 1 << 20), (1 << 15, 2), (1, 1)):
        monkeypatch.setattr(toxicity, "BLOCK", block)
        monkeypatch.setattr(toxicity, "WAITING", waiting, raising=False)
        row, number = model.present(texts)
        assert list(zip(row.tolist(), number.tolist())) == sorted(least)
        if block == 1 << 15:
            assert len(hashed) == 1
        hashed.clear()


def test_toxicity_ngrams_cost_a_few_sorts():
    source = random.Random(3)
    texts = [" ".join("".join(source.choices("abcdefghij", k=source.randint(2, 9))) for _ in range(300)) for _ in range(200)]
    keys = np.random.default_rng(0).integers(0, 1 << 62, 4 * sum(map(len, texts)))
    toxicity.short_present(texts[:1])

    def least(work):
        took = []
        for _ in range(3):
            begun = time.process_time()
            work()
            took.append(time.process_time() - begun)
        return min(took)

    assert least(lambda: toxicity.short_present(texts)) < 20 * least(lambda: np.sort(keys))


# cross-entropy difference


@pytest.mark.parametrize("size", [8, 1 << 20])
def test_cross_entropy(spark, size, monkeypatch):
    """Against both models by definition; with slices of a text or two, and of all."""
    monkeypatch.setattr(cross_entropy, "_SLICE", size)
    let_workers_import(spark)
    docs = [(1, "abcab a"), (2, None), (3, ""), (4, "zabc\U0001f600"), (5, "abcab a")]
    table = spark.createDataFrame(docs, "doc_id long, text string")
    label = spark.createDataFrame([(1, 1), (4, 0), (5, None)], "doc_id long, quality int")
    found = {r.doc_id: r for r in cross_entropy.cross_entropy_difference(table, label).collect()}

    def padded(text):
        return "￾" * 3 + "".join(c if ord(c) < 0x10000 else "￿" for c in text or "")

    def model(texts):
        n = Counter(t[i - 3 : i + 1] for t in map(padded, texts) for i in range(3, len(t)))

        def chance(gram, k):
            if k == 1:
                return (sum(v for g, v in n.items() if g[-1] == gram[-1]) + 1) / (sum(n.values()) + 65536)
            seen, head = (sum(v for g, v in n.items() if g[-k:end] == gram[-k:end]) for end in (None, -1))
            return (seen + 5 * chance(gram, k - 1)) / (head + 5)

        return chance

    for name, chance in (("background_loss", model([t for _, t in docs])), ("target_loss", model(["abcab a"]))):
        for doc, text in docs:
            own = padded(text)
            each = [-log2(chance(own[i - 3 : i + 1], 4)) for i in range(3, len(own))]
            assert found[doc][name] == (pytest.approx(sum(each) / len(each)) if each else None)


def test_good_documents_score_higher(spark):
    score = {d: r.score for d, r in rows(spark, "op8_lm_scoring").items()}
    labels = spark.read.parquet(f"{SF_DIR}/labels.parquet").collect()
    good, bad = (np.median([score[r.doc_id] for r in labels if r.quality == q]) for q in (1, 0))
    assert good > bad + 0.5


# packing


def test_word_encoder_equals_the_library():
    library, own = Tokenizer.from_file(WORDS), packing.WordEncoder(WORDS)
    cases = TRICKY + random_texts(7, 4000, ALPHABET) + [f"a{chr(c)}1{chr(c)} {chr(c)}!" for c in range(0x300)]
    assert [np.frombuffer(b, "<u4").tolist() for b in own.ids(cases)] == [e.ids for e in library.encode_batch(cases, add_special_tokens=False)]


def test_packing(spark, texts):
    library = Tokenizer.from_file(WORDS)
    found = GOOD["op9_best_fit_packing"](spark, SF_DIR).collect()
    by = {}
    for r in found:
        by.setdefault(r.doc_id, []).append(r)
    for doc, text in texts.items():
        ids = [*library.encode(text, add_special_tokens=False).ids, 0]
        own = sorted(by[doc], key=lambda r: r.piece)
        assert [r.start for r in own] == list(range(0, len(ids), 2048)) and sum(r.length for r in own) == len(ids)
        for r in own:
            assert r.ids_crc32 == zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes())
    bins = {}
    for r in found:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in bins.values():
        ends = 0
        for offset, length in sorted(parts):
            assert offset == ends
            ends += length
        assert ends <= 2048
    assert len(bins) <= 1.02 * sum(r.length for r in found) / 2048 + 1


@pytest.mark.parametrize("select", ["dot", "norm"])
def test_packing_under_every_capacity(select):
    lengths = np.random.default_rng(8).integers(1, 900, 500)
    capacity = (1000.0, 3.0, 700_000.0)
    bins, offsets = packing.best_fit(lengths, capacity, (1.0, 0.5, 0.5), select)
    for b in range(bins.max() + 1):
        own = lengths[bins == b]
        assert own.sum() <= 1000 and len(own) <= 3 and ((own**2).sum() <= 700_000 or len(own) == 1)
        assert sorted(offsets[bins == b].tolist()) == np.concatenate([[0], np.cumsum(own[np.argsort(offsets[bins == b])])[:-1]]).tolist()


def test_weights_take_part_in_the_query(spark, texts):
    """Documents and attention cost weigh in the selection: without them other rows come out."""
    let_workers_import(spark)
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    found = {(r.doc_id, r.piece): (r.sequence_id, r.offset) for r in GOOD["op9_best_fit_packing"](spark, SF_DIR).collect()}
    stored = materialize(packing.pieces(docs, WORDS).coalesce(1))
    own, alone = (
        {(r.doc_id, r.piece): (r.sequence_id, r.offset) for r in packing.packed(stored, weights=w).collect()} for w in ((1.0, 1.0, 1.0), (1.0, 0.0, 0.0))
    )
    assert own.keys() == found.keys() and own != alone


def test_a_slice_of_texts_is_cut_like_each_text():
    """Quotes, numbers, signs and empty texts at the borders of texts that are cut together."""
    library, own = Tokenizer.from_file(WORDS), packing.WordEncoder(WORDS)
    cases = ["'s", "a'", "s 't", "", "12", "3a", "..", "!'re", "'", "ll", "É'VE", " ", "\n", "x\n'd y", "don't", "''s"] * 3
    for turn in range(2):
        assert [np.frombuffer(b, "<u4").tolist() for b in own.ids(cases)] == [e.ids for e in library.encode_batch(cases, add_special_tokens=False)]
    kept = packing.KEPT_WORDS
    packing.KEPT_WORDS = 5
    try:
        small = packing.WordEncoder(WORDS)
        assert [small.ids(cases) for _ in range(3)] == [own.ids(cases)] * 3 and len(small.known) <= 2 * len(cases)
    finally:
        packing.KEPT_WORDS = kept


def test_repeated_pieces_spread_over_groups(spark):
    let_workers_import(spark)
    same = spark.createDataFrame([(None, 0, 0, 10, 7)] * 3000, "doc_id long, piece int, start long, length long, ids_crc32 long")
    found = packing.packed(same, length=100, group_pieces=100).collect()
    assert len(found) == 3000 and found[0].__fields__ == [*same.columns, "sequence_id", "offset"]
    assert max(Counter(r.sequence_id // 2 % 30 for r in found).values()) < 300


def test_pieces_do_not_depend_on_the_slices(spark, texts):
    docs = spark.createDataFrame(list(texts.items())[:60], "doc_id long, text string").coalesce(1)
    path = public_tokenizers.path("word_bpe_49k.json")
    few, usual = (sorted(map(tuple, packing.pieces(docs, path, **more).collect())) for more in ({"slice_bytes": 3000}, {}))
    assert few == usual and len(few) >= 60


# fingerprints


def test_differences_are_recovered():
    source = random.Random(9)
    old = [np.array(source.sample(range(1 << 40), k), np.uint64) for k in (0, 1, 5, 50, 700, 20)]
    new = [np.concatenate([o[: len(o) // 2], np.array(source.sample(range(1 << 40), k), np.uint64)]) for o, k in zip(old, (0, 3, 5, 50, 10, 2000))]
    for a, b, (gone, added) in zip(old, new, fingerprints.differences(old, new)):
        a, b = set(a.tolist()), set(b.tolist())
        assert set(gone.tolist()) == a - b and set(added.tolist()) == b - a


@pytest.mark.parametrize("bucket_bytes", [fingerprints.BUCKET_BYTES, 20_000])
def test_edited_fingerprints(spark, texts, bucket_bytes, monkeypatch):
    monkeypatch.setattr(fingerprints.next_documents, "__defaults__", ("doc_id", "text", bucket_bytes))
    found = rows(spark, "op10_document_fingerprints")
    ids = sorted(texts, reverse=True)
    for doc, after in zip(ids, ids[1:] + ids[:1]):
        text, follower, r = texts[doc], texts[after], found[doc]
        cut = len(text) // 3
        edited = text[: len(text) - cut] + follower[:cut]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        own, one, two = (set(fingerprints.paragraphs(t).tolist()) for t in (text, edited, follower))
        assert r.near_edited == pytest.approx(len(own & one) / len(own | one)) and r.near_next == pytest.approx(len(own & two) / len(own | two))
    assert len({r.fingerprint for r in found.values()}) == len(set(texts.values()))
