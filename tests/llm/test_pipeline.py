"""The corpus pipeline, stage by stage, against plain Python."""

import re

import corpus_pipeline
import numpy as np
import public_tokenizers
from conftest import SF_DIR
from tokenizers import Tokenizer

from tabscope.llm import queries, secrets, simhash
from tabscope.workspace import materialize


def words(text):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", text.translate({c: c + 32 for c in range(65, 91)}))


def contaminated(text, windows):
    own, hit = words(text), set()
    for n, spans in windows.items():
        for i in range(len(own) - n + 1):
            if tuple(own[i : i + n]) in spans:
                hit |= set(range(i, i + n))
    return bool(hit) and 20 * len(hit) >= len(own)


def test_pipeline(spark):
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "near_dedup", "decontamination", "secrets", "packing"]
    docs = queries.table(spark, SF_DIR, "documents")
    rows = {r.doc_id: r for r in docs.collect()}

    def after(name, table):
        return materialize(stages[name](spark, table, SF_DIR), name)

    toxic = {r.doc_id for r in queries.QUERIES["op7_toxicity"](spark, SF_DIR).collect() if r.predicted}
    table = after("toxicity", docs)
    left = {d: r for d, r in rows.items() if d not in toxic}
    assert {r.doc_id: r for r in table.collect()} == left

    ids = sorted(left)
    prints = np.array([simhash.fingerprint(left[d].text.encode()) for d in ids], np.uint64)
    group = list(range(len(ids)))
    for a in range(len(ids)):
        for b in np.flatnonzero(np.bitwise_count(prints ^ prints[a]) <= 2):
            low, high = sorted((group[a], group[int(b)]))
            group = [low if g == high else g for g in group]
    left = {d: left[d] for i, d in enumerate(ids) if group[i] == i}
    table = after("near_dedup", table)
    assert {r.doc_id: r for r in table.collect()} == left

    windows = {}
    for item in spark.read.parquet(f"{SF_DIR}/benchmark.parquet").collect():
        own = words(item.text)
        n = min(13, len(own))
        windows.setdefault(n, set()).update(tuple(own[i : i + n]) for i in range(len(own) - n + 1))
    left = {d: r for d, r in left.items() if not contaminated(r.text, windows)}
    table = after("decontamination", table)
    assert {r.doc_id: r for r in table.collect()} == left

    spans = {r.doc_id: r.spans for r in secrets.find_secrets(table, secrets.train(table)).collect()}
    clean = {}
    for d, r in left.items():
        text, at, out = r.text, 0, ""
        for s in spans[d]:
            if s.start >= at:
                out += text[at : s.start] + secrets.MASK
            at = max(at, s.end)
        clean[d] = out + text[at:]
    table = after("secrets", table)
    found = {r.doc_id: r for r in table.collect()}
    assert {d: r.text for d, r in found.items()} == clean
    assert all(r.n_chars == (len(r.text) if spans[d] else left[d].n_chars) for d, r in found.items())

    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    totals = {}
    packed = corpus_pipeline.run(spark, SF_DIR).collect()
    for r in packed:
        totals[r.doc_id] = totals.get(r.doc_id, 0) + r.length
    assert totals == {d: len(library.encode(t, add_special_tokens=False).ids) + 1 for d, t in clean.items()}
    bins = {}
    for r in packed:
        bins[r.sequence_id] = bins.get(r.sequence_id, 0) + r.length
    assert max(bins.values()) <= 2048 and len(bins) <= 1.05 * sum(bins.values()) / 2048 + 1
