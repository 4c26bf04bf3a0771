"""MinHash groups, source divergence and centroid clusters against brute force, and their edges."""

import hashlib
import random
import re
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
from edges import LONG, TEXTS, documents

from tabscope.llm import centroids, divergence, minhash
from tabscope.session import let_workers_import

LOWER = {c: c + 32 for c in range(65, 91)}


def shingles(text):
    own = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return frozenset(tuple(own[i : i + 3]) for i in range(max(1, len(own) - 2))) if own else frozenset()


def expected_groups(rows, percent=85):
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))
    for a, b in combinations(range(len(rows)), 2):
        if sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
            low, high = sorted((root[a], root[b]))
            root = [low if r == high else r for r in root]
    least = defaultdict(list)
    for (doc, _), r in zip(rows, root):
        least[r].append(doc)
    return [(doc, len(s), min((d for d in least[r] if d is not None), default=None)) for (doc, _), s, r in zip(rows, sets, root)]


def found_groups(spark, rows, **options):
    table = spark.createDataFrame(rows, "doc_id long, text string")
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in minhash.near_duplicates(table, **options).collect()), key=repr)


# MinHash


def family(source, n, words, edits):
    base = [source.choice(words) for _ in range(150)]
    out = [" ".join(base)]
    for _ in range(n):
        own = list(base)
        for _ in range(source.randrange(edits)):
            own[source.randrange(len(own))] = "w%d" % source.randrange(10**6)
        out.append(" ".join(own))
    return out


def test_minhash_equals_brute_force(spark):
    let_workers_import(spark)
    source = random.Random(5)
    words = ["v%d" % i for i in range(400)]
    texts = family(source, 150, words, 16) + family(source, 40, words, 9) + family(source, 12, words[:20], 6)
    passage = " ".join(source.choices(words, k=60))
    texts += [passage + " " + " ".join(source.choices(words, k=source.randrange(1, 60))) for _ in range(60)]
    texts += [" ".join(source.choices(["a", "b"], k=source.randrange(6))) for _ in range(60)] + texts[:20]
    source.shuffle(texts)
    rows = list(enumerate(texts))
    assert found_groups(spark, rows) == sorted(expected_groups(rows), key=repr)


def test_large_buckets_by_differences(spark, monkeypatch):
    """Buckets beyond two sets go the way of large ones; chains that no star covers are still found."""
    let_workers_import(spark)
    source = random.Random(6)
    base, texts = ["x%d" % i for i in range(120)], []
    for i in range(40):  # each differs a little from the one before, much from the first
        base[source.randrange(120)] = "y%d" % i
        texts.append(" ".join(base))
    texts += family(source, 80, ["z%d" % i for i in range(300)], 14)
    rows = list(enumerate(texts))
    listed = minhash.linked_sets
    monkeypatch.setattr(minhash, "linked_sets", lambda *a: listed(*a, small=2))
    assert found_groups(spark, rows) == sorted(expected_groups(rows), key=repr)


def test_shingle_sets_at_row_borders():
    texts = ["a b c", "d", "", None, " e  f ", "A B C", "a b c a b c", "é\tß\x0bx y", "x\x1cy"]
    values, begins = minhash.shingle_sets(pa.array(texts), 3)
    sets = [frozenset(values[a:b].tolist()) for a, b in zip(begins, begins[1:])]
    assert [len(s) for s in sets] == [len(shingles(t)) for t in texts]
    assert sets[0] == sets[5] and sets[0] < sets[6] and len(set(sets)) == 7


def test_chance_of_meeting():
    """Sets at the threshold meet as often as the bands promise."""
    source = np.random.default_rng(3)
    values = np.sort(source.integers(0, 2**63, 4000, dtype=np.uint64))
    met = 0
    for turn in range(200):
        own = source.permutation(values)
        a, b = np.sort(own[:1850]), np.sort(own[150:2000])  # 1700 of 2000
        one, two = (minhash.bands(s, np.array([0]), 8, 2)[0] for s in (a, b))
        met += bool((one[:8] == two[:8]).any() and (one[8:] == two[8:]).any())
    assert met >= 199


def test_minhash_edges(spark):
    rows = minhash.near_duplicates(documents(spark)).collect()
    assert sorted(str(r.doc_id) for r in rows) == sorted(str(i) for i, _ in TEXTS)
    assert sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in rows if r.doc_id in (1, 2, 3)) == [(i, 0, i, True) for i in (1, 2, 3)]
    assert sorted((r.doc_id, r.component_id) for r in rows if r.doc_id in (8, 9)) == [(8, 8), (9, 8), (9, 8), (9, 9)]
    assert [(r.n_shingles, r.component_id, r.kept) for r in rows if r.doc_id is None] == [(3, None, True)]
    assert [r.n_shingles for r in rows if r.doc_id == 5] == [len(shingles(LONG))]
    assert minhash.near_duplicates(documents(spark, [])).count() == 0
    same = minhash.near_duplicates(documents(spark, [(None, "p q r s"), (7, "p q r s"), (None, None)])).collect()
    found = sorted((str(r.doc_id), str(r.component_id), r.kept) for r in same)
    assert found == [("7", "7", True), ("None", "7", False), ("None", "None", True)]


# source divergence


def expected_audit(rows, min_docs=3, top=200):
    rows = [tuple(v or "" for v in r) for r in rows]
    occur, held = Counter(), Counter()
    for text, lang, source in rows:
        own = re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", text)
        own = [w.translate(LOWER) for w in own]
        occur.update((lang, source, w) for w in own)
        held.update((lang, w) for w in set(own))
    out = set()
    for lang in {r[1] for r in rows}:
        kept = sorted(w for (l, w), n in held.items() if l == lang and n >= min_docs)
        sources = sorted({r[2] for r in rows if r[1] == lang})
        total = {s: sum(occur[lang, s, w] for w in kept) for s in sources}
        share = {s: {w: 1 + 10**9 * (occur[lang, s, w] + 1) // (total[s] + len(kept)) for w in kept} for s in sources}
        own = {w: 1 + 10**9 * (sum(occur[lang, s, w] for s in sources) + 1) // (sum(total.values()) + len(kept)) for w in kept}
        for s in sources:
            pairs = [(t, sum((share[s][w] - share[t][w]) ** 2 // share[t][w] for w in kept)) for t in sources if t != s]
            over = [(w, (share[s][w] - own[w]) ** 2 // own[w]) for w in kept if occur[lang, s, w] and share[s][w] > own[w]]
            for part, items, limit in (("pair", pairs, None), ("term", over, top)):
                ordered = sorted(items, key=lambda x: (-x[1], x[0].encode()))[:limit]
                out |= {(lang, s, part, item, value, rank) for rank, (item, value) in enumerate(ordered, 1)}
    return out


def found_audit(spark, rows, **options):
    table = spark.createDataFrame(rows, "text string, lang string, source string")
    found = [tuple(r) for r in divergence.divergence_audit(table, **options).collect()]
    assert len(found) == len(set(found))
    return set(found)


def test_divergence_equals_brute_force(spark):
    let_workers_import(spark)
    source = random.Random(7)
    words = ["Ab", "ab", "é", "日本", "x1y", "the", "q", "Zz"] + ["t%s" % chr(97 + i % 26) * (1 + i // 26) for i in range(60)]
    rows = []
    for _ in range(400):
        weights = [1 / (1 + i) for i in range(len(words))]
        text = " ".join(source.choices(words, weights, k=source.randrange(30)))
        rows.append((text, source.choice(["en", "fr", "", None]), source.choice(["s%d" % i for i in range(7)] + [None])))
    rows += [(None, "xx", "a"), ("only here", "xx", "b"), ("", "yy", "lone"), ("once", "xx", "a")]
    assert found_audit(spark, rows) == expected_audit(rows)
    assert found_audit(spark, rows, min_docs=1, top=3) == expected_audit(rows, 1, 3)


def test_pattern_tree_shares_paths():
    """Equal beginnings are one path with summed multiplicity; each node meets each ancestor once."""
    rows = [([0, 1], [5, 7], 3), ([0, 1, 2], [5, 7, 9], 2), ([0, 1, 2], [5, 8, 9], 1), ([1, 2], [7, 9], 4)]
    offsets = np.cumsum([0] + [len(r[0]) for r in rows])
    flat = [np.array([x for r in rows for x in r[i]], np.int64) for i in (0, 1)]
    tree = divergence.PatternTree(offsets, *flat, np.full(len(flat[0]), 2), np.array([r[2] for r in rows]))
    nodes = sorted(zip(tree.source.tolist(), tree.p.tolist(), tree.times.tolist()))
    assert nodes == [(0, 5, 6), (1, 7, 4), (1, 7, 5), (1, 8, 1), (2, 9, 1), (2, 9, 2), (2, 9, 4)]
    keys, sums = tree.corrections(3)
    f = lambda p, q: (p - q) ** 2 // q
    plain = Counter()
    for sources, ps, times in rows:
        for (s, p), (t, q) in combinations(list(zip(sources, ps)), 2):
            for (a, x), (b, y) in (((s, p), (t, q)), ((t, q), (s, p))):
                plain[a * 3 + b] += times * (f(x, y) - f(x, 2) - f(2, y) + f(2, 2))
    assert dict(zip(keys.tolist(), sums.tolist())) == dict(plain)


def test_divergence_edges(spark):
    rows = [(t, "en" if i else None, "s") for i, t in TEXTS]
    found = {tuple(r) for r in divergence.divergence_audit(documents(spark)).collect()}
    assert found == expected_audit(rows)
    assert divergence.divergence_audit(documents(spark, [])).count() == 0


# centroids


def expected_clusters(rows, k=40, rounds=5, size=64):
    kept = [(i, np.floor(256 * np.array(v, float)).astype(np.int64)) for i, v in rows if v and len(v) == size and all(x is not None and np.isfinite(x) for x in v)]
    digest = lambda r: hashlib.sha256(f"2:{r[0]}".encode()).hexdigest()
    centres = [v for _, v in sorted(kept, key=digest)[:k]]
    vectors = np.array([v for _, v in kept])

    def assigned():
        far = ((vectors[:, None] - np.array(centres)[None]) ** 2).sum(2)
        return far.argmin(1), far.min(1)

    for _ in range(rounds):
        own, _ = assigned()
        centres = [vectors[own == c].sum(0) // (own == c).sum() if (own == c).any() else centres[c] for c in range(len(centres))]
    own, far = assigned()
    names = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in centres]
    return sorted((i, int(c), int(d), int(far[own == c].sum()), int(far.sum()), names[c]) for (i, _), c, d in zip(kept, own, far))


def clusters(spark, rows, kind="float", **options):
    table = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>, label int, id long, v int, cluster int")
    return sorted(tuple(r) for r in centroids.cluster_vectors(table, **options).collect())


@pytest.mark.parametrize("kind", ["float", "double"])
def test_clusters_equal_brute_force(spark, kind):
    let_workers_import(spark)
    source = np.random.default_rng(4)
    middles = source.normal(size=(9, 64))
    vectors = (middles[source.integers(0, 9, 700)] + source.normal(scale=0.4, size=(700, 64))).astype(np.float32)
    vectors[::7] = vectors[0]  # a very common vector, and ties
    rows = [(i, [float(x) for x in v], 1, 2, 3, 4) for i, v in enumerate(vectors)]
    plain = [r[:2] for r in rows]
    odd = [(9000, None), (9001, []), (9002, [1.0] * 63), (9003, [1.0] * 63 + [float("nan")]), (9004, [float("-inf")] + [0.0] * 63), (9005, [None] + [0.0] * 63)]
    rows += [(*r, 1, 2, 3, 4) for r in odd]
    assert clusters(spark, rows, kind) == expected_clusters(plain)
    few = [(i, v) for i, v in plain[:12]]
    assert clusters(spark, [(*r, 1, 2, 3, 4) for r in few], kind) == expected_clusters(few)


def test_search_passes_over_centroids():
    source = np.random.default_rng(8)
    vectors = source.integers(-300, 300, (500, 64)) + source.integers(-2000, 2000, (500, 1))
    centres = source.integers(-300, 300, (40, 64)) + source.integers(-2000, 2000, (40, 1))
    centres[7] = centres[3]  # a tie goes to the smaller number
    far = ((vectors[:, None] - centres[None]) ** 2).sum(2)
    number, best, computed = centroids.nearest(vectors, centroids.Centroids.of(centres))
    assert (number == far.argmin(1)).all() and (best == far.min(1)).all()
    assert computed < 500 * 40 / 4


def test_cluster_edges(spark):
    let_workers_import(spark)
    assert clusters(spark, []) == []
    same = [(1, [0.5] * 64, 1, 2, 3, 4)] * 3 + [(None, [0.25] * 64, 1, 2, 3, 4)]
    table = spark.createDataFrame(same, "vec_id long, embedding array<double>, label int, id long, v int, cluster int")
    found = centroids.cluster_vectors(table, k=3).collect()
    assert sorted((str(r.vec_id), r.cluster) for r in found) == [("1", 1)] * 3 + [("None", 0)]  # the first of three equal centroids is pulled away
    with pytest.raises(Exception, match="beyond"):
        clusters(spark, [(1, [1e9] * 64, 1, 2, 3, 4)], "double")
