"""Registered queries of this folder: whole tables, production parameters, digest columns."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tabscope.llm.centroids import cluster_vectors
from tabscope.llm.cross_entropy import cross_entropy_difference
from tabscope.llm.decontaminate import contamination
from tabscope.llm.divergence import divergence_audit
from tabscope.llm.fingerprints import edited_fingerprints
from tabscope.llm.language import identify
from tabscope.llm.licenses import license_scan
from tabscope.llm.minhash import near_duplicates as minhash_near_duplicates
from tabscope.llm.packing import packed, pieces
from tabscope.llm.secrets import secret_scan
from tabscope.llm.simhash import near_duplicates
from tabscope.llm.tokens import token_counts
from tabscope.llm.toxicity import toxicity
from tabscope.session import let_workers_import


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    let_workers_import(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents")).drop("detections")


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan(table(spark, sf_dir, "documents"))


def op3_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op5_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.drop("items", "hit_spans")


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cross_entropy_difference(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(pieces(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json")))


def op10_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_fingerprints(table(spark, sf_dir, "documents"))


def op11_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_near_duplicates(table(spark, sf_dir, "documents"))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence_audit(table(spark, sf_dir, "documents"))


def op13_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster_vectors(table(spark, sf_dir, "embeddings"))


OP5_SQL = r"""
WITH docs AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
items AS (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE text IS NOT NULL),
item_windows AS (
  SELECT DISTINCT item, least(len(w), 13) AS n, array_to_string(w[i : i + least(len(w), 13) - 1], ' ') AS gram
  FROM (SELECT item, w, unnest(range(1, len(w) - least(len(w), 13) + 2)) AS i FROM items WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM item_windows),
doc_windows AS (
  SELECT doc_id, i, n, array_to_string(w[i : i + n - 1], ' ') AS gram
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM docs, sizes WHERE len(w) >= n)),
hits AS (SELECT doc_id, i, n, item FROM doc_windows JOIN item_windows USING (n, gram)),
hit_words AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS k FROM hits) GROUP BY doc_id),
hit_items AS (
  SELECT doc_id, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS items_sha256
  FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, coalesce(items_sha256, sha256('')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM docs LEFT JOIN hit_words USING (doc_id) LEFT JOIN hit_items USING (doc_id)
"""

OP11_SQL = r"""
WITH RECURSIVE docs AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+') AS w FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, array_to_string(w[i : i + 2], ' ') AS gram
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS i FROM docs WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
links AS (
  SELECT a, b FROM (
    SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS shared FROM shingles x JOIN shingles y USING (gram)
    WHERE x.doc_id <> y.doc_id GROUP BY x.doc_id, y.doc_id)
  JOIN sizes sa ON sa.doc_id = a JOIN sizes sb ON sb.doc_id = b WHERE 100 * shared >= 85 * (sa.n + sb.n - shared)),
reached AS (
  SELECT doc_id, doc_id AS other FROM docs
  UNION
  SELECT reached.doc_id, links.b FROM reached JOIN links ON links.a = reached.other)
SELECT doc_id, CAST(coalesce(any_value(n), 0) AS BIGINT) AS n_shingles, min(other) AS component_id, doc_id = min(other) AS kept
FROM reached LEFT JOIN sizes USING (doc_id) GROUP BY doc_id
"""

OP12_SQL = r"""
WITH docs AS (
  SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
words AS (SELECT row, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM docs),
kept AS (SELECT lang, term, count(*) AS total FROM words GROUP BY lang, term HAVING count(DISTINCT row) >= 3),
langs AS (SELECT lang, count(*) AS v, sum(total) AS lang_n FROM kept GROUP BY lang),
counts AS (SELECT lang, source, term, count(*) AS n FROM words JOIN kept USING (lang, term) GROUP BY lang, source, term),
sums AS (SELECT lang, source, sum(n) AS group_n FROM counts GROUP BY lang, source),
groups AS (SELECT DISTINCT lang, source FROM docs),
cells AS (
  SELECT lang, source, term, coalesce(n, 0) AS n,
    1 + (1000000000::HUGEINT * (coalesce(n, 0) + 1)) // (coalesce(group_n, 0) + v) AS p,
    1 + (1000000000::HUGEINT * (total + 1)) // (lang_n + v) AS q
  FROM groups JOIN kept USING (lang) JOIN langs USING (lang) LEFT JOIN sums USING (lang, source) LEFT JOIN counts USING (lang, source, term)),
gaps AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
  FROM cells a JOIN cells b USING (lang, term) WHERE a.source <> b.source GROUP BY a.lang, a.source, b.source),
pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN gaps ON gaps.lang = a.lang AND gaps.source = a.source AND gaps.item = b.source),
over AS (SELECT lang, source, 'term' AS part, term AS item, (p - q) * (p - q) // q AS value FROM cells WHERE n > 0 AND p > q),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank
  FROM (SELECT * FROM pairs UNION ALL SELECT * FROM over))
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank
FROM ranked WHERE part = 'pair' OR rank <= 200
"""


def _clustering_sql(k: int = 40, rounds: int = 5, size: int = 64) -> str:
    """Plain assignment to the nearest of all centroids, round by round."""
    nearest = f"""SELECT vec_id, any_value(v) AS v, min(d * {k} + number) AS best FROM (
        SELECT vec_id, x.v, number, list_sum([(x.v[i] - c.v[i]) * (x.v[i] - c.v[i]) for i in range(1, {size + 1})]) AS d
        FROM vectors x, centroids_{{0}} c) GROUP BY vec_id"""
    moved = f"""SELECT c.number, coalesce(m.v, c.v) AS v FROM centroids_{{0}} c LEFT JOIN (
        SELECT number, list((total - ((total % held) + held) % held) // held ORDER BY i) AS v FROM (
          SELECT best % {k} AS number, i, sum(v[i]) AS total, count(*) AS held
          FROM (SELECT best, v, unnest(range(1, {size + 1})) AS i FROM nearest_{{0}}) GROUP BY ALL) GROUP BY number) m USING (number)"""
    steps = []
    for turn in range(rounds):
        steps += [f"nearest_{turn} AS MATERIALIZED ({nearest.format(turn)})", f"centroids_{turn + 1} AS MATERIALIZED ({moved.format(turn)})"]
    return f"""
WITH vectors AS MATERIALIZED (
  SELECT vec_id, [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) for x in embedding] AS v FROM embeddings
  WHERE len(embedding) = {size} AND len([x for x in embedding if x IS NOT NULL AND isfinite(x)]) = {size}),
centroids_0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY digest) - 1 AS number, v
  FROM (SELECT sha256('2:' || CAST(vec_id AS VARCHAR)) AS digest, v FROM vectors ORDER BY digest LIMIT {k})),
{", ".join(steps)},
found AS (SELECT vec_id, CAST(best % {k} AS INTEGER) AS cluster, CAST(best // {k} AS BIGINT) AS distance FROM ({nearest.format(rounds)})),
sums AS (SELECT cluster, CAST(sum(distance) AS BIGINT) AS cluster_inertia FROM found GROUP BY cluster)
SELECT vec_id, cluster, distance, cluster_inertia, (SELECT CAST(sum(distance) AS BIGINT) FROM found) AS inertia,
  sha256(array_to_string([CAST(x AS VARCHAR) for x in v], ',')) AS centroid_sha256
FROM found JOIN sums USING (cluster) JOIN centroids_{rounds} ON number = cluster
"""


OP13_SQL = _clustering_sql()

QUERIES = {
    q.__name__: q
    for q in (
        op1_license_scan,
        op2_secret_scan,
        op3_simhash_near_dedup,
        op4_token_counts,
        op5_benchmark_decontamination,
        op6_language_id,
        op7_toxicity,
        op8_lm_scoring,
        op9_best_fit_packing,
        op10_document_fingerprints,
        op11_minhash_near_dedup,
        op12_source_divergence,
        op13_centroid_clustering,
    )
}
ORACLES = {
    "op5_benchmark_decontamination": OP5_SQL,
    "op11_minhash_near_dedup": OP11_SQL,
    "op12_source_divergence": OP12_SQL,
    "op13_centroid_clustering": OP13_SQL,
}
